import json

from pyspark.sql import functions as F

from kelpwork.sources import crawl, sinks
from kelpwork.streaming import incremental


def test_token_bucket():
    now = [0.0]
    b = crawl.TokenBucket(2, 1.0, clock=lambda: now[0])
    assert b.try_acquire() and b.try_acquire() and not b.try_acquire() and 0 < b.wait_time() <= 0.5
    now[0] = 0.5
    assert b.try_acquire() and not b.try_acquire()
    b.acquire(sleep=lambda s: now.__setitem__(0, now[0] + s + 1e-9))


def test_fetch_isolates_errors(spark):
    def fetch(url):
        if "bad" in url:
            raise ValueError("no")
        return url + "/", 200, "<p>x"

    rows = {r.url: r for r in crawl.fetched(spark.createDataFrame([("a",), ("bad",)], "url string"), fetch, 1000).collect()}
    assert rows["a"].status == 200 and rows["bad"].error == "ValueError: no"


def test_sitemaps(spark):
    index = "<sitemapindex><sitemap><loc> s1.xml </loc></sitemap><sitemap><loc>root.xml</loc></sitemap><sitemap></sitemap></sitemapindex>"
    one = "<urlset><URL><LOC>p1</LOC><lastmod>2024</lastmod><priority>0.5</priority></URL><url><priority>1</priority></url><url><loc>s2-sitemap</loc></url></urlset>"
    two = "<urlset><url><loc>p2</loc></url></urlset>"
    maps = spark.createDataFrame([("root.xml", index), ("s1.xml", one), ("s2-sitemap", two), ("other", "<html>")], "url string, xml string")
    assert [r.loc for r in crawl.sitemap_entries(maps).where("url = 's1.xml'").orderBy("place").collect()] == ["p1", "s2-sitemap"]
    assert {r.loc for r in crawl.deep_entries(maps, "root.xml").collect()} == {"p1", "s2-sitemap"}
    assert {r.loc for r in crawl.deep_entries(maps, "root.xml", also_named=True).collect()} == {"p1", "p2"}
    r = crawl.robots_sitemaps(spark.createDataFrame([("Sitemap: a\nsitemap:b\nSitemap: a\nAllow: /",)], "text string")).first()
    assert r.sitemaps == ["a", "b"]


def test_sitemaps_are_found_where_robots_name_none(spark):
    def probe(url):
        if url == "b/sitemap.xml":
            raise OSError("refused")
        return url, 200 if url.startswith("b/") else 404, ""

    sites = spark.createDataFrame([("a", "Sitemap: a/x.xml\nSITEMAP: a/y.xml\nSitemap: a/x.xml"), ("b", None), ("c", "Allow: /")], "origin string, text string")
    assert {r.origin: r.sitemaps for r in crawl.discovered_sitemaps(sites, probe, 1_000).collect()} == {"a": ["a/x.xml", "a/y.xml"], "b": ["b/sitemap_index.xml"], "c": []}


def test_upsert(spark):
    old = spark.createDataFrame([("u1", "h1", 1), ("u2", "h2", 2)], "url string, content_hash string, id int")
    new = spark.createDataFrame([("u1", "h1", 200, 50, 9), ("u2", "hx", 200, 50, 9), ("u3", "h3", 200, 50, 9), ("u4", "h4", 404, 50, 9), ("u5", "h5", 200, 3, 9)], "url string, content_hash string, status_code int, word_count int, id int")
    status = sinks.ingest_status(old, new)
    assert {r.url: r.ingest_status for r in status.collect()} == {"u1": "unchanged", "u2": "updated", "u3": "new", "u4": "rejected", "u5": "rejected"}
    got = {r.url: (r.content_hash, r.id) for r in sinks.upserted(old, status.drop("status_code", "word_count")).collect()}
    assert got == {"u1": ("h1", 1), "u2": ("hx", 9), "u3": ("h3", 9)}
    assert sinks.selected_pipelines(None) == ("chunk",) and sinks.selected_pipelines({"fact": True}) == ("fact",)


def test_links_patches_and_lines(spark, tmp_path):
    df = spark.createDataFrame([(1, 10, "a"), (2, None, "b"), (3, 11, "c")], "id int, link int, t string")
    gone = spark.createDataFrame([(10,)], "link int")
    assert {r.id: r.link for r in sinks.unlinked(df, gone, "link").collect()} == {1: None, 2: None, 3: 11}
    assert {r.id for r in sinks.deleted(df, gone, "link").collect()} == {2, 3}
    up = spark.createDataFrame([(1, "  new "), (2, "  ")], "id int, t string")
    assert {r.id: r.t for r in sinks.patched(df, up, "id").collect()} == {1: "new", 2: "b", 3: "c"}
    assert sinks.singleton(df.where("id = 1"), up.where("id = 1")).first().t == "new"
    lines = spark.createDataFrame([('{"a":1}',), (" ",)], "line string")
    assert sinks.write_lines(lines, str(tmp_path / "out"), files=1) == 1
    assert spark.range(1).select(sinks.quoted(F.lit("it's"))).first()[0] == "'it''s'"


def test_incremental_stream(spark, tmp_path):
    rows = [("u1", "h", "2024-01-01 00:00:00"), ("u1", "h", "2024-01-01 00:10:00"), ("u2", "h", "2024-01-01 00:20:00")]
    spark.createDataFrame(rows, "url string, content_hash string, t string").select("url", "content_hash", F.to_timestamp("t").alias("fetched_at")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("url string, content_hash string, fetched_at timestamp").parquet(str(tmp_path / "in"))
    frames = []
    incremental.run_incremental(incremental.changed_pages(stream), lambda b: b.select("url"), str(tmp_path / "out"), str(tmp_path / "cp"), frames.append).awaitTermination(120)
    assert sorted(r.url for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["u1", "u2"]
    assert frames[0].startswith("event: start") and json.loads(frames[-1].split("data: ")[1])["batch"] >= 0


def test_event_windows(spark, tmp_path):
    rows = [("2024-01-01 00:05:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 3.0), ("2024-01-01 01:05:00", "b", 5.0)]
    spark.createDataFrame(rows, "t string, event_type string, value double").select(F.to_timestamp("t").alias("ts"), "event_type", "value").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    q = incremental.windowed(stream).writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.event_type, r.n, r.mean_value) for r in spark.table("w").collect()) == [("a", 2, 2.0), ("b", 1, 5.0)]


def test_sitemaps_of_any_depth(spark):
    rows = [(f"m{i}", f"<sitemapindex><sitemap><loc>m{i + 1}</loc></sitemap></sitemapindex>") for i in range(22)] + [("m22", "<urlset><url><loc>page</loc></url></urlset>")]
    maps = spark.createDataFrame(rows, "url string, xml string").coalesce(1)
    assert [(r.loc, r.depth) for r in crawl.deep_entries(maps, "m0").collect()] == [("page", 22)]
