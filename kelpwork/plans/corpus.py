"""Queries over pages, texts, chunks, facts and tables (A to E, N), and over events (streams' batch form)."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelpwork.functions import chunking, markup
from kelpwork.functions import facts as FX
from kelpwork.functions import text as T
from kelpwork.operators import ingest
from kelpwork.operators import reporting as N
from kelpwork.plans import inputs as I
from kelpwork.plans.inputs import CHUNKS, FACTS, SUMMARIES, sql_list
from kelpwork.sources import crawl, sinks
from kelpwork.sources.tables import checkpoint_dir, table
from kelpwork.streaming import incremental

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _sitemaps(s, d):
    """A tree of sitemaps: the index of each number names a map of the document's page and the ten indexes of one digit more; the
    index 0, which is no document's, is the root."""
    doc = I.documents(s, d).select("doc_id", "url", F.date_format("updated_at", "yyyy-MM-dd").alias("day"))
    page = F.format_string("<?xml version=\"1.0\"?><urlset>\n <url>\n  <loc> %s </loc><LASTMOD>%s</LASTMOD></url><url><priority>0.5</priority></url></urlset>", "url", "day")
    pages = doc.select(F.concat(F.lit("map-"), F.col("doc_id").cast("string"), F.lit(".xml")).alias("url"), page.alias("xml"))
    numbers = doc.select("doc_id").unionByName(s.createDataFrame([(0,)], "doc_id bigint"))
    below = F.transform(F.sequence(F.when(F.col("doc_id") == 0, 1).otherwise(0), F.lit(9)), lambda k: F.format_string("<sitemap><loc>index-%d.xml</loc></sitemap>", F.col("doc_id") * 10 + k))
    index = F.concat(F.format_string("<sitemapindex><sitemap><loc>map-%d.xml</loc></sitemap>", "doc_id"), F.array_join(below, ""), F.lit("</sitemapindex>"))
    return pages.unionByName(numbers.select(F.concat(F.lit("index-"), F.col("doc_id").cast("string"), F.lit(".xml")).alias("url"), index.alias("xml")))


def _stored(url: str) -> tuple[str, int, str]:
    """Stands in for a fetch: blog pages fail, addresses lose their fragment, glossaries are gone."""
    if "/blog/" in url:
        raise TimeoutError("no answer")
    return url.split("#")[0], 404 if "/docs/" in url else 200, f"<h1>{len(url)}</h1>"


@query("A01_fetch", "SELECT DISTINCT url, CASE WHEN contains(url, '/blog/') THEN NULL ELSE string_split(url, '#')[1] END AS final_url, CASE WHEN contains(url, '/blog/') THEN NULL WHEN contains(url, '/docs/') THEN 404 ELSE 200 END AS status, CASE WHEN contains(url, '/blog/') THEN NULL ELSE '<h1>' || length(url) || '</h1>' END AS body, CASE WHEN contains(url, '/blog/') THEN 'TimeoutError: no answer' END AS error FROM documents WHERE url IS NOT NULL")
def a01(s, d):
    return crawl.fetched(I.documents(s, d).select("url").where("url IS NOT NULL").distinct(), _stored, per_second=1_000_000)


@query("A03_sitemap", "WITH n AS (SELECT doc_id FROM documents UNION ALL SELECT 0) SELECT 'map-' || doc_id || '.xml' AS url, url AS loc, strftime(updated_at AT TIME ZONE 'UTC', '%Y-%m-%d') AS lastmod FROM documents UNION ALL SELECT 'index-' || doc_id || '.xml', 'map-' || doc_id || '.xml', NULL FROM n UNION ALL SELECT 'index-' || doc_id || '.xml', 'index-' || (doc_id * 10 + k) || '.xml', NULL FROM n, (SELECT unnest(range(10)) AS k) WHERE doc_id * 10 + k > 0")
def a03(s, d):
    return crawl.sitemap_entries(_sitemaps(s, d)).select("url", "loc", "lastmod")


@query("A04_deep_sitemap", "SELECT url AS loc, min(length(CAST(doc_id AS VARCHAR)) + 1) AS depth FROM documents GROUP BY url")
def a04(s, d):
    return crawl.deep_entries(_sitemaps(s, d), "index-0.xml").select("loc", F.col("depth").cast("bigint").alias("depth"))


@query("A05_robots", "SELECT doc_id, ['https://' || domain || '/a.xml', 'https://' || domain || '/b.xml'] AS sitemaps FROM documents WHERE domain IS NOT NULL")
def a05(s, d):
    text = F.format_string("User-agent: *\nSitemap: https://%s/a.xml\nsitemap:https://%s/b.xml\nSITEMAP: https://%s/a.xml\n", "domain", "domain", "domain")
    return crawl.robots_sitemaps(I.documents(s, d).where("domain IS NOT NULL").select("doc_id", text.alias("text"))).select("doc_id", "sitemaps")


def _probed(url: str) -> tuple[str, int, str]:
    """Stands in for a request: documentation has an index, help a folder, all else nothing."""
    if "//docs." in url:
        return url, 200 if url.endswith("/sitemap_index.xml") else 404, ""
    if "//help." in url and url.endswith("/sitemaps/sitemap.xml"):
        return url, 204, ""
    raise ConnectionError("refused")


@query("A05_discovered_sitemaps", "SELECT 'https://' || domain AS origin, CASE WHEN length(domain) % 2 = 0 THEN ['https://' || domain || '/a.xml'] WHEN starts_with(domain, 'docs.') THEN ['https://' || domain || '/sitemap_index.xml'] WHEN starts_with(domain, 'help.') THEN ['https://' || domain || '/sitemaps/sitemap.xml'] ELSE []::VARCHAR[] END AS sitemaps FROM (SELECT DISTINCT domain FROM documents WHERE domain IS NOT NULL)")
def a05d(s, d):
    """Sites of even length name a sitemap in their robots file, the others are asked."""
    sites = I.documents(s, d).select("domain").where("domain IS NOT NULL").distinct()
    origin = F.concat(F.lit("https://"), "domain")
    robots = F.when(F.length("domain") % 2 == 0, F.concat(F.lit("User-agent: *\nSitemap: "), origin, F.lit("/a.xml\n")))
    return crawl.discovered_sitemaps(sites.select(origin.alias("origin"), robots.alias("text")), _probed, per_second=1_000_000)


@query("A08_excluded_paths", "SELECT doc_id, regexp_matches(coalesce(nullif(regexp_extract(url, '^https?://[^/?#]+([^?#]*)', 1), ''), '/'), '^(/blog|/help/.*a-)') AS excluded FROM documents")
def a08(s, d):
    return I.documents(s, d).select("doc_id", T.path_excluded(F.col("url"), ["/blog", "/help/*a-"]).alias("excluded"))


@query("A10_stored_pages", "SELECT doc_id, url, md5(raw_html) AS page FROM documents WHERE raw_html IS NOT NULL")
def a10(s, d):
    return I.documents(s, d).where("raw_html IS NOT NULL").select("doc_id", "url", F.md5("raw_html").alias("page"))


@query("A11_columns", "SELECT column_name AS name FROM (DESCRIBE SELECT * FROM documents)")
def a11(s, d):
    return s.createDataFrame([(c,) for c in I.documents(s, d).columns], "name string")


_ARRIVING = "arriving AS (SELECT url, CASE WHEN id % 10 = 0 THEN 'changed' ELSE content_hash END AS content_hash, CASE WHEN id % 7 = 0 THEN 404 ELSE 200 END AS status_code, w AS word_count, id FROM one)"
_ONE = "one AS (SELECT url, min(doc_id) AS id, arg_min(content_hash, doc_id) AS content_hash, CAST(arg_min(metadata.wordcount, doc_id) AS BIGINT) AS w FROM documents GROUP BY url)"
_STATUS = "CASE WHEN a.status_code <> 200 OR coalesce(a.word_count, 0) < 10 THEN 'rejected' WHEN o.url IS NULL THEN 'new' WHEN o.content_hash IS NOT DISTINCT FROM a.content_hash THEN 'unchanged' ELSE 'updated' END"


def _ingest(s, d):
    one = I.documents(s, d).groupBy("url").agg(F.min("doc_id").alias("id"), F.min_by("content_hash", "doc_id").alias("content_hash"), F.min_by("metadata.wordcount", "doc_id").alias("word_count"))
    arriving = one.select("url", F.when(F.col("id") % 10 == 0, "changed").otherwise(F.col("content_hash")).alias("content_hash"), F.when(F.col("id") % 7 == 0, 404).otherwise(200).alias("status_code"), "word_count", "id")
    return one.where("id % 2 = 0").select("url", "content_hash", "id"), sinks.ingest_status(one.where("id % 2 = 0"), arriving)


@query("B01_ingest_status", f"WITH {_ONE.replace('CAST(arg_min(metadata.wordcount, doc_id) AS BIGINT)', 'arg_min(coalesce(metadata.wordcount, -1), doc_id)')}, {_ARRIVING} SELECT a.url, {_STATUS} AS ingest_status FROM arriving a LEFT JOIN (SELECT * FROM one WHERE id % 2 = 0) o ON a.url = o.url")
def b01(s, d):
    return _ingest(s, d)[1].select("url", "ingest_status")


@query("B01_upserted", f"WITH {_ONE.replace('CAST(arg_min(metadata.wordcount, doc_id) AS BIGINT)', 'arg_min(coalesce(metadata.wordcount, -1), doc_id)')}, {_ARRIVING}, st AS (SELECT a.*, {_STATUS} AS st FROM arriving a LEFT JOIN (SELECT * FROM one WHERE id % 2 = 0) o ON a.url = o.url) SELECT url, content_hash, id FROM st WHERE st IN ('new', 'updated') UNION ALL SELECT url, content_hash, id FROM one WHERE id % 2 = 0 AND url NOT IN (SELECT url FROM st WHERE st IN ('new', 'updated'))")
def b01u(s, d):
    existing, arriving = _ingest(s, d)
    return sinks.upserted(existing, arriving.select("url", "content_hash", "id", "ingest_status"))


@query("B04_reindexed", f"WITH {CHUNKS}, fresh AS (SELECT id, document_id FROM chunks WHERE document_id % 3 = 0 AND chunk_index = 0) SELECT id, document_id, 'fresh' AS state FROM fresh UNION ALL SELECT id, document_id, 'kept' FROM chunks WHERE document_id NOT IN (SELECT document_id FROM fresh)")
def b04(s, d):
    c = I.chunks(s, d).select("id", "document_id", F.lit("kept").alias("state"), "chunk_index")
    return sinks.reindexed(c, c.where("document_id % 3 = 0 AND chunk_index = 0").withColumn("state", F.lit("fresh"))).select("id", "document_id", "state")


@query("B04_outcomes", f"WITH {CHUNKS}, {FACTS}, n AS (SELECT document_id, 'chunk' AS pipeline, count(*) AS n, count(*) FILTER (WHERE dense_embedding IS NULL) AS w FROM chunks GROUP BY 1 UNION ALL SELECT document_id, 'fact', count(*), count(*) FILTER (WHERE dense_embedding IS NULL) FROM facts GROUP BY 1) SELECT d.doc_id, p.pipeline, coalesce(n.n, 0) AS n, coalesce(n.w, 0) AS without_vector, CASE WHEN raw_html IS NULL THEN 'no stored page' WHEN n.w > 0 THEN 'embedding failed' END AS error FROM documents d CROSS JOIN (SELECT unnest(['chunk', 'fact']) AS pipeline) p LEFT JOIN n ON n.document_id = d.doc_id AND n.pipeline = p.pipeline")
def b04o(s, d):
    own = lambda df: df.withColumn("doc_id", F.col("document_id"))
    return ingest.outcomes(I.documents(s, d), {"chunk": own(I.chunks(s, d)), "fact": own(I.facts(s, d))})


@query("B05_deleted_children", f"WITH {CHUNKS} SELECT id FROM chunks WHERE document_id NOT IN (SELECT doc_id FROM documents WHERE url LIKE '%/blog/%')")
def b05(s, d):
    gone = I.documents(s, d).where(F.contains("url", F.lit("/blog/"))).select(F.col("doc_id").alias("document_id"))
    return sinks.deleted(I.chunks(s, d), gone, "document_id").select("id")


@query("B06_emptied", "SELECT doc_id, url FROM documents WHERE false")
def b06(s, d):
    return sinks.emptied(I.documents(s, d).select("doc_id", "url"))


@query("B08_patched", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'patched' ELSE title END AS title, CASE WHEN doc_id % 5 = 0 THEN least(greatest(doc_id / 100.0, 0.3), 2.0) ELSE 1.0 END AS weight FROM documents")
def b08(s, d):
    docs = I.documents(s, d).select("doc_id", "title", F.lit(1.0).alias("weight"))
    updates = docs.where("doc_id % 5 <= 1").select("doc_id", F.when(F.col("doc_id") % 5 == 0, " patched ").otherwise("  ").alias("title"), F.when(F.col("doc_id") % 5 == 0, F.col("doc_id") / 100.0).alias("weight"))
    return sinks.patched(docs, updates, "doc_id", {"weight": (0.3, 2.0)})


@query("B12_seed_statements", "WITH w AS (SELECT DISTINCT unnest(expected_document_ids) AS doc_id FROM test_queries) SELECT 'INSERT INTO documents (id, url, title) VALUES (' || doc_id || ', ' || coalesce('''' || replace(url, '''', '''''') || '''', 'NULL') || ', ' || coalesce('''' || replace(title, '''', '''''') || '''', 'NULL') || ');' AS statement FROM documents SEMI JOIN w USING (doc_id) UNION ALL SELECT 'INSERT INTO test_queries (id, query) VALUES (' || query_id || ', ' || coalesce('''' || replace(query_text, '''', '''''') || '''', 'NULL') || ');' FROM test_queries")
def b12(s, d):
    return sinks.seed_statements(I.queries(s, d), I.documents(s, d))


@query("B14_valid_test_queries", "SELECT query_id, CASE WHEN query_id % 4 = 0 THEN 'medium' ELSE difficulty END AS difficulty FROM test_queries WHERE trim(query_text) <> '' AND query_id % 4 <> 1 AND (query_id % 4 = 0 OR difficulty IN ('easy', 'medium', 'hard') OR difficulty IS NULL)")
def b14(s, d):
    q = I.queries(s, d).withColumn("difficulty", F.when(F.col("query_id") % 4 == 0, None).when(F.col("query_id") % 4 == 1, "unknown").otherwise(F.col("difficulty")))
    return sinks.valid_test_queries(q).select("query_id", "difficulty")


_BL = r"[ \t\n\r\f\v]+"


@query("C03_spaced_tags", "SELECT doc_id, md5(regexp_replace(raw_html, '(?i)(</(?:a|abbr|b|code|em|i|mark|s|small|span|strong|sub|sup|u)>)([A-Za-z0-9À-ɏ]|<(?:a|abbr|b|code|em|i|mark|s|small|span|strong|sub|sup|u)[ >])', '\\1 \\2', 'g')) AS page FROM documents WHERE raw_html IS NOT NULL")
def c03(s, d):
    return I.documents(s, d).where("raw_html IS NOT NULL").select("doc_id", F.md5(markup.spaced_tags(F.col("raw_html"))).alias("page"))


@query("C06_plain_text", rf"SELECT doc_id, CASE WHEN length(t) > 300 THEN substr(t, 1, 300) || '...' ELSE t END AS plain FROM (SELECT doc_id, trim(regexp_replace(raw_content, '{_BL}', ' ', 'g'), ' ') AS t FROM documents)")
def c06(s, d):
    return I.documents(s, d).select("doc_id", T.plain_text(F.col("raw_content"), 300).alias("plain"))


def _stop_words(words) -> str:
    return f"len(list_filter(regexp_split_to_array(lower(raw_content), '[^a-z0-9_]+'), lambda w: w IN ({sql_list(words)})))"


@query("C09_text_features", rf"SELECT doc_id, len(list_filter(regexp_split_to_array(raw_content, '{_BL}'), lambda w: w <> '')) AS words, coalesce(contains(raw_html, '<code') OR contains(raw_html, '<pre'), false) AS has_code, CASE WHEN e > g THEN 'en' WHEN g > e THEN 'de' END AS language, CASE WHEN length(raw_content) > 200 THEN substr(raw_content, 1, 200) || '...' ELSE raw_content END AS excerpt FROM (SELECT *, {_stop_words(T.ENGLISH)} AS e, {_stop_words(T.GERMAN)} AS g FROM documents)")
def c09(s, d):
    c = F.col("raw_content")
    return I.documents(s, d).select("doc_id", T.word_count(c).alias("words"), T.has_code(F.lit(None).cast("string"), F.col("raw_html")).alias("has_code"), T.stop_word_language(c).alias("language"), T.excerpt(c).alias("excerpt"))


@query("C12_stale_hashes", "SELECT doc_id, sha256(raw_content) AS content_hash, sha256(raw_content) <> content_hash AS stale FROM documents")
def c12(s, d):
    h = T.content_hash(F.col("raw_content"))
    return I.documents(s, d).select("doc_id", h.alias("content_hash"), (h != F.col("content_hash")).alias("stale"))


@query("C13_rolling_hash", "WITH u AS (SELECT doc_id, list_transform(string_split(regexp_replace(raw_content, '[^ -~]', '', 'g'), ''), lambda c: CAST(ascii(c) AS BIGINT)) AS a FROM documents), h AS (SELECT doc_id, len(a) AS n, list_reduce(a, lambda x, y: ((x * 31 + y + 139586437120) % 4294967296) - 2147483648, 0::BIGINT) AS h FROM u) SELECT doc_id, lpad(to_hex(abs(h)), 8, '0') AS h, to_hex(n) AS n FROM h")
def c13(s, d):
    """Of the printable ASCII characters, whose units are their codes."""
    h = F.split(T.rolling_hash(F.regexp_replace("raw_content", "[^ -~]", "")), "-")
    return I.documents(s, d).select("doc_id", F.upper(h[0]).alias("h"), F.upper(h[1]).alias("n"))


@query("C14_host", "SELECT doc_id, lower(regexp_extract(url, '^[a-zA-Z]+://([^/:?#]+)', 1)) AS host FROM documents")
def c14(s, d):
    return I.documents(s, d).select("doc_id", T.host(F.col("url")).alias("host"))


@query("C16_extracted_pages")
def c16(s, d):
    return markup.extract_pages(I.documents(s, d).where("raw_html IS NOT NULL"))


def _pages(s, d):
    return I.documents(s, d).where("raw_html IS NOT NULL").select("doc_id", markup.extract("raw_html").alias("e")).select("doc_id", F.col("e.markdown").alias("markdown"))


@query("D04_chunked_pages")
def d04(s, d):
    return chunking.chunk_documents(_pages(s, d))


@query("D11_chunk_metadata", f"WITH {CHUNKS}, t AS (SELECT id, trim(content_markdown, chr(10) || chr(9) || chr(13) || ' ') AS m FROM chunks WHERE content_markdown IS NOT NULL) SELECT id, 0 AS chunk_index, CASE WHEN contains(m, '|') AND contains(m, '---') THEN 'mixed' ELSE 'text' END AS chunk_type, contains(m, '|') AND contains(m, '---') AS has_table, nullif(regexp_extract(m, '(?m)^#{{1,6}}[ \\t]+([^\\n]+)$', 1), '') AS section_title, CAST(ceil(length(m) / 4.0) AS INTEGER) AS token_count, length(m) AS size FROM t WHERE length(m) >= 50")
def d11(s, d):
    """Stored chunks are short, so each is one chunk again."""
    made = chunking.chunk_documents(I.chunks(s, d).where("content_markdown IS NOT NULL").select("id", "content_markdown"), "id", "content_markdown")
    return made.select("id", "chunk_index", "chunk_type", "has_table", "section_title", "token_count", F.length("content").cast("bigint").alias("size"))


@query("D13_chunk_stats", f"WITH {CHUNKS} SELECT count(*) AS chunks, coalesce(sum(metadata.tokencount), 0) AS tokens, round(coalesce(avg(metadata.tokencount), 0), 6) AS avg_tokens, round(coalesce(avg(cardinality(sparse_vector)), 0), 6) AS avg_terms FROM chunks")
def d13(s, d):
    return N.chunk_stats(I.chunks(s, d))


@query("E01_extracted_facts")
def e01(s, d):
    return FX.extract_facts(_pages(s, d))


_LOW = "lower(content)"
_HEDGED = " OR ".join(f"starts_with({_LOW}, '{w}') OR contains({_LOW}, ', {w}')" for w in FX.HEDGES)
_NOT_FACT = "regexp_matches(content, '(?i)" + "|".join(FX.NOT_FACTS) + f"') OR ends_with(content, '?') OR {_HEDGED}"


@query("E05_is_fact", f"WITH {FACTS} SELECT id, NOT ({_NOT_FACT}) AS is_fact FROM facts")
def e05(s, d):
    return I.facts(s, d).select("id", FX.is_fact(F.col("content")).alias("is_fact"))


def _score(c: str) -> str:
    own = " + ".join(f"CAST(contains({_LOW}, {sql_list([k])}) AS INTEGER)" for k in FX.KEYWORDS[c])
    more = {"SPEC": f" + CASE WHEN regexp_matches(content, '(?i){FX._UNIT}') THEN 2 ELSE 0 END", "DEF": f" + CAST(regexp_matches(content, '(?i){FX._DEFINES}') AS INTEGER)", "PROC": f" + CAST(regexp_matches(content, '(?i){FX._PROCEEDS}') AS INTEGER)"}
    return own + more.get(c, "")


_TOP = "greatest(spec, proc, def, rel)"


@query("E08_category", f"WITH {FACTS}, s AS (SELECT id, {_score('SPEC')} AS spec, {_score('PROC')} AS proc, {_score('DEF')} AS def, {_score('REL')} AS rel FROM facts) SELECT id, CASE WHEN {_TOP} <= 0 THEN 'OTHER' WHEN spec = {_TOP} THEN 'SPEC' WHEN proc = {_TOP} THEN 'PROC' WHEN def = {_TOP} THEN 'DEF' ELSE 'REL' END AS category FROM s")
def e08(s, d):
    return I.facts(s, d).select("id", FX.category(F.col("content")).alias("category"))


_RUNS = f"regexp_extract_all(content, '{FX.CAPITALS}', 1)"
_ENTITIES = f"list_distinct(list_concat(list_filter(CASE WHEN len({_RUNS}) = 1 AND starts_with(content, {_RUNS}[1]) THEN [] ELSE {_RUNS} END, lambda x: x NOT IN ({sql_list(sorted(FX._COMMON))})), regexp_extract_all(content, '{FX.TECHNICAL}', 1), regexp_extract_all(content, '`([^`]+)`', 1)))"


@query("E07_entities", f"WITH {FACTS} SELECT id, list_sort({_ENTITIES}) AS entities FROM facts")
def e07(s, d):
    return I.facts(s, d).select("id", F.array_sort(FX.entities(F.col("content"))).alias("entities"))


_CONF = f"0.5 + CASE WHEN n > 0 THEN 0.1 ELSE 0 END + CASE WHEN n > 2 THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(content, '`[^`]+`') THEN 0.1 ELSE 0 END + CASE WHEN regexp_matches(content, '[0-9]') THEN 0.05 ELSE 0 END + CASE WHEN regexp_matches({_LOW}, '{FX._ASSERTS}') THEN 0.1 ELSE 0 END - CASE WHEN regexp_matches({_LOW}, '{FX._VAGUE}') THEN 0.1 ELSE 0 END - CASE WHEN regexp_matches({_LOW}, '{FX._OPEN}') THEN 0.1 ELSE 0 END"


@query("E09_confidence", f"WITH {FACTS}, e AS (SELECT id, content, len({_ENTITIES}) AS n FROM facts) SELECT id, round(greatest(least(CAST({_CONF} AS DOUBLE), 1.0), 0.1), 6) AS confidence FROM e")
def e09(s, d):
    return I.facts(s, d).select("id", FX.confidence(F.col("content"), F.size(FX.entities(F.col("content")))).alias("confidence"))


@query("E14_distinct_facts", f"WITH {FACTS}, k AS (SELECT id, document_id, fact_index, regexp_replace(trim(regexp_replace(lower(content), '{_BL}', ' ', 'g'), ' '), '[.,;:!?]+$', '') AS k FROM facts) SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY document_id, k ORDER BY fact_index, id) AS n FROM k) WHERE n = 1")
def e14(s, d):
    w = W.partitionBy("document_id", "k").orderBy("fact_index", "id")
    return I.facts(s, d).withColumn("k", FX.fact_key(F.col("content"))).withColumn("n", F.row_number().over(w)).where("n = 1").select("id")


@query("E15_fact_stats", f"WITH {FACTS} SELECT coalesce(upper(category), 'OTHER') AS category, count(*) AS facts, round(avg(length(content)), 6) AS avg_length, round(avg(confidence), 6) AS avg_confidence FROM facts GROUP BY 1")
def e15(s, d):
    return N.fact_stats(I.facts(s, d))


@query("G09_text_search", f"WITH {CHUNKS}, {FACTS}, h AS (SELECT document_id FROM chunks WHERE content ILIKE '%gateway%' UNION SELECT document_id FROM facts WHERE content ILIKE '%gateway%'), t AS (SELECT doc_id, created_at FROM documents WHERE title ILIKE '%gateway%' OR url ILIKE '%gateway%' OR domain ILIKE '%gateway%' OR doc_id IN (SELECT document_id FROM h) ORDER BY created_at DESC, doc_id DESC LIMIT 500) SELECT doc_id, (SELECT count(*) FROM chunks c WHERE c.document_id = t.doc_id) AS chunks, (SELECT count(*) FROM facts f WHERE f.document_id = t.doc_id) AS facts FROM t")
def g09(s, d):
    return N.search_text(I.documents(s, d), {"chunks": (I.chunks(s, d), "content"), "facts": (I.facts(s, d), "content")}, "gateway").select("doc_id", "chunks", "facts")


@query("G10_domains", "SELECT DISTINCT domain FROM documents WHERE url ILIKE '%docs%'")
def g10(s, d):
    return I.documents(s, d).where(F.ilike("url", F.lit("%docs%"))).select("domain").distinct()


@query("N01_overview", f"WITH {CHUNKS}, {FACTS} SELECT 'documents' AS name, count(*) AS n FROM documents UNION ALL SELECT 'chunks', count(*) FROM chunks UNION ALL SELECT 'facts', count(*) FROM facts UNION ALL SELECT 'test_queries', count(*) FROM test_queries")
def n01(s, d):
    return N.overview({"documents": I.documents(s, d), "chunks": I.chunks(s, d), "facts": I.facts(s, d), "test_queries": I.queries(s, d)})


@query("N02_top_domains", "SELECT domain, count(*) AS documents, epoch_us(max(updated_at)) AS updated_at FROM documents GROUP BY domain ORDER BY documents DESC, domain LIMIT 10")
def n02(s, d):
    return N.top_domains(I.documents(s, d)).withColumn("updated_at", F.unix_micros("updated_at"))


@query("N03_categories", f"WITH {FACTS} SELECT category, count(*) AS n FROM facts GROUP BY category")
def n03(s, d):
    return N.categories(I.facts(s, d))


@query("N04_recent_documents", "SELECT doc_id, url, title, epoch_us(created_at) AS created_at FROM documents ORDER BY documents.created_at DESC, doc_id DESC LIMIT 5")
def n04(s, d):
    return N.recent(I.documents(s, d)).withColumn("created_at", F.unix_micros("created_at"))


@query("N05_mean_children", f"WITH {CHUNKS}, {FACTS} SELECT round(avg(c), 6) AS avg_chunks, round(avg(f), 6) AS avg_facts FROM (SELECT count(DISTINCT c.id) AS c, count(DISTINCT f.id) AS f FROM documents d LEFT JOIN chunks c ON c.document_id = d.doc_id LEFT JOIN facts f ON f.document_id = d.doc_id GROUP BY d.doc_id)")
def n05(s, d):
    return N.mean_children(I.documents(s, d), {"chunks": I.chunks(s, d), "facts": I.facts(s, d)})


@query("N06_child_counts", f"WITH {CHUNKS}, {FACTS} SELECT doc_id, (SELECT count(*) FROM chunks c WHERE c.document_id = d.doc_id) AS chunks, (SELECT count(*) FROM facts f WHERE f.document_id = d.doc_id) AS facts FROM documents d")
def n06(s, d):
    return N.with_child_counts(I.documents(s, d).select("doc_id"), {"chunks": I.chunks(s, d), "facts": I.facts(s, d)})


@query("N07_facts_of_category", f"WITH {FACTS} SELECT id, confidence AS score FROM facts WHERE upper(category) = 'SPEC' ORDER BY confidence DESC NULLS LAST, id LIMIT 50")
def n07(s, d):
    return N.facts_of(I.facts(s, d), "SPEC").select("id", "score")


@query("N08_counts_by_document", f"WITH {FACTS} SELECT document_id, count(*) AS facts FROM facts GROUP BY document_id")
def n08(s, d):
    return I.facts(s, d).groupBy("document_id").agg(F.count(F.lit(1)).alias("facts"))


@query("N09_summary_counts", f"WITH {SUMMARIES} SELECT document_id, count(*) AS n FROM summaries GROUP BY document_id")
def n09(s, d):
    return I.summaries(s, d).groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))


@query("S01_event_windows", "SELECT epoch_us(date_trunc('hour', ts)) AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean_value FROM events GROUP BY 1, 2")
def s01(s, d):
    e = table(s, d, "events")
    return e.groupBy(F.unix_micros(F.date_trunc("hour", "ts")).alias("start"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean_value"))


@query("A06_domain_crawl", "SELECT DISTINCT url AS loc FROM documents")
def a06(s, d):
    return crawl.deep_entries(_sitemaps(s, d), "index-0.xml", also_named=True).select("loc")


@query("B03_appended", f"WITH {CHUNKS} SELECT id, document_id, content, CASE WHEN document_id % 2 = 0 THEN metadata.tokencount ELSE CAST(ceil(length(content) / 4.0) AS INTEGER) END AS token_count, CASE WHEN document_id % 2 = 0 THEN coalesce(len(dense_embedding), -1) ELSE 64 END AS dimension FROM chunks")
def b03(s, d):
    """Chunks of odd documents are embedded anew and appended to those of even ones; known ids come again and are left out."""
    c = I.chunks(s, d)
    old = c.where("document_id % 2 = 0").select("id", "document_id", "content", "dense_embedding", "sparse_vector", F.col("metadata.tokencount").alias("token_count"))
    fresh = ingest.embed_record(c.where("document_id % 2 = 1 OR id % 10 = 0").select("id", "document_id", "content"), F.col("content"))
    return sinks.appended(old, fresh).select("id", "document_id", "content", "token_count", F.coalesce(F.size("dense_embedding"), F.lit(-1)).alias("dimension"))


@query("B07_deleted_ids", f"WITH {FACTS} SELECT id FROM facts WHERE id NOT IN (1, 2, 3, 5, 8)")
def b07(s, d):
    return sinks.deleted(I.facts(s, d), s.createDataFrame([(i,) for i in (1, 2, 3, 5, 8)], "id bigint"), "id").select("id")


@query("B09_singleton", "SELECT 1 AS id, 'dark' AS theme, 'Docs' AS title")
def b09(s, d):
    old = s.createDataFrame([(1, "light", "Docs")], "id int, theme string, title string")
    return sinks.singleton(old, s.createDataFrame([(1, " dark ", "  ")], "id int, theme string, title string"))


@query("B10_json_lines", "SELECT '{\"doc_id\":' || doc_id || ',\"domain\":\"' || domain || '\"}' AS line FROM documents WHERE domain IS NOT NULL")
def b10(s, d):
    """Written as text, then read again."""
    path = f"{checkpoint_dir(s)}/lines-{uuid.uuid4().hex}"
    sinks.write_lines(I.documents(s, d).where("domain IS NOT NULL").select(F.to_json(F.struct("doc_id", "domain")).alias("line")), path)
    return s.read.text(path).withColumnRenamed("value", "line")


@query("B13_progress_frames", "SELECT doc_id, 'event: progress' || chr(10) || 'data: {\"url\":\"' || url || '\"}' || chr(10) || chr(10) AS frame FROM documents")
def b13(s, d):
    return incremental.frames(I.documents(s, d).select("doc_id", "url"), "progress", "url").select("doc_id", "frame")


@query("D14_chunk_records", "SELECT doc_id, 0 AS chunk_index, trim(t) AS content, CAST(ceil(length(trim(t)) / 4.0) AS INTEGER) AS token_count, 64 AS dimension, 1.0 AS size FROM (SELECT doc_id, regexp_replace(raw_content, '[^A-Za-z ]+', ' ', 'g') AS r, 'document ' || doc_id || ' ' || substr(r, 1, 1500) AS t FROM documents) WHERE length(trim(t)) >= 50")
def d14(s, d):
    """One paragraph a document, made of the letters of its text, so that it is one chunk."""
    letters = F.regexp_replace("raw_content", "[^A-Za-z ]+", " ")
    text = F.concat(F.lit("document "), F.col("doc_id").cast("string"), F.lit(" "), F.substring(letters, 1, 1500))
    made = ingest.chunk_records(I.documents(s, d).select("doc_id", text.alias("markdown")))
    norm = F.sqrt(F.aggregate("dense_embedding", F.lit(0.0), lambda a, x: a + x * x))
    return made.select("doc_id", "chunk_index", "content", "token_count", F.size("dense_embedding").alias("dimension"), F.round(norm, 6).alias("size"))


@query("D14_page_records")
def d14p(s, d):
    return ingest.chunk_records(_pages(s, d)).select("doc_id", "chunk_index", "content", "token_count", F.size("dense_embedding").alias("dimension"), F.size("sparse_vector").alias("terms"))


@query("C04_markdown")
def c04(s, d):
    return _pages(s, d)


@query("D05_strategy", f"WITH {CHUNKS} SELECT id, CASE WHEN len(list_filter(regexp_split_to_array(content_markdown, '\\n\\n+'), lambda p: trim(p) <> '')) >= 2 THEN 'paragraph' WHEN regexp_matches(content_markdown, '[.!?][ \\t\\n\\r\\f\\v]+[^ \\t\\n\\r\\f\\v]') THEN 'sentence' ELSE 'window' END AS strategy FROM chunks WHERE content_markdown IS NOT NULL")
def d05(s, d):
    return I.chunks(s, d).where("content_markdown IS NOT NULL").select("id", chunking.strategy_of("content_markdown").alias("strategy"))


@query("E06_length_filter", f"WITH {FACTS} SELECT id FROM facts WHERE length(content) BETWEEN 10 AND 500")
def e06(s, d):
    return I.facts(s, d).where(F.length("content").between(FX.SHORTEST, FX.LONGEST)).select("id")


_HEADED = "'# First part' || chr(10) || coalesce(l[1], '') || chr(10) || '## Second part' || chr(10) || coalesce(l[len(l)], '')"


@query("E04_nearest_heading", f"WITH p AS (SELECT doc_id, string_split(raw_content, chr(10)) AS l FROM documents), m AS (SELECT doc_id, coalesce(l[len(l)], '') AS s, {_HEADED} AS md, length('# First part' || chr(10) || coalesce(l[1], '') || chr(10)) AS second FROM p), a AS (SELECT *, strpos(md, array_to_string(string_split(s, ' ')[1:5], ' ')) - 1 AS pos FROM m) SELECT doc_id, CASE WHEN pos < 0 THEN NULL WHEN pos >= second THEN 'Second part' ELSE 'First part' END AS heading FROM a")
def e04(s, d):
    """The first and the last line of each document under a heading each; which one the last line stands under."""
    lines = F.split("raw_content", "\n", -1)
    first, last = F.element_at(lines, 1), F.element_at(lines, -1)
    page = F.concat(F.lit("# First part\n"), first, F.lit("\n## Second part\n"), last)
    return I.documents(s, d).select("doc_id", FX.nearest_heading(page, last).alias("heading"))


@query("E10_context_window", f"WITH {FACTS}, m AS (SELECT id, ['Alpha ' || id || ' runs.', 'Beta ' || id || ' waits.', 'Gamma ' || id || ' stops.', 'Delta ' || id || ' ends.'] AS l FROM facts) SELECT id, k - 1 AS position, l[k] AS content, array_to_string(l[greatest(k - 1, 1):k + 1], ' ') AS context FROM m, (SELECT unnest(range(1, 5)) AS k)")
def e10(s, d):
    """Four sentences a fact, in one paragraph."""
    text = F.format_string("Alpha %1$d runs. Beta %1$d waits. Gamma %1$d stops. Delta %1$d ends.", "id")
    return I.facts(s, d).select("id", F.explode(FX.raw_facts_of(text)).alias("f")).select("id", F.col("f.position").cast("bigint").alias("position"), "f.content", F.col("f.source_context").alias("context"))


_BUILT = (
    "<html><head><title>Head {0}</title><style>p {{}}</style></head><body><nav>Menu of all pages</nav><article><h1>Title {0}</h1><p>Some <b>bold</b> text about number {0}, which is long enough to be taken as the article of its page, with <a href=\"/x/{0}\">a link</a> in it.</p>"
    "<table><tr><th>name</th><th>size</th></tr><tr><td>row {0}</td></tr></table><ul><li>one</li><li>two of {0}</li></ul><pre><code class=\"language-py\">x = {0}</code></pre></article><footer>Foot of the page</footer></body></html>"
)
_BUILT_MARKDOWN = "# Title {0}\n\nSome **bold** text about number {0}, which is long enough to be taken as the article of its page, with [a link](/x/{0}) in it.\n\n| name | size |\n| --- | --- |\n| row {0} |   |\n\n- one\n- two of {0}\n\n```py\nx = {0}\n```"
_BUILT_TEXT = "Title {0} Some bold text about number {0}, which is long enough to be taken as the article of its page, with a link in it. name size row {0} one two of {0} x = {0}"


def _sql_filled(text: str) -> str:
    return "replace('" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "', '{0}', CAST(doc_id AS VARCHAR))"


@query("C16_built_pages", f"SELECT doc_id, 'Title ' || doc_id AS title, {_sql_filled(_BUILT_MARKDOWN)} AS markdown, {_sql_filled(_BUILT_TEXT)} AS text, true AS has_code, 'en' AS language FROM documents")
def c16b(s, d):
    """A page of every kind of block for each document: menus and footers go, the rest becomes markdown."""
    page = F.replace(F.lit(_BUILT.replace("{{}}", "{}")), F.lit("{0}"), F.col("doc_id").cast("string"))
    return markup.extract_pages(I.documents(s, d).select("doc_id", page.alias("raw_html"))).select("doc_id", "title", "markdown", F.trim(F.regexp_replace("text", " +", " ")).alias("text"), "has_code", "language")


_PARTS = "SELECT doc_id, 'First ' || doc_id || repeat(' alpha', 240) AS a, 'Second ' || doc_id || repeat(' gamma', 200) AS b, 'The end of page ' || doc_id || '.' AS c FROM documents"


@query("D06_packed_paragraphs", f"WITH p AS ({_PARTS}), t AS (SELECT *, substr(right(a, 512), strpos(right(a, 512), ' ') + 1) AS rest FROM p), k AS (SELECT doc_id, 0 AS chunk_index, a AS content, 0 AS start_char FROM t UNION ALL SELECT doc_id, 1, rest || chr(10) || chr(10) || b || chr(10) || chr(10) || c, length(a) - length(rest) FROM t) SELECT doc_id, chunk_index, content, CAST(ceil(length(content) / 4.0) AS INTEGER) AS token_count, CAST(start_char AS INTEGER) AS start_char FROM k")
def d06(s, d):
    """Three paragraphs, of which the first fills a chunk and hands its tail to the next."""
    i = F.col("doc_id").cast("string")
    text = F.concat(F.lit("First "), i, F.repeat(F.lit(" alpha"), F.lit(240)), F.lit("\n\nSecond "), i, F.repeat(F.lit(" gamma"), F.lit(200)), F.lit("\n\nThe end of page "), i, F.lit("."))
    return chunking.chunk_documents(I.documents(s, d).select("doc_id", text.alias("markdown"))).select("doc_id", "chunk_index", "content", "token_count", "start_char")


@query("D09_split_tables", "SELECT doc_id, 120 AS rows FROM documents")
def d09(s, d):
    """A long table is split into parts under one header: all rows come out once, each part with the header and within the bound."""
    row = lambda k: F.concat(F.lit("| row "), k.cast("string"), F.lit(" of document "), F.col("doc_id").cast("string"), F.lit(" | "), F.repeat(F.lit("x"), F.lit(20)), F.lit(" |"))
    text = F.concat(F.lit("| name | size |\n| --- | --- |\n"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(119)), row), "\n"))
    made = chunking.chunk_documents(I.documents(s, d).select("doc_id", text.alias("markdown")))
    fair = made.where("startswith(content, '| name | size |\\n| --- | --- |\\n') AND chunk_type = 'table' AND token_count <= 512")
    return fair.groupBy("doc_id").agg(F.count(F.lit(1)).alias("parts"), F.sum(F.size(F.split("content", "\n")) - 2).alias("rows")).where("parts > 1").select("doc_id", "rows")


@query("D07_packed_sentences", "WITH p AS (SELECT doc_id, list_transform(range(1, 61), lambda k: 'Sentence ' || lpad(CAST(k AS VARCHAR), 2, '0') || ' of page ' || lpad(CAST(doc_id AS VARCHAR), 8, '0') || ' goes.') AS l FROM documents), a AS (SELECT doc_id, array_to_string(l[1:58], ' ') AS a, array_to_string(l[59:60], ' ') AS b FROM p), t AS (SELECT *, substr(right(a, 512), strpos(right(a, 512), ' ') + 1) AS rest FROM a), k AS (SELECT doc_id, 0 AS chunk_index, a AS content, 0 AS start_char FROM t UNION ALL SELECT doc_id, 1, rest || ' ' || b, length(a) - length(rest) FROM t) SELECT doc_id, chunk_index, content, CAST(start_char AS INTEGER) AS start_char FROM k")
def d07(s, d):
    """Sixty sentences of 34 characters in one paragraph: 58 fill a chunk."""
    one = lambda k: F.concat(F.lit("Sentence "), F.lpad(k.cast("string"), 2, "0"), F.lit(" of page "), F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(" goes."))
    text = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), one), " ")
    return chunking.chunk_documents(I.documents(s, d).select("doc_id", text.alias("markdown"))).select("doc_id", "chunk_index", "content", "start_char")


@query("D08_windows", "WITH t AS (SELECT doc_id, 'd' || lpad(CAST(doc_id AS VARCHAR), 9, '0') || repeat(' alpha', 500) AS t FROM documents) SELECT doc_id, 0 AS chunk_index, substr(t, 1, 2044) AS content, 0 AS start_char FROM t UNION ALL SELECT doc_id, 1, substr(t, 1533), 1532 FROM t")
def d08(s, d):
    """A run of words without stop: windows cut at their last blank, which overlap."""
    text = F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.repeat(F.lit(" alpha"), F.lit(500)))
    return chunking.chunk_documents(I.documents(s, d).select("doc_id", text.alias("markdown"))).select("doc_id", "chunk_index", "content", "start_char")


@query("E01_built_facts", "SELECT doc_id, k AS fact_index, CASE k WHEN 0 THEN 'The gateway ' || doc_id || ' is a store of at most 20 entries.' ELSE 'Press the red button ' || doc_id || ' now' END AS content, CASE k WHEN 0 THEN 'DEF' ELSE 'PROC' END AS category, CASE k WHEN 0 THEN 0.65 ELSE 0.55 END AS confidence, 'Limits' AS heading FROM documents, (SELECT unnest([0, 1]) AS k)")
def e01b(s, d):
    """A definition, a hedge that is no fact and a list item, under a heading too short for a fact; the item comes once."""
    text = F.format_string("## Limits\n\nThe gateway %1$d is a store of at most 20 entries. Maybe it grows.\n\n- Press the red button %1$d now", "doc_id")
    made = FX.extract_facts(I.documents(s, d).select("doc_id", text.alias("markdown")))
    return made.select("doc_id", "fact_index", "content", "category", F.round("confidence", 6).alias("confidence"), "heading")
