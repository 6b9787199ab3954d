import numpy as np
import pytest
from pyspark.sql import functions as F

from kelpwork.functions import chunking, models, terms, vectors
from kelpwork.functions import facts as FX
from kelpwork.operators import feedback, ingest, metrics, retrieval
from kelpwork.sources import sinks, tables

PAGE = "# Setup\n\nThe gateway stores 20 entries. It was changed on May 7.\n\n## Limits\n\nThe archive holds at most 40 files for each team, which is enough."


def test_pages_become_records(spark):
    pages = spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "doc_id bigint, markdown string")
    made = ingest.chunk_records(pages).collect()
    assert {r.doc_id for r in made} == {1} and all(len(r.dense_embedding) == 64 for r in made)
    assert np.allclose(made[0].dense_embedding, models.hashed_words([made[0].content])[0]) and made[0].sparse_vector == pytest.approx(terms.weigh(terms.stems(made[0].content)))
    found = ingest.fact_records(pages).collect()
    assert found and all(np.allclose(r.dense_embedding, models.hashed_words([f"[{r.heading}] {r.content}" if r.heading else r.content])[0]) for r in found)
    told = ingest.summary_records(spark.createDataFrame([(1, "word " * 100)], "id bigint, content string")).first()
    assert np.allclose(told.dense_embedding, models.hashed_words([told.summary])[0]) and told.token_count == 125


def test_outcomes_isolate_errors(spark):
    def model(texts):
        if any("broken" in t for t in texts):
            raise ValueError("no vector")
        return models.hashed_words(texts)

    docs = spark.createDataFrame([(1, "<p>x"), (2, None), (3, "<p>y"), (4, "<p>z")], "doc_id bigint, raw_html string")
    rows = ingest.embed_record(spark.createDataFrame([(1, "fine"), (3, "broken"), (3, "fine")], "doc_id bigint, content string"), F.col("content"), model=model)
    got = {(r.doc_id, r.pipeline): (r.n, r.without_vector, r.error) for r in ingest.outcomes(docs, {"chunk": rows, "fact": rows.where("doc_id = 1")}).collect()}
    assert got[1, "chunk"] == (1, 0, None) and got[2, "chunk"] == (0, 0, "no stored page") and got[3, "chunk"] == (2, 1, "embedding failed") and got[3, "fact"] == got[4, "chunk"] == (0, 0, None)


def test_appended_rows(spark, tmp_path):
    old = spark.createDataFrame([(1, "a", 0.5)], "id bigint, t string, w double")
    new = spark.createDataFrame([(1, "b"), (2, "c")], "id bigint, t string")
    assert sorted(map(tuple, sinks.appended(old, new).collect())) == [(1, "a", 0.5), (2, "c", None)]
    for part in (old.select("id", "t"), new):
        sinks.append_rows(part, str(tmp_path / "rows"))
    assert spark.read.parquet(str(tmp_path / "rows")).count() == 3


def test_messages_and_feedback(spark):
    kinds = "id bigint, session_id bigint, pipeline string, rating string, rating_category string, training_weight double, created_at timestamp"
    m = spark.createDataFrame([(i, 1, "chunk", "down", "irrelevant" if i else "off_topic", None, None) for i in range(20)], kinds)
    sessions = spark.createDataFrame([(1, "chunk", None)], "session_id bigint, pipeline string, created_at timestamp")
    more, named = feedback.saved_messages(m, spark.createDataFrame([(5, 1, "fact"), (20, 2, "fact")], "id bigint, session_id bigint, pipeline string").withColumn("created_at", F.lit("2024-01-01").cast("timestamp")), sessions)
    assert more.count() == 21 and more.where("id = 20").first().rating is None and {(r.session_id, r.pipeline) for r in named.collect()} == {(1, "chunk"), (2, "fact")}
    ratings = spark.createDataFrame([(1, "down", "off_topic"), (2, "up", "irrelevant"), (3, None, None)], "id bigint, rating string, rating_category string")
    got = {r.id: (r.rating, r.rating_category, r.training_weight) for r in feedback.saved_feedback(m, ratings).collect()}
    assert got[1] == ("down", "off_topic", pytest.approx(0.8 * 1.15)) and got[2] == ("up", None, 1.0) and got[3] == (None, None, None) and got[4][:2] == ("down", "irrelevant")


def test_measured():
    result, ms = metrics.measured(lambda: sum(range(1000)))
    assert result == 499500 and ms >= 0


def test_dense_pool_in_slices(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.repeat(rng.normal(size=(150, 4)), 2, axis=0)  # every vector twice: ties
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, dense array<double>").repartition(3)
    asked = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, 300, 25)], "query_id bigint, dense array<double>")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(q, int(i)) for q in range(0, 300, 25) for i in np.lexsort((np.arange(300), -np.round(u @ u[q], 9)))[:7]}
    for size in (1_024, 16):
        monkeypatch.setattr(retrieval, "SLICE", size)
        assert {(r.query_id, r.id) for r in retrieval.dense_pool(asked, items, 7, 4).collect()} == want


def test_fact_search_by_brute_force(spark):
    texts = ["the gateway stores entries", "gateways storing an entry", "a pipeline runs daily", "the daily run of pipelines", "nothing here"]
    df = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "id bigint, document_id bigint, content string")
    rows = ingest.embed_record(df, F.col("content")).select("id", "document_id", F.col("dense_embedding").alias("dense"), F.col("sparse_vector").alias("sparse"))
    got = {(r.query_id, r.id): r.score for r in retrieval.hybrid_search(rows.select(F.col("id").alias("query_id"), "dense", "sparse"), rows, 5).collect()}
    d, s = models.hashed_words(texts), [terms.weigh(terms.stems(t)) for t in texts]
    for a in range(5):
        for b in range(5):
            shared = sum(min(s[a][k], s[b][k]) for k in s[a].keys() & s[b].keys())
            whole = sum(s[a].values()) + sum(s[b].values()) - shared
            score = 0.7 * float(d[a] @ d[b]) + 0.3 * (shared / whole if whole else 0)
            assert got.get((a, b)) == (pytest.approx(score, abs=1e-6) if score >= 0.1 else None)


def test_strict_vectors_and_shared_folder(spark, monkeypatch):
    df = spark.createDataFrame([([1.0, 0.0], [1.0])], "x array<double>, y array<double>")
    with pytest.raises(Exception):
        df.select(vectors.cosine(F.col("x"), F.col("y"))).collect()
    assert df.select(vectors.cosine(F.col("x"), F.col("y"), strict=False).alias("c")).first().c == 0

    class Context:
        master = "spark://host:7077"
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context
        conf = {"spark.checkpoint.dir": None}

    with pytest.raises(ValueError):
        tables.checkpoint_dir(Session)


def test_strategy_and_heading(spark):
    assert [chunking.strategy(t)[0] for t in ("a\n\nb", "One. Two.", "one")] == ["paragraph", "sentence", "window"]
    df = spark.createDataFrame([(PAGE, "The archive holds at most 40 files"), (PAGE, "The gateway stores 20 entries."), (PAGE, "not there"), (None, "x")], "m string, s string")
    assert [r.h for r in df.select(FX.nearest_heading("m", "s").alias("h")).collect()] == ["Limits", "Setup", None, None]
