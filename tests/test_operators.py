import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kelpwork.operators import evaluation as E
from kelpwork.operators import feedback as FB
from kelpwork.operators import judging as K
from kelpwork.operators import metrics as M
from kelpwork.operators import reporting as N
from kelpwork.operators import retrieval as R


def metric(spark, f, got, want, *k):
    df = spark.createDataFrame([(got, want)], "got array<bigint>, want array<bigint>")
    return df.select(f(F.col("got"), F.col("want"), *k)).first()[0]


@pytest.mark.parametrize(("f", "got", "want", "k", "value"), [
    (M.recall, [1, 2, 3], [2, 9], (3,), 0.5), (M.recall, [2, 2], [2], (2,), 2.0), (M.recall, [1], [], (1,), 0.0), (M.recall, [1, 2], [2], (0,), 0.0),
    (M.precision, [1, 2], [2], (5,), 0.5), (M.precision, [], [2], (5,), None), (M.precision, [1], [1], (0,), 0.0),
    (M.reciprocal_rank, [5, 6, 7], [7, 6], (), 0.5), (M.reciprocal_rank, [], [1], (), 0.0), (M.reciprocal_rank, [1], [], (), 0.0),
    (M.ndcg, [1, 2], [1, 2], (2,), 1.0), (M.ndcg, [3], [1, 1], (3,), 0.0), (M.ndcg, [1], [], (3,), 0.0), (M.hit, [4, 1], [1], (1,), 0.0), (M.hit, [4, 1], [1], (2,), 1.0),
])
def test_metrics(spark, f, got, want, k, value):
    assert metric(spark, f, got, want, *k) == (value if value is None else pytest.approx(value))


def test_dcg(spark):
    g = F.array(*(F.lit(float(x)) for x in (3, 2, 0, 1)))
    row = spark.range(1).select(M.dcg(g, 4).alias("a"), M.ideal_dcg(g, 2).alias("b")).first()
    assert row["a"] == pytest.approx(3 + 2 / math.log2(3) + 1 / math.log2(5)) and row["b"] == pytest.approx(3 + 2 / math.log2(3))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(1, 9), max_size=6, unique=True), st.lists(st.integers(1, 9), min_size=1, max_size=5, unique=True))
def test_metric_bounds(spark, got, want):
    for f, k in ((M.recall, (5,)), (M.ndcg, (5,)), (M.reciprocal_rank, ())):
        assert 0 <= metric(spark, f, got, want, *k) <= 1 + 1e-9


def test_latency_and_bands(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 101)], "p string, latency_ms double")
    r = M.latency_stats(df, "p").first()
    assert (r.min_ms, r.max_ms, r.median_ms, r.p95_ms, r.p99_ms) == (1, 100, 50.5, 95, 99)
    assert [spark.range(1).select(E.band(F.lit(x))).first()[0] for x in (0.8, 0.3, 0.1)] == ["high", "medium", "low"]


def test_failure_types(spark):
    rows = [(None, 4.0, False, True), (0.5, 4.0, True, False), (0.5, 4.0, False, False), (0.5, 4.0, True, True), (0.5, 3.0, False, None), (0.6, 2.9, False, True), (0.4, 3.0, False, True), (0.4, 2.0, True, True)]
    df = spark.createDataFrame(rows, "r double, m double, h boolean, a boolean").coalesce(1)
    got = [r[0] for r in df.select(K.failure_type(*map(F.col, "rmha"))).collect()]
    assert got == [None, "hallucination_failure", "retrieval_failure", "hallucination_failure", "normal", "generation_failure", "robust_generation", "retrieval_failure"]


def test_votes_and_replies(spark):
    votes = spark.createDataFrame([(1, 1, 1, 1, True, True), (1, 5, 5, 5, True, False), (1, 3, 3, 3, False, None), (2, 1, 1, 1, True, None), (2, 1, 1, 1, False, None)], "evaluation_id int, groundedness int, completeness int, correctness int, hallucination boolean, answerable boolean")
    got = {r.evaluation_id: r for r in K.with_mean(K.voted(votes)).collect()}
    assert got[1].hallucination is True and got[1].answerable is True and got[1].judge_mean == 3 and got[1].judge_std == 0
    assert got[2].hallucination is False and got[2].answerable is None
    body = '{"groundedness": 2, "completeness": 3, "%s": %d, "hallucination": "true", "answerable_from_context": false}'
    replies = [body % ("answer_quality", 4), "x ```json\n" + body % ("correctness", 5) + "\n``` y", "well " + body % ("answer_quality", 1) + " so", body % ("answer_quality", 9), "garbage", None]
    df = spark.createDataFrame([(r,) for r in replies], "reply string").coalesce(1)
    got = [r[0] for r in df.select(K.parsed_reply(F.col("reply"))).collect()]
    assert [g and g.correctness for g in got] == [4, 5, 1, None, None, None] and got[0].hallucination and got[0].answerable is False


def test_weights_and_lines(spark):
    m = spark.createDataFrame([(i, "down", "hallucination") for i in range(19)] + [(20, "down", "off_topic"), (21, "up", None), (22, None, None)], "id int, rating string, rating_category string")
    w = {r.id: r.training_weight for r in FB.rating_weights(m).collect()}
    assert w[0] == 1.8 and w[20] == pytest.approx(0.8 * 1.15) and w[21] == 1.0 and 22 not in w
    p = spark.createDataFrame([(1, "q", "c", "a", 4.0, True, 1.5), (2, "q", None, "b", None, True, 0.4), (3, "q", "c", "d", 5.0, False, 2.0), (4, "q", "c", "e", 3.0, True, None)], "id int, question string, context string, answer string, quality_score double, chosen boolean, training_weight double")
    got = sorted((r.id, r.copy) for r in FB.training_lines(p).collect())
    assert got == [(1, 1), (1, 2), (4, 1)]
    with pytest.raises(Exception, match="empty dataset"):
        FB.registered(spark.createDataFrame([], "base_model string, adapter_path string, dataset_size bigint, avg_quality_score double, active boolean"), p.where("false"), "b").collect()
    assert '"lora_r": 16' in FB.training_config("b", "d", "o")


def test_search_fusion_and_diversity(spark):
    items = spark.createDataFrame([(i, i // 2, f"c{i}", [1.0, i / 10], {"a": 1.0, str(i): 1.0}) for i in range(12)], "id bigint, document_id bigint, content string, dense array<double>, sparse map<string,double>")
    asked = spark.createDataFrame([(0, [1.0, 0.0], {"a": 1.0}), (1, None, {}), (2, [1.0, 1.1], {"9": 1.0})], "query_id bigint, dense array<double>, sparse map<string,double>")
    pool = R.dense_pool(asked, items, 3, dimension=2)
    assert {(r.query_id, r.id) for r in pool.collect()} == {(0, 0), (0, 1), (0, 2), (2, 11), (2, 10), (2, 9)}
    lists = spark.createDataFrame([(0, 1, 0, 1, 5, 0.9), (0, 1, 1, 2, 5, 0.8), (0, 2, 0, 2, 6, 0.5)], "query_id int, id int, list_no int, rank int, document_id int, score double")
    fused = {r.id: r.fused for r in R.fused(lists).collect()}
    assert fused[1] == pytest.approx(1 / 61 + 1 / 62) and fused[2] == pytest.approx(1 / 62)
    found = spark.createDataFrame([(0, 1, 1, 1.0, [1.0, 0.0]), (0, 2, 2, 0.99, [1.0, 0.0]), (0, 3, 3, 0.5, [0.0, 1.0])], "query_id int, id int, rank int, score double, dense array<double>")
    assert [r.id for r in R.diverse(found, 2).orderBy("place").collect()] == [1, 3]
    assert R.dense_pool(asked.where("false"), items, 3, dimension=2).count() == 0


def test_reports_do_not_fan_out(spark):
    d = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, domain string")
    c = spark.createDataFrame([(1, 1), (2, 1), (2, 1)], "id bigint, document_id bigint")
    f = spark.createDataFrame([(1, 1), (2, 1), (3, 2)], "id bigint, document_id bigint")
    r = N.mean_children(d, {"chunks": c, "facts": f}).first()
    assert (r.avg_chunks, r.avg_facts) == (1.0, 1.5)


def test_overlap_of_means_equals_mean_of_pairs(spark):
    a = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 2.0])], "query_id int, dense array<double>")
    b = spark.createDataFrame([(1, [3.0, 3.0])], "query_id int, dense array<double>")
    assert M.embedding_overlap(a, b).first().overlap == pytest.approx(0.707107)


def test_ids_are_decoded(spark):
    df = spark.createDataFrame([("[1,2]",), ('"[3]"',), ("no",), (None,)], "raw string").coalesce(1)
    assert [r[0] for r in df.select(E.decoded_ids(F.col("raw"))).collect()] == [[1, 2], [3], [], []]


def test_judge_sees_the_answer_behind_a_long_context(spark, tmp_path):
    from kelpwork.plans import quality

    rows = [(i, "chunk", "q", "x" * 9_000, "a" * i) for i in range(1, 6)]
    spark.createDataFrame(rows, "evaluation_id bigint, pipeline_name string, question string, retrieved_context string, generated_answer string").write.parquet(f"{tmp_path}/evaluation.parquet")
    assert len({r.groundedness for r in quality.k02(spark, str(tmp_path)).collect()}) == 5
