"""Queries over rankings, runs, judgements, feedback and preferences (I to M)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelpwork.operators import evaluation as E
from kelpwork.operators import feedback as FB
from kelpwork.operators import judging as K
from kelpwork.operators import metrics as M
from kelpwork.plans import inputs as I
from kelpwork.plans.inputs import EVAL, JUDGED, MESSAGES, PREFERENCES, RANKED, SUMMARIES, VOTED, VOTES, failure_weighted
from kelpwork.sources.tables import cut

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def _hits(k: str) -> str:
    return f"len(list_filter(got[1:{k}], lambda x: list_contains(want, x)))"


_RECALL = lambda k: f"CASE WHEN len(want) > 0 THEN {_hits(k)} / len(want) ELSE 0.0 END"
_PRECISION = lambda k: f"CASE WHEN len(got) > 0 THEN {_hits(k)} / least({k}, len(got)) END"
_MRR = "coalesce(1.0 / nullif(list_position(list_transform(got, lambda x: list_contains(want, x)), true), 0), 0.0)"
_DCG = "coalesce(list_sum(list_transform(got[1:10], lambda x, i: CASE WHEN list_contains(want, x) THEN 1.0 / log2(i + 1) ELSE 0.0 END)), 0.0)"
_IDEAL = "list_sum(list_transform(range(1, least(10, len(list_distinct(want))) + 1), lambda i: 1.0 / log2(i + 1)))"
_NDCG = f"CASE WHEN len(want) > 0 THEN {_DCG} / {_IDEAL} ELSE 0.0 END"
_HIT = lambda k: f"CASE WHEN {_hits(k)} > 0 THEN 1.0 ELSE 0.0 END"
_BUNDLE = f"""round({_RECALL('10')}, 6) AS recall_at_k, round({_RECALL('5')}, 6) AS recall_at_5, round({_RECALL('10')}, 6) AS recall_at_10, round({_MRR}, 6) AS mrr, round({_NDCG}, 6) AS ndcg,
  round({_PRECISION('10')}, 6) AS precision_at_k, {_HIT('1')} AS hit_at_1, {_HIT('5')} AS hit_at_5, {_HIT('10')} AS hit_at_10"""
_METRICS = f"WITH {RANKED}, metrics AS (SELECT evaluation_id, run_id, query_id, pipeline, category, difficulty, latency_ms, created_at, {_BUNDLE} FROM ranked) "


def _column(name: str, sql: str, make) -> None:
    """A query of one metric over the evaluated rankings."""
    QUERIES[name] = lambda s, d: I.ranked(s, d).select("evaluation_id", F.round(make(F.col("got"), F.col("want")), 6).alias("value"))
    SQL[name] = f"WITH {RANKED} SELECT evaluation_id, round({sql}, 6) AS value FROM ranked"


_column("I01_recall", _RECALL("5"), lambda g, w: M.recall(g, w, 5))
_column("I02_precision", _PRECISION("5"), lambda g, w: M.precision(g, w, 5))
_column("I03_mrr", _MRR, M.reciprocal_rank)
_column("I06_ndcg", _NDCG, lambda g, w: M.ndcg(g, w, 10))
_column("I07_hit", _HIT("3"), lambda g, w: M.hit(g, w, 3))
_column("I14_source_diversity", "CASE WHEN len(got) > 0 THEN len(list_distinct(got)) / least(len(got), 5) ELSE 0.0 END", lambda g, w: M.diversity(g, 5))
_column("I17_result_overlap", "CASE WHEN len(got) > 0 AND len(want) > 0 THEN len(list_intersect(got, want)) / len(list_distinct(list_concat(got, want))) ELSE 0.0 END", M.overlap)


@query("I04_dcg", f"WITH {RANKED} SELECT evaluation_id, round(coalesce(list_sum(list_transform(got[1:5], lambda x, i: (x % 4) / log2(i + 1))), 0.0), 6) AS value FROM ranked")
def i04(s, d):
    return I.ranked(s, d).select("evaluation_id", F.round(M.dcg(F.transform("got", lambda x: (x % 4).cast("double")), 5), 6).alias("value"))


@query("I05_ideal_dcg", f"WITH {RANKED} SELECT evaluation_id, round(coalesce(list_sum(list_transform(list_reverse_sort(list_transform(got, lambda x: x % 4))[1:5], lambda g, i: g / log2(i + 1))), 0.0), 6) AS value FROM ranked")
def i05(s, d):
    return I.ranked(s, d).select("evaluation_id", F.round(M.ideal_dcg(F.transform("got", lambda x: (x % 4).cast("double")), 5), 6).alias("value"))


def _metrics(s, d):
    return M.query_metrics(I.ranked(s, d).drop("recall_at_k"))


@query("I08_query_metrics", _METRICS + "SELECT evaluation_id, query_id, pipeline, " + ", ".join(M.MEASURES) + " FROM metrics")
def i08(s, d):
    return _metrics(s, d).select("evaluation_id", "query_id", "pipeline", *M.MEASURES)


_MEANS = ", ".join(f"round(avg(coalesce({m}, 0.0)), 6) AS {m}" for m in M.MEASURES)


@query("I09_mean_metrics", _METRICS + f"SELECT pipeline, {_MEANS} FROM metrics GROUP BY pipeline")
def i09(s, d):
    return M.mean_metrics(_metrics(s, d).select("pipeline", *M.MEASURES), "pipeline")


@query("I10_latency", f"WITH {EVAL} SELECT pipeline_name, min(latency_ms) AS min_ms, max(latency_ms) AS max_ms, round(avg(latency_ms), 6) AS mean_ms, round(median(latency_ms), 6) AS median_ms, quantile_disc(latency_ms, 0.95) AS p95_ms, quantile_disc(latency_ms, 0.99) AS p99_ms FROM ev GROUP BY pipeline_name")
def i10(s, d):
    return M.latency_stats(I.evaluation(s, d), "pipeline_name")


@query("I12_compared", _METRICS + f", means AS (SELECT pipeline, {_MEANS} FROM metrics GROUP BY pipeline) SELECT " + ", ".join(f"round(a.{m} - b.{m}, 6) AS {m}_diff, a.{m} > b.{m} AS {m}_better" for m in ("recall_at_k", "mrr", "ndcg")) + " FROM means a, means b WHERE a.pipeline = 'fact' AND b.pipeline = 'chunk'")
def i12(s, d):
    return M.compared(QUERIES["I09_mean_metrics"](s, d), "fact", "chunk")


def _retrieved(s, d):
    e = I.ranked(s, d).select("query_id", "pipeline", F.explode("got").alias("document_id"))
    c = I.chunks(s, d).select("id", "document_id")
    return e.distinct().join(c, "document_id")


@query("I13_coverage", f"""WITH {RANKED}, {I.CHUNKS}, e AS (SELECT DISTINCT query_id, pipeline, unnest(got) AS document_id FROM ranked), r AS (SELECT e.*, c.id FROM e JOIN chunks c USING (document_id)),
n AS (SELECT query_id, pipeline, document_id, count(*) AS n FROM r GROUP BY ALL), w AS (SELECT query_id, len(expected_document_ids) AS wanted, unnest(list_distinct(expected_document_ids)) AS document_id FROM test_queries)
SELECT query_id, pipeline, round(avg(n), 6) AS avg_chunks, round(count(*) FILTER (WHERE n >= 2) / max(wanted), 6) AS share_of_several FROM n JOIN w USING (query_id, document_id) GROUP BY ALL""")
def i13(s, d):
    return M.coverage(_retrieved(s, d), I.queries(s, d).select("query_id", F.col("expected_document_ids").alias("want")))


@query("I15_summary_compression", f"WITH {SUMMARIES} SELECT count(*) AS n, round(avg(coalesce(CASE WHEN token_count > 0 AND summary_token_count > 0 THEN token_count / summary_token_count END, 1.0)), 6) AS mean_ratio, round(min(coalesce(CASE WHEN token_count > 0 AND summary_token_count > 0 THEN token_count / summary_token_count END, 1.0)), 6) AS least, round(max(coalesce(CASE WHEN token_count > 0 AND summary_token_count > 0 THEN token_count / summary_token_count END, 1.0)), 6) AS largest FROM summaries")
def i15(s, d):
    from kelpwork.functions.vectors import compression

    r = compression(F.col("token_count"), F.col("summary_token_count"))
    return I.summaries(s, d).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(r), 6).alias("mean_ratio"), F.round(F.min(r), 6).alias("least"), F.round(F.max(r), 6).alias("largest"))


@query("I16_fact_compression", f"WITH {I.FACTS} SELECT id, round(coalesce(CASE WHEN length(content) > 0 AND length(coalesce(source_context, content)) > 0 THEN length(content) / length(coalesce(source_context, content)) END, 1.0), 6) AS ratio FROM facts")
def i16(s, d):
    from kelpwork.functions.vectors import compression

    return I.facts(s, d).select("id", F.round(compression(F.length("content"), F.length(F.coalesce("source_context", "content"))), 6).alias("ratio"))


@query("I18_embedding_overlap", f"""WITH {I.CHUNKS}, {I.FACTS}, a AS (SELECT document_id, dense_embedding AS x FROM chunks WHERE len(dense_embedding) = 64 AND list_dot_product(dense_embedding, dense_embedding) > 0),
b AS (SELECT document_id, dense_embedding AS y FROM facts WHERE len(dense_embedding) = 64 AND list_dot_product(dense_embedding, dense_embedding) > 0)
SELECT document_id AS query_id, round(avg(list_cosine_similarity(x, y)), 6) AS overlap FROM a JOIN b USING (document_id) GROUP BY document_id""")
def i18(s, d):
    a, b = (I.items(s, d, p).select(F.col("document_id").alias("query_id"), "dense") for p in ("chunk", "fact"))
    return M.embedding_overlap(a, b)


@query("J01_availability", f"WITH {I.CHUNKS}, {I.FACTS} SELECT 'chunk' AS pipeline, count(*) AS items, count(*) > 0 AS active FROM chunks UNION ALL SELECT 'fact', count(*), count(*) > 0 FROM facts UNION ALL SELECT 'llm', count(*), count(*) > 0 FROM chunks")
def j01(s, d):
    return E.availability({"chunk": I.chunks(s, d), "fact": I.facts(s, d), "llm": I.summaries(s, d)})


@query("J03_distinct_documents", f"""WITH {I.CHUNKS}, f AS (SELECT metadata.chunktype AS kind, document_id, id AS rank FROM chunks), g AS (SELECT kind, document_id, min(rank) AS rank FROM f GROUP BY ALL)
SELECT kind, sum(document_id * n) AS weighted, count(*) AS documents FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY rank, document_id) AS n FROM g) GROUP BY kind""")
def j03(s, d):
    f = I.chunks(s, d).select(F.col("metadata.chunktype").alias("kind"), "document_id", F.col("id").alias("rank"))
    from pyspark.sql import Window as W

    g = f.groupBy("kind", "document_id").agg(F.min("rank").alias("rank")).withColumn("n", F.row_number().over(W.partitionBy("kind").orderBy("rank", "document_id")))
    return g.groupBy("kind").agg(F.sum(F.col("document_id") * F.col("n")).alias("weighted"), F.count(F.lit(1)).alias("documents"))


@query("J04_decoded_ids", f"WITH {EVAL} SELECT evaluation_id, CASE WHEN evaluation_id % 3 = 2 THEN []::BIGINT[] ELSE retrieved_doc_ids END AS ids FROM ev")
def j04(s, d):
    raw = F.to_json("retrieved_doc_ids")
    i = F.col("evaluation_id") % 3
    text = F.when(i == 0, raw).when(i == 1, F.concat(F.lit('"'), raw, F.lit('"'))).otherwise("not json")
    return I.evaluation(s, d).select("evaluation_id", E.decoded_ids(text).alias("ids"))


_JM = ("recall_at_k", "mrr", "ndcg")


@query("J05_rollup", _METRICS + "SELECT pipeline, count(*) AS queries, " + ", ".join(f"round(avg(coalesce({m}, 0.0)), 6) AS {m}" for m in _JM) + ", CAST(floor(avg(latency_ms) + 0.5) AS BIGINT) AS mean_latency_ms, min(latency_ms) AS min_latency_ms, max(latency_ms) AS max_latency_ms FROM metrics GROUP BY pipeline")
def j05(s, d):
    return E.rollup(_bundle(s, d), _JM)


def _bundle(s, d):
    return M.query_metrics(I.ranked(s, d).drop("recall_at_k"))


@query("J08_latest_runs", f"WITH {EVAL} SELECT run_id, count(*) AS evaluations, epoch_us(max(created_at)) AS completed_at FROM ev GROUP BY run_id ORDER BY completed_at DESC, run_id DESC LIMIT 50")
def j08(s, d):
    return I.evaluation(s, d).groupBy("run_id").agg(F.count(F.lit(1)).alias("evaluations"), F.unix_micros(F.max("created_at")).alias("completed_at")).orderBy(F.desc("completed_at"), F.desc("run_id")).limit(50)


@query("J09_results_by_pipeline", f"WITH {RANKED} SELECT pipeline, category, count(*) AS results, count(DISTINCT query_id) AS queries FROM ranked GROUP BY ALL")
def j09(s, d):
    return I.ranked(s, d).groupBy("pipeline", "category").agg(F.count(F.lit(1)).alias("results"), F.count_distinct("query_id").alias("queries"))


@query("J10_query_pivot", _METRICS + "SELECT query_id, " + ", ".join(f"round(avg(ndcg) FILTER (WHERE pipeline = '{p}'), 6) AS {p}" for p in ("chunk", "fact", "llm")) + " FROM metrics GROUP BY query_id")
def j10(s, d):
    return E.pivoted(_bundle(s, d), "ndcg")


@query("J11_category_breakdown", _METRICS + "SELECT coalesce(category, 'uncategorized') AS category, pipeline, count(*) AS queries, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in _JM) + " FROM metrics GROUP BY 1, 2")
def j11(s, d):
    return E.breakdown(_bundle(s, d), "category", _JM)


@query("J11_difficulty_breakdown", _METRICS + "SELECT coalesce(difficulty, 'uncategorized') AS difficulty, pipeline, count(*) AS queries, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in _JM) + " FROM metrics GROUP BY 1, 2")
def j11b(s, d):
    return E.breakdown(_bundle(s, d), "difficulty", _JM)


_RUNS = "runs AS (SELECT run_id, pipeline, min(created_at) AS started_at, round(avg(recall_at_k), 6) AS recall_at_k, round(avg(mrr), 6) AS mrr, round(avg(latency_ms), 6) AS latency_ms FROM metrics GROUP BY run_id, pipeline)"


@query("J12_run_delta", _METRICS + f", {_RUNS}, t AS (SELECT *, row_number() OVER (PARTITION BY pipeline ORDER BY started_at DESC, run_id DESC) AS n FROM runs), x AS (SELECT a.pipeline, " + ", ".join(f"round(a.{m} - b.{m}, 6) AS {m}" for m in ("recall_at_k", "mrr", "latency_ms")) + " FROM t a JOIN t b USING (pipeline) WHERE a.n = 1 AND b.n = 2) SELECT pipeline, CASE WHEN abs(recall_at_k) < 0.005 THEN 0.0 ELSE recall_at_k END AS recall_at_k, CASE WHEN abs(mrr) < 0.005 THEN 0.0 ELSE mrr END AS mrr, CASE WHEN abs(latency_ms) < 1 THEN 0.0 ELSE latency_ms END AS latency_ms FROM x")
def j12(s, d):
    runs = _bundle(s, d).groupBy("run_id", "pipeline").agg(F.min("created_at").alias("started_at"), *(F.round(F.avg(m), 6).alias(m) for m in ("recall_at_k", "mrr", "latency_ms")))
    return E.run_delta(runs, ("recall_at_k", "mrr", "latency_ms"))


@query("J13_score_bands", _METRICS + "SELECT CASE WHEN recall_at_k >= 0.8 THEN 'high' WHEN recall_at_k >= 0.3 THEN 'medium' ELSE 'low' END AS band, count(*) AS n FROM metrics GROUP BY 1")
def j13(s, d):
    return _bundle(s, d).groupBy(E.band(F.col("recall_at_k")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("K01_unjudged", f"WITH {EVAL} SELECT evaluation_id, pipeline_name FROM ev WHERE evaluation_id % 8 = 7 AND generated_answer NOT LIKE '[Generation failed%' AND pipeline_name IN ('chunk', 'fact')")
def k01(s, d):
    e = I.evaluation(s, d)
    return K.unjudged(e, e.where("evaluation_id % 8 <> 7"), ["chunk", "fact"], most=None).select("evaluation_id", "pipeline_name")


@query("K03_parsed_reply", f"WITH {EVAL} SELECT evaluation_id, CAST(1 + evaluation_id % 5 AS DOUBLE) AS groundedness, evaluation_id % 2 = 0 AS hallucination FROM ev WHERE evaluation_id % 4 < 3 AND evaluation_id % 7 < 5")
def k03(s, d):
    i = F.col("evaluation_id")
    body = F.format_string('{"groundedness": %d, "completeness": 3, "%s": %d, "hallucination": %s}', 1 + i % 5, F.when(i % 3 == 0, "correctness").otherwise("answer_quality"), 1 + i % 7, F.when(i % 2 == 0, F.when(i % 6 == 0, '"true"').otherwise("true")).otherwise("false"))
    reply = F.when(i % 4 == 0, body).when(i % 4 == 1, F.concat(F.lit("Verdict:\n```json\n"), body, F.lit("\n```\n"))).when(i % 4 == 2, F.concat(F.lit("I would say "), body, F.lit(" overall."))).otherwise("no scores")
    r = I.evaluation(s, d).select("evaluation_id", K.parsed_reply(reply).alias("r")).where("r IS NOT NULL")
    return r.select("evaluation_id", "r.groundedness", "r.hallucination")


@query("K04_votes", f"WITH {VOTED} SELECT evaluation_id, round(g, 6) AS groundedness, round(c, 6) AS completeness, round(q, 6) AS correctness, h AS hallucination, a AS answerable FROM voted")
def k04(s, d):
    return K.voted(I.votes(s, d)).select("evaluation_id", *(F.round(c, 6).alias(c) for c in ("groundedness", "completeness", "correctness")), "hallucination", "answerable")


@query("K05_mean_std", f"WITH {VOTED} SELECT evaluation_id, round(m, 6) AS judge_mean, round(sd, 6) AS judge_std FROM deviated")
def k05(s, d):
    return K.with_mean(K.voted(I.votes(s, d))).select("evaluation_id", F.round("judge_mean", 6).alias("judge_mean"), F.round("judge_std", 6).alias("judge_std"))


@query("K06_refusals", f"WITH {EVAL} SELECT evaluation_id, {I._refusal_sql('generated_answer')} AS refusal FROM ev WHERE generated_answer IS NOT NULL")
def k06(s, d):
    return I.evaluation(s, d).where("generated_answer IS NOT NULL").select("evaluation_id", K.is_refusal(F.col("generated_answer")).alias("refusal"))


@query("K08_failure_type", f"WITH {JUDGED} SELECT evaluation_id, failure_type FROM judged")
def k08(s, d):
    return I.judged(s, d).select("evaluation_id", "failure_type")


@query("K09_stored_scores", f"WITH {JUDGED} SELECT evaluation_id, groundedness, completeness, correctness, judge_mean, judge_std FROM judged")
def k09(s, d):
    return I.judged(s, d).select("evaluation_id", "groundedness", "completeness", "correctness", "judge_mean", "judge_std")


@query("K10_filled_recall", f"WITH {JUDGED} SELECT evaluation_id, round(recall_at_k, 6) AS recall_at_k FROM judged")
def k10(s, d):
    return I.judged(s, d).select("evaluation_id", F.round("recall_at_k", 6).alias("recall_at_k"))


_STALE = "CASE WHEN evaluation_id % 9 = 0 THEN NULL WHEN evaluation_id % 9 = 1 THEN 'content_gap' WHEN evaluation_id % 9 = 2 THEN 'robust_generation' WHEN evaluation_id % 9 = 3 THEN 'generation_failure' ELSE failure_type END"


@query("K11_repaired", f"""WITH {JUDGED}, stale AS (SELECT * REPLACE ({_STALE} AS failure_type), failure_type AS t0, recall_at_k AS r, hallucination AS h, answerable AS a, judge_mean AS m FROM judged),
s AS (SELECT evaluation_id, failure_type AS old_type, {I._TYPE} AS failure_type FROM stale WHERE failure_type IS NULL OR (failure_type = 'robust_generation' AND m < 3) OR (failure_type = 'generation_failure' AND r < 0.5)
  OR (failure_type IN ('normal', 'generation_failure') AND h AND r >= 0.5) OR (failure_type = 'retrieval_failure' AND h AND NOT a AND r >= 0.5) OR failure_type = 'content_gap')
SELECT * FROM s WHERE failure_type IS NOT NULL AND failure_type IS DISTINCT FROM old_type""")
def k11(s, d):
    return K.repaired(I.judged(s, d).withColumn("failure_type", F.expr(_STALE)))


def _sql_quality(by: str, where: str = "true") -> str:
    mean = ", ".join(f"round(coalesce(avg(nullif({c}, 0)), 0), 6) AS mean_{c}" for c in ("groundedness", "correctness", "completeness"))
    counts = ", ".join(f"count(*) FILTER (WHERE failure_type = '{t}') AS {t}" for t in K.FAILURES)
    return f"SELECT {by}, {mean}, round(coalesce(avg(CASE WHEN hallucination THEN 1.0 ELSE 0.0 END) FILTER (WHERE judge_mean > 0), 0), 6) AS hallucination_rate, round(coalesce(avg(nullif(judge_mean, 0)), 0), 6) AS mean_judge_mean, count(*) FILTER (WHERE judge_mean > 0) AS judged, {counts}, count(*) FILTER (WHERE failure_type IS NULL) AS unclassified FROM judged WHERE {where} GROUP BY {by}".replace("mean_judge_mean", "mean_judge")


@query("K12_quality", f"WITH {JUDGED} " + _sql_quality("pipeline_name"))
def k12(s, d):
    return K.quality(I.judged(s, d), "pipeline_name")


@query("K13_quality_by_run", f"WITH {JUDGED} " + _sql_quality("run_id, pipeline_name"))
def k13(s, d):
    return K.quality(I.judged(s, d), "run_id", "pipeline_name")


@query("K14_latest_judged_runs", f"WITH {JUDGED} SELECT run_id, epoch_us(min(created_at)) AS started_at FROM judged GROUP BY run_id ORDER BY started_at DESC, run_id DESC LIMIT 2")
def k14(s, d):
    return K.latest_runs(I.judged(s, d)).withColumn("started_at", F.unix_micros("started_at"))


@query("K15_results_of_run", f"WITH {JUDGED} SELECT evaluation_id, pipeline_name, question, judge_mean FROM judged WHERE run_id = (SELECT max(run_id) FROM judged)")
def k15(s, d):
    j = I.judged(s, d)
    return j.join(j.agg(F.max("run_id").alias("run_id")), "run_id", "left_semi").select("evaluation_id", "pipeline_name", "question", "judge_mean")


@query("K16_details", f"WITH {JUDGED} SELECT evaluation_id, substr(generated_answer, 1, 500) AS generated_answer FROM judged WHERE failure_type IS NULL AND pipeline_name = 'chunk' ORDER BY created_at DESC, evaluation_id DESC LIMIT 200")
def k16(s, d):
    return K.details(I.judged(s, d), "unclassified", "chunk").select("evaluation_id", "generated_answer")


@query("K17_best_pipeline", f"WITH {JUDGED}, m AS ({_sql_quality('pipeline_name')}), l AS (SELECT pipeline_name, 'mean_judge' AS measure, mean_judge AS v FROM m UNION ALL SELECT pipeline_name, 'mean_groundedness', mean_groundedness FROM m UNION ALL SELECT pipeline_name, 'hallucination_rate', -hallucination_rate FROM m) SELECT measure, pipeline_name AS best FROM (SELECT *, row_number() OVER (PARTITION BY measure ORDER BY v DESC, pipeline_name) AS n FROM l) WHERE n = 1")
def k17(s, d):
    return K.best_pipeline(K.quality(I.judged(s, d), "pipeline_name"), ("mean_judge", "mean_groundedness"), ("hallucination_rate",))


@query("K18_run_delta", f"WITH {JUDGED}, m AS ({_sql_quality('run_id, pipeline_name')}), r AS (SELECT run_id, row_number() OVER (ORDER BY min(created_at) DESC, run_id DESC) AS n FROM judged GROUP BY run_id) SELECT a.pipeline_name, round(a.mean_judge - b.mean_judge, 6) AS mean_judge, round(a.hallucination_rate - b.hallucination_rate, 6) AS hallucination_rate, round(a.judged - b.judged, 6) AS judged FROM m a JOIN r x ON a.run_id = x.run_id AND x.n = 1 JOIN m b ON a.pipeline_name = b.pipeline_name JOIN r y ON b.run_id = y.run_id AND y.n = 2")
def k18(s, d):
    j = I.judged(s, d)
    two = K.latest_runs(j)
    q = K.quality(j.join(two.select("run_id"), "run_id", "left_semi"), "run_id", "pipeline_name").join(two, "run_id")
    newest = two.agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id"))
    return K.delta(q.join(newest, "run_id", "left_semi"), q.join(newest, "run_id", "left_anti"), ("mean_judge", "hallucination_rate", "judged"))


@query("K19_failure_share", f"WITH {JUDGED} SELECT pipeline_name, round(coalesce(count(*) FILTER (WHERE failure_type = 'retrieval_failure') * 100.0 / nullif(count(*), 0), 0), 6) AS share FROM judged GROUP BY pipeline_name")
def k19(s, d):
    return I.judged(s, d).groupBy("pipeline_name").agg(F.round(K.share(F.count_if(F.col("failure_type") == "retrieval_failure"), F.count(F.lit(1))), 6).alias("share"))


_CATEGORY_BASE = "CASE rating_category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in FB.CATEGORY_WEIGHTS.items()) + " ELSE 1.0 END"


@query("L01_rating_weights", f"WITH {MESSAGES}, c AS (SELECT *, count(rating_category) OVER (PARTITION BY rating_category) AS n, count(rating_category) OVER () AS total FROM messages WHERE rating IS NOT NULL) SELECT id, round(CASE WHEN rating_category IS NULL THEN 1.0 ELSE greatest(least({_CATEGORY_BASE} * CASE WHEN n / total < 0.1 THEN least(1 + (0.1 - n / total) * 3, 1.3) ELSE 1 END, 2.0), 0.3) END, 6) AS training_weight FROM c")
def l01(s, d):
    return FB.rating_weights(I.messages(s, d)).select("id", F.round("training_weight", 6).alias("training_weight"))


@query("L02_failure_weights", f"WITH {JUDGED}, {failure_weighted('w', 'judged')} SELECT evaluation_id, round(weight, 6) AS training_weight FROM w")
def l02(s, d):
    return FB.failure_weights(I.judged(s, d)).select("evaluation_id", F.round("training_weight", 6).alias("training_weight"))


@query("L03_failure_histogram", f"WITH {JUDGED} SELECT failure_type, count(*) AS n FROM judged WHERE failure_type IS NOT NULL GROUP BY failure_type")
def l03(s, d):
    return FB.histogram(I.judged(s, d), "failure_type")


@query("L04_category_histogram", f"WITH {MESSAGES} SELECT rating_category, count(*) AS n FROM messages WHERE rating = 'down' AND rating_category IS NOT NULL GROUP BY 1")
def l04(s, d):
    return FB.histogram(I.messages(s, d).where("rating = 'down'"), "rating_category")


@query("L08_page", f"WITH {MESSAGES} SELECT id, pipeline FROM messages WHERE reviewed_at IS NULL ORDER BY created_at DESC, id DESC LIMIT 20 OFFSET 20")
def l08(s, d):
    return FB.page(I.messages(s, d), 2, 20, reviewed=False).select("id", "pipeline")


@query("L09_conversation_stats", f"WITH {MESSAGES} SELECT pipeline, count(*) AS total, count(*) FILTER (WHERE rating = 'up') AS up, count(*) FILTER (WHERE rating = 'down') AS down, count(*) FILTER (WHERE rating IS NULL) AS unrated, count(reviewed_at) AS reviewed FROM messages GROUP BY pipeline")
def l09(s, d):
    return FB.conversation_stats(I.messages(s, d), "pipeline")


@query("L11_exported", f"WITH {MESSAGES} SELECT id AS chat_message_id, substr(array_to_string(context, chr(10) || chr(10)), 1, 10000) AS context, rating = 'up' AS chosen, rating = 'down' AS rejected, 1.0 AS training_weight FROM messages WHERE rating IS NOT NULL")
def l11(s, d):
    return FB.exported(I.messages(s, d)).select("chat_message_id", "context", "chosen", "rejected", "training_weight")


@query("M01_labels", f"WITH {JUDGED} SELECT evaluation_id, judge_mean >= 3.5 AND NOT hallucination AND failure_type IS DISTINCT FROM 'retrieval_failure' AS chosen, judge_mean < 2.5 OR hallucination AS rejected FROM judged")
def m01(s, d):
    chosen, rejected = FB.label(F.col("judge_mean"), F.col("hallucination"), F.col("failure_type"))
    return I.judged(s, d).select("evaluation_id", chosen.alias("chosen"), rejected.alias("rejected"))


@query("M02_new_preferences", f"WITH {PREFERENCES}, {failure_weighted('w', 'judged')} SELECT evaluation_id, judge_mean AS quality_score, judge_mean >= 3.5 AND NOT hallucination AND failure_type IS DISTINCT FROM 'retrieval_failure' AS chosen, round(weight, 6) AS training_weight FROM w WHERE evaluation_id NOT IN (SELECT evaluation_id FROM preferences WHERE evaluation_id IS NOT NULL)")
def m02(s, d):
    j = cut(I.judged(s, d))  # read four times below
    return FB.new_preferences(j, I.preferences(s, d, j)).select("evaluation_id", "quality_score", "chosen", F.round("training_weight", 6).alias("training_weight"))


@query("M03_drifted", f"WITH {PREFERENCES}, {failure_weighted('w', 'judged')}, n AS (SELECT p.id, p.evaluation_id, w.judge_mean AS quality_score, w.judge_mean >= 3.5 AND NOT w.hallucination AND w.failure_type IS DISTINCT FROM 'retrieval_failure' AS chosen, w.judge_mean < 2.5 OR w.hallucination AS rejected, round(coalesce(p.training_weight, w.weight), 6) AS training_weight, p.quality_score AS s0, p.chosen AS c0, p.rejected AS r0 FROM preferences p JOIN w ON p.evaluation_id = w.evaluation_id) SELECT id, evaluation_id, quality_score, chosen, rejected, training_weight FROM n WHERE quality_score IS DISTINCT FROM s0 OR chosen IS DISTINCT FROM c0 OR rejected IS DISTINCT FROM r0")
def m03(s, d):
    j = cut(I.judged(s, d))
    return FB.drifted(I.preferences(s, d, j), j).withColumn("training_weight", F.round("training_weight", 6))


@query("M04_training_lines", f"WITH {PREFERENCES} SELECT id, generate_series AS copy FROM preferences, generate_series(1, 3) WHERE chosen AND generate_series <= CAST(floor(coalesce(training_weight, 1.0) + 0.5) AS INTEGER)")
def m04(s, d):
    return FB.training_lines(I.preferences(s, d), most=None).select("id", "copy")


@query("M04_training_text", f"WITH {PREFERENCES} SELECT id, generate_series AS copy, to_json({{'messages': [{{'role': 'system', 'content': 'Answer only using the provided context.'}}, {{'role': 'user', 'content': 'Question: ' || question || chr(10) || 'Context: ' || substr(coalesce(context, ''), 1, 6000)}}, {{'role': 'assistant', 'content': answer}}]}}) AS line FROM preferences, generate_series(1, 3) WHERE chosen AND generate_series <= CAST(floor(coalesce(training_weight, 1.0) + 0.5) AS INTEGER)")
def m04b(s, d):
    return FB.training_lines(I.preferences(s, d), most=None)


@query("M05_relinked", f"WITH {PREFERENCES}, o AS (SELECT id, question, answer FROM preferences WHERE evaluation_id IS NULL), r AS (SELECT o.id, e.evaluation_id, row_number() OVER (PARTITION BY o.id ORDER BY e.created_at DESC, e.evaluation_id DESC) AS n FROM o JOIN ev e ON o.question = e.question AND o.answer = e.generated_answer) SELECT id, evaluation_id FROM r WHERE n = 1")
def m05(s, d):
    return FB.relinked(I.preferences(s, d), I.evaluation(s, d))


@query("M06_unmatched", f"WITH {PREFERENCES} SELECT id FROM preferences p WHERE evaluation_id IS NULL AND NOT EXISTS (SELECT 1 FROM ev e WHERE e.question = p.question)")
def m06(s, d):
    return FB.unmatched(I.preferences(s, d), I.evaluation(s, d)).select("id")


@query("M07_samples", f"WITH {PREFERENCES}, t AS (SELECT * FROM preferences ORDER BY created_at DESC, id DESC LIMIT 50) SELECT t.id, t.source, coalesce((SELECT pipeline_name FROM ev e WHERE e.evaluation_id = t.evaluation_id), (SELECT arg_max(pipeline_name, (created_at, evaluation_id)) FROM ev e WHERE e.question = t.question)) AS pipeline_name FROM t")
def m07(s, d):
    return FB.samples(I.preferences(s, d), I.evaluation(s, d)).select("id", "source", "pipeline_name")


@query("M08_preference_stats", f"WITH {PREFERENCES} SELECT source, count(*) AS total, count(*) FILTER (WHERE chosen) AS chosen, count(*) FILTER (WHERE rejected) AS rejected, count(*) FILTER (WHERE NOT chosen AND NOT rejected) AS neutral, round(avg(quality_score), 6) AS mean_score FROM preferences GROUP BY source")
def m08(s, d):
    return FB.preference_stats(I.preferences(s, d), "source")


@query("M09_without_pipelines", f"WITH {PREFERENCES} SELECT id FROM preferences WHERE evaluation_id IS NULL OR evaluation_id NOT IN (SELECT evaluation_id FROM ev WHERE pipeline_name = 'llm')")
def m09(s, d):
    return FB.without_pipelines(I.preferences(s, d), I.evaluation(s, d), ["llm"]).select("id")


@query("M10_register_model", f"WITH {PREFERENCES} SELECT 'base' AS base_model, count(*) AS dataset_size, round(avg(quality_score), 6) AS avg_quality_score, true AS active FROM preferences WHERE chosen")
def m10(s, d):
    models = s.createDataFrame([], "base_model string, adapter_path string, dataset_size bigint, avg_quality_score double, active boolean")
    return FB.activated(FB.registered(models, I.preferences(s, d), "base"), "base_model", "base").drop("adapter_path")


@query("K02_judge_calls", f"WITH {EVAL}, p AS (SELECT evaluation_id, length(concat_ws(chr(10), question, substr(retrieved_context, 1, 8000), generated_answer)) + 1 AS n FROM ev WHERE generated_answer IS NOT NULL) SELECT evaluation_id, 1.0 + n % 5 AS groundedness, 3.0 AS completeness, 1.0 + n % 4 AS correctness, false AS hallucination, CAST(NULL AS BOOLEAN) AS answerable FROM p")
def k02(s, d):
    """Three calls a row through the model interface; the stand-in judge replies with scores from the answer's length."""
    from kelpwork.functions import models

    def judge(prompts):
        return ['{"groundedness": %d, "completeness": 3, "answer_quality": %d, "hallucination": false}' % (1 + len(p) % 5, 1 + len(p) % 4) for p in prompts]

    e = I.evaluation(s, d).where("generated_answer IS NOT NULL").select("evaluation_id", F.concat_ws("\n", "question", F.substring("retrieved_context", 1, 8000), "generated_answer").alias("prompt"), F.explode(F.array(*(F.lit(v) for v in range(3)))).alias("v"))
    replies = e.select("evaluation_id", K.parsed_reply(models.generate(F.concat("prompt", F.col("v").cast("string")), judge)).alias("r")).where("r IS NOT NULL")
    return K.voted(replies.select("evaluation_id", "r.*"))


@query("K07_refusal_override", f"WITH {JUDGED} SELECT evaluation_id, answerable FROM judged")
def k07(s, d):
    return I.judged(s, d).select("evaluation_id", "answerable")


_BASE = "CASE r.rating_category " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in FB.CATEGORY_WEIGHTS.items()) + " ELSE 1.0 END"


@query("L07_feedback", f"WITH {MESSAGES}, bad AS (SELECT rating_category AS c, count(*) AS n, sum(count(*)) OVER () AS total FROM messages WHERE rating = 'down' AND rating_category IS NOT NULL GROUP BY 1), whole AS (SELECT count(*) AS total FROM messages WHERE rating = 'down' AND rating_category IS NOT NULL), r AS (SELECT id, CASE id % 15 WHEN 0 THEN 'down' WHEN 5 THEN 'up' END AS rating, CASE WHEN id % 15 = 0 THEN ['hallucination', 'off_topic', 'misleading'][id // 15 % 3 + 1] END AS rating_category FROM messages WHERE id % 5 = 0), w AS (SELECT r.*, CASE WHEN r.rating IS NULL THEN NULL WHEN r.rating_category IS NULL THEN 1.0 ELSE greatest(least({_BASE} * CASE WHEN coalesce(b.n, 0) / t.total < 0.1 THEN least(1 + (0.1 - coalesce(b.n, 0) / t.total) * 3, 1.3) ELSE 1 END, 2.0), 0.3) END AS weight FROM r LEFT JOIN bad b ON r.rating_category = b.c, whole t) SELECT m.id, CASE WHEN w.id IS NULL THEN m.rating ELSE w.rating END AS rating, CASE WHEN w.id IS NULL THEN m.rating_category ELSE w.rating_category END AS rating_category, round(w.weight, 6) AS training_weight FROM messages m LEFT JOIN w ON m.id = w.id")
def l07(s, d):
    """Every fifth message is rated anew: a third of these down, a third up, a third cleared."""
    m, i = I.messages(s, d).select("id", "rating", "rating_category", "training_weight"), F.col("id")
    bad = F.element_at(F.array(*(F.lit(c) for c in ("hallucination", "off_topic", "misleading"))), (F.floor(i / 15) % 3 + 1).cast("int"))
    ratings = m.where("id % 5 = 0").select("id", F.when(i % 15 == 0, "down").when(i % 15 == 5, "up").alias("rating"), F.when(i % 15 == 0, bad).alias("rating_category"))
    return FB.saved_feedback(m, ratings).withColumn("training_weight", F.round("training_weight", 6))


def _saved(s, d):
    m = I.messages(s, d).select("id", F.floor(F.col("id") / 7).alias("session_id"), "question", "answer", "pipeline", "rating", "created_at")
    old = m.where("id % 3 <> 0")
    sessions = old.groupBy("session_id").agg(F.min_by("pipeline", "id").alias("pipeline"), F.min("created_at").alias("created_at"))
    return FB.saved_messages(old, m.where("id % 3 = 0 OR id % 5 = 0").drop("rating"), sessions)


@query("L06_saved_messages", f"WITH {MESSAGES} SELECT id, id // 7 AS session_id, question, CASE WHEN id % 3 <> 0 THEN rating END AS rating FROM messages")
def l06(s, d):
    return _saved(s, d)[0].select("id", "session_id", "question", "rating")


@query("L06_sessions", f"WITH {MESSAGES}, o AS (SELECT id // 7 AS session_id, min(created_at) AS first FROM messages WHERE id % 3 <> 0 GROUP BY 1), n AS (SELECT id // 7 AS session_id, min(created_at) AS first FROM messages WHERE id % 3 = 0 GROUP BY 1) SELECT session_id, epoch_us(first) AS created_at FROM o UNION ALL SELECT session_id, epoch_us(first) FROM n WHERE session_id NOT IN (SELECT session_id FROM o)")
def l06s(s, d):
    return _saved(s, d)[1].select("session_id", F.unix_micros("created_at").alias("created_at"))


@query("L10_mark_reviewed", f"WITH {MESSAGES} SELECT id, reviewed_at IS NOT NULL OR id % 3 = 0 AS reviewed FROM messages")
def l10(s, d):
    from kelpwork.sources import sinks

    m = I.messages(s, d).select("id", "reviewed_at", "created_at")
    marked = sinks.patched(m, m.where("id % 3 = 0").select("id", F.col("created_at").alias("reviewed_at")), "id")
    return marked.select("id", F.col("reviewed_at").isNotNull().alias("reviewed"))


@query("M11_exclusive_flag", f"WITH {EVAL} SELECT run_id, run_id = (SELECT max(run_id) FROM ev) AS active FROM (SELECT DISTINCT run_id FROM ev)")
def m11(s, d):
    runs = I.evaluation(s, d).groupBy("run_id").agg(F.count(F.lit(1)).alias("n")).select("run_id")  # one row a run
    newest = F.max("run_id").over(W.partitionBy(F.lit(1)))
    return FB.activated(runs.withColumn("newest", newest), "run_id", F.col("newest")).drop("newest")
