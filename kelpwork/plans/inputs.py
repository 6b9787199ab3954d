"""What the queries read, and the same in SQL.

Tables without counterpart in the data (judge votes, chat messages, preferences, summaries) are derived from those that
exist by plain arithmetic on ids, so that both sides compute the same stand-ins over the whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpwork.functions import models, terms
from kelpwork.functions import text as T
from kelpwork.operators import evaluation as E
from kelpwork.operators import feedback as FB
from kelpwork.operators import judging as K
from kelpwork.sources.tables import table

DIMENSION = 64


def documents(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents")


def chunks(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "traditional_chunks").dropDuplicates(["id"])


def facts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "facts_chunks").dropDuplicates(["id"])


def summaries(s: SparkSession, d: str) -> DataFrame:
    """Chunks with a summary: its first characters, as without a model."""
    c = chunks(s, d)
    return c.select("id", "document_id", "chunk_index", F.col("content").alias("original_content"), models.summary(F.col("content")).alias("summary"), "dense_embedding", "sparse_vector", F.col("metadata.tokencount").alias("token_count"), T.token_estimate(models.summary(F.col("content"))).alias("summary_token_count"))


def evaluation(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "evaluation").dropDuplicates(["evaluation_id"]).withColumn("pipeline_name", E.pipeline(F.col("pipeline_name")))


def queries(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "test_queries")


def asked(s: SparkSession, d: str, pipeline: str = "chunk") -> DataFrame:
    """Search queries (query_id, dense, sparse): the items whose id is divisible by 50, against all items."""
    return items(s, d, pipeline).where("query_id_of % 50 = 0").select(F.col("query_id_of").alias("query_id"), "dense", "sparse")


def items(s: SparkSession, d: str, pipeline: str = "chunk") -> DataFrame:
    """(id, document_id, content, dense, sparse, ...): unusable vectors are left out by the search."""
    usable = lambda df: df.where((F.size("dense_embedding") == DIMENSION) & (F.aggregate("dense_embedding", F.lit(0.0), lambda a, x: a + x * x) > 0))
    if pipeline == "fact":
        return usable(facts(s, d)).select("id", F.col("id").alias("query_id_of"), "document_id", F.coalesce(F.nullif("source_context", F.lit("")), "content").alias("content"), F.col("dense_embedding").alias("dense"), terms.sparse_vector(F.coalesce(F.nullif("source_context", F.lit("")), "content")).alias("sparse"), F.upper("category").alias("category"), "confidence")
    if pipeline == "llm":
        return usable(summaries(s, d)).select("id", F.col("id").alias("query_id_of"), "document_id", F.col("original_content").alias("content"), F.col("dense_embedding").alias("dense"), F.col("sparse_vector").alias("sparse"))
    return usable(chunks(s, d)).select("id", F.col("id").alias("query_id_of"), "document_id", "content", F.col("dense_embedding").alias("dense"), F.col("sparse_vector").alias("sparse"))


def ranked(s: SparkSession, d: str) -> DataFrame:
    """Evaluated test queries: (evaluation_id, query_id, pipeline, got, want, category, difficulty, latency_ms, ...)."""
    e = evaluation(s, d).where("query_id IS NOT NULL")
    return e.join(queries(s, d), "query_id").select("evaluation_id", "run_id", "query_id", F.col("pipeline_name").alias("pipeline"), F.col("retrieved_doc_ids").alias("got"), F.col("expected_document_ids").alias("want"), "category", "difficulty", "top_k", "latency_ms", "recall_at_k", "created_at")


def votes(s: SparkSession, d: str) -> DataFrame:
    """Three votes an evaluation."""
    e = evaluation(s, d).select("evaluation_id", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("v"))
    i, v = F.col("evaluation_id"), F.col("v")
    return e.select(
        "evaluation_id", "v", (1 + (i * 7 + v * 3) % 5).alias("groundedness"), (1 + (i * 3 + v) % 5).alias("completeness"), (1 + (i * 11 + v * 2) % 5).alias("correctness"),
        (((i % 6 == 0) & (v < 2)) | ((i + v) % 4 == 0)).alias("hallucination"), F.when((i + v) % 7 == 0, None).when((i % 5 == 0) & (v < 2), False).otherwise(True).alias("answerable"),
    )


def judged(s: SparkSession, d: str) -> DataFrame:
    """Evaluations with aggregated votes, recall filled in, and the failure type; every eighth is not judged."""
    v = K.with_mean(K.voted(votes(s, d)))
    e = K.filled_recall(evaluation(s, d).where("evaluation_id % 8 <> 7"), queries(s, d))
    j = e.join(v, "evaluation_id").withColumn("answerable", K.overridden(F.col("answerable"), F.col("generated_answer"), F.col("recall_at_k")))
    j = j.withColumn("failure_type", K.failure_type(F.col("recall_at_k"), F.col("judge_mean"), F.col("hallucination"), F.col("answerable")))
    for c in ("groundedness", "completeness", "correctness"):
        j = j.withColumn(c, K.stored_score(F.col(c), F.col("answerable")))
    for c in ("judge_mean", "judge_std"):
        j = j.withColumn(c, F.round(K.stored_score(F.col(c), F.col("answerable"), False), 6))
    return j


def messages(s: SparkSession, d: str) -> DataFrame:
    """Chat messages: questions and answers of the evaluations, with ratings by id."""
    i = F.col("evaluation_id")
    z, y = i % 10, F.floor(i / 10) % 16
    kind = F.when(y < 5, "hallucination").when(y < 9, "incomplete").when(y < 12, "irrelevant").when(y < 14, "misleading").when(y < 15, "off_topic").otherwise("other")
    return evaluation(s, d).select(
        i.alias("id"), "question", F.col("generated_answer").alias("answer"), F.array("retrieved_context", "question").alias("context"), F.col("pipeline_name").alias("pipeline"), "latency_ms",
        F.when(z < 5, "up").when(z < 9, "down").alias("rating"), F.when((z >= 5) & (z < 9), kind).alias("rating_category"), F.when(i % 4 == 0, F.col("created_at")).alias("reviewed_at"), F.lit(None).cast("double").alias("training_weight"), "created_at",
    )


def preferences(s: SparkSession, d: str, judged_rows: DataFrame | None = None) -> DataFrame:
    """Preferences of the judged rows with even id: some without link, some of these with another question, some with an old
    score or no weight."""
    j = FB.failure_weights((judged(s, d) if judged_rows is None else judged_rows).where("evaluation_id % 2 = 0"))
    i = F.col("evaluation_id")
    score = F.when(i % 6 == 0, F.col("judge_mean") + 1).otherwise(F.col("judge_mean"))
    chosen, rejected = FB.label(F.col("judge_mean"), F.col("hallucination"), F.col("failure_type"))
    return j.select(
        i.alias("id"), F.when(i % 20 == 0, F.concat("question", F.lit(" (edited)"))).otherwise(F.col("question")).alias("question"), F.substring("retrieved_context", 1, 10000).alias("context"), F.col("generated_answer").alias("answer"), score.alias("quality_score"), "hallucination", chosen.alias("chosen"), rejected.alias("rejected"),
        F.when(i % 17 == 0, "user").otherwise("llm_judge").alias("source"), F.when(i % 10 != 0, i).alias("evaluation_id"), F.when(i % 3 != 0, F.round("training_weight", 6)).alias("training_weight"), "created_at",
    )


def sql_list(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _refusal_sql(column: str) -> str:
    return "regexp_matches(" + column + ", '(?i)" + "|".join(f"(?:{p})" for p in T.REFUSALS).replace("'", "''") + "')"


CHUNKS = "chunks AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id) AS rn FROM traditional_chunks) WHERE rn = 1)"
FACTS = "facts AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id) AS rn FROM facts_chunks) WHERE rn = 1)"
EVAL = """ev AS (SELECT * EXCLUDE (rn) REPLACE (CASE pipeline_name WHEN 'traditional' THEN 'chunk' WHEN 'facts' THEN 'fact' ELSE pipeline_name END AS pipeline_name)
  FROM (SELECT *, row_number() OVER (PARTITION BY evaluation_id) AS rn FROM evaluation) WHERE rn = 1)"""
SUMMARIES = CHUNKS + """, summaries AS (SELECT id, document_id, chunk_index, content AS original_content, substr(content, 1, 200) || '...' AS summary, dense_embedding, sparse_vector,
  metadata.tokencount AS token_count, CAST(ceil(length(substr(content, 1, 200) || '...') / 4.0) AS INTEGER) AS summary_token_count FROM chunks)"""
RANKED = EVAL + """, ranked AS (SELECT e.evaluation_id, e.run_id, e.query_id, e.pipeline_name AS pipeline, e.retrieved_doc_ids AS got, q.expected_document_ids AS want,
  q.category, q.difficulty, e.top_k, e.latency_ms, e.recall_at_k, e.created_at FROM ev e JOIN test_queries q ON e.query_id = q.query_id)"""
VOTES = EVAL + """, votes AS (SELECT evaluation_id, v, 1 + (evaluation_id * 7 + v * 3) % 5 AS groundedness, 1 + (evaluation_id * 3 + v) % 5 AS completeness, 1 + (evaluation_id * 11 + v * 2) % 5 AS correctness,
  (evaluation_id % 6 = 0 AND v < 2) OR (evaluation_id + v) % 4 = 0 AS hallucination,
  CASE WHEN (evaluation_id + v) % 7 = 0 THEN NULL WHEN evaluation_id % 5 = 0 AND v < 2 THEN false ELSE true END AS answerable FROM ev CROSS JOIN (SELECT unnest([0, 1, 2]) AS v))"""
VOTED = VOTES + """, voted AS (SELECT evaluation_id, avg(groundedness) AS g, avg(completeness) AS c, avg(correctness) AS q, count(*) FILTER (WHERE hallucination) * 2 > count(*) AS h,
  CASE WHEN count(answerable) > 0 THEN count(*) FILTER (WHERE answerable) >= count(*) FILTER (WHERE NOT answerable) END AS a FROM votes GROUP BY evaluation_id),
meaned AS (SELECT *, (g + c + q) / 3 AS m FROM voted), deviated AS (SELECT *, sqrt((pow(g - m, 2) + pow(c - m, 2) + pow(q - m, 2)) / 3) AS sd FROM meaned)"""
_TYPE = """CASE WHEN r IS NULL THEN NULL WHEN a IS NOT DISTINCT FROM false AND h AND r >= 0.5 THEN 'hallucination_failure' WHEN a IS NOT DISTINCT FROM false THEN 'retrieval_failure'
  WHEN h AND r >= 0.5 THEN 'hallucination_failure' WHEN r >= 0.5 AND m >= 3 THEN 'normal' WHEN r >= 0.5 THEN 'generation_failure' WHEN m >= 3 THEN 'robust_generation' ELSE 'retrieval_failure' END"""
JUDGED = VOTED + f""", recalled AS (SELECT e.*, coalesce(e.recall_at_k, CASE WHEN t.expected_document_ids IS NULL THEN NULL WHEN len(t.expected_document_ids) > 0
    THEN len(list_filter(e.retrieved_doc_ids, lambda x: list_contains(t.expected_document_ids, x))) / len(t.expected_document_ids) ELSE 0.0 END) AS r
  FROM ev e LEFT JOIN test_queries t ON e.query_id = t.query_id WHERE e.evaluation_id % 8 <> 7),
overruled AS (SELECT x.* EXCLUDE (recall_at_k), d.g, d.c, d.q, d.h, d.m, d.sd,
    CASE WHEN coalesce({_refusal_sql('x.generated_answer')}, false) AND (x.r IS NULL OR x.r < 0.5) THEN false ELSE d.a END AS a FROM recalled x JOIN deviated d ON x.evaluation_id = d.evaluation_id),
judged AS (SELECT * EXCLUDE (g, c, q, h, m, sd, a, r), r AS recall_at_k, h AS hallucination, a AS answerable, {_TYPE} AS failure_type,
    CASE WHEN a IS NOT DISTINCT FROM false THEN 0.0 ELSE floor(g + 0.5) END AS groundedness, CASE WHEN a IS NOT DISTINCT FROM false THEN 0.0 ELSE floor(c + 0.5) END AS completeness,
    CASE WHEN a IS NOT DISTINCT FROM false THEN 0.0 ELSE floor(q + 0.5) END AS correctness, CASE WHEN a IS NOT DISTINCT FROM false THEN 0.0 ELSE round(m, 6) END AS judge_mean,
    CASE WHEN a IS NOT DISTINCT FROM false THEN 0.0 ELSE round(sd, 6) END AS judge_std FROM overruled)"""
_FAILURE_BASE = "CASE failure_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in FB.FAILURE_WEIGHTS.items()) + " ELSE 1.0 END"


def failure_weighted(name: str, source: str, condition: str = "true") -> str:
    return f"""{name} AS (SELECT j.*, CASE WHEN failure_type IS NULL THEN 1.0 ELSE greatest(least({_FAILURE_BASE} * CASE WHEN n / total < 0.1 THEN least(1 + (0.1 - n / total) * 3, 1.3) ELSE 1 END, 2.0), 0.3) END AS weight
  FROM (SELECT *, count(failure_type) OVER (PARTITION BY failure_type) AS n, count(failure_type) OVER () AS total FROM {source} WHERE {condition}) j)"""


MESSAGES = EVAL + """, messages AS (SELECT evaluation_id AS id, question, generated_answer AS answer, [retrieved_context, question] AS context, pipeline_name AS pipeline, latency_ms,
  CASE WHEN evaluation_id % 10 < 5 THEN 'up' WHEN evaluation_id % 10 < 9 THEN 'down' END AS rating,
  CASE WHEN evaluation_id % 10 BETWEEN 5 AND 8 THEN CASE WHEN (evaluation_id // 10) % 16 < 5 THEN 'hallucination' WHEN (evaluation_id // 10) % 16 < 9 THEN 'incomplete' WHEN (evaluation_id // 10) % 16 < 12 THEN 'irrelevant'
    WHEN (evaluation_id // 10) % 16 < 14 THEN 'misleading' WHEN (evaluation_id // 10) % 16 < 15 THEN 'off_topic' ELSE 'other' END END AS rating_category,
  CASE WHEN evaluation_id % 4 = 0 THEN created_at END AS reviewed_at, created_at FROM ev)"""
PREFERENCES = JUDGED + ", " + failure_weighted("even", "judged", "evaluation_id % 2 = 0") + """, preferences AS (SELECT evaluation_id AS id, CASE WHEN evaluation_id % 20 = 0 THEN question || ' (edited)' ELSE question END AS question, substr(retrieved_context, 1, 10000) AS context, generated_answer AS answer,
  CASE WHEN evaluation_id % 6 = 0 THEN judge_mean + 1 ELSE judge_mean END AS quality_score, hallucination, judge_mean >= 3.5 AND NOT hallucination AND failure_type IS DISTINCT FROM 'retrieval_failure' AS chosen,
  judge_mean < 2.5 OR hallucination AS rejected, CASE WHEN evaluation_id % 17 = 0 THEN 'user' ELSE 'llm_judge' END AS source, CASE WHEN evaluation_id % 10 <> 0 THEN evaluation_id END AS evaluation_id,
  CASE WHEN evaluation_id % 3 <> 0 THEN round(weight, 6) END AS training_weight, created_at FROM even)"""
