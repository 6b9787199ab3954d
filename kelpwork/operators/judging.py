"""Judgements of answers: parsing, voting, classification and their aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelpwork.functions.text import is_refusal, round_half_up

RECALL, MEAN = 0.5, 3.0
FAILURES = ("normal", "generation_failure", "retrieval_failure", "robust_generation", "hallucination_failure")
_REPLY = "groundedness string, completeness string, answer_quality string, correctness string, hallucination string, answerable_from_context string"


def unjudged(evaluation: DataFrame, judged: DataFrame, pipelines: list[str] | None = None, most: int | None = 200) -> DataFrame:
    """Rows without judgement whose generation did not fail, the oldest first."""
    left = evaluation.join(judged.select("evaluation_id"), "evaluation_id", "left_anti").where(~F.startswith("generated_answer", F.lit("[Generation failed")))
    left = left if pipelines is None else left.where(F.col("pipeline_name").isin(*pipelines))
    return left if most is None else left.orderBy("created_at", "evaluation_id").limit(most)


def parsed_reply(reply: Column) -> Column:
    """Scores from a judge's reply: a bare object, one in a fence or one in prose, the first whose three scores are within
    1 to 5; null if there is none."""
    # fixed values: the three shapes in which judges reply
    texts = (F.regexp_extract(reply, r"(?s)^\s*(\{.*\})\s*$", 1), F.regexp_extract(reply, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.regexp_extract(reply, r'(\{[^{}]*"groundedness"[^{}]*\})', 1))

    def read(text: Column) -> Column:
        r = F.from_json(F.nullif(text, F.lit("")), _REPLY)
        g, c, q = (x.try_cast("double") for x in (r["groundedness"], r["completeness"], F.coalesce(r["answer_quality"], r["correctness"])))
        fair = g.between(1, 5) & c.between(1, 5) & q.between(1, 5)
        answerable = F.when(r["answerable_from_context"] == "false", False).when(r["answerable_from_context"] == "true", True)
        return F.when(fair, F.struct(g.alias("groundedness"), c.alias("completeness"), q.alias("correctness"), F.coalesce(r["hallucination"] == "true", F.lit(False)).alias("hallucination"), answerable.alias("answerable")))

    return F.coalesce(*(read(t) for t in texts))


def voted(votes: DataFrame) -> DataFrame:
    """One row an evaluation: mean scores; hallucination by more than half of the votes; answerable by those with an
    opinion, a tie counting as true."""
    yes, no = F.count_if(F.col("answerable")), F.count_if(~F.col("answerable"))
    return votes.groupBy("evaluation_id").agg(
        *(F.avg(c).alias(c) for c in ("groundedness", "completeness", "correctness")),
        (F.count_if(F.col("hallucination")) * 2 > F.count(F.lit(1))).alias("hallucination"),
        F.when(yes + no > 0, yes >= no).alias("answerable"),
    )


def with_mean(judged: DataFrame) -> DataFrame:
    """Mean and population standard deviation of the three scores."""
    g, c, q = (F.col(x) for x in ("groundedness", "completeness", "correctness"))
    mean = (g + c + q) / 3
    return judged.withColumn("judge_mean", mean).withColumn("judge_std", F.sqrt((F.pow(g - mean, 2) + F.pow(c - mean, 2) + F.pow(q - mean, 2)) / 3))


def overridden(answerable: Column, answer: Column, recall: Column) -> Column:
    """A refusal whose recall is missing or below the threshold is not answerable."""
    return F.when(F.coalesce(is_refusal(answer), F.lit(False)) & (recall.isNull() | (recall < RECALL)), False).otherwise(answerable)


def failure_type(recall: Column, mean: Column, hallucination: Column, answerable: Column) -> Column:
    good, never = recall >= RECALL, answerable.eqNullSafe(F.lit(False))
    return (
        F.when(recall.isNull(), None)
        .when(never & hallucination & good, "hallucination_failure")
        .when(never, "retrieval_failure")
        .when(hallucination & good, "hallucination_failure")
        .when(good & (mean >= MEAN), "normal")
        .when(good, "generation_failure")
        .when(mean >= MEAN, "robust_generation")
        .otherwise("retrieval_failure")
    )


def stored_score(score: Column, answerable: Column, rounded: bool = True) -> Column:
    """0 for what cannot be answered, else the score, rounded half up."""
    return F.when(answerable.eqNullSafe(F.lit(False)), 0.0).otherwise(round_half_up(score).cast("double") if rounded else score)


def filled_recall(evaluation: DataFrame, queries: DataFrame) -> DataFrame:
    """``recall_at_k``, where missing, from the stored distinct ids and the query's expected ids; 0 for none expected."""
    joined = evaluation.join(queries.select("query_id", "expected_document_ids"), "query_id", "left")
    hits = F.size(F.filter("retrieved_doc_ids", lambda x: F.array_contains("expected_document_ids", x)))
    own = F.when(F.col("expected_document_ids").isNull(), None).when(F.size("expected_document_ids") > 0, hits / F.size("expected_document_ids")).otherwise(0.0)
    return joined.withColumn("recall_at_k", F.coalesce("recall_at_k", own))


def repaired(judged: DataFrame) -> DataFrame:
    """(evaluation_id, old_type, failure_type) of the rows whose type no longer fits; a type that would become null stays."""
    f, good, bad = F.col("failure_type"), F.col("recall_at_k") >= RECALL, F.col("recall_at_k") < RECALL
    suspect = (
        f.isNull()
        | ((f == "robust_generation") & (F.col("judge_mean") < MEAN))
        | ((f == "generation_failure") & bad)
        | (f.isin("normal", "generation_failure") & F.col("hallucination") & good)
        | ((f == "retrieval_failure") & F.col("hallucination") & ~F.col("answerable") & good)
        | (f == "content_gap")
    )
    new = failure_type(F.col("recall_at_k"), F.col("judge_mean"), F.col("hallucination"), F.col("answerable"))
    return judged.where(suspect).select("evaluation_id", f.alias("old_type"), new.alias("failure_type")).where(F.col("failure_type").isNotNull() & ~F.col("failure_type").eqNullSafe(F.col("old_type")))


def quality(judged: DataFrame, *by: str) -> DataFrame:
    """Means without zeros, hallucination rate, and counts by failure type; a missing mean is 0."""
    mean = lambda c: F.round(F.coalesce(F.avg(F.nullif(F.col(c), F.lit(0.0))), F.lit(0.0)), 6).alias("mean_" + c)
    live = F.col("judge_mean") > 0
    return judged.groupBy(*by).agg(
        *(mean(c) for c in ("groundedness", "correctness", "completeness")),
        F.round(F.coalesce(F.avg(F.when(live, F.col("hallucination").cast("double"))), F.lit(0.0)), 6).alias("hallucination_rate"),
        mean("judge_mean").alias("mean_judge"),
        F.count_if(live).alias("judged"),
        *(F.count_if(F.col("failure_type") == t).alias(t) for t in FAILURES),
        F.count_if(F.col("failure_type").isNull()).alias("unclassified"),
    )


def latest_runs(judged: DataFrame, n: int = 2) -> DataFrame:
    """The runs with judgements that began last."""
    return judged.groupBy("run_id").agg(F.min("created_at").alias("started_at")).orderBy(F.desc("started_at"), F.desc("run_id")).limit(n)


def details(judged: DataFrame, failure: str | None = None, pipeline: str | None = None, run: int | None = None, most: int = 200, answer_most: int = 500) -> DataFrame:
    """Judged rows by any of failure type (``unclassified``: none), pipeline and run; answers cut."""
    if failure is not None:
        judged = judged.where(F.col("failure_type").isNull() if failure == "unclassified" else F.col("failure_type") == failure)
    if pipeline is not None:
        judged = judged.where(F.col("pipeline_name") == pipeline)
    if run is not None:
        judged = judged.where(F.col("run_id") == run)
    return judged.withColumn("generated_answer", F.substring("generated_answer", 1, answer_most)).orderBy(F.desc("created_at"), F.desc("evaluation_id")).limit(most)


def best_pipeline(means: DataFrame, higher: tuple[str, ...], lower: tuple[str, ...] = (), name: str = "pipeline_name") -> DataFrame:
    """(measure, best): the pipeline of the largest, or least, value; of equal ones the first name."""
    long = means.select(name, F.explode(F.array(*(F.struct(F.lit(m).alias("measure"), (F.col(m) if m in higher else -F.col(m)).cast("double").alias("v")) for m in (*higher, *lower)))).alias("x")).select(name, "x.*")
    order = W.partitionBy("measure").orderBy(F.desc("v"), F.asc(name))
    return long.withColumn("n", F.row_number().over(order)).where("n = 1").select("measure", F.col(name).alias("best"))


def delta(now: DataFrame, before: DataFrame, measures: tuple[str, ...], name: str = "pipeline_name") -> DataFrame:
    """Now less before, for pipelines that both have."""
    old = before.select(name, *(F.col(m).alias("before_" + m) for m in measures))
    return now.join(old, name).select(name, *(F.round(F.col(m) - F.col("before_" + m), 6).alias(m) for m in measures))


def share(count: Column, total: Column) -> Column:
    return F.coalesce(F.try_divide(count * 100.0, total), F.lit(0.0))
