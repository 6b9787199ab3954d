"""Feedback weights, conversations, preferences and training data."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelpwork.functions.text import round_half_up

# Base weights by category of a bad rating and by failure type; bounds; boost of rare kinds.
CATEGORY_WEIGHTS = {"hallucination": 1.8, "incomplete": 1.5, "irrelevant": 1.3, "misleading": 1.2, "off_topic": 0.8, "other": 1.0}
FAILURE_WEIGHTS = {"hallucination_failure": 1.8, "generation_failure": 1.4, "retrieval_failure": 1.3, "normal": 1.0, "robust_generation": 0.4}
LOW, HIGH, RARE, SLOPE, BOOST = 0.3, 2.0, 0.1, 3.0, 1.3


def clipped(w: Column) -> Column:
    return F.greatest(F.least(w, F.lit(HIGH)), F.lit(LOW))


def _weight(kind: Column, base: dict[str, float], count: Column, total: Column) -> Column:
    value = F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in base.items()), F.lit(1.0))
    share = F.coalesce(count, F.lit(0)) / total
    boosted = F.when((total > 0) & (share < RARE), value * F.least(1 + (RARE - share) * SLOPE, F.lit(BOOST))).otherwise(value)
    return F.when(kind.isNull(), F.lit(1.0)).otherwise(clipped(boosted))


def _counted(df: DataFrame, kinds: DataFrame, column: str) -> DataFrame:
    """``df`` with the count of its kind and of all; the histogram has one row a kind of the fixed lists."""
    counts = kinds.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("kind_count"))
    whole = counts.withColumn("kind_total", F.sum("kind_count").over(W.partitionBy(F.lit(1))))  # over one row a kind
    return df.join(F.broadcast(whole), column, "left")


def rating_weights(messages: DataFrame) -> DataFrame:
    """Every rated message with the weight of its rating, by the histogram of all bad ratings."""
    bad = messages.where("rating = 'down' AND rating_category IS NOT NULL").select("rating_category")
    counted = _counted(messages.where("rating IS NOT NULL"), bad, "rating_category")
    kind = F.when(F.col("rating") == "down", F.col("rating_category"))
    return counted.withColumn("training_weight", _weight(kind, CATEGORY_WEIGHTS, F.col("kind_count"), F.col("kind_total"))).drop("kind_count", "kind_total")


def failure_weights(judged: DataFrame) -> DataFrame:
    counted = _counted(judged, judged.select("failure_type"), "failure_type")
    return counted.withColumn("training_weight", _weight(F.col("failure_type"), FAILURE_WEIGHTS, F.col("kind_count"), F.col("kind_total"))).drop("kind_count", "kind_total")


def saved_messages(messages: DataFrame, arriving: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``messages`` with the arriving ones (id, session_id, question, answer, ...; unrated), and ``sessions`` (session_id,
    pipeline, created_at) with those that only arriving messages name. Messages whose id is known are there already."""
    new = arriving.join(messages.select("id"), "id", "left_anti")
    first = new.join(sessions.select("session_id"), "session_id", "left_anti").groupBy("session_id").agg(F.min_by("pipeline", F.struct("created_at", "id")).alias("pipeline"), F.min("created_at").alias("created_at"))
    return messages.unionByName(new.select(*(c for c in messages.columns if c in new.columns)), allowMissingColumns=True), sessions.unionByName(first)


def saved_feedback(messages: DataFrame, ratings: DataFrame) -> DataFrame:
    """``messages`` with ``ratings`` (id, rating, rating_category): a bad rating gets its weight by the histogram of the bad ratings
    before these, a good one the weight 1; a null rating clears rating, category and weight."""
    known = messages.where("rating = 'down' AND rating_category IS NOT NULL").select("rating_category")
    counted = _counted(ratings, known, "rating_category")
    kind = F.when(F.col("rating") == "down", F.col("rating_category"))
    weight = F.when(F.col("rating").isNotNull(), _weight(kind, CATEGORY_WEIGHTS, F.col("kind_count"), F.coalesce("kind_total", F.lit(0))))
    new = counted.select("id", F.struct("rating", F.when(F.col("rating") == "down", F.col("rating_category")).alias("rating_category"), weight.alias("training_weight")).alias("new"))
    fields = ("rating", "rating_category", "training_weight")
    held = messages.join(new, "id", "left")
    return held.select(*(F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c) if c in fields else c for c in messages.columns))


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def page(messages: DataFrame, number: int = 1, size: int = 20, reviewed: bool | None = None, pipeline: str | None = None) -> DataFrame:
    """A page, newest first; the size is held to 1..100 and the number to at least 1."""
    if reviewed is not None:
        messages = messages.where(F.col("reviewed_at").isNotNull() if reviewed else F.col("reviewed_at").isNull())
    if pipeline is not None:
        messages = messages.where(F.col("pipeline") == pipeline)
    size, number = max(1, min(100, size)), max(1, number)
    return messages.orderBy(F.desc("created_at"), F.desc("id")).offset((number - 1) * size).limit(size)


def conversation_stats(messages: DataFrame, *by: str) -> DataFrame:
    return messages.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("rating") == "up").alias("up"), F.count_if(F.col("rating") == "down").alias("down"), F.count_if(F.col("rating").isNull()).alias("unrated"), F.count_if(F.col("reviewed_at").isNotNull()).alias("reviewed"))


def exported(messages: DataFrame, most: int = 10_000) -> DataFrame:
    """Rated messages as preferences: up is chosen, down rejected; contexts joined and cut; the weight defaults to 1."""
    return messages.where("rating IS NOT NULL").select(
        F.col("id").alias("chat_message_id"), "question", F.substring(F.array_join("context", "\n\n"), 1, most).alias("context"), "answer",
        (F.col("rating") == "up").alias("chosen"), (F.col("rating") == "down").alias("rejected"), F.lit("user").alias("source"), F.coalesce("training_weight", F.lit(1.0)).alias("training_weight"),
    )


def label(score: Column, hallucination: Column, failure: Column) -> tuple[Column, Column]:
    """(chosen, rejected)."""
    return (score >= 3.5) & ~hallucination & ~failure.eqNullSafe(F.lit("retrieval_failure")), (score < 2.5) | hallucination


def new_preferences(judged: DataFrame, preferences: DataFrame, most: int = 10_000) -> DataFrame:
    """Preferences of judged rows that have none yet."""
    chosen, rejected = label(F.col("judge_mean"), F.col("hallucination"), F.col("failure_type"))
    fresh = failure_weights(judged).join(preferences.select("evaluation_id"), "evaluation_id", "left_anti")
    return fresh.select("evaluation_id", "question", F.substring("retrieved_context", 1, most).alias("context"), F.col("generated_answer").alias("answer"), F.col("judge_mean").alias("quality_score"), "hallucination", chosen.alias("chosen"), rejected.alias("rejected"), F.lit("llm_judge").alias("source"), "training_weight", "created_at")


def drifted(preferences: DataFrame, judged: DataFrame) -> DataFrame:
    """Preferences whose score or label no longer fits the judgement, as they should be; a weight is kept if there is one."""
    now = failure_weights(judged).select("evaluation_id", F.col("judge_mean").alias("mean_now"), F.col("hallucination").alias("halluc_now"), "failure_type", F.col("training_weight").alias("weight_now"))
    chosen, rejected = label(F.col("mean_now"), F.col("halluc_now"), F.col("failure_type"))
    joined = preferences.join(now, "evaluation_id").withColumn("chosen_now", chosen).withColumn("rejected_now", rejected)
    off = ~F.col("quality_score").eqNullSafe(F.col("mean_now")) | ~F.col("chosen").eqNullSafe(F.col("chosen_now")) | ~F.col("rejected").eqNullSafe(F.col("rejected_now"))
    return joined.where(off).select("id", "evaluation_id", F.col("mean_now").alias("quality_score"), F.col("chosen_now").alias("chosen"), F.col("rejected_now").alias("rejected"), F.coalesce("training_weight", "weight_now").alias("training_weight"))


def training_lines(preferences: DataFrame, only_chosen: bool = True, most: int | None = 10_000, context_most: int = 6_000) -> DataFrame:
    """(id, copy, line): chat examples as JSON, best scores first, each as often as its weight rounds to (0: not at all)."""
    rows = preferences.where("chosen") if only_chosen else preferences
    if most is not None:
        rows = rows.orderBy(F.desc_nulls_last("quality_score"), "id").limit(most)
    copies = round_half_up(F.greatest(F.coalesce("training_weight", F.lit(1.0)), F.lit(0.0))).cast("int")
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    asked = F.concat(F.lit("Question: "), "question", F.lit("\nContext: "), F.substring(F.coalesce("context", F.lit("")), 1, context_most))
    line = F.to_json(F.struct(F.array(message("system", F.lit("Answer only using the provided context.")), message("user", asked), message("assistant", F.col("answer"))).alias("messages")), {"ignoreNullFields": "false"})
    return rows.select("id", line.alias("line"), F.explode(F.array_repeat(F.lit(1), copies)).alias("one")).select("id", F.row_number().over(W.partitionBy("id").orderBy("one")).alias("copy"), "line")


def relinked(preferences: DataFrame, evaluation: DataFrame) -> DataFrame:
    """(id, evaluation_id): orphans joined with the latest evaluation of the same question and answer."""
    orphans = preferences.where("evaluation_id IS NULL").select("id", "question", "answer")
    latest = evaluation.groupBy("question", F.col("generated_answer").alias("answer")).agg(F.max_by("evaluation_id", F.struct("created_at", "evaluation_id")).alias("evaluation_id"))
    return orphans.join(latest, ["question", "answer"]).select("id", "evaluation_id")


def unmatched(preferences: DataFrame, evaluation: DataFrame) -> DataFrame:
    """Orphans whose question no evaluation asks."""
    return preferences.where("evaluation_id IS NULL").join(evaluation.select("question").distinct(), "question", "left_anti")


def samples(preferences: DataFrame, evaluation: DataFrame, most: int = 50) -> DataFrame:
    """The newest preferences with the pipeline of their evaluation, else of the latest one of the same question."""
    named = evaluation.select("evaluation_id", F.col("pipeline_name").alias("own"))
    latest = evaluation.groupBy("question").agg(F.max_by("pipeline_name", F.struct("created_at", "evaluation_id")).alias("other"))
    top = preferences.orderBy(F.desc("created_at"), F.desc("id")).limit(most)
    return top.join(named, "evaluation_id", "left").join(latest, "question", "left").select("id", "question", "source", "quality_score", F.coalesce("own", "other").alias("pipeline_name"))


def preference_stats(preferences: DataFrame, *by: str) -> DataFrame:
    return preferences.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("chosen")).alias("chosen"), F.count_if(F.col("rejected")).alias("rejected"), F.count_if(~F.col("chosen") & ~F.col("rejected")).alias("neutral"), F.round(F.avg("quality_score"), 6).alias("mean_score"))


def without_pipelines(preferences: DataFrame, evaluation: DataFrame, pipelines: list[str]) -> DataFrame:
    """Preferences that do not come from evaluations of these pipelines."""
    gone = evaluation.where(F.col("pipeline_name").isin(*pipelines)).select("evaluation_id")
    return preferences.join(gone, "evaluation_id", "left_anti")


def registered(models: DataFrame, preferences: DataFrame, base_model: str, adapter: str | None = None) -> DataFrame:
    """``models`` with a row for a model trained on the chosen preferences; raises for an empty dataset."""
    n = F.count(F.lit(1))
    row = preferences.where("chosen").agg(F.when(n == 0, F.raise_error(F.lit("empty dataset")).cast("bigint")).otherwise(n).alias("dataset_size"), F.round(F.avg("quality_score"), 6).alias("avg_quality_score"))
    row = row.select(F.lit(base_model).alias("base_model"), F.lit(adapter).cast("string").alias("adapter_path"), "dataset_size", "avg_quality_score", F.lit(False).alias("active"))
    return models.unionByName(row, allowMissingColumns=True)


def activated(models: DataFrame, key: str, value: object) -> DataFrame:
    """Exactly the named model is active; ``value`` is a value or a column."""
    return models.withColumn("active", F.coalesce(F.col(key) == value, F.lit(False)))


def training_config(base_model: str, dataset: str, output: str, rank: int = 16, alpha: int = 32, epochs: int = 3, batch: int = 4, rate: float = 2e-4) -> str:
    keys = {"base_model": base_model, "dataset_path": dataset, "output_dir": output, "lora_r": rank, "lora_alpha": alpha, "epochs": epochs, "batch_size": batch, "learning_rate": rate}
    return json.dumps(keys, indent=2)
