"""Evaluation runs: fan-out of all queries over all pipelines, rollups and breakdowns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Older names of pipelines.
ALIASES = {"traditional": "chunk", "facts": "fact"}
FETCH = {"chunk": 2, "fact": 4, "llm": 2}


def pipeline(name: Column) -> Column:
    return F.coalesce(*(F.when(name == old, F.lit(new)) for old, new in ALIASES.items()), name)


def availability(tables: dict[str, DataFrame]) -> DataFrame:
    """(pipeline, items, active); raises in the caller's hands if none is active."""
    parts = [df.agg(F.count(F.lit(1)).alias("items")).select(F.lit(name).alias("pipeline"), "items") for name, df in tables.items()]
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.withColumn("active", F.col("items") > 0)


def distinct_documents(found: DataFrame, *by: str) -> DataFrame:
    """(*by, documents): distinct documents in the order of their first rank."""
    first = found.groupBy(*by, "document_id").agg(F.min("rank").alias("rank"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "document_id"))), lambda x: x["document_id"])
    return first.groupBy(*by).agg(ordered.alias("documents"))


def decoded_ids(raw: Column) -> Column:
    """A JSON array of numbers, also one written as a JSON string; an empty array for anything else."""
    plain = F.from_json(raw, "array<bigint>")
    inner = F.from_json(F.get_json_object(F.concat(F.lit('{"a":'), raw, F.lit("}")), "$.a"), "array<bigint>")
    return F.coalesce(plain, inner, F.array().cast("array<bigint>"))


def rollup(metrics: DataFrame, measures: tuple[str, ...]) -> DataFrame:
    """Per pipeline: means, rounded mean latency, least and largest latency."""
    return metrics.groupBy("pipeline").agg(F.count(F.lit(1)).alias("queries"), *(F.round(F.avg(F.coalesce(m, F.lit(0.0))), 6).alias(m) for m in measures), F.floor(F.avg("latency_ms") + 0.5).alias("mean_latency_ms"), F.min("latency_ms").alias("min_latency_ms"), F.max("latency_ms").alias("max_latency_ms"))


def pivoted(metrics: DataFrame, measure: str, pipelines: tuple[str, ...] = ("chunk", "fact", "llm")) -> DataFrame:
    """A row a query, a column a pipeline."""
    return metrics.groupBy("query_id").pivot("pipeline", list(pipelines)).agg(F.round(F.avg(measure), 6))


def breakdown(metrics: DataFrame, by: str, measures: tuple[str, ...], missing: str = "uncategorized") -> DataFrame:
    return metrics.groupBy(F.coalesce(F.col(by), F.lit(missing)).alias(by), "pipeline").agg(F.count(F.lit(1)).alias("queries"), *(F.round(F.avg(m), 6).alias(m) for m in measures))


def run_delta(runs: DataFrame, measures: tuple[str, ...], least: float = 0.005, ms: float = 1.0) -> DataFrame:
    """Per pipeline, the latest run less the one before; small differences are 0."""
    order = W.partitionBy("pipeline").orderBy(F.desc("started_at"), F.desc("run_id"))
    two = runs.withColumn("n", F.row_number().over(order)).where("n <= 2")
    now, before = (two.where(F.col("n") == n).select("pipeline", *(F.col(m).alias(f"{m}_{n}") for m in measures)) for n in (1, 2))
    least_of = lambda m: ms if m.endswith("_ms") else least
    diff = lambda m: F.round(F.col(f"{m}_1") - F.col(f"{m}_2"), 6)
    return now.join(before, "pipeline").select("pipeline", *(F.when(F.abs(diff(m)) < least_of(m), 0.0).otherwise(diff(m)).alias(m) for m in measures))


def band(score: Column, high: float = 0.8, low: float = 0.3) -> Column:
    return F.when(score >= high, "high").when(score >= low, "medium").otherwise("low")
