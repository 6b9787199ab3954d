"""Ranking quality. Rows: retrieved (query_id, pipeline, rank, document_id, ...), relevant (query_id, expected: array)."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Column forms over arrays: a ranked list ``got`` and a list ``want``. They need no join and no shuffle.


def _hits(got: Column, want: Column, k: int | None = None) -> Column:
    top = got if k is None else F.slice(got, 1, k) if k > 0 else F.slice(got, 1, 0)
    return F.size(F.filter(top, lambda x: F.array_contains(want, x))).cast("double")


def recall(got: Column, want: Column, k: int) -> Column:
    return F.when(F.size(want) > 0, _hits(got, want, k) / F.size(want)).otherwise(0.0)


def precision(got: Column, want: Column, k: int) -> Column:
    """0 for k = 0; null where nothing was retrieved."""
    return F.lit(0.0) if k == 0 else F.try_divide(_hits(got, want, k), F.least(F.lit(k), F.size(got)))


def reciprocal_rank(got: Column, want: Column) -> Column:
    first = F.array_position(F.transform(got, lambda x: F.array_contains(want, x)), True)
    return F.when(F.coalesce(first, F.lit(0)) > 0, 1.0 / first).otherwise(0.0)


def dcg(grades: Column, k: int) -> Column:
    """Sum of grade / log2(position + 1)."""
    return F.aggregate(F.transform(F.slice(grades, 1, max(k, 0)), lambda g, i: g / F.log2(i + 2.0)), F.lit(0.0), lambda s, x: s + x)


def ideal_dcg(grades: Column, k: int) -> Column:
    return dcg(F.reverse(F.array_sort(grades)), k)


def ndcg(got: Column, want: Column, k: int) -> Column:
    """Binary; the ideal counts distinct relevant ids."""
    gains = F.transform(got, lambda x: F.array_contains(want, x).cast("double"))
    ideal = dcg(F.transform(F.array_distinct(want), lambda x: F.lit(1.0)), k)
    return F.when(ideal > 0, dcg(gains, k) / ideal).otherwise(0.0)


def hit(got: Column, want: Column, k: int) -> Column:
    return (_hits(got, want, k) > 0).cast("double")


def query_metrics(rows: DataFrame, k: int = 10, got: str = "got", want: str = "want") -> DataFrame:
    """The bundle of nine metrics beside each row."""
    g, w = F.coalesce(F.col(got), F.array().cast(rows.schema[got].dataType)), F.coalesce(F.col(want), F.array().cast(rows.schema[want].dataType))
    return rows.select(
        "*",
        *(F.round(recall(g, w, n), 6).alias(name) for n, name in ((k, "recall_at_k"), (5, "recall_at_5"), (10, "recall_at_10"))),
        F.round(reciprocal_rank(g, w), 6).alias("mrr"),
        F.round(ndcg(g, w, k), 6).alias("ndcg"),
        F.round(precision(g, w, k), 6).alias("precision_at_k"),
        *(hit(g, w, n).alias(f"hit_at_{n}") for n in (1, 5, 10)),
    )


MEASURES = ("recall_at_k", "recall_at_5", "recall_at_10", "mrr", "ndcg", "precision_at_k", "hit_at_1", "hit_at_5", "hit_at_10")


def mean_metrics(metrics: DataFrame, *by: str, measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """Plain means, a missing value as 0; zeros for no rows."""
    return metrics.groupBy(*by).agg(*(F.round(F.coalesce(F.avg(F.coalesce(F.col(m), F.lit(0.0))), F.lit(0.0)), 6).alias(m) for m in measures))


def latency_stats(df: DataFrame, *by: str, value: str = "latency_ms") -> DataFrame:
    v = F.col(value)
    rank = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")
    return df.groupBy(*by).agg(F.min(v).alias("min_ms"), F.max(v).alias("max_ms"), F.round(F.avg(v), 6).alias("mean_ms"), F.round(F.median(v), 6).alias("median_ms"), rank(0.95).alias("p95_ms"), rank(0.99).alias("p99_ms"))


def compared(metrics: DataFrame, a: str, b: str, name: str = "pipeline", measures: tuple[str, ...] = ("recall_at_k", "mrr", "ndcg")) -> DataFrame:
    """One row: differences of two rows of means, and whether the first is strictly better."""
    of = lambda side, m: F.max(F.when(F.col(name) == side, F.col(m)))
    both = metrics.agg(*(of(side, m).alias(p + m) for side, p in ((a, "a_"), (b, "b_")) for m in measures))
    return both.select(*(F.round(F.col("a_" + m) - F.col("b_" + m), 6).alias(m + "_diff") for m in measures), *((F.col("a_" + m) > F.col("b_" + m)).alias(m + "_better") for m in measures))


def coverage(retrieved: DataFrame, relevant: DataFrame) -> DataFrame:
    """(query_id, pipeline, avg_chunks, share_of_several): over the expected documents, how many items of each were found on
    average where any was, and the share of expected documents with two or more."""
    want = relevant.select("query_id", F.size("want").alias("wanted"), F.explode(F.array_distinct("want")).alias("document_id"))
    n = retrieved.groupBy("query_id", "pipeline", "document_id").agg(F.count(F.lit(1)).alias("n")).join(want, ["query_id", "document_id"])
    return n.groupBy("query_id", "pipeline").agg(F.round(F.avg("n"), 6).alias("avg_chunks"), F.round(F.count_if(F.col("n") >= 2) / F.max("wanted"), 6).alias("share_of_several"))


def diversity(got: Column, k: int) -> Column:
    """Distinct documents over the smaller of list length and k; 0 for an empty list."""
    return F.when(F.size(got) > 0, F.size(F.array_distinct(got)) / F.least(F.size(got), F.lit(k))).otherwise(0.0)


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two lists of ids; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def embedding_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """(query_id, overlap): the mean cosine over all pairs of two result lists (query_id, dense). The mean of all inner
    products of unit vectors is the inner product of the means, so no pair is formed."""
    from kelpwork.functions.vectors import norm

    def mean(df: DataFrame, name: str) -> DataFrame:
        unit = df.select("query_id", F.posexplode(F.transform("dense", lambda x: x / norm(F.col("dense")))).alias("i", "x"))
        return unit.groupBy("query_id", "i").agg(F.avg("x").alias(name))

    both = mean(a, "x").join(mean(b, "y"), ["query_id", "i"])
    return both.groupBy("query_id").agg(F.round(F.sum(F.col("x") * F.col("y")), 6).alias("overlap"))


def measured(action: Callable[[], object]) -> tuple[object, float]:
    """The result of ``action`` and the milliseconds it took by the wall clock."""
    begun = time.perf_counter()
    result = action()
    return result, (time.perf_counter() - begun) * 1000
