"""Reports over the corpus. Child tables are aggregated before they are joined, so nothing fans out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def overview(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n)."""
    return reduce(DataFrame.unionByName, (df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()))


def top_domains(documents: DataFrame, k: int = 10) -> DataFrame:
    return documents.groupBy("domain").agg(F.count(F.lit(1)).alias("documents"), F.max("updated_at").alias("updated_at")).orderBy(F.desc("documents"), F.asc("domain")).limit(k)


def categories(facts: DataFrame) -> DataFrame:
    return facts.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def recent(documents: DataFrame, k: int = 5) -> DataFrame:
    return documents.select("doc_id", "url", "title", "created_at").orderBy(F.desc("created_at"), F.desc("doc_id")).limit(k)


def with_child_counts(documents: DataFrame, children: dict[str, DataFrame], key: str = "doc_id") -> DataFrame:
    """``documents`` with the number of distinct ids of each child table."""
    for name, df in children.items():
        n = df.groupBy(F.col("document_id").alias(key)).agg(F.count_distinct("id").alias(name))
        documents = documents.join(n, key, "left")
    return documents.fillna(0, list(children))


def mean_children(documents: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    counted = with_child_counts(documents.select("doc_id"), children)
    return counted.agg(*(F.round(F.avg(n), 6).alias("avg_" + n) for n in children))


def search_text(documents: DataFrame, children: dict[str, tuple[DataFrame, str]], text: str, k: int | None = 500) -> DataFrame:
    """Documents whose title, url or domain, or any child's text, is like %text% in any case; with child counts, newest
    first. The text is a pattern: % and _ stand for anything."""
    like = lambda c: F.ilike(F.col(c), F.lit(f"%{text}%"))
    hits = reduce(DataFrame.unionByName, (df.where(like(c)).select(F.col("document_id").alias("doc_id")) for df, c in children.values())).distinct().withColumn("child", F.lit(True))
    own = reduce(lambda a, b: a | b, (F.coalesce(like(c), F.lit(False)) for c in ("title", "url", "domain")))
    found = documents.join(hits, "doc_id", "left").where(own | F.coalesce("child", F.lit(False))).select("doc_id", "url", "domain", "title", "created_at")
    found = found if k is None else found.orderBy(F.desc("created_at"), F.desc("doc_id")).limit(k)
    return with_child_counts(found, {n: df for n, (df, _) in children.items()})


def facts_of(facts: DataFrame, category: str, k: int = 50) -> DataFrame:
    """The most confident facts of a category; their score is the confidence."""
    return facts.where(F.upper("category") == category).withColumn("score", F.col("confidence")).orderBy(F.desc_nulls_last("confidence"), "id").limit(k)


def chunk_stats(chunks: DataFrame) -> DataFrame:
    return chunks.agg(
        F.count(F.lit(1)).alias("chunks"),
        F.coalesce(F.sum("metadata.tokencount"), F.lit(0)).alias("tokens"),
        F.round(F.coalesce(F.avg("metadata.tokencount"), F.lit(0.0)), 6).alias("avg_tokens"),
        F.round(F.coalesce(F.avg(F.size(F.map_keys("sparse_vector"))), F.lit(0.0)), 6).alias("avg_terms"),
    )


def fact_stats(facts: DataFrame) -> DataFrame:
    return facts.groupBy(F.coalesce(F.upper("category"), F.lit("OTHER")).alias("category")).agg(F.count(F.lit(1)).alias("facts"), F.round(F.avg(F.length("content")), 6).alias("avg_length"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))
