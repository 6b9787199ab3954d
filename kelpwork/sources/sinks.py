"""Writing: upserts, re-indexing and deletes as rewrites of partitions or tables, and exports.

Parquet has no update in place, so a change is a table derived from the old one and written beside it; callers swap
the folder. Every function gives the new state as a DataFrame.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_WORDS = 10
# Pipelines that an ingest may fill.
PIPELINES = ("chunk", "fact", "llm")


def selected_pipelines(asked: dict[str, bool] | None) -> tuple[str, ...]:
    """The pipelines asked for; chunk only if nothing is."""
    return tuple(p for p in PIPELINES if (asked or {}).get(p)) or ("chunk",)


def ingest_status(existing: DataFrame, arriving: DataFrame) -> DataFrame:
    """``arriving`` with its status against ``existing`` by url and content hash: rejected (bad answer or too few words),
    unchanged, updated or new."""
    old = existing.select("url", F.col("content_hash").alias("old_hash"), F.lit(True).alias("known"))
    bad = (F.coalesce("status_code", F.lit(200)) != 200) | (F.coalesce("word_count", F.lit(0)) < LEAST_WORDS)
    status = F.when(bad, "rejected").when(F.col("known").isNull(), "new").when(F.col("old_hash").eqNullSafe(F.col("content_hash")), "unchanged").otherwise("updated")
    return arriving.join(old, "url", "left").withColumn("ingest_status", status).drop("old_hash", "known")


def upserted(existing: DataFrame, arriving: DataFrame, key: str = "url") -> DataFrame:
    """``existing`` with the new and updated rows of ``arriving`` in place of those of the same key."""
    changed = arriving.where(F.col("ingest_status").isin("new", "updated")).drop("ingest_status")
    return existing.join(changed.select(key), key, "left_anti").unionByName(changed, allowMissingColumns=True).select(*existing.columns)


def reindexed(children: DataFrame, fresh: DataFrame, key: str = "document_id") -> DataFrame:
    """Children of the documents in ``fresh`` replaced, all others kept."""
    return children.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh, allowMissingColumns=True)


def appended(existing: DataFrame, fresh: DataFrame, key: str = "id") -> DataFrame:
    """``existing`` and the rows of ``fresh`` whose key it does not have; columns that ``fresh`` lacks are null."""
    new = fresh.join(existing.select(key), key, "left_anti")
    return existing.unionByName(new.select(*(c for c in existing.columns if c in new.columns)), allowMissingColumns=True)


def append_rows(fresh: DataFrame, path: str) -> None:
    """New part files beside those of the table; nothing that is there is read or written again."""
    fresh.write.mode("append").parquet(path)


def deleted(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among ``keys``; with a child's foreign key this is the cascade."""
    return df.join(keys.select(key).distinct(), key, "left_anti")


def unlinked(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows kept, links to deleted ``keys`` set to null."""
    gone = keys.select(key).distinct().withColumn("gone", F.lit(True))
    return df.join(gone, key, "left").withColumn(key, F.when(F.col("gone").isNull(), F.col(key))).drop("gone").select(*df.columns)


def emptied(df: DataFrame) -> DataFrame:
    return df.limit(0)


def patched(df: DataFrame, updates: DataFrame, key: str, limits: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """``df`` with the non-null fields of ``updates``, trimmed, blank ones ignored; numbers held within ``limits``."""
    fields = [c for c in updates.columns if c != key]
    kinds = dict(updates.dtypes)
    new = updates.select(key, *(F.col(c).alias("new_" + c) for c in fields))

    def value(c: str) -> Column:
        n = F.col("new_" + c)
        if kinds[c] == "string":
            n = F.nullif(F.trim(n), F.lit(""))
        if limits and c in limits:
            n = F.when(n.isNotNull(), F.greatest(F.least(n, F.lit(limits[c][1])), F.lit(limits[c][0])))
        return F.coalesce(n, F.col(c)).alias(c)

    return df.join(new, key, "left").select(*(value(c) if c in fields else c for c in df.columns))


def singleton(df: DataFrame, row: DataFrame) -> DataFrame:
    """The one row of a table: the old one, overwritten field by field."""
    return patched(df, row, "id") if not df.isEmpty() else row


def valid_test_queries(arriving: DataFrame) -> DataFrame:
    """Queries with text and a known difficulty (medium if none); no expected ids are an empty list."""
    rows = arriving.withColumn("difficulty", F.coalesce("difficulty", F.lit("medium"))).withColumn("expected_document_ids", F.coalesce("expected_document_ids", F.array().cast("array<bigint>")))
    return rows.where((F.trim("query_text") != "") & F.col("difficulty").isin("easy", "medium", "hard"))


def write_lines(lines: DataFrame, path: str, column: str = "line", files: int | None = None) -> int:
    """JSON lines written as text; returns the number of lines that are not blank."""
    rows = lines.where(F.trim(column) != "").select(F.col(column).alias("value"))
    (rows if files is None else rows.coalesce(files)).write.mode("overwrite").text(path)
    return lines.sparkSession.read.text(path).count()


def quoted(text: Column) -> Column:
    """An SQL string literal; NULL for null."""
    return F.coalesce(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("''")), F.lit("'")), F.lit("NULL"))


def seed_statements(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """(statement): INSERTs of the documents that any query expects, and of the queries."""
    wanted = queries.select(F.explode("expected_document_ids").alias("doc_id")).distinct()
    docs = documents.join(wanted, "doc_id", "left_semi").select(F.concat(F.lit("INSERT INTO documents (id, url, title) VALUES ("), F.col("doc_id").cast("string"), F.lit(", "), quoted(F.col("url")), F.lit(", "), quoted(F.col("title")), F.lit(");")).alias("statement"))
    asked = queries.select(F.concat(F.lit("INSERT INTO test_queries (id, query) VALUES ("), F.col("query_id").cast("string"), F.lit(", "), quoted(F.col("query_text")), F.lit(");")).alias("statement"))
    return docs.unionByName(asked)
