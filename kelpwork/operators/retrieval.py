"""Top-k search of all queries at once, re-ranking, fusion and diversity.

Queries (query_id, dense, sparse) meet items (id, document_id, content, dense, sparse). The dense pool is exact: the
queries are sent to the items in blocks of about ``BLOCK`` vectors, every task keeps its own best per query from slices of
``SLICE`` items, and one window per query takes the best of the tasks. Only the pool is joined with sparse vectors. Ranks are by score,
ties by id; scores are rounded to nine decimals, so that the order does not hang on the last bit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelpwork.functions.models import score_pairs
from kelpwork.functions.vectors import hybrid, weighted_jaccard

BLOCK, SLICE, POOL, ALPHA, LEAST = 4_096, 1_024, 10, 0.7, 0.1


def best(df: DataFrame, k: int, score: str = "score", by: str = "query_id", key: str = "id") -> DataFrame:
    """The ``k`` best rows of each query, with their rank from 1."""
    order = W.partitionBy(by).orderBy(F.desc(score), F.asc(key))
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _unit(column: pa.Array, dimension: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension).astype(np.float64)
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(size > 0, size, 1)


def dense_pool(queries: DataFrame, items: DataFrame, k: int, dimension: int = 64) -> DataFrame:
    """(query_id, id, dense_score): the ``k`` items of largest cosine for each query. Vectors that are null or of
    another length take no part."""
    fit = lambda c: F.size(c) == dimension
    asked = queries.where(fit("dense")).select("query_id", "dense")
    rows = items.where(fit("dense")).select("id", "dense")
    kinds = f"query_id {asked.schema['query_id'].dataType.simpleString()}, id {rows.schema['id'].dataType.simpleString()}, dense_score double"
    spark = items.sparkSession

    def against(block: pa.Table) -> DataFrame:
        shared = spark.sparkContext.broadcast((block["query_id"].to_numpy(), _unit(block["dense"].combine_chunks(), dimension)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q = shared.value
            row, ids, score = np.zeros(0, np.int64), None, np.zeros(0)
            least = np.full(len(q), -np.inf)
            for b in batches:
                own, x = b.column(0).to_numpy(zero_copy_only=False), _unit(b.column(1), dimension)
                ids = own[:0] if ids is None else ids
                for at in range(0, len(own), SLICE):  # of each slice only what may be among the best so far
                    s = np.round(q @ x[at : at + SLICE].T, 9)
                    if s.shape[1] > k:
                        least = np.maximum(least, np.partition(s, s.shape[1] - k, axis=1)[:, -k])
                    r, c = np.nonzero(s >= least[:, None])
                    row, ids, score = np.concatenate([row, r]), np.concatenate([ids, own[at + c]]), np.concatenate([score, s[r, c]])
                    if len(row) > 4 * k * len(q):
                        row, ids, score = top(row, ids, score)
                        full = np.bincount(row, minlength=len(q)) >= k
                        least[full] = np.maximum(least[full], score[np.searchsorted(row, np.flatnonzero(full), "right") - 1])
            if ids is not None:
                row, ids, score = top(row, ids, score)
                yield pa.RecordBatch.from_arrays([pa.array(names[row]), pa.array(ids), pa.array(score)], ["query_id", "id", "dense_score"])

        def top(row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            order = np.lexsort((ids, -score, row))
            row = row[order]
            keep = np.arange(len(row)) - np.searchsorted(row, row) < k
            return row[keep], ids[order][keep], score[order][keep]

        return rows.mapInArrow(run, kinds)

    blocks = -(-asked.count() // BLOCK)
    numbered = asked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(max(blocks, 1))))
    parts = []
    for n in range(blocks):  # one block of vectors at a time comes to the driver and goes out again
        block = numbered.where(F.col("block") == n).select("query_id", "dense").toArrow()
        if block.num_rows:
            parts.append(against(block))
    if not parts:
        return spark.createDataFrame([], kinds)
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return best(found, k, "dense_score").drop("rank")


def dense_search(queries: DataFrame, items: DataFrame, k: int, least: float = 0.0) -> DataFrame:
    found = best(dense_pool(queries, items, k), k, "dense_score")
    return found.where(F.col("dense_score") >= least).withColumnRenamed("dense_score", "score")


def hybrid_search(queries: DataFrame, items: DataFrame, k: int, alpha: float = ALPHA, least: float = LEAST, pool: int = POOL, where: Column | None = None, index: Callable[[DataFrame, DataFrame, int], DataFrame] = dense_pool) -> DataFrame:
    """(query_id, id, document_id, score, rank): dense pool of ``pool`` x k, rescored with the sparse vectors, cut to k, then
    to scores of at least ``least``. ``where`` filters the items before. ``index`` gives the dense pool (query_id, id,
    dense_score): the exact scan, or an approximate index of the same form."""
    live = items if where is None else items.where(where)
    found = index(queries, live, pool * k)
    held = found.join(live.select("id", "document_id", F.col("sparse").alias("item_sparse")), "id").join(queries.select("query_id", "sparse"), "query_id")
    score = F.round(hybrid(F.col("dense_score"), weighted_jaccard(F.col("sparse"), F.col("item_sparse")), alpha), 9)
    ranked = best(held.select("query_id", "id", "document_id", score.alias("score")), k)
    return ranked.where(F.col("score") >= least)


def of_documents(items: DataFrame, order: str, documents: DataFrame | None = None) -> DataFrame:
    """The items of ``documents`` (document_id), or of all, with their place in the document and score 1."""
    rows = items if documents is None else items.join(documents.select("document_id").distinct(), "document_id", "left_semi")
    return rows.withColumns({"place": F.row_number().over(W.partitionBy("document_id").orderBy(order, "id")), "score": F.lit(1.0)})


def summary_text(summary: Column, original: Column) -> Column:
    """How an item of the summaries is shown."""
    return F.concat(F.lit("Summary: "), F.coalesce(summary, F.lit("")), F.lit("\n\nDetails: "), F.coalesce(original, F.lit("")))


def reranked(found: DataFrame, k: int, least: float = 0.3, model: Callable | None = None, query: str = "query", content: str = "content") -> DataFrame:
    """Rows of at least ``least``, best first, cut to k; scores by a cross encoder if there is one."""
    if model is not None:
        found = found.withColumn("score", score_pairs(F.col(query), F.col(content), model, F.col("score")))
    return best(found.drop("rank").where(F.col("score") >= least), k)


def fused(lists: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of (query_id, list, rank, id, score): the sum of 1 / (k + rank), with the payload of the copy
    of the best original score, of equal ones that of the first list."""
    first = F.struct(F.col("score"), -F.col("list_no"), -F.col("rank"))
    return lists.groupBy("query_id", "id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("fused"), F.max_by("document_id", first).alias("document_id"), F.max("score").alias("score"))


def diverse(found: DataFrame, k: int, weight: float = 0.5) -> DataFrame:
    """Maximal marginal relevance: greedily the item of largest weight x score less (1 - weight) x similarity to what was
    taken. Lists of at most k rows stay as they are. A query's list is bounded by the search that made it."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank"], kind="stable").reset_index(drop=True)
        if len(pdf) > k:
            x = np.array(pdf["dense"].tolist(), float)
            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
            score = pdf["score"].to_numpy()
            taken = [int(score.argmax())]
            near = np.maximum(x @ x[taken[0]], 0)
            while len(taken) < k:
                value = weight * score - (1 - weight) * near
                value[taken] = -np.inf
                taken.append(int(value.argmax()))
                near = np.maximum(near, x @ x[taken[-1]])
            pdf = pdf.iloc[taken].reset_index(drop=True)
        return pdf.assign(place=np.arange(1, len(pdf) + 1))[["query_id", "id", "place"]]

    kinds = {f.name: f.dataType.simpleString() for f in found.schema.fields}
    return found.select("query_id", "id", "rank", "score", "dense").groupBy("query_id").applyInPandas(one, f"query_id {kinds['query_id']}, id {kinds['id']}, place int")


def distinct_sources(found: DataFrame) -> DataFrame:
    """The first row of each source of a query; the source is url, else title, else content, where an empty text is none."""
    source = F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in ("url", "title", "content")))
    order = W.partitionBy("query_id", "source").orderBy("rank")
    return found.withColumn("source", source).withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def context(found: DataFrame, most: int = 8_000, mark: str = "\n[...]") -> DataFrame:
    """(query_id, context): numbered contents in rank order, a blank line between, cut at ``most`` characters."""
    parts = F.array_sort(F.collect_list(F.struct("rank", "content")))
    text = F.array_join(F.transform(parts, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), F.coalesce(p["content"], F.lit("")))), "\n\n")
    joined = found.groupBy("query_id").agg(text.alias("context"))
    return joined.withColumn("context", F.when(F.length("context") > most, F.concat(F.substring("context", 1, most), F.lit(mark))).otherwise(F.col("context")))
