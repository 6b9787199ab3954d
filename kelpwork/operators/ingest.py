"""From stored pages to rows that can be searched: chunks, facts and summaries with dense and sparse vectors, and what became
of each document.

Everything is a map over rows; only the counts of ``outcomes`` shuffle, after a partial aggregate. Models are functions
from a batch of texts to a batch of vectors; a text for which the model fails gets no vector and is told by ``outcomes``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpwork.functions import chunking, models, terms
from kelpwork.functions import facts as FX
from kelpwork.functions.text import token_estimate

Model = Callable[[list[str]], np.ndarray]


def embed_record(df: DataFrame, dense: Column, sparse: Column | None = None, model: Model = models.hashed_words, dimension: int = models.DIMENSION) -> DataFrame:
    """``df`` with dense_embedding, sparse_vector and token_count of the texts ``dense`` and ``sparse`` (the same if not given)."""
    held = df.withColumns({"dense_text": dense, "sparse_text": dense if sparse is None else sparse})
    vectors = {"dense_embedding": models.embed(F.col("dense_text"), model, dimension), "sparse_vector": terms.sparse_vector("sparse_text"), "token_count": token_estimate(F.col("sparse_text"))}
    return held.withColumns(vectors).drop("dense_text", "sparse_text")


def chunk_records(pages: DataFrame, key: str = "doc_id", markdown: str = "markdown", model: Model = models.hashed_words) -> DataFrame:
    """Pages cut into chunks, each with its vectors: (key, chunk_index, content, ..., dense_embedding, sparse_vector)."""
    return embed_record(chunking.chunk_documents(pages, key, markdown), F.col("content"), model=model)


def fact_targets(facts: DataFrame, heading: str = "heading") -> DataFrame:
    """``facts`` with dense_target (the content behind its heading in brackets) and sparse_target (the source context, else the
    content)."""
    dense = F.when(F.col(heading).isNotNull(), F.concat(F.lit("["), heading, F.lit("] "), "content")).otherwise(F.col("content"))
    return facts.withColumns({"dense_target": dense, "sparse_target": F.coalesce(F.nullif("source_context", F.lit("")), "content")})


def fact_records(pages: DataFrame, key: str = "doc_id", markdown: str = "markdown", model: Model = models.hashed_words) -> DataFrame:
    """Facts of pages with the vectors of their targets; the stored content stays as it is."""
    return embed_record(fact_targets(FX.extract_facts(pages, key, markdown)), F.col("dense_target"), F.col("sparse_target"), model).drop("dense_target", "sparse_target")


def summary_targets(summaries: DataFrame) -> DataFrame:
    """Summaries are embedded, originals weigh the terms."""
    return summaries.withColumns({"dense_target": F.col("summary"), "sparse_target": F.col("original_content")})


def summary_records(chunks: DataFrame, summarise: Callable | None = None, model: Model = models.hashed_words) -> DataFrame:
    """Chunks (content) as original_content with summary and vectors."""
    told = summary_targets(chunks.withColumns({"original_content": F.col("content"), "summary": models.summary(F.col("content"), summarise)}).drop("content"))
    return embed_record(told, F.col("dense_target"), F.col("sparse_target"), model).drop("dense_target", "sparse_target")


def outcomes(documents: DataFrame, made: dict[str, DataFrame], key: str = "doc_id", page: str = "raw_html") -> DataFrame:
    """(key, pipeline, n, without_vector, error): one row a document and pipeline, the rows made and what failed. ``made`` holds
    the records of each pipeline. A document without stored page, or of which a vector is missing, is an error of its own
    row and of no other."""
    counted = None
    for name, rows in made.items():
        n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("dense_embedding").isNull()).alias("without_vector")).withColumn("pipeline", F.lit(name))
        counted = n if counted is None else counted.unionByName(n)
    wanted = documents.select(key, F.col(page).isNull().alias("no_page"), F.explode(F.array(*(F.lit(p) for p in made))).alias("pipeline"))
    both = wanted.join(counted, [key, "pipeline"], "left").withColumns({"n": F.coalesce("n", F.lit(0)), "without_vector": F.coalesce("without_vector", F.lit(0))})
    error = F.when(F.col("no_page"), "no stored page").when(F.col("without_vector") > 0, "embedding failed")
    return both.select(key, "pipeline", "n", "without_vector", error.alias("error"))
