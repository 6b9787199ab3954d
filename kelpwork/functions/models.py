"""Places for models: each is a function from a batch of inputs to a batch of outputs, run in Arrow batches.

Without a model the deterministic stand-ins are used: hashed words for embeddings, word overlap for cross encoders,
the first characters for summaries. No stand-in opens a connection.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as X

DIMENSION, BATCH = 64, 32
_WORD = re.compile(r"[^\W_]+")


def hashed_words(texts: list[str], dimension: int = DIMENSION) -> np.ndarray:
    """One unit vector a text: signed counts of hashed words; zero for a text without words."""
    out = np.zeros((len(texts), dimension))
    for row, t in zip(out, texts):
        for w in _WORD.findall((t or "").lower()):
            h = zlib.crc32(w.encode())
            row[h % dimension] += 1.0 if h >> 16 & 1 else -1.0
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(size > 0, size, 1)


def fitted(vector: np.ndarray, dimension: int) -> np.ndarray:
    """Padded with zeros or cut to ``dimension``."""
    return np.pad(vector[:dimension], (0, max(0, dimension - len(vector))))


def _by_batch(values: pd.Series, model: Callable, size: int) -> list:
    """The model's outputs; a batch that fails is tried item by item, and what fails again is None."""
    items, out = values.tolist(), []
    for at in range(0, len(items), size):
        part = items[at : at + size]
        try:
            out += list(model(part))
        except Exception:
            for x in part:
                try:
                    out += list(model([x]))
                except Exception:
                    out.append(None)
    return out


def embed(text: Column, model: Callable[[list[str]], np.ndarray] = hashed_words, dimension: int = DIMENSION, batch: int = BATCH) -> Column:
    @F.pandas_udf(X.ArrayType(X.DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([None if v is None else fitted(np.asarray(v, float), dimension) for v in _by_batch(s, model, batch)], dtype=object)

    return run(text)


def generate(prompt: Column, model: Callable[[list[str]], list[str]], failed: str = "[Generation failed]", batch: int = BATCH) -> Column:
    """Text of a language model; an error leaves ``failed``."""

    @F.pandas_udf(X.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([failed if x is None else x for x in _by_batch(s, model, batch)], dtype=object)

    return run(prompt)


def score_pairs(query: Column, content: Column, model: Callable[[list[tuple[str, str]]], list[float]], otherwise: Column) -> Column:
    """Cross-encoder score of each pair; a pair that fails keeps ``otherwise``."""

    @F.pandas_udf(X.DoubleType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, c in batches:
            yield pd.Series(_by_batch(pd.Series(list(zip(q, c))), model, BATCH), dtype="float64")

    return F.coalesce(F.nanvl(run(query, content), F.lit(None).cast("double")), otherwise)


def word_overlap(pairs: list[tuple[str, str]]) -> list[float]:
    """Share of the query's words found in the content: stands in for a cross encoder."""
    out = []
    for q, c in pairs:
        words = set(_WORD.findall((q or "").lower()))
        out.append(len(words & set(_WORD.findall((c or "").lower()))) / len(words) if words else 0.0)
    return out


def summary(text: Column, model: Callable[[list[str]], list[str]] | None = None, most: int = 200) -> Column:
    """Summary by ``model``, or its first characters and three dots where there is none or it fails."""
    start = F.concat(F.substring(text, 1, most), F.lit("..."))
    return start if model is None else F.coalesce(F.nullif(generate(text, model, failed=""), F.lit("")), start)
