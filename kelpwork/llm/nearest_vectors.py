"""The most similar vectors for every vector, with randomly rotated one-bit codes.

1. Unit vectors are kept as 24-bit fixed-point numbers. Equal vectors (by digest) become one, represented
   by the smallest id and holding its k+1 smallest ids.
2. Centroids are fitted on a sample of at most ``SAMPLE`` vectors. Every vector goes to its two nearest lists
   and to all others whose centroid is nearly as near (``MARGIN``, at most ``LISTS``, both for a least similarity of 0.9 and
   wider below).
3. In a list, the residual of each vector against the centroid is rotated at random and kept as one bit a
   dimension in packed words, with its norm and the inner product of code and residual as correction
   scalars. The inner product of two vectors is estimated from the popcounts of the code and the bit planes
   of the other residual, quantised to four bits; pairs whose estimate plus error bound reaches the least
   similarity are reranked by the vectors themselves.
4. The k best of all lists, ties by the smaller id, are taken per vector, copies included.

Scale: the index is fitted on a bounded sample, every row is indexed and searched. A row is sent
``lists`` times (about three) with 192 bytes of vector. Lists expected above ``LIST_ROWS`` rows are cut into
blocks and searched block against block in separate tasks, so no task gets an unbounded list and no pair is
left out. Exact copies never meet in a list: a vector that a third of all rows share is searched once. Ids of
surplus copies are broadcast only if counted to be few. The centroids (at most ``CENTROIDS`` x dimension) are
broadcast.

Cases: null, empty, too short, too long, all-zero and non-finite vectors are unusable and take no part, nor do rows
without id; rows with a repeated id count once; fewer than two usable vectors give no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelpwork.sources.tables import cut, hashed_sample, table

DIMENSION, NEAREST, LEAST = 64, 5, 0.9
SAMPLE, CENTROIDS, ROWS_PER_LIST = 32_768, 16_384, 100
#: At least 0.9; both grow in proportion to the distance that the least similarity allows.
LISTS, MARGIN = 8, 0.05
LIST_ROWS, GROUP = 16_384, 16
ERROR_SDS = 3.0
BROADCAST_IDS = 200_000
_SCALE = float(2**31 - 256)
_MICRO = 1_000_000


def _packed(unit: np.ndarray) -> np.ndarray:
    fixed = np.rint(unit * _SCALE / 256).astype(np.int32)
    return np.ascontiguousarray(fixed.view(np.uint8).reshape(len(unit), unit.shape[1], 4)[:, :, :3]).reshape(len(unit), -1)


def _unpacked(raw: np.ndarray, dimension: int) -> np.ndarray:
    wide = np.zeros((len(raw), dimension, 4), np.uint8)
    wide[:, :, 1:] = raw.reshape(len(raw), dimension, 3)
    return wide.view(np.int32).reshape(len(raw), dimension) / _SCALE


def _fixed(column: pa.Array, dimension: int) -> np.ndarray:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return _unpacked(data.reshape(-1, 3 * dimension), dimension)


def usable(vectors: DataFrame, dimension: int, key: str, vector: str) -> DataFrame:
    """(id, digest, unit) of the usable vectors."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.asarray(b.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dimension)
            with np.errstate(all="ignore"):
                largest = np.abs(x).max(axis=1, initial=0.0)
                scaled = x / largest[:, None]
                norm = np.sqrt((scaled * scaled).sum(1))
            good = np.isfinite(norm) & (norm > 0)
            raw = _packed(np.where(good[:, None], scaled / np.where(good, norm, 1)[:, None], 0))
            offsets = np.arange(len(x) + 1, dtype=np.int32) * raw.shape[1]
            unit = pa.BinaryArray.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())])
            digest = pa.array([xxhash.xxh128_digest(r) for r in raw], pa.binary())
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in (b.column(0), digest, unit)], ["id", "digest", "unit"])

    fit = F.when(F.size(vector) == dimension, ~F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x))).otherwise(False)
    rows = vectors.where(fit & F.col(key).isNotNull()).select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    return rows.mapInArrow(make, f"id {rows.schema['id'].dataType.simpleString()}, digest binary, unit binary")


def fit_centroids(sample: np.ndarray, count: int, rounds: int = 4, seed: int = 7) -> np.ndarray:
    """Unit centroids of ``sample`` by spherical k-means."""
    rng = np.random.default_rng(seed)
    x = sample.astype(np.float32)
    c = x[rng.choice(len(x), count, replace=False)]
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 1024] @ c.T).argmax(1) for i in range(0, len(x), 1024)])
        order = np.argsort(near, kind="stable")
        held, start = np.unique(near[order], return_index=True)
        c = c.copy()
        c[held] = np.add.reduceat(x[order], start, axis=0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def near_lists(x: np.ndarray, centroids: np.ndarray, least: float = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) of every list that a row goes to."""
    wide = max(1.0, (1 - least) / 0.1)
    k = min(int(LISTS * wide), len(centroids))
    score = x.astype(np.float32) @ centroids.T
    top = np.argpartition(-score, k - 1, axis=1)[:, :k]
    value = np.take_along_axis(score, top, 1)
    order = np.argsort(-value, axis=1)
    top, value = np.take_along_axis(top, order, 1), np.take_along_axis(value, order, 1)
    go = value >= value[:, :1] - MARGIN * wide
    go[:, :2] = True
    row, at = np.nonzero(go)
    return row, top[row, at]


def rotation(dimension: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dimension, dimension)))
    return q * np.sign(np.diag(r))


def _words(bits: np.ndarray) -> np.ndarray:
    """Packed 64-bit words of rows of bits."""
    pad = -bits.shape[1] % 64
    return np.packbits(np.pad(bits, ((0, 0), (0, pad))), axis=1).view(np.uint64)


def candidates(left: np.ndarray, right: np.ndarray, centroid: np.ndarray, turn: np.ndarray, least: float, sds: float = ERROR_SDS) -> np.ndarray:
    """Pairs (i, j) of ``left`` x ``right`` whose estimated inner product, plus the bound of ``sds`` standard deviations, reaches
    ``least``."""
    d = left.shape[1]

    def residual(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        r = x - centroid
        norm = np.sqrt((r * r).sum(1))
        return (r / np.maximum(norm, 1e-12)[:, None]) @ turn.T, norm, x @ centroid

    o, norm_o, along_o = residual(left)
    q, norm_q, along_q = residual(right)
    bits = o > 0
    code = _words(bits)
    own = np.abs(o).sum(1) / np.sqrt(d)  # <code, residual>
    bound = sds * np.sqrt(np.maximum(1 - own**2, 0)) / np.maximum(own, 1e-6) / np.sqrt(max(d - 1, 1))
    low = q.min(1)
    step = np.maximum(q.max(1) - low, 1e-12) / 15
    level = np.clip(np.rint((q - low[:, None]) / step[:, None]), 0, 15).astype(np.uint8)
    planes = [_words(level >> b & 1) for b in range(4)]
    ones, total = bits.sum(1).astype(np.float32), (low * d + step * level.sum(1)).astype(np.float32)
    f = lambda a: a.astype(np.float32)
    found = []
    rows = max(1, (1 << 22) // max(len(right), 1))
    for s in range(0, len(left), rows):
        cut = slice(s, s + rows)
        count = np.zeros((len(code[cut]), len(right)), np.float32)
        for b, plane in enumerate(planes):
            for w in range(code.shape[1]):
                count += np.float32(1 << b) * np.bitwise_count(code[cut, w][:, None] & plane[:, w][None, :])
        # <code, q>: twice the sum over the set bits less the sum over all, over the square root of d
        inner = (2 * (f(step)[None, :] * count + f(low)[None, :] * ones[cut][:, None]) - total[None, :]) / np.float32(np.sqrt(d))
        size = f(norm_o[cut])[:, None] * f(norm_q)[None, :]
        top = size * (inner / f(np.maximum(own[cut], 1e-6))[:, None] + f(bound[cut])[:, None]) + f(along_o[cut])[:, None] + f(along_q)[None, :] - np.float32(centroid @ centroid)
        i, j = np.nonzero(top >= least - 1e-3)
        found.append(np.stack([i + s, j], 1))
    return np.concatenate(found) if found else np.zeros((0, 2), np.int64)


def _best(a: np.ndarray, b: np.ndarray, micro: np.ndarray, nearest: int) -> np.ndarray:
    order = np.lexsort((b, -micro, a))
    a_sorted = a[order]
    start = np.r_[True, a_sorted[1:] != a_sorted[:-1]]
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))
    return order[place < nearest]


def search_lists(t: pa.Table, centroids: np.ndarray, turn: np.ndarray, nearest: int, least: float, sds: float = ERROR_SDS) -> pa.Table:
    """The best partners inside the lists of one group: columns list, side (0 or 1, 2 for both), id, unit."""
    t = t.combine_chunks()
    lists, side, ids = (t[c].to_numpy() for c in ("list", "side", "id"))
    unit = _fixed(t["unit"].chunk(0), centroids.shape[1]) if t.num_rows else np.zeros((0, centroids.shape[1]))
    out = []
    for one in np.unique(lists):
        rows = np.flatnonzero(lists == one)
        rows = rows[np.unique(ids[rows], return_index=True)[1]]
        both = side[rows] == 2
        left, right = (rows, rows) if both.any() else (rows[side[rows] == 0], rows[side[rows] == 1])
        if not len(left) or not len(right):
            continue
        pair = candidates(unit[left], unit[right], centroids[one].astype(np.float64), turn, least, sds)
        if both.any():
            pair = pair[pair[:, 0] != pair[:, 1]]
            pair = np.unique(np.sort(pair, axis=1), axis=0) if len(pair) else pair
        i, j = left[pair[:, 0]], right[pair[:, 1]]
        micro = np.rint(np.einsum("ij,ij->i", unit[i], unit[j]) * _MICRO).astype(np.int64)
        good = micro >= round(least * _MICRO)
        a, b, m = (np.concatenate(x) for x in ((ids[i][good], ids[j][good]), (ids[j][good], ids[i][good]), (micro[good], micro[good])))
        best = _best(a, b, m, nearest)
        out.append((a[best], b[best], m[best]))
    a, b, m = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, ids.dtype), np.zeros(0, ids.dtype), np.zeros(0, np.int64))
    return pa.table({"a": a, "b": b, "micro": m})


def nearest_vectors(vectors: DataFrame, nearest: int = NEAREST, least: float = LEAST, dimension: int = DIMENSION, key: str = "id", vector: str = "dense_embedding", exact: bool = False) -> DataFrame:
    """(id, other, similarity) of the ``nearest`` most similar other vectors of each usable vector with a cosine,
    rounded to six decimals, of at least ``least``; ties by the smaller id. ``exact``: one list, in blocks, all against all, and every
    pair is reranked that the estimate with a bound of eight standard deviations does not rule out."""
    spark = vectors.sparkSession
    units = usable(vectors, dimension, key, vector)
    kind = units.schema["id"].dataType.simpleString()
    named = cut(units.select("id", "digest").distinct())
    several = named.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "rep")
    copies = named.join(several, "digest").select("rep", F.col("id").alias("member"))
    first = copies.withColumn("place", F.row_number().over(W.partitionBy("rep").orderBy("member"))).where(F.col("place") <= nearest + 1).select("rep", "member")

    total = named.count()
    surplus = copies.where("member <> rep").select(F.col("member").alias("id"))
    single = units.select("id", "unit").join(F.broadcast(surplus) if surplus.count() <= BROADCAST_IDS else surplus, "id", "left_anti")
    drawn = usable(hashed_sample(vectors, key, SAMPLE), dimension, key, vector).select("unit").toArrow()
    sample = _fixed(drawn.combine_chunks()["unit"].chunk(0), dimension) if drawn.num_rows else np.eye(1, dimension)
    sample = np.unique(sample.astype(np.float32), axis=0)
    centroids = sample[:1] if exact else fit_centroids(sample, int(np.clip(total // ROWS_PER_LIST, 1, min(CENTROIDS, len(sample)))))
    held = sum(np.bincount(near_lists(sample[i : i + 1000], centroids, least)[1], minlength=len(centroids)) for i in range(0, len(sample), 1000))
    expected = held * max(1.0, total / max(len(sample), 1))
    blocks = np.maximum(1, np.ceil(expected / LIST_ROWS)).astype(np.int64)
    index = spark.sparkContext.broadcast((centroids, blocks, rotation(dimension)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, cuts, _ = index.value
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                row, one = near_lists(_fixed(b.column(1), c.shape[1]), c, least)
                n = cuts[one]
                split = n > 1
                parts = [(row[~split], one[~split], one[~split] // GROUP, np.full((~split).sum(), 2, np.int8))]
                for r, l, k in zip(row[split], one[split], n[split]):
                    own = xxhash.xxh32_intdigest(str(b.column(0)[int(r)].as_py())) % int(k)
                    mate = np.arange(k)
                    cell = -1 - (l << 32 | np.minimum(own, mate) << 16 | np.maximum(own, mate))
                    parts.append((np.full(k, r), np.full(k, l), cell, np.where(mate == own, 2, mate < own).astype(np.int8)))
                row, one, cell, side = (np.concatenate(x) for x in zip(*parts))
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(one, pa.int32()), pa.array(side, pa.int8()), b.column(0).take(take), b.column(1).take(take)], ["cell", "list", "side", "id", "unit"])

    cells = single.mapInArrow(assign, f"cell bigint, list int, side byte, id {kind}, unit binary")
    found = cells.groupBy("cell").applyInArrow(lambda t: search_lists(t, index.value[0], index.value[2], nearest, least, 8.0 if exact else ERROR_SDS), f"a {kind}, b {kind}, micro bigint")
    # copies: each member has the partners of its representative, and the other members
    spread = found.join(first.select(F.col("rep").alias("b"), F.col("member").alias("mb")), "b", "left").select("a", F.coalesce("mb", "b").alias("other"), "micro")
    spread = spread.join(copies.select(F.col("rep").alias("a"), F.col("member").alias("ma")), "a", "left").select(F.coalesce("ma", "a").alias("id"), "other", "micro")
    own = copies.join(first.select("rep", F.col("member").alias("other")), "rep").where("member <> other").select(F.col("member").alias("id"), "other", F.lit(_MICRO).cast("bigint").alias("micro"))
    ranked = spread.unionByName(own).withColumn("place", F.dense_rank().over(W.partitionBy("id").orderBy(F.desc("micro"), "other")))
    return ranked.where(F.col("place") <= nearest).select("id", "other", (F.col("micro") / _MICRO).alias("similarity")).distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = []
    for name, collection in (("traditional_chunks", "chunk"), ("facts_chunks", "fact")):
        near = nearest_vectors(table(spark, sf_dir, name))
        parts.append(near.select(F.lit(collection).alias("collection"), F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")))
    return parts[0].unionByName(parts[1]).distinct()


SQL = {
    "p2_found": """
WITH v AS (
  SELECT DISTINCT 'chunk' AS collection, id, dense_embedding AS e FROM traditional_chunks
  WHERE len(dense_embedding) = 64 AND list_sum(list_transform(dense_embedding, lambda x: x * x)) > 0
  UNION ALL SELECT DISTINCT 'fact', id, dense_embedding FROM facts_chunks
  WHERE len(dense_embedding) = 64 AND list_sum(list_transform(dense_embedding, lambda x: x * x)) > 0),
s AS (SELECT a.collection, a.id AS x, b.id AS y, round(list_cosine_similarity(a.e, b.e), 6) AS c
  FROM v a JOIN v b ON a.collection = b.collection AND a.id <> b.id),
r AS (SELECT *, row_number() OVER (PARTITION BY collection, x ORDER BY c DESC, y) AS place FROM s WHERE c >= 0.9)
SELECT DISTINCT collection, least(x, y) AS id_a, greatest(x, y) AS id_b FROM r WHERE place <= 5"""
}
QUERIES = {"p2_found": p2_found}
