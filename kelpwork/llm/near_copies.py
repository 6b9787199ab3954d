"""Near-duplicate records with small edits, by min-max hashing.

Each document becomes the set of its runs of ``words`` consecutive words. Under every permutation both
the smallest and the largest value are kept, so ``permutations`` hash evaluations give twice as many
signature values; ``rows`` values form a band, documents that share a band are candidates, and the exact
overlap of the two sets decides.

Scale: documents with the very same set are one class from the start, represented by the smallest id, so
a text that a third of all rows copies is banded once; classes are expanded only in the result of ``near_copy_pairs``, of which the
pairs of all copies are a part; ``near_copy_groups`` has one row a document. Number and length of the bands follow
from the threshold. The sets
(4 bytes a run) are written once to the shared checkpoint folder and read again for the check, so texts
are read once and never shuffled. Bands are joined with themselves on a 64-bit key by a sort-merge join,
which spills; a band that more than ``HOT`` documents share is cut into cells that meet in keys of their own, so that
no task holds more than two cells; candidates are made distinct and pass a comparison of 32-byte sketches before the sets are
attached. The ids of copies are broadcast
only if they were counted to be few, otherwise they are joined.

Cases: null, empty and short texts (fewer than ``words`` words) have no runs and no partners, nor have
rows without id; rows with a repeated id count once; equal texts are partners; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpwork.sources.tables import cut, table

#: A pair at the threshold shares no band with at most this probability, and a set has at most so many values. At 0.5 that makes
#: 192 bands of 5 values: a pair of 0.55 is lost with 0.00005, unrelated pages at 0.05 meet with 0.00006.
LOST, VALUES = 0.0023, 960
#: Sketches of one bit a value. Pairs whose bits differ by more than the mean at the threshold and this many
#: standard deviations (lost at the threshold: 0.00003) are not given to the exact check.
SKETCH_BITS, SKETCH_SDS = 256, 4.0
BROADCAST_IDS = 200_000
#: Documents of a band from which it is cut into cells, and the share of the documents (one in so many) that tells such bands.
HOT, DRAWN = 2_000, 16
_WORD = re.compile(r"[^\W_]+")
_words: dict[str, int] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_runs(texts: list[str | None], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(runs, ends): the sorted distinct 32-bit hashes of each text's runs, laid end to end."""
    if len(_words) > 500_000:
        _words.clear()
    found: list[str] = []
    count = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if t:
            w = _WORD.findall(t.lower())
            count[i] = len(w)
            found += w
    for w in set(found).difference(_words):
        _words[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(_words.__getitem__, found), np.uint64, len(found))
    row = np.repeat(np.arange(len(texts), dtype=np.uint64), count)
    if h.size < words:
        return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
    n = h.size - words + 1
    run = np.zeros(n, np.uint64)
    for k in range(words):
        run = _mixed(run * np.uint64(3) + h[k : k + n])
    whole = row[:n] == row[words - 1 :]
    key = np.unique(row[:n][whole] << np.uint64(32) | run[whole] >> np.uint64(32))
    ends = np.searchsorted(key, (np.arange(len(texts), dtype=np.uint64) + np.uint64(1)) << np.uint64(32))
    return key.astype(np.uint32), ends


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.r_[0, ends].astype(np.int32) * values.itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return np.frombuffer(data.tobytes(), np.uint32), (offsets[1:] - offsets[0]) // 4


def band_plan(threshold: float) -> tuple[int, int]:
    """(bands, values a band) for a threshold: the longest bands for which the values suffice, since longer ones bring fewer
    candidates."""
    best = (VALUES, 1)
    for rows in range(1, 33):
        hit = threshold**rows
        count = 1 if hit >= 1 - LOST else int(np.ceil(np.log(LOST) / np.log1p(-hit)))
        if count * rows <= VALUES:
            best = (count, rows)
    return best


def run_sets(documents: DataFrame, words: int, doc: str, text: str) -> DataFrame:
    """(doc_id, digest, runs) of each document that has runs."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                runs, ends = word_runs(b.column(1).to_pylist(), words)
                sets = _binary(runs, ends)
                digest = pa.array([xxhash.xxh128_digest(x) for x in sets.to_pylist()], pa.binary())
                keep = pa.array(np.diff(np.r_[0, ends]) > 0)
                yield pa.RecordBatch.from_arrays([c.filter(keep) for c in (b.column(0), digest, sets)], ["doc_id", "digest", "runs"])

    rows = documents.where(F.col(doc).isNotNull()).select(F.col(doc).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, digest binary, runs binary")


def min_max(runs: np.ndarray, ends: np.ndarray, permutations: int) -> np.ndarray:
    """One row of 2 x ``permutations`` values a set: all minima, then all maxima. Sets are not empty."""
    rng = np.random.default_rng(20240229)
    seed, factor = rng.integers(0, 2**32, permutations, np.uint32), rng.integers(0, 2**31, permutations, np.uint32) * np.uint32(2) + np.uint32(1)
    starts = np.r_[0, ends[:-1]]
    out = np.empty((2 * permutations, len(ends)), np.uint32)
    value = np.empty_like(runs)
    for p in range(permutations):
        np.bitwise_xor(runs, seed[p], out=value)
        np.multiply(value, factor[p], out=value)
        out[p], out[permutations + p] = np.minimum.reduceat(value, starts), np.maximum.reduceat(value, starts)
    return out.T


def bands(sets: DataFrame, count: int, rows: int) -> DataFrame:
    """(band, doc_id): a 64-bit key for each of ``count`` bands of each set."""
    permutations = -(-count * rows // 2)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                values = min_max(*_flat(b.column(1)), permutations)
                n = count
                key = np.broadcast_to(np.arange(n, dtype=np.uint64) + np.uint64(1), (len(values), n)).copy()
                for r in range(rows):
                    key = _mixed(key * np.uint64(0x9E3779B97F4A7C15) + values[:, r : n * rows : rows])
                ids = b.column(0).take(pa.array(np.repeat(np.arange(len(values)), n)))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64).ravel()), ids], ["band", "doc_id"])

    return sets.select("doc_id", "runs").mapInArrow(make, f"band bigint, doc_id {sets.schema['doc_id'].dataType.simpleString()}")


def sketches(sets: DataFrame) -> DataFrame:
    """(doc_id, s0, s1, ...): the low bits of the first values of each set, 64 to a column."""
    width = SKETCH_BITS // 64

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                low = (_mixed(min_max(*_flat(b.column(1)), SKETCH_BITS // 2).astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
                packed = np.packbits(np.ascontiguousarray(low), axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(packed[:, k]) for k in range(width))], ["doc_id", *(f"s{k}" for k in range(width))])

    columns = ", ".join(f"s{k} bigint" for k in range(width))
    return sets.select("doc_id", "runs").mapInArrow(make, f"doc_id {sets.schema['doc_id'].dataType.simpleString()}, {columns}")


def _alike(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose sketches differ in few enough bits."""
    sketch = sketches(sets)
    columns = [c for c in sketch.columns if c != "doc_id"]
    a, b = (sketch.select(F.col("doc_id").alias(side), *(F.col(c).alias(side + c) for c in columns)) for side in "ab")
    differing = sum((F.bit_count(F.col("a" + c).bitwiseXOR(F.col("b" + c))) for c in columns), F.lit(0))
    p = (1 - threshold) / 2
    most = SKETCH_BITS * p + SKETCH_SDS * (SKETCH_BITS * p * (1 - p)) ** 0.5
    return pairs.join(a, "a").join(b, "b").where(differing <= most).select("a", "b")


def _checked(pairs: DataFrame, threshold: float) -> DataFrame:
    kind = pairs.schema["a"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                (x, ex), (y, ey) = _flat(b.column(2)), _flat(b.column(3))
                nx, ny = np.diff(np.r_[0, ex]), np.diff(np.r_[0, ey])
                left = np.repeat(np.arange(len(nx), dtype=np.uint64), nx) << np.uint64(32) | x
                right = np.repeat(np.arange(len(ny), dtype=np.uint64), ny) << np.uint64(32) | y
                hit = left[np.minimum(np.searchsorted(left, right), max(left.size - 1, 0))] == right if left.size else np.zeros(right.size, bool)
                both = np.bincount((right >> np.uint64(32)).astype(np.int64), weights=hit, minlength=len(nx))
                share = both / (nx + ny - both)
                keep = pa.array(share >= threshold)
                yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), pa.array(share).filter(keep)], ["a", "b", "similarity"])

    return pairs.mapInArrow(make, f"a {kind}, b {kind}, similarity double")


def _candidates(keyed: DataFrame, drawn: DataFrame, times: int) -> DataFrame:
    """(a, b), distinct, a < b: documents that share a band.

    A band of more than about ``HOT`` documents, as the bands ``drawn`` of one in ``times`` documents tell, is cut into cells of
    about that many by a hash of the document, and cell meets cell under a key of its own, each pair of cells once: a document
    goes to as many keys as its band has cells, no key holds more than two cells, and no pair is left out, however well the
    hot bands are told."""
    kind = keyed.schema["doc_id"].dataType.simpleString()
    counted = drawn.groupBy("band").agg((F.count(F.lit(1)) * times).alias("n")).where((F.col("n") > HOT) & (F.col("n") > times))
    hot = cut(counted.select("band", F.ceil(F.col("n") / HOT).cast("int").alias("cells")))
    if hot.isEmpty():
        cold, split = keyed, None
    else:  # the keys of hot bands are few: at most the rows over HOT
        cold = keyed.join(hot, "band", "left_anti")
        cell = F.pmod(F.xxhash64("doc_id"), F.col("cells")).cast("int")
        split = keyed.join(hot, "band").withColumn("cell", cell).select("band", "doc_id", "cell", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("mate"))
        split = split.select("doc_id", "cell", F.struct("band", F.least("cell", "mate").alias("x"), F.greatest("cell", "mate").alias("y")).alias("band"))
    other = cold.select("band", F.col("doc_id").alias("b"))
    pairs = cold.select("band", F.col("doc_id").alias("a")).join(other.hint("merge"), "band").where("a < b").select("a", "b")
    if split is not None:
        left = split.where("cell = band.x").select("band", F.col("doc_id").alias("a"))
        right = split.where("cell = band.y").select("band", F.col("doc_id").alias("b"))
        met = left.join(right.hint("merge"), "band").where("a <> b")
        pairs = pairs.unionByName(met.select(F.least("a", "b").cast(kind).alias("a"), F.greatest("a", "b").cast(kind).alias("b")))
    return pairs.distinct()


def near_copy_classes(documents: DataFrame, threshold: float = 0.8, words: int = 5, doc: str = "doc_id", text: str = "raw_content") -> tuple[DataFrame, DataFrame]:
    """(links, copies): (a, b, similarity) between class representatives, and (rep, member) of the classes of
    equal sets that have more than one member, the representative among them."""
    sets = cut(run_sets(documents, words, doc, text))
    named = sets.select("doc_id", "digest").distinct()
    several = named.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = cut(named.join(several.select("digest", "rep"), "digest").select("rep", F.col("doc_id").alias("member")))
    surplus = copies.where("member <> rep").select(F.col("member").alias("doc_id"))
    if surplus.count() <= BROADCAST_IDS:
        surplus = F.broadcast(surplus)
    single = sets.select("doc_id", "runs").join(surplus, "doc_id", "left_anti")
    plan = band_plan(threshold)
    drawn = bands(single.where(F.pmod(F.xxhash64("doc_id"), F.lit(DRAWN)) == 0), *plan)
    pairs = _alike(_candidates(bands(single, *plan), drawn, DRAWN), sets, threshold)
    whole = sets.select("doc_id", "runs")
    held = pairs.join(whole.select(F.col("doc_id").alias("a"), F.col("runs").alias("x")), "a").join(whole.select(F.col("doc_id").alias("b"), F.col("runs").alias("y")), "b")
    return _checked(held.select("a", "b", "x", "y"), threshold).dropDuplicates(["a", "b"]), copies


def near_copy_pairs(documents: DataFrame, threshold: float = 0.8, words: int = 5, doc: str = "doc_id", text: str = "raw_content") -> DataFrame:
    """(doc_a, doc_b) of all documents whose run sets are similar enough, copies included, doc_a < doc_b."""
    links, copies = near_copy_classes(documents, threshold, words, doc, text)
    left, right = copies.select(F.col("rep").alias("a"), F.col("member").alias("ma")), copies.select(F.col("rep").alias("b"), F.col("member").alias("mb"))
    apart = links.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("ma", "a").alias("x"), F.coalesce("mb", "b").alias("y"))
    within = copies.select("rep", F.col("member").alias("x")).join(copies.select("rep", F.col("member").alias("y")), "rep").where("x < y").select("x", "y")
    return apart.unionByName(within).select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))


def components(links: DataFrame) -> DataFrame:
    """(id, root) of every end of ``links`` (a, b): the least id that links lead to. Large and small stars in turn, until nothing
    changes: the rounds grow with the logarithm of the longest chain. Each round is kept in the checkpoint folder."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())

    def stars(edges: DataFrame, large: bool) -> DataFrame:
        """Every neighbour above a node (large), or the node and its neighbours below (small), is tied to the least of them all."""
        ends = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
        least = ends.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        tied = ends.join(least, "u")
        made = tied.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else tied.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        return made.where("u <> v").distinct()

    state = None
    while True:
        edges = cut(stars(cut(stars(edges, True)), False))
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v") % 1_000_003)).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root"))).distinct()


def near_copy_groups(documents: DataFrame, threshold: float = 0.8, words: int = 5, doc: str = "doc_id", text: str = "raw_content") -> DataFrame:
    """(doc_id, group_id, links): one row for each document with a near copy: the least id of its group, which links tie together,
    and the number of documents similar to it. Copies are counted, not expanded: a text that a third of all rows share
    is one row in every shuffle but the last."""
    links, copies = near_copy_classes(documents, threshold, words, doc, text)
    links = cut(links)
    sizes = copies.groupBy("rep").agg(F.count(F.lit(1)).alias("n"))
    ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    size = F.coalesce("n", F.lit(1))
    outer = ends.join(sizes.withColumnRenamed("rep", "b"), "b", "left").groupBy("a").agg(F.sum(size).alias("outer"))
    reps = outer.select(F.col("a").alias("rep")).unionByName(sizes.select("rep")).distinct()
    told = reps.join(components(links).withColumnRenamed("id", "rep"), "rep", "left").join(outer.withColumnRenamed("a", "rep"), "rep", "left").join(sizes, "rep", "left")
    told = told.select("rep", F.coalesce("root", "rep").alias("group_id"), (F.coalesce("outer", F.lit(0)) + size - 1).alias("links"))
    return told.join(copies, "rep", "left").select(F.coalesce("member", "rep").alias("doc_id"), "group_id", "links")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copy_pairs(table(spark, sf_dir, "documents"), threshold=0.5, words=3)


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copy_groups(table(spark, sf_dir, "documents"), threshold=0.8, words=5)


SQL = {
    "p5_found": r"""
WITH w AS (SELECT doc_id, regexp_extract_all(lower(raw_content), '[\p{L}\p{N}]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS run FROM w),
k AS (SELECT doc_id, hash(run) AS h FROM s),
n AS (SELECT doc_id, count(*) AS n FROM k GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM k a JOIN k b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY 1, 2)
SELECT p.a AS doc_a, p.b AS doc_b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE c >= 0.5 * (x.n + y.n - c)"""
}
QUERIES = {"p5_found": p5_found, "p5_groups": p5_groups}
