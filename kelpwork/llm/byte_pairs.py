"""Encoding of texts with a public byte-level BPE tokenizer.

A batch of texts is cut into pieces by the tokenizer's pattern, its distinct pieces are put into
length-bucketed, padded matrices of symbol ids, and every matrix is merged round by round: each row
merges its leftmost pair of minimum rank, looked up in an open-addressed hash table of pairs, and the
further occurrences of that pair to its right (not overlapping), and is compacted; rows without a pair in the table leave the
matrix. That is what one leftmost merge a round comes to, since a pair that a merge creates always has a higher rank than
the merge itself, and one unbroken run of 100,000 letters takes few rounds. Only the pairs beside new symbols are looked up anew.

The vocabulary file is a parameter; the driver reads it once and sends its two arrays (50,000 merges, a
size fixed by the vocabulary) to the tasks. Pieces already encoded by a Python worker are kept in a
table of at most ``CACHE`` pieces, which is emptied when full.

Scale: a map over the rows without shuffle; only the id and the text are read.

Cases: null and empty texts have an empty list; text is encoded as it stands, special tokens in it are
ordinary text; very long pieces take their own bucket; repeated rows give repeated results; extra
columns are ignored.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpwork.sources.tables import table

TOKENIZERS = os.environ.get("KELPWORK_TOKENIZERS", "/opt/tokenizers")
NAME = "byte_bpe_50k"
CACHE = 300_000
#: White space of the pattern: Unicode's, which the regex module's \s is not.
_S = r"\t-\r \x85\xa0  -     　"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
_NONE = np.int32(2**30)


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for the 256 bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Hash table of the pairs: ``look(left, right)`` gives ranks, ``made`` the id that a rank makes."""

    def __init__(self, left: np.ndarray, right: np.ndarray, made: np.ndarray, single: np.ndarray):
        self.made, self.single = made, single
        bits = int(np.ceil(np.log2(max(4, 4 * left.size))))
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.keys, self.ranks = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int32)
        key = left.astype(np.int64) << 32 | right
        todo = np.arange(key.size)
        slot = self._slot(key)
        while todo.size:  # each round, one pair per free slot; the others probe on
            free = self.keys[slot[todo]] == -1
            got, first = np.unique(slot[todo[free]], return_index=True)
            put = todo[free][first]
            self.keys[got], self.ranks[got] = key[put], put
            todo = np.setdiff1d(todo, put)
            slot[todo] = (slot[todo] + 1) & self.mask
        self.probes = 1
        at = self._slot(key)
        while (lost := self.keys[at] != key).any():
            at = np.where(lost, (at + 1) & self.mask, at)
            self.probes += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 32 | right
        slot = self._slot(key)
        rank = np.full(key.shape, _NONE, np.int32)
        open_ = np.ones(key.shape, bool)
        for _ in range(self.probes):
            there = self.keys[slot]
            hit = there == key
            rank[hit] = self.ranks[slot[hit]]
            open_ &= ~hit & (there != -1)
            if not open_.any():
                break
            slot = (slot + 1) & self.mask
        return rank


def read_merges(folder: str = TOKENIZERS, name: str = NAME) -> tuple[np.ndarray, ...]:
    """(left, right, made, single) of the vocabulary file ``name``.json: ids in order of rank, and each byte's id."""
    with open(os.path.join(folder, f"{name}.json"), encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab = model["vocab"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    single = np.zeros(256, np.int32)
    for letter, b in _byte_letters().items():
        single[b] = vocab[letter]
    return (*(np.array([vocab[x] for x in xs], np.int32) for xs in ([a for a, _ in pairs], [b for _, b in pairs], [a + b for a, b in pairs])), single)


def _merged(sym: np.ndarray, size: np.ndarray, merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Rows of symbols, padded with -1 behind ``size``, merged to the end."""
    out, sizes = np.full_like(sym, -1), size.copy()
    rows = np.arange(len(sym))
    rank = np.where(np.arange(sym.shape[1] - 1) < (size - 1)[:, None], merges.look(sym[:, :-1], np.maximum(sym[:, 1:], 0)), _NONE) if sym.shape[1] > 1 else None
    while rank is not None and len(rows):
        best = rank.min(axis=1)
        done = best == _NONE
        if done.any():
            out[rows[done], : sym.shape[1]], sizes[rows[done]] = sym[done], size[done]
            sym, size, rank, rows, best = sym[~done], size[~done], rank[~done], rows[~done], best[~done]
            if not len(rows):
                return out, sizes
        width = int(size.max())
        sym, rank = sym[:, :width], rank[:, : width - 1]
        hit = rank == best[:, None]
        if (hit[:, 1:] & hit[:, :-1]).any():  # of a run of equal symbols every other pair
            col = np.arange(width - 1)
            first = hit & ~np.pad(hit[:, :-1], ((0, 0), (1, 0)))
            hit &= (col - np.maximum.accumulate(np.where(first, col, 0), axis=1)) % 2 == 0
        r, c = np.nonzero(hit)
        sym[r, c] = merges.made[best[r]]
        keep = np.arange(width) < size[:, None]
        keep[r, c + 1] = False
        place = np.cumsum(keep, 1) - 1
        kr, kc = np.nonzero(keep)
        to = place[kr, kc]
        packed, ranks = np.full_like(sym, -1), np.full((len(rows), width), _NONE, rank.dtype)
        packed[kr, to] = sym[kr, kc]
        inner = kc < width - 1
        ranks[kr[inner], to[inner]] = rank[kr[inner], kc[inner]]
        sym, size = packed, keep.sum(1)
        at = place[r, c]
        for side in (at - 1, at):  # only the pairs beside the new symbols are new
            ok = (side >= 0) & (side + 1 < size[r])
            line, left = r[ok], side[ok]
            ranks[line, left] = merges.look(sym[line, left], sym[line, left + 1])
        end = at + 1 >= size[r]
        ranks[r[end], at[end]] = _NONE
        rank = ranks[:, : width - 1]
    if rank is None:
        out[:] = sym
    return out, sizes


def encode_pieces(pieces: list[bytes], merges: Merges) -> list[np.ndarray]:
    """The ids of each piece, by buckets of powers of two of its length."""
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    result: list = [None] * len(pieces)
    bucket = np.ceil(np.log2(np.maximum(size, 1))).astype(int)
    for b in np.unique(bucket):
        members = np.flatnonzero(bucket == b)
        step = max(1, (1 << 22) >> max(int(b), 1))
        for part in (members[i : i + step] for i in range(0, len(members), step)):
            n = size[part]
            flat = merges.single[np.frombuffer(b"".join(pieces[i] for i in part), np.uint8)]
            sym = np.full((len(part), int(n.max())), -1, np.int32)
            sym[np.arange(sym.shape[1]) < n[:, None]] = flat
            ids, sizes = _merged(sym, n, merges)
            for i, line, k in zip(part, ids, sizes):
                result[i] = line[:k]
    return result


@lru_cache(maxsize=1)
def _splitter():
    import regex

    return regex.compile(PATTERN)


class Encoder:
    """Texts to (flat ids, number of ids of each text), with a bounded table of known pieces."""

    def __init__(self, arrays: tuple[np.ndarray, ...]):
        self.merges = Merges(*arrays)
        self.number: dict[str, int] = {}
        self.flat, self.start, self.length = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, new: list[str]) -> None:
        got = encode_pieces([p.encode() for p in new], self.merges)
        length = np.fromiter(map(len, got), np.int64, len(got))
        self.start = np.r_[self.start, self.flat.size + np.cumsum(length) - length]
        self.length = np.r_[self.length, length]
        self.flat = np.concatenate([self.flat, *got])
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.number) > CACHE:
            self.number, self.flat, self.start, self.length = {}, self.flat[:0], self.start[:0], self.length[:0]
        find, pieces, count = _splitter().findall, [], np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                found = find(t)
                count[i] = len(found)
                pieces += found
        if new := [p for p in dict.fromkeys(pieces) if p not in self.number]:
            self._learn(new)
        at = np.fromiter(map(self.number.__getitem__, pieces), np.int64, len(pieces))
        n = self.length[at]
        ids = self.flat[np.repeat(self.start[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        text = np.repeat(np.arange(len(texts)), count)
        return ids, np.bincount(text, weights=n, minlength=len(texts)).astype(np.int64)


_encoders: dict[str, Encoder] = {}


def encoder(key: str, arrays: tuple[np.ndarray, ...]) -> Encoder:
    """The worker's encoder; it outlives a task where Spark keeps the worker."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(arrays)
    return _encoders[key]




def encode(documents: DataFrame, doc: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, name: str = NAME, only_count: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, *keep, ids) of every row, or (doc_id, *keep, n_tokens) if ``only_count``."""
    shared = documents.sparkSession.sparkContext.broadcast(read_merges(folder, name))
    key = f"{folder}/{name}"
    rows = documents.select(F.col(doc).alias("doc_id"), *keep, F.col(text).alias("__text"))
    names = ["doc_id", *keep, "n_tokens" if only_count else "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(key, shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                ids, n = known(b.column(b.num_columns - 1).to_pylist())
                out = pa.array(n, pa.int64()) if only_count else pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], out], names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{schema}, " + ("n_tokens bigint" if only_count else "ids array<int>"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


SQL: dict[str, str] = {}
QUERIES = {"p7_ids": p7_ids}
