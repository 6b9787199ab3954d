"""Language of each document and of each line of mixed documents, with a confidence.

Multilingual mixture inference: byte n-gram models give each line a likelihood in each language;
expectation-maximisation over the lines of a document estimates the document's language proportions; a
language stays in the document's set only if leaving it out costs more likelihood than the penalty. The proportions are
estimated until they settle (at most ``ROUNDS`` rounds). The languages are a closed set: a text in another language gets the
nearest of them, with what confidence its n-grams leave. The
lines then have the language of the largest posterior within the set.

The models are fitted on at most ``SAMPLE`` documents that bear a label (the only place where labels count)
plus a few seed words a language, and refitted on their own posteriors, so wrong labels are outvoted.
Everything else covers all rows and whole texts.

Scale: one map over the documents without shuffle; the model (2 MB, fixed by ``BUCKETS``) is broadcast.

Cases: null or empty text and texts without a line of ``LINE_WORDS`` words have no language and are no
cases; a null struct or label is a missing label; rows with a repeated id give repeated rows unless made
distinct; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpwork.sources.tables import hashed_sample, table

LANGUAGES = ("en", "de", "fr", "es")
# Spellings of the languages besides code and code with region, and frequent words of each language.
NAMES = {"english": "en", "eng": "en", "german": "de", "deutsch": "de", "deu": "de", "ger": "de", "french": "fr", "français": "fr", "francais": "fr", "fra": "fr", "fre": "fr", "spanish": "es", "español": "es", "espanol": "es", "castellano": "es", "spa": "es"}
SEEDS = {
    "en": "the of and to in is you that it was for on are as with his they at be this have from or had by not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei hatte kann gegen vom können schon wenn habe seine ihre dann unter wir soll ich eines jahr zwei diese dieser wieder keine seiner worden will zwischen immer was sagte gibt alle",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont mais comme ou si leur y dont aux avec cette ces ses son sa fait être ont tout nous vous elle entre sans aussi même bien où peut après deux encore depuis très été était avait faire leurs notre votre quand moins avant sous toute cela ainsi autres toujours trop ici rien",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué sólo han yo hay vez puede todos así nos ni parte tiene él uno donde bien tiempo mismo ese ahora cada e vida otro después te otros aunque esa eso hace otra gobierno tan durante siempre día",
}
SAMPLE, REFITS, LINE_WORDS = 4_000, 2, 10
BUCKETS, SIZES = 1 << 17, (3, 4)
#: Overlapping n-grams repeat evidence: likelihoods are scaled down by this. Penalty of a language in a document's set, in scaled units.
TEMPER, PENALTY, ROUNDS, SETTLED = 4.0, 4.0, 100, 1e-2
#: Smallest probability of an n-gram, in counts of the best known language; what a label adds to the first scores.
FLOOR, LABEL_WEIGHT = 0.05, 3.0
#: Code lines begin with a mark of code, or have one sign of code for every three words and four at least: prose has fewer.
_CODE, _SIGNS, SIGN_WORDS = re.compile(r"\s*(?:```|\$ |>>> )"), re.compile(r"[{}\[\];=<>_\\$]|\w\(|\w\.\w+\("), 3


def label_language(label: str | None) -> str | None:
    """en, de, fr or es for a code, a code with region or a name in any case; otherwise the code or name as it is,
    and None for what names no language."""
    key = (label or "").strip().lower()
    if key in NAMES:
        return NAMES[key]
    code = re.split(r"[-_ ]", key)[0]
    if code in NAMES:
        return NAMES[code]
    return code if re.fullmatch(r"[a-z]{2,3}", code) and code not in ("und", "mul", "zxx", "mis", "nan") else None


@lru_cache(maxsize=1)
def _alnum() -> np.ndarray:
    return np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)


def word_counts(lines: list[str]) -> np.ndarray:
    """Maximal runs of letters or digits in each line; lines hold no newline."""
    cp = np.frombuffer(("\n".join(lines) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
    word = _alnum()[cp]
    starts = word & ~np.r_[False, word[:-1]]
    ends = np.flatnonzero(cp == 10)
    return np.diff(np.r_[0, np.cumsum(starts)[ends]])


def is_code(line: str, words: int) -> bool:
    return bool(_CODE.match(line)) or len(_SIGNS.findall(line)) >= max(4, words / SIGN_WORDS)


def _grams(lines: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each size: (buckets of all n-grams, first n-gram of each line). Lines end in a space."""
    raw = ("\n".join(lines) + "\n").lower().encode("utf-8", "replace")
    ends = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
    starts = np.r_[0, ends[:-1] + 1]
    data = np.frombuffer(raw, np.uint8).astype(np.uint32)
    data[ends] = 32
    for k, n in enumerate(SIZES):
        h = data ^ np.uint32(k)
        h *= np.uint32(0x01000193)
        for j in range(1, n):
            h[:-j] ^= data[j:]
            h[-j:] ^= np.uint32(32)
            h *= np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        h &= np.uint32(BUCKETS - 1)
        yield h, starts


def line_scores(lines: list[str], model: np.ndarray) -> np.ndarray:
    """Log likelihood of each line in each language, less that of the best, scaled."""
    if not lines:
        return np.zeros((0, model.shape[1]), np.float32)
    total = sum(np.add.reduceat(np.take(model, g, axis=0), s, axis=0) for g, s in _grams(lines))
    return (total - total.max(axis=1, keepdims=True)) / TEMPER


def _counts(lines: list[str], weight: np.ndarray) -> np.ndarray:
    out = np.zeros((weight.shape[1], BUCKETS))
    for g, s in _grams(lines):
        row = np.repeat(np.arange(len(lines)), np.diff(np.r_[s, len(g)]))
        for k in range(weight.shape[1]):
            out[k] += np.bincount(g, weights=weight[row, k], minlength=BUCKETS)
    return out


def _model(counts: np.ndarray) -> np.ndarray:
    total = counts.sum(1, keepdims=True)
    p = np.log(counts / np.maximum(total, 1) + FLOOR / max(total.max(), 1)).T  # one floor for all, or a rare language would like what is unknown
    return np.ascontiguousarray((p - p.max(1, keepdims=True)).astype(np.float32))


def fit(texts: list[str], labels: list[str | None], languages: tuple[str, ...] = LANGUAGES) -> np.ndarray:
    """n-gram model: rows are buckets, columns languages."""
    seeds = _counts([SEEDS.get(k, k) for k in languages], np.eye(len(languages)))
    lines, weight = [], []
    for t, l in zip(texts, labels):
        if l in languages:
            w = np.eye(len(languages))[languages.index(l)]
            for line in (t or "").split("\n"):
                lines.append(line)
                weight.append(w)
    if not lines:
        return _model(seeds)
    keep = np.flatnonzero(word_counts(lines) >= LINE_WORDS)
    lines, w = [lines[i] for i in keep], np.array(weight)[keep]
    if not lines:
        return _model(seeds)
    model = _model(seeds)
    for n in range(REFITS + 1):
        post = np.exp(line_scores(lines, model) + (LABEL_WEIGHT * w if n == 0 else 0))
        model = _model(seeds + _counts(lines, post / post.sum(1, keepdims=True)))
    return model


def _per(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, axis=0)


def mixture(score: np.ndarray, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(set of each document, posterior of each line): rows are languages' columns. Every document has a line."""
    doc = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(score)]))
    like = np.exp(np.maximum(score, -60.0))
    weight = words / _per(words.astype(float), starts)[doc]

    def em(allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        share = allowed / allowed.sum(1, keepdims=True)
        for _ in range(ROUNDS):
            joint = like * share[doc]
            mass = joint.sum(1, keepdims=True)
            post = joint / np.maximum(mass, 1e-300)
            before, share = share, _per(post * weight[:, None], starts)
            if np.abs(share - before).max() < SETTLED:
                break
        joint = like * np.maximum(share, 1e-12 * allowed)[doc]
        mass = joint.sum(1)
        return joint / np.maximum(mass, 1e-300)[:, None], share, _per(np.log(np.maximum(mass, 1e-300)), starts)

    allowed = np.ones((len(starts), score.shape[1]))
    for _ in range(score.shape[1] - 1):  # drop the language that costs least, while that is below the penalty
        _, share, whole = em(allowed)
        loss = np.full(allowed.shape, np.inf)
        for k in range(score.shape[1]):
            less = allowed.copy()
            less[:, k] = 0
            can = (allowed[:, k] > 0) & (less.sum(1) > 0)
            if can.any():
                less[~can] = allowed[~can]
                loss[can, k] = (whole - em(less)[2])[can]
        worst = loss.argmin(1)
        drop = loss[np.arange(len(loss)), worst] < PENALTY
        if not drop.any():
            break
        allowed[np.flatnonzero(drop), worst[drop]] = 0
    return allowed > 0, em(allowed)[0]


def detect(documents: DataFrame, doc: str = "doc_id", text: str = "raw_content", label: str = "metadata.language", languages: tuple[str, ...] = LANGUAGES) -> DataFrame:
    """(doc_id, line_no, language, confidence, labelled): line 0 is the document, with the posterior of its language over all of its words as
    confidence and ``labelled`` telling whether its label names that language; lines from 1 are those
    of documents in several languages, with the posterior as confidence."""
    rows = documents.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"), F.col(label).alias("label"))
    spark = documents.sparkSession
    drawn = hashed_sample(rows.where(F.col("label").isNotNull() & (F.trim("label") != "")), "doc_id", SAMPLE).select("text", "label").toArrow()
    model = spark.sparkContext.broadcast(fit(drawn["text"].to_pylist(), [label_language(x) for x in drawn["label"].to_pylist()], languages))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                yield _detected(whole.slice(at, 500), model.value, languages)

    return rows.mapInArrow(make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, line_no int, language string, confidence double, labelled boolean")


def _detected(b: pa.RecordBatch, model: np.ndarray, languages: tuple[str, ...]) -> pa.RecordBatch:
    lines, count = [], []
    for t in b.column(1).to_pylist():
        own = t.split("\n") if t else []
        lines += own
        count.append(len(own))
    n = word_counts(lines) if lines else np.zeros(0, np.int64)
    of = np.repeat(np.arange(len(count)), count)
    no = np.arange(len(lines)) - np.repeat(np.cumsum(count) - count, count) + 1
    keep = np.flatnonzero(n >= LINE_WORDS)
    keep = np.array([i for i in keep if lines[i].count(" | ") < 2 and not is_code(lines[i], n[i])], np.int64)
    names = ["doc_id", "line_no", "language", "confidence", "labelled"]
    if not len(keep):
        empty = [pa.array([], b.schema.field(0).type), pa.array([], pa.int32()), pa.array([], pa.string()), pa.array([], pa.float64()), pa.array([], pa.bool_())]
        return pa.RecordBatch.from_arrays(empty, names)
    docs, starts = np.unique(of[keep], return_index=True)
    words = n[keep]
    chosen, post = mixture(line_scores([lines[i] for i in keep], model), words, starts)
    best = post.argmax(1)
    held = _per(np.eye(len(languages))[best] * words[:, None], starts)
    main = held.argmax(1)
    sure = _per(post[np.arange(len(keep)), np.repeat(main, np.diff(np.r_[starts, len(keep)]))] * words, starts) / _per(words.astype(float), starts)
    name = np.array(languages, object)
    labels = [label_language(x) for x in b.column(2).take(pa.array(docs)).to_pylist()]
    agree = [x == name[m] for x, m in zip(labels, main)]
    mixed = (held > 0).sum(1) > 1
    line = np.flatnonzero(np.repeat(mixed, np.diff(np.r_[starts, len(keep)])))
    take = np.r_[docs, of[keep][line]]
    return pa.RecordBatch.from_arrays(
        [
            b.column(0).take(pa.array(take)),
            pa.array(np.r_[np.zeros(len(docs), np.int64), no[keep][line]], pa.int32()),
            pa.array(np.r_[name[main], name[best[line]]], pa.string()),
            pa.array(np.r_[sure, post[line, best[line]]], pa.float64()),
            pa.array([*agree, *[None] * len(line)], pa.bool_()),
        ],
        names,
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents"))
    return found.where("line_no > 0 OR NOT labelled").select("doc_id", "line_no", "language").distinct()


SQL: dict[str, str] = {}
QUERIES = {"p3_found": p3_found}
