"""Broken prompt and response pairs.

Responses are cut into clauses (sentences, list items, code lines). A linear-chain conditional random field
tags each clause as answer, refusal, echo, foreign or unfinished, from hashed words and word pairs, kinds of words (first
person, negation, words of speaking, knowing, regret and declining), the endings of the last clause, its overlap with the question
and its language against the question's. The words under each tag are then added up, and their shares decide the
defect of the pair.

The field is trained here, on all pairs of the table. No feature holds a label. Echoes are
made by putting questions, also changed, in the place of answers; foreign answers by giving questions the answers of rows in another
language; unfinished ones by cutting finished answers at random places, finished ones without a stop by removing it; refusals are
labelled by seed phrases, which the features do not have and nothing after the training uses. All other answers begin
as answers and then get the tags of the round before (self-training), so that the defects among them do not stay
labelled as sound. The language model and the counts of sentence ends come from all texts too.

Scale: two maps over the rows, one that adds up n-grams and one that makes chunks of features, in the order of a hash of the row, into the checkpoint
folder (about 1.5 times the input), where the parts of training are kept apart once more (0.7 times); each step of training is a map over one part, all parts in turn, whose
sums are as large as the model; the last map decodes the chunks. Models and counts (about 12 MB, fixed by ``BUCKETS``, ``WORDS`` and ``TAILS``) are broadcast; the counts of
words (one row a bucket) come to the driver. Results of repeated rows are made distinct by id, a shuffle of defective rows only.

Cases: null, empty, invisible and placeholder answers are ``empty``; a null question is an empty one, has no
language and cannot be copied; very long answers are chains like any other; an empty table gives no rows;
ids may repeat; extra columns are ignored.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpwork.llm.languages import BUCKETS as BYTES
from kelpwork.llm.languages import LANGUAGES, SEEDS, TEMPER, _alnum, _counts, _grams, _model, line_scores
from kelpwork.sources.tables import cut, table

TAGS = ("answer", "refusal", "echo", "foreign", "unfinished")
ANSWER, REFUSAL, ECHO, FOREIGN, UNFINISHED = range(5)
#: Passes over all texts that fit the language model.
REFITS = 1
#: Buckets of grams, of words and of endings; dense columns of a clause.
BUCKETS, WORDS, TAILS, COLUMNS = 1 << 15, 1 << 20, 1 << 16, 24 + 15
#: Steps and rate of each round of training; what holds down grams, of which most are rare, columns and transitions; weight of a made pair.
ROUNDS, L2, MADE = ((48, 0.2), (24, 0.15)), (8.0, 0.1, 0.1), 1.6
#: Pairs of a chunk and of a task that makes chunks; slices of sums, and up to how many tasks the driver adds up their sums. A step of training goes over one part of the table, which has one of ``TURNS`` parts, each of
#: at least ``TURN`` pairs; the parts take turns, each as often as any, so all pairs count alike.
CHUNK, PART, SLOTS, FEW, TURNS, TURN = 2_000, 16_000, 4, 64, (1, 2, 3, 4, 6, 8, 12), 6_000
FOREIGN_WORDS, SHORT_WORDS = 5, 4
#: A gram found in fewer clauses of the table has no weight: it would tell the clause, not the kind.
USUAL = 6
_INVISIBLE = re.compile("[­͏؜ᅟᅠ឴឵᠋-᠎​-‏‪-‮⁠-⁯ㅤ︀-️﻿ﾠ\x00-\x08\x0e-\x1f\x7f]")
# Placeholders and failure marks that stand where an answer should be.
_PLACEHOLDER = re.compile(r"^(?:n\.?/?a\.?|null|none|nil|nan|undefined|unknown error|tbd|todo|empty|no answer|keine antwort|sans réponse|sin respuesta|[\[<({]+\s*(?:[^\]>)}]*\b(?:failed|failure|error|timeout|timed out|empty|no answer|placeholder|null|none)\b[^\]>)}]*)[\]>)}]+)$", re.I)
_BREAK = re.compile(r"(?<=[^\W\d][.!?…])[\"»”')\]]*\s+|(?<=[)\]\"»”][.!?…])\s+|\s+(?=https?://)|\s*\n+\s*")
#: The same for texts without line break and link, quicker: a match begins with the stop.
_STOP = re.compile("[.!?…](?:(?<=[^\\W\\d].)[\"»”')\\]]*|(?<=[)\\]\"»”].))\\s+")
_WORD = re.compile(r"[^\W_]+")
_MARK = re.compile(r"(?:[-*•] |\d+[.)] )").match
# Seed phrases of refusals, which label training clauses.
_SEED = re.compile(
    r"\b(?:i (?:cannot|can't|can not|could not|am unable|am not able|must decline|don't have|do not have|don't know|do not know)\b|impossible for me|unable to help|holds? no information about|(?:nothing|no information) about .{0,60} in the (?:text|documents?|passages?|context)"
    r"|ich kann .{0,60}nicht (?:beantworten|weiterhelfen|sagen)|kann ich (?:leider )?nicht (?:weiterhelfen|beantworten|helfen)|liegen mir keine|ich darf mich|geht das leider nicht hervor|(?:kontext|text) enthält keine|ich weiß (?:es )?nicht"
    r"|je ne peux pas|je ne (?:sais|suis) pas|m'est impossible|je n'ai pas assez|(?:contexte|texte|documents?) ne (?:dit|disent|contient|contiennent)|je dois refuser|je refuse"
    r"|no puedo (?:responder|ayudar|decir|contestar)|me es imposible|no tengo suficiente|(?:contexto|texto) no (?:dice|contiene)|no sé\b|debo rechazar|no me es posible)",
    re.I,
)
# Every seed phrase holds one of these, which are quicker to look for.
_HINTS = ("i can", "i could not", "i am ", "i must decline", "i don't", "i do not", "impossible for me", "unable to help", "no information about", "nothing about", "ich kann ", "kann ich ", "liegen mir keine", "ich darf mich", "geht das leider", "enthält keine", "ich weiß ", "je ne ", "m'est impossible", "je n'ai pas", " ne di", " ne contien", "je dois refuser", "je refuse", "no puedo ", "me es imposible", "no tengo suficiente", "no dice", "no contiene", "no sé", "debo rechazar", "no me es posible")
# Kinds of words, as beginnings (a final blank ends the word): what a refusal is made of, and much else too. Shortened
# words stand as they are cut at the apostrophe.
KINDS = {
    "first": "i |me |my |we |our |us |ich |mir |mich |mein|wir |uns |je |j |me |m |moi |mon |nous |yo |mí |mi |nos |puedo |quiero |prefiero |debo |tengo |dispongo |lamento |siento |sé |estoy |soy ",
    "not": "not |cannot |won |don |doesn |didn |couldn |wouldn |shouldn |isn |aren |haven |hasn |no |nothing |none |unable |without |never |neither |nicht |kein|nichts |nie |ne |n |pas |rien |aucun|impossible |non |ni |nada |ningun|ningún|sin |imposible |unmöglich |außerstande ",
    "speak": "answer|respond|reply|say |saying |tell |comment|help|assist|discuss|address |speak|provide|offer|give |share |beantwort|antwort|sagen |sage |äußern |weiterhelf|helfen |helfe |auskunft|mitteil|stellung|répon|répond|dire |dis |aider |aide |comment|fournir |donner |exprim|renseign|parler |respond|respuesta|decir |digo |ayuda|contest|comentar|facilitar |ofrecer |hablar |pronunci|opinar ",
    "know": "information|detail|context|passage|document|source|material|data |knowledge |know|mention|text |angaben |kontext |quelle|unterlage|weiß |wissen |erwähn|daten |bekannt|geht |renseignement|contexte |texte |sais |savoir |données |précis|indicat|información |contexto |texto |datos |sabe|menciona|documento|fuente",
    "regret": "sorry |apolog|unfortunately |regret|afraid |leider |leid |bedau|entschuldig|verzeih|désol|malheureusement |regrett|excus|navr|lament|siento |sentimos |disculp|perdón |desgraciad|desafortunad",
    "decline": "declin|refus|prefer|rather |must |allowed |permitted |able |comfortable |willing|ablehn|lehne |verweiger|darf |möchte |lieber |imstande |lage |verzicht|préf|refus|abst|autoris|mesure |capable |souhait|rechaz|prefier|niego |negar|abst|permit|posible |condiciones |dispuest",
}
_BEGINNINGS: dict[str, list[tuple[str, int]]] = {}  # by first letter
for _k, _v in enumerate(KINDS.values()):
    for _w in _v.split("|"):
        _BEGINNINGS.setdefault(_w[0], []).append((_w, 1 << _k))


class _Known(dict):
    """Word: its hash, and above that its kinds, one bit each."""

    def __missing__(self, word: str) -> int:
        found = 0
        for beginning, bit in _BEGINNINGS.get(word[0], ()):
            if word == beginning[:-1] if beginning[-1] == " " else word.startswith(beginning):
                found |= bit
        self[word] = x = xxhash.xxh32_intdigest(word) | found << 32
        return x


_known = _Known()


def word_kinds(kinds: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which kinds of words each clause has, and which of them together; ``kinds`` of the words of all clauses, ``size`` words a clause."""
    bits = np.zeros(len(size), np.int64)
    has = np.flatnonzero(size)
    if len(has):
        bits[has] = np.bitwise_or.reduceat(kinds, (np.cumsum(size) - size)[has])
    first, no, speak, know, regret, decline = ((bits >> k & 1).astype(bool) for k in range(6))
    return np.stack([first, no, speak, know, regret, decline, first & no, first & decline, first & (no | decline) & speak, first & no & know, no & speak, no & know, regret & no, regret & (no | decline) & (speak | know), first & (no | decline) & (speak | know)], 1).astype(np.float32)


def visible(text: str | None) -> str:
    return _INVISIBLE.sub("", text or "").strip()


def is_empty(text: str | None) -> bool:
    """Nothing visible, no letter or digit at all, or only a placeholder or failure mark."""
    return not _told(visible(text))


def _told(plain: str) -> bool:
    return bool(_WORD.search(plain)) and not _PLACEHOLDER.match(plain)


def clauses(text: str) -> list[str]:
    if "http" in text:
        parts = _BREAK.split(text)
    else:
        parts, at = [], 0
        for m in _STOP.finditer(text):
            parts.append(text[at : m.start() + 1])
            at = m.end()
        parts.append(text[at:])
        if "\n" in text:
            parts = [x for p in parts for x in p.split("\n")]
    return [c for c in map(str.strip, parts) if c and (c[0].isalnum() or _WORD.search(c) or "```" in c)] or [" ".join(text.split())]


def split_words(texts: list[str], changes: tuple[tuple[str, str], ...] = ()) -> tuple[list[str], np.ndarray]:
    """(the words of all texts in small letters, as ``_WORD`` finds them after the ``changes``; how many each text has)."""
    if not texts:
        return [], np.zeros(0, np.int64)
    one = "\0".join(texts)
    if one.count("\0") >= len(texts):
        one = "\0".join(t.replace("\0", " ") for t in texts)
    one = (one + "\0").lower()
    for x, y in changes:
        one = one.replace(x, y)
    cp = np.frombuffer(one.encode("utf-32-le", "surrogatepass"), np.uint32)
    word = np.take(_alnum(), cp)
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    size = np.diff(np.r_[0, np.cumsum(starts)[np.flatnonzero(cp == 0)]])
    return np.where(word, cp, np.uint32(32)).tobytes().decode("utf-32-le").split(), size


def _hash(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh32_intdigest, words), np.uint32, len(words))


def _hash_kinds(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and kinds of words, which come again and again."""
    if len(_known) > 500_000:
        _known.clear()
    x = np.fromiter(map(_known.__getitem__, words), np.int64, len(words))
    return (x & 0xFFFFFFFF).astype(np.uint32), x >> 32


def _different(x: np.ndarray) -> np.ndarray:
    """``np.unique``, by sorting, which is quicker for a few thousand numbers."""
    x = np.sort(x)
    return x[np.r_[True, x[1:] != x[:-1]]] if len(x) else x


def _within(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``x`` are among ``known``, which is sorted."""
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x7FEB352D)
    return (h ^ (h >> np.uint32(15))) * np.uint32(0x846CA68B)


class Ends:
    """How often words, and endings of words, stand last in a finished clause and elsewhere. Words are hashed to ``WORDS`` buckets, endings to ``TAILS``."""

    def __init__(self, last: np.ndarray, inner: np.ndarray, tail: np.ndarray):
        self.last, self.inner, self.tail = last, inner, tail

    @classmethod
    def of(cls, word: np.ndarray, tail: np.ndarray, last: np.ndarray, inner: np.ndarray) -> Ends:
        """From rows of (word, ending, times last, times elsewhere); a word may have several rows."""
        different = np.unique(word.astype(np.int64) * TAILS + tail) % TAILS
        sums = [np.bincount(word, weights=x, minlength=WORDS).astype(np.float32) for x in (last, inner)]
        return cls(*sums, np.bincount(different, minlength=TAILS).astype(np.float32))

    def fill(self, dense: np.ndarray, f: dict) -> None:
        """Sets the columns of the last words: log odds of the word to stand last, whether it is known, how usual its ending is.
        What the row itself, or the row it was made of, adds to the counts is taken off, so that no clause knows itself."""
        at = f["end"][f["loose"]]
        word, tail, long, digit, own_last, own_inner = f["ended"].T
        a, b = self.last[word] - own_last, self.inner[word] - own_inner
        known = (a + b > 1) | (digit > 0)
        dense[at, 16], dense[at, 17] = np.log((a + 0.3) / (b * 0.3 + 0.3)) / 3, known
        dense[at, 18] = np.where(known, 0, np.where(long > 0, np.log(np.maximum(self.tail[tail] - (own_last + own_inner > 0) * (a + b == 0), 0) + 0.2), -1.0) / 3)
        dense[at, 19] = ~known


class Features:
    """Clauses of a batch of pairs: sparse gram buckets and dense columns."""

    def __init__(self, questions: list[str], answers: list[str], languages: np.ndarray, ends: Ends | None = None, cut: dict[str, list[str]] | None = None):
        parts = [clauses(a) for a in answers] if cut is None else [cut.get(a) or clauses(a) for a in answers]  # ``cut``: clauses of answers, as far as they are known
        self.count = np.fromiter(map(len, parts), np.int64, len(parts))
        flat = [c for p in parts for c in p]
        self.row = np.repeat(np.arange(len(parts)), self.count)
        self.end = np.cumsum(self.count) - 1
        n = len(flat)
        last = np.zeros(n, bool)
        last[self.end] = True
        word, self.words = split_words(flat, (("can't", "cannot"), ("can’t", "cannot")))
        qword, asked = split_words(questions)
        h, kinds = _hash_kinds(word)
        of = np.repeat(np.arange(n), self.words)
        g, _ = _hash_kinds(qword)
        qof = np.repeat(np.arange(len(asked)), asked)
        pair = lambda x, o: (_mix(x[:-1] * np.uint32(31) + x[1:])[o[:-1] == o[1:]], o[:-1][o[:-1] == o[1:]])
        hp, hof = pair(h, of) if len(h) > 1 else (h[:0], of[:0])
        gp, gof = pair(g, qof) if len(g) > 1 else (g[:0], qof[:0])
        # overlap of the clause's word pairs with the question's, and of the question's with the clause
        known = _different(gof.astype(np.uint64) << np.uint64(32) | gp)
        mine = self.row[hof].astype(np.uint64) << np.uint64(32) | hp
        hit = _within(mine, known)
        pairs = np.bincount(hof, minlength=n)
        hits = np.bincount(hof, weights=hit, minlength=n)
        copied = hits / np.maximum(pairs, 1)
        held = np.bincount((known >> np.uint64(32)).astype(np.int64), minlength=len(asked)).astype(float)
        covers = np.minimum(hits / np.maximum(held[self.row], 1), 1)
        # language against the question's
        score = line_scores([*flat, *(" ".join(q.split()) for q in questions), "    "], languages)  # the last line: n-grams need four bytes
        cs, qs = score[:n], score[n:-1]
        self.qlang = qlang = qs.argmax(1)
        margin = -cs[np.arange(n), qlang[self.row]]
        sure = (-np.sort(-qs, axis=1)[:, 1] < -1.0) & (asked > 0)
        self.foreign = np.where((self.words >= FOREIGN_WORDS) & sure[self.row], np.minimum(margin, 12.0), 0.0)
        self.lost = cs.argmax(1) != qlang[self.row]
        # the end of the response
        ends_in = [flat[e] for e in self.end.tolist()]
        stop = np.array([c.rstrip("\"»”')]").endswith((".", "!", "?")) for c in ends_in], bool)
        torn = np.array([c.endswith(("-", ",", "(", ":", "–", "—", "/", "…", "...")) for c in ends_in], bool)
        fence = np.array([a.count("```") % 2 == 1 for a in answers], bool)
        mark = np.array([bool(_MARK(c)) for c in ends_in], bool)
        link = np.array([c.startswith("http") or "```" in c for c in ends_in], bool)
        stop &= ~torn
        only, at = self.count == 1, self.end
        few = only & (self.words[at] <= SHORT_WORDS)  # too few words for their endings to tell
        dense = np.zeros((n, COLUMNS), np.float32)
        dense[:, 0] = 1
        dense[:, 1], dense[:, 2] = copied, covers
        their = _different(qof.astype(np.uint64) << np.uint64(32) | g)
        same = np.bincount(of, weights=_within(self.row[of].astype(np.uint64) << np.uint64(32) | h, their), minlength=n) / np.maximum(self.words, 1)
        dense[:, 3], dense[:, 21], dense[:, 22] = same, copied * covers, (pairs < 2) | (held[self.row] < 2)
        dense[:, 4], dense[:, 5] = self.foreign / 6, np.minimum(self.foreign, 3) / 3
        dense[:, 23] = np.where(sure[self.row], 1 - np.exp(-margin), 0)
        dense[:, 24:] = word_kinds(kinds, self.words)
        dense[:, 6] = np.minimum(self.words, 20) / 20
        for k, x in enumerate((stop, torn & ~stop, fence, mark & ~stop, link & ~fence, only & ~stop, ~only & ~stop & ~mark & ~link)):
            dense[at, 7 + k] = x
        dense[:, 14] = last
        dense[at, 15] = loose = ~stop & ~link
        dense[at, 20] = loose & few
        self.dense, self.stop, self.torn, self.fence, self.mark, self.link, self.only = dense, stop, torn, fence, mark, link, only
        self.copied, self.pairs = copied, pairs
        # grams: words and word pairs of all clauses; endings of last clauses that have no stop
        tails, owner, ended, lasts = [], [], [], []
        self.loose = np.flatnonzero(loose & ~few & (self.words[at] > 0))
        dense[at[loose & ~few & (self.words[at] == 0)], 19] = 1
        start = np.cumsum(self.words) - self.words
        for e, x in zip(at[self.loose].tolist(), start[at[self.loose]].tolist()):
            ws, t = word[x : x + int(self.words[e])], flat[e]
            w = ws[-1]
            cap = "A" if t[-len(w) : ][:1].isupper() else "a"
            before = ws[-2] if len(ws) > 1 else ""
            third, head, commas = ws[-3] if len(ws) > 2 else "", " ".join(ws[:2]), str(t.count(","))
            own = ["$1" + w, "$2" + before + " " + w, "$3" + cap + w[-3:], "$4" + cap + w[-2:] + str(min(len(w), 6)), "$5" + before, "$6" + third + " " + before + " " + cap + w[-2:], "$7" + head + " " + w[-3:], "$8" + head + commas, "$9" + head + commas + cap + w[-2:], "$a" + third + cap]
            part = _WORD.findall(t[t.rfind(",") + 1 :].lower())  # what stands behind the last comma: how it begins, how long it is
            size = str(min(len(part), 15))
            own += ["$b" + "".join(part[:1]) + size, "$c" + " ".join(part[:2]) + size, "$d" + " ".join(part[:2]) + cap + w[-2:], "$e" + commas + size]
            tails += own
            owner += [e] * len(own)
            ended.append((len(w) > 3, w.isdigit()))
            lasts.append(w)
        th = _hash(tails)
        gram = np.concatenate([_mix(h ^ np.uint32(0x51ED)), _mix(hp ^ np.uint32(0xA341)), _mix(th)]) % np.uint32(BUCKETS)
        clause = np.concatenate([of, hof, np.array(owner, np.int64)])
        order = np.argsort(clause, kind="stable")
        self.gram, self.clause = gram[order].astype(np.int64), clause[order]
        self.flat, self.parts, self.word, self.start, self.h, self.of = flat, parts, word, start, h, of
        # last words whose odds are filled in: bucket of the word, of its ending, long, digit, and what the row itself counts for
        self.ended = np.zeros((len(ended), 6), np.int64)
        if ended:
            self.ended[:, 0], self.ended[:, 1] = _hash(lasts) % np.uint32(WORDS), _hash([w[-3:] for w in lasts]) % np.uint32(TAILS)
            self.ended[:, 2:4] = ended
        if ends is not None:
            ends.fill(self.dense, vars(self))


#: The tags that words tell: refusals and open ends. Whether a clause is an echo or foreign only its question tells.
_TOLD = [REFUSAL, UNFINISHED]


def _product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``x @ y`` in pieces that the library does not spread over threads: those would wait for each other longer than they work."""
    return np.concatenate([x[i : i + 1000] @ y for i in range(0, len(x), 1000)]) if len(x) > 1000 else x @ y


def _inner(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``x.T @ y`` in such pieces."""
    return sum(x[i : i + 1000].T @ y[i : i + 1000] for i in range(0, max(len(x), 1), 1000))


def _emission(f: dict, weights: np.ndarray, dense: np.ndarray, n: int) -> np.ndarray:
    """Scores of the first ``n`` clauses."""
    out = _product(f["dense"][:n], dense).astype(np.float64)
    size = f["size"][:n]
    has = np.flatnonzero(size)
    if len(has):
        start = np.cumsum(size) - size
        both = np.ascontiguousarray(weights, np.float32).view(np.complex64)[:, 0]  # one gather for both columns
        sums = np.add.reduceat(both[f["gram"][: int(size.sum())]], start[has])
        out[has, REFUSAL] += sums.real
        out[has, UNFINISHED] += sums.imag
    return out


def marginals(emission: np.ndarray, count: np.ndarray, steps: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of each clause's tag, expected transitions (times the ``weight`` of the clause), and the log partition, by
    forward and backward, each clause's messages scaled to one. Chains go together, the longest first, so nothing is padded."""
    if not len(count):
        return np.zeros_like(emission), np.zeros_like(steps), 0.0
    first = np.cumsum(count) - count
    order = np.argsort(-count, kind="stable")
    at = first[order]
    live = np.searchsorted(-count[order], -np.arange(int(count.max())), side="left")
    top = emission.max(1, keepdims=True)
    e, m = np.exp(emission - top), np.exp(steps - steps.max())
    a, b, scale = np.empty_like(e), np.ones_like(e), np.ones(len(e))
    x = e[at]
    scale[at] = z = x.sum(1)
    a[at] = x / z[:, None]
    for t in range(1, len(live)):
        i = at[: live[t]] + t
        x = _product(a[i - 1], m) * e[i]
        scale[i] = z = x.sum(1)
        a[i] = x / z[:, None]
    moves = np.zeros_like(m)
    for t in range(len(live) - 1, 0, -1):
        i = at[: live[t]] + t
        y = e[i] * b[i] / scale[i][:, None]
        b[i - 1] = _product(y, m.T)
        moves += _inner(a[i - 1] if weight is None else a[i - 1] * weight[i][:, None], y) * m
    return a * b, moves, float(np.log(scale).sum() + top.sum() + steps.max() * (count - 1).sum())


def decode(f: dict, model: tuple[np.ndarray, np.ndarray, np.ndarray], rows: int) -> np.ndarray:
    """Posterior of the clauses of the first ``rows`` rows."""
    count = f["count"][:rows]
    return marginals(_emission(f, model[0], model[1], int(count.sum())), count, model[2])[0]


_SHAPES = ((BUCKETS, len(_TOLD)), (COLUMNS, len(TAGS)), (len(TAGS), len(TAGS)))


def _start() -> tuple[np.ndarray, ...]:
    return tuple(np.zeros(x, np.float32) for x in _SHAPES)


def _missing(f: dict, model: tuple, before: tuple | None) -> np.ndarray:
    """What the expectations of a chunk miss of its tags: grams, dense columns, transitions, one behind the other. Free clauses count as answers, or have the posteriors of the model ``before``; then unfinished rows count too."""
    own, gold = f["own"], f["gold"]
    n = int(f["count"][:own].sum())
    tags = np.eye(len(TAGS))
    want = tags[np.where(gold < 0, ANSWER, gold)]
    weight = np.full(len(f["count"]), MADE)
    weight[:own] = ~f["open"] if before is None else 1.0
    if before is not None:
        free = np.flatnonzero(gold[:n] < 0)
        want[free] = decode(f, before, own)[free]
    weight = np.repeat(weight, f["count"])
    post, moves, _ = marginals(_emission(f, model[0], model[1], len(gold)), f["count"], model[2].astype(np.float64), weight)
    miss = (want - post) * weight[:, None]
    inside = np.ones(len(gold), bool)
    inside[np.cumsum(f["count"]) - f["count"]] = False
    i = np.flatnonzero(inside)
    moves = _inner(want[i - 1] * weight[i][:, None], want[i]) - moves
    each = np.repeat(miss[:, _TOLD], f["size"], axis=0)
    gram = f["gram"].astype(np.intp)
    grams = np.stack([np.bincount(gram, weights=each[:, k], minlength=BUCKETS) for k in range(len(_TOLD))], 1)
    return np.concatenate([grams.ravel(), _inner(f["dense"], miss.astype(np.float32)).ravel(), moves.ravel()])


def _often(f: dict) -> np.ndarray:
    return np.bincount(f["gram"], minlength=BUCKETS)


def train(total: Callable[[tuple, tuple | None, int], np.ndarray], often: np.ndarray) -> tuple:
    """The field of largest likelihood by Adam: ``total(model, before, step)`` adds ``_missing`` up over the table, or over the part of it whose turn it
    is, times the number of parts. Two rounds: after the first, which has the finished answers as answers, the free clauses get the posteriors of
    its model. Grams that come less than ``USUAL`` times have no weight."""
    model, before = _start(), None
    cuts = np.cumsum([int(np.prod(x)) for x in _SHAPES])[:-1]
    held = (often >= USUAL)[:, None]
    for steps, rate in ROUNDS:
        state = [(np.zeros(x), np.zeros(x)) for x in _SHAPES]
        params = [x.astype(np.float64) for x in model]
        for step in range(1, steps + 1):
            parts = np.split(total(tuple(x.astype(np.float32) for x in params), before, step), cuts)
            fall = rate * min(1.0, 2 * (1 - (step - 1) / steps))  # the second half of the steps grows smaller
            for p, g, l2, (m, v) in zip(params, parts, L2, state):
                g = g.reshape(p.shape) - l2 * p
                m += 0.2 * (g - m)
                v += 0.05 * (g * g - v)
                p += fall * (held if p is params[0] else 1) * (m / (1 - 0.8**step)) / (np.sqrt(v / (1 - 0.95**step)) + 1e-6)
        model = before = tuple(x.astype(np.float32) for x in params)
    return model


def _refuses(text: str) -> bool:
    low = text.lower()
    for x in _HINTS:
        if x in low:
            return bool(_SEED.search(text))
    return False


def _seeded(f: Features, seed: np.ndarray) -> np.ndarray:
    """The clauses that seed phrases tell to be refusals, and what a refusal adds (offers, excuses)."""
    refused = np.fromiter((s and bool(_SEED.search(c)) for s, c in zip(seed[f.row].tolist(), f.flat)), bool, len(f.flat))
    for i in np.flatnonzero(seed[f.row]).tolist():
        if i and not refused[i] and refused[i - 1] and f.row[i] == f.row[i - 1] and f.words[i] <= 8:
            refused[i] = True
    return refused

def _finished(a: str) -> bool:
    a = a.rstrip()
    return a[-1:] in (".", "!", "?") and not a.endswith("...") or "https://" in a[-60:] or a.endswith("```") and a.count("```") % 2 == 0


def _made(questions: list[str], answers: list[str], qlang: np.ndarray, sound: list[int], f: Features) -> Iterator[tuple[int, str, str, int]]:
    """(source, question, answer, tag) of pairs whose tags are known because they were made so, at most one of a sound row; the tag is that of the
    last clause for cut answers and of all clauses otherwise, -1 for echo and answer. A hash of the row chooses what is made."""
    for i in sound:
        q, a = questions[i], answers[i]
        kind, r = 0, xxhash.xxh64_intdigest(f"{q}\n{a}")
        r, kind = divmod(r, 36)
        r, x = divmod(r, 1 << 20)
        r, y = divmod(r, 60)
        if kind < 10:  # cut, at a word or within one
            if len(a) > 40 and a[-1:] in ".!?`":
                at = len(a) // 4 + x % (len(a) - 2 - len(a) // 4)
                if y % 10 < 6 and (space := a.rfind(" ", len(a) // 5, at)) > 0:
                    at = space
                end = a[:at].rstrip()
                if _WORD.search(end) and (end[-1] not in ".!?" or end.endswith("...")):
                    yield i, q, end + ("", "", "", "-", "…", "...")[y // 10], UNFINISHED
        elif kind < 17:
            if a[-1:] == "." and (kind < 12 or f.count[i] == 1):  # a lost stop is rarer where others were set
                yield i, q, a[:-1], ANSWER
        elif kind < 20:
            yield i, q, f"{q}\n{a}", -1  # repeats the question and then answers it
        elif kind < 25:
            if _WORD.search(q):
                bare = q.rstrip("?¿ .")
                yield i, q, (q, q.lower(), bare + ".", bare, f"{q} {q}", f"Question: {q}", f"{q.lower()} {q}", q.upper())[y % 8], ECHO
        else:  # another row's answer
            asked = kind >= 31 or _WORD.search(q)  # without a question no answer is foreign
            near = [j for j in (sound[(x + k) % len(sound)] for k in range(min(len(sound), 16))) if asked and (kind >= 31 or qlang[j] != qlang[i])]
            if near and kind < 31:
                yield near[0], q, answers[near[0]], FOREIGN
            elif near and answers[near[0]][-1:] == ".":  # the last words of a sentence stand for short answers, which need no stop
                yield near[0], q, " ".join(answers[near[0]][:-1].split()[-(1 + y % SHORT_WORDS) :]), ANSWER


def prepared(questions: list[str], answers: list[str], languages: np.ndarray) -> tuple[dict, tuple[np.ndarray, ...]]:
    """(features of a chunk of pairs and of pairs made of them, rows of ``Ends.of``). The columns of last words are still to be filled."""
    u = Features(questions, answers, languages)
    seed = np.fromiter(map(_refuses, answers), bool, len(answers))
    finished = np.fromiter(map(_finished, answers), bool, len(answers))
    sound = np.flatnonzero(finished & ~seed).tolist()
    made = list(_made(questions, answers, u.qlang, sound, u))
    m = Features([q for _, q, _, _ in made], [a for _, _, a, _ in made], languages, cut=dict(zip(answers, u.parts)))
    # words of clauses with a stop
    ok = ~seed[u.row] & np.fromiter((c[-1] in ".!?" for c in u.flat), bool, len(u.flat))
    word = np.flatnonzero(ok[u.of])
    last = np.r_[u.of[1:] != u.of[:-1], np.ones(min(len(u.of), 1), bool)][word]
    bucket, at, of, often = np.unique(u.h[word] if len(word) else u.h, return_index=True, return_inverse=True, return_counts=True) if len(word) else (np.zeros(0, np.uint32), *[np.zeros(0, np.int64)] * 3)
    n_last = np.bincount(of, weights=last, minlength=len(bucket)).astype(np.int64)
    ends = ((bucket % np.uint32(WORDS)).astype(np.int32), (_hash([u.word[k][-3:] for k in word[at].tolist()]) % np.uint32(TAILS)).astype(np.int32), n_last, often - n_last)
    # what the source of a made pair counts for itself
    first = u.end - u.count + 1
    for k, r in enumerate(m.loose.tolist()):
        i, w = made[r][0], m.word[m.start[m.end[r]] + m.words[m.end[r]] - 1]
        own = [u.word[u.start[c] : u.start[c] + u.words[c]] for c in range(first[i], u.end[i] + 1) if ok[c]]
        n = sum(ws[-1:] == [w] for ws in own)
        m.ended[k, 4:] = n, sum(ws.count(w) for ws in own) - n
    kind = np.array([k for *_, k in made], np.int8)
    gold = np.where(np.isin(kind, (ECHO, FOREIGN)), kind, ANSWER)[m.row].astype(np.int8) if made else np.zeros(0, np.int8)
    if made:
        gold[m.end[kind == UNFINISHED]] = UNFINISHED
        gold[(m.end - m.count + 1)[kind == -1]] = ECHO
    both = lambda x, y: np.concatenate([x, y])
    size = lambda f: np.bincount(f.clause, minlength=len(f.row)).astype(np.int32)
    return {
        "own": len(answers), "open": ~finished, "count": both(u.count, m.count), "end": both(u.end, m.end + len(u.row)), "words": u.words.astype(np.int32),
        "dense": both(u.dense, m.dense), "gram": both(u.gram, m.gram).astype(np.uint16), "size": both(size(u), size(m)),
        "gold": both(np.where(_seeded(u, seed), REFUSAL, -1).astype(np.int8), gold), "loose": both(u.loose, m.loose + len(answers)), "ended": both(u.ended, m.ended),
    }, ends


def language_counts(texts: list[str], model: np.ndarray) -> np.ndarray:
    """n-grams of long texts by language: of the likeliest one, if that is sure, or by their posteriors."""
    k = model.shape[1]
    out = np.zeros(BYTES * k)
    texts = [" ".join(t.split()) for t in texts if len(t) > 40]
    if texts:
        grams = list(_grams(texts))
        score = sum(np.add.reduceat(np.take(model, g, axis=0), s, axis=0) for g, s in grams) / TEMPER
        post = np.exp(score - score.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
        best = np.where(post.max(1) > 0.999, post.argmax(1), k).astype(np.uint32)
        for g, s in grams:
            of = np.repeat(best, np.diff(np.r_[s, len(g)]))
            out += np.bincount(g * np.uint32(k + 1) + of, minlength=BYTES * (k + 1)).reshape(BYTES, k + 1)[:, :k].ravel()
        if (unsure := np.flatnonzero(best == k)).size:
            out += _counts([texts[i] for i in unsure], post[unsure]).T.ravel()
    return out


def language_model(total: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Byte n-grams of each language, from seed words and all texts: ``total(model)`` adds ``language_counts`` up over the table."""
    seeds = _counts([SEEDS[k] for k in LANGUAGES], np.eye(len(LANGUAGES)))
    model = _model(seeds)
    for _ in range(REFITS):
        model = _model(seeds + total(model).reshape(BYTES, len(LANGUAGES)).T)
    return model


def fit(questions: list[str], answers: list[str]) -> tuple[np.ndarray, Ends, tuple]:
    """(language model, ends, field) from unlabelled pairs in memory; ``pair_defects`` does the same over a table."""
    languages = language_model(lambda model: language_counts([*questions, *answers], model))
    chunk, words = prepared(questions, [visible(a) for a in answers], languages)
    ends = Ends.of(*words)
    ends.fill(chunk["dense"], chunk)
    return languages, ends, train(lambda model, before, _: _missing(chunk, model, before), _often(chunk))

def _decided(count: np.ndarray, words: np.ndarray, tag: np.ndarray) -> tuple[list, np.ndarray]:
    """Defect of each row (None if sound) and the share of words under each tag."""
    total = np.zeros((len(count), len(TAGS)))
    np.add.at(total, (np.repeat(np.arange(len(count)), count), tag), np.maximum(words, 1))
    share = total / total.sum(1, keepdims=True)
    defect: list = [None] * len(count)
    torn = tag[np.cumsum(count) - 1] == UNFINISHED
    for i in np.flatnonzero((share[:, ANSWER] < 1) | torn).tolist():
        s = share[i]
        if s[ECHO] > 0 and s[ANSWER] + s[REFUSAL] + s[FOREIGN] + s[UNFINISHED] < 0.2:
            defect[i] = "question_copy"
        elif s[REFUSAL] > 0 and s[REFUSAL] >= s[ANSWER] + s[FOREIGN]:
            defect[i] = "refusal"
        elif torn[i]:
            defect[i] = "truncated"
        elif s[FOREIGN] > 0.5:
            defect[i] = "other_language"
    return defect, share


def pair_defect(questions: list[str], answers: list[str], languages: np.ndarray, ends: Ends, model: tuple) -> tuple[list, np.ndarray]:
    """Defect of each pair (None if sound) and the share of words under each tag."""
    defect: list = ["empty"] * len(answers)
    share = np.zeros((len(answers), len(TAGS)))
    plain = [visible(a) for a in answers]
    rest = [i for i, a in enumerate(plain) if _told(a)]
    if rest:
        f = Features([questions[i] for i in rest], [plain[i] for i in rest], languages, ends)
        chunk = {"count": f.count, "dense": f.dense, "gram": f.gram, "size": np.bincount(f.clause, minlength=len(f.row))}
        found, share[rest] = _decided(f.count, f.words, decode(chunk, model, len(rest)).argmax(1))
        for i, d in zip(rest, found):
            defect[i] = d
    return defect, share


def _packed(chunk: dict) -> bytes:
    raw = pickle.dumps(chunk, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="lz4", asbytes=True)


def _unpacked(data: bytes) -> dict:
    return pickle.loads(pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="lz4"))


def _total(df: DataFrame, make: Callable[[pa.RecordBatch], np.ndarray], length: int, tasks: int | None = None) -> np.ndarray:
    """Sum of ``make`` over all batches of ``df``: each task adds up its own, ``SLOTS`` tasks those of the tasks, a slice each, or the driver if
    there are but few ``tasks``."""
    schema = "slot int, part binary"

    def rows(parts: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([x.astype(np.float32).tobytes() for x in parts.values()], pa.binary())], ["slot", "part"])

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = None
        for b in batches:
            if b.num_rows:
                mine = make(b) if mine is None else mine + make(b)
        if mine is not None:
            yield rows({k: mine[k::SLOTS] for k in range(SLOTS)})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: dict[int, np.ndarray] = {}
        for b in batches:
            for slot, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                mine[slot] = mine.get(slot, 0) + np.frombuffer(part, np.float32).astype(np.float64)
        if mine:
            yield rows(mine)

    out = np.zeros(length)
    sums = df.mapInArrow(one, schema)
    if tasks is None or tasks > FEW:
        sums = sums.repartition(SLOTS, "slot").mapInArrow(add, schema)
    found = sums.toArrow().to_pydict()
    for slot, part in zip(found["slot"], found["part"]):
        out[slot::SLOTS] += np.frombuffer(part, np.float32)
    return out


def pair_defects(pairs: DataFrame, key: str = "evaluation_id", question: str = "question", answer: str = "generated_answer") -> DataFrame:
    """(id, defect) of every defective pair."""
    rows = pairs.select(F.col(key).alias("id"), F.col(question).alias("question"), F.col(answer).alias("answer"))
    context = pairs.sparkSession.sparkContext

    def counted(model: np.ndarray) -> np.ndarray:
        sent = context.broadcast(model)

        def make(b: pa.RecordBatch) -> np.ndarray:
            out = np.zeros(BYTES * len(LANGUAGES))
            for at in range(0, b.num_rows, CHUNK):
                part = b.slice(at, CHUNK)
                plain = [visible(a) for a in part.column(1).to_pylist()]
                out += language_counts([*(q or "" for q in part.column(0).to_pylist()), *filter(_told, plain)], sent.value)
            return out

        return _total(rows.select("question", "answer"), make, BYTES * len(LANGUAGES))

    languages = context.broadcast(language_model(counted))
    # rows in the order of their hashes, so that chunks mix the table and do not depend on how it is laid out
    n = rows.select("id").count()
    parts, turns = max(1, -(-n // PART)), max(k for k in TURNS if k == 1 or k * TURN <= n)
    order = F.xxhash64("id", "question", "answer")
    laid = rows.repartition(parts, order).sortWithinPartitions(order, "id", "question", "answer")

    def make_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = TaskContext.get().partitionId()
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                b = whole.slice(at, CHUNK)
                plain = [visible(a) for a in b.column(2).to_pylist()]
                full = [_told(a) for a in plain]
                mask = pa.array(full)
                chunk = words = None
                if any(full):
                    f, w = prepared([q or "" for q, k in zip(b.column(1).to_pylist(), full) if k], [a for a, k in zip(plain, full) if k], languages.value)
                    chunk, words = _packed(f), pickle.dumps(w)
                ids = b.column(0)
                held = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids.filter(mask), ids.filter(pa.array([not k for k in full])))]
                yield pa.RecordBatch.from_arrays([*held, pa.array([chunk], pa.binary()), pa.array([words], pa.binary()), pa.array([turn % turns], pa.int32())], ["ids", "empty", "chunk", "words", "turn"])
                turn += 1

    kind = rows.schema["id"].dataType.simpleString()
    chunks = cut(laid.mapInArrow(make_chunks, f"ids array<{kind}>, empty array<{kind}>, chunk binary, words binary, turn int"))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for w in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in pickle.loads(w)], ["word", "tail", "last", "inner"])

    # a step of training has few pairs a task, but each task costs some 50 ms of Python before it begins
    tasks = min(parts, max(2, -(-parts // turns)))
    words = chunks.select("words").coalesce(tasks).where("words IS NOT NULL").mapInArrow(listed, "word bigint, tail bigint, last bigint, inner bigint")
    words = cut(words.groupBy("word", "tail").agg(F.sum("last").alias("last"), F.sum("inner").alias("inner")))
    known, tails = words.groupBy("word").agg(F.sum("last"), F.sum("inner")).toArrow(), words.groupBy("tail").count().toArrow()
    word, last, inner = (x.to_numpy().astype(np.int64) for x in known.columns)
    tail, different = (x.to_numpy().astype(np.int64) for x in tails.columns)
    ends = context.broadcast(Ends(*(np.bincount(k, weights=x, minlength=size).astype(np.float32) for k, x, size in ((word, last, WORDS), (word, inner, WORDS), (tail, different, TAILS)))))

    def filled(data: bytes) -> dict:
        f = _unpacked(data)
        ends.value.fill(f["dense"], f)
        return f

    held = chunks.select("chunk", "turn").coalesce(tasks).where("chunk IS NOT NULL")
    # each part is kept apart, or every step would read the chunks of all
    shares = [cut(held.where(F.col("turn") == k).select("chunk")) for k in range(turns)] if turns > 1 else [held.select("chunk")]

    def missing(model: tuple, before: tuple | None, step: int) -> np.ndarray:
        sent = context.broadcast((model, before))
        return turns * _total(shares[step % turns], lambda b: sum(_missing(filled(x.as_py()), *sent.value) for x in b.column(0)), sum(int(np.prod(x)) for x in _SHAPES), tasks)

    often = _total(held.select("chunk"), lambda b: sum(_often(_unpacked(x.as_py())) for x in b.column(0)), BUCKETS, tasks)
    field = context.broadcast(train(missing, often))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                none = b.column(1)[i].values
                yield pa.RecordBatch.from_arrays([none, pa.array(["empty"] * len(none), pa.string())], ["id", "defect"])
                if (data := b.column(2)[i].as_py()) is not None:
                    f = filled(data)
                    count = f["count"][: f["own"]]
                    defect, _ = _decided(count, f["words"], decode(f, field.value, len(count)).argmax(1))
                    keep = pa.array([d is not None for d in defect])
                    yield pa.RecordBatch.from_arrays([b.column(0)[i].values.filter(keep), pa.array(defect, pa.string()).filter(keep)], ["id", "defect"])

    return chunks.select("ids", "empty", "chunk").mapInArrow(decide, f"id {kind}, defect string").distinct()

def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_defects(table(spark, sf_dir, "evaluation")).select(F.col("id").alias("evaluation_id"), "defect")


SQL: dict[str, str] = {}
QUERIES = {"p4_found": p4_found}
