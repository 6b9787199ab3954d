"""Sparse term weights: words, stop words, stems and saturated frequencies."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as X

# The English stop words of the sparse vectors.
STOP_WORDS = frozenset((
    "the", "a", "an", "and", "or", "but", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will",
    "would", "could", "should", "may", "might", "must", "shall", "to", "of", "in", "for", "on", "with", "at", "by", "from", "as", "into", "through",
    "during", "before", "after", "above", "below", "between", "under", "again", "further", "then", "once", "i", "you", "he", "she", "it", "we",
    "they", "me", "him", "her", "us", "them", "my", "your", "his", "its", "our", "their", "this", "that", "these", "those", "what", "which", "who",
    "whom", "how", "when", "where", "why", "all", "each", "every", "both", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only",
    "own", "same", "so", "than", "too", "very", "just", "can",
))
K1, B, AVERAGE = 1.5, 0.75, 200
_WORD = re.compile(r"[a-zа-яё0-9_]+")
_VOWEL = "aeiou"


def _kinds(word: str) -> str:
    out = ""
    for i, c in enumerate(word):
        out += "v" if c in _VOWEL or c == "y" and i and out[-1] == "c" else "c"
    return out


def _measure(stem: str) -> int:
    return len(re.findall("v+c+", _kinds(stem)))


def _has_vowel(stem: str) -> bool:
    return "v" in _kinds(stem)


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _kinds(word)[-1] == "c"


def _cvc(word: str) -> bool:
    return _kinds(word)[-3:] == "cvc" and word[-1] not in "wxy"


# The suffix rules of Porter's published algorithm.
_STEP2 = dict(pair.split(":") for pair in "ational:ate tional:tion enci:ence anci:ance izer:ize abli:able alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble".split())
_STEP3 = {**dict(pair.split(":") for pair in "icate:ic alize:al iciti:ic ical:ic".split()), "ative": "", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def porter(word: str) -> str:
    """Porter stem of a lower-case word."""
    if len(word) < 3:
        return word
    if word.endswith("sses") or word.endswith("ies"):
        word = word[:-2]
    elif word.endswith("s") and not word.endswith("ss"):
        word = word[:-1]
    if word.endswith("eed"):
        word = word[:-1] if _measure(word[:-3]) > 0 else word
    else:
        cut = next((word[: -len(s)] for s in ("ed", "ing") if word.endswith(s) and _has_vowel(word[: -len(s)])), None)
        if cut is not None:
            word = cut
            if word.endswith(("at", "bl", "iz")):
                word += "e"
            elif _double(word) and word[-1] not in "lsz":
                word = word[:-1]
            elif _measure(word) == 1 and _cvc(word):
                word += "e"
    if word.endswith("y") and _has_vowel(word[:-1]):
        word = word[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        s = _longest(word, rules)
        if s and _measure(word[: -len(s)]) > 0:
            word = word[: -len(s)] + rules[s]
    s = _longest(word, _STEP4)
    if s and _measure(word[: -len(s)]) > 1 and (s != "ion" or word[-4:-3] in ("s", "t")):
        word = word[: -len(s)]
    if word.endswith("e") and (_measure(word[:-1]) > 1 or _measure(word[:-1]) == 1 and not _cvc(word[:-1])):
        word = word[:-1]
    return word[:-1] if _measure(word) > 1 and _double(word) and word[-1] == "l" else word


def stems(text: str | None) -> list[str]:
    """Stems of the words of more than two letters that are no stop words."""
    return [porter(w) for w in _WORD.findall((text or "").lower()) if len(w) > 2 and w not in STOP_WORDS]


def weigh(terms: list[str]) -> dict[str, float]:
    """Saturated term frequencies, at most 1, for documents of ``AVERAGE`` terms."""
    counts = pd.Series(terms, dtype=object).value_counts()
    pressure = K1 * (1 - B + B * len(terms) / AVERAGE)
    return {t: min(float(n) / (float(n) + pressure), 1.0) for t, n in counts.items()}


@F.pandas_udf(X.MapType(X.StringType(), X.DoubleType()))
def sparse_vector(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: weigh(stems(t)))


@F.pandas_udf(X.ArrayType(X.StringType()))
def stemmed(texts: pd.Series) -> pd.Series:
    return texts.map(stems)
