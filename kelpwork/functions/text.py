"""Text columns: everything here stays in the JVM except the rolling hash."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as X

# The words that tell English from German.
ENGLISH = ("the", "and", "is", "are", "was", "were", "have", "has", "this", "that")
GERMAN = ("der", "die", "das", "und", "ist", "sind", "haben", "hat", "diese", "dieser")
# Answers that refuse, in English and German.
REFUSALS = (
    r"\bnot (in|within|part of|covered by)\b.{0,50}\b(context|documents?)\b",
    r"\b(provided |given |retrieved )?(context|documents?)\b.{0,30}\b(does?n'?t|do not|cannot|can'?t|lacks?|has no)\b.{0,25}\b(contain|include|mention|have|cover|answer|address)\b",
    r"\bcannot (answer|find|determine)\b.{0,60}\b(context|documents?)\b",
    r"\bno (information|details?|data)\b.{0,20}\b(in|from|within)\b.{0,25}\b(the )?(context|documents?|provided|retrieved)\b",
    r"\b(not|n'?t)\b.{0,15}\b(available|present|found|mentioned)\b.{0,25}\b(in|from|within)\b.{0,25}\b(the )?(context|documents?|provided|retrieved)\b",
    r"\bI (don'?t|do not|cannot|can'?t) have (enough |sufficient |any )?(information|context|details?) (to |for )",
    r"\bnicht\b.{0,60}\b(im|in (dem|diesem)|aus (dem|diesem))\b.{0,20}\bbereitgestell",
    r"\bbereitgestell\w*.{0,80}\bnicht\b.{0,40}\b(abgeleitet|entnommen|gefunden|beantwortet|bestimmt)\b",
    r"\b(Es ist nicht möglich|kann nicht\b.{0,20}\b(beantwortet|abgeleitet|bestimmt) werden)\b",
    r"\b(keine?|nicht genug|nicht ausreichend).{0,20}(Informationen?|Angaben?|Details?).{0,30}(in (dem|den|diesem)|aus (dem|den)).{0,30}(Text|Kontext|Dokumenten?|bereitgestellt)",
)
_BLANKS = r"[ \t\n\r\f\x0B]+"


def plain_text(text: Column, most: int | None = None) -> Column:
    """Blanks collapsed and trimmed; beyond ``most`` characters cut and followed by three dots."""
    flat = F.trim(F.regexp_replace(text, _BLANKS, " "))
    return flat if most is None else F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("..."))).otherwise(flat)


def excerpt(text: Column, most: int = 200, dots: str = "...") -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(dots))).otherwise(text)


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, _BLANKS), lambda w: w != ""))


def has_code(markdown: Column, markup: Column) -> Column:
    """A fence in the markdown, or code or pre elements in the markup."""
    found = F.coalesce(F.contains(markdown, F.lit("```")), F.lit(False))
    return found | F.coalesce(F.contains(markup, F.lit("<code")) | F.contains(markup, F.lit("<pre")), F.lit(False))


def stop_word_language(text: Column) -> Column:
    """en or de by the larger count of stop words; null for a tie."""
    low = F.lower(text)
    english, german = (F.regexp_count(low, F.lit("(?<![a-z0-9_])(?:" + "|".join(known) + ")(?![a-z0-9_])")) for known in (ENGLISH, GERMAN))
    return F.when(english > german, "en").when(german > english, "de")


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded up: what stands in for a tokenizer."""
    return F.ceil(F.length(text) / 4).cast("int")


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def path_excluded(url: Column, globs: list[str]) -> Column:
    """Whether the path of ``url`` begins with one of the globs; what is no URL is not excluded."""
    path = F.try_parse_url(url, F.lit("PATH"))
    path = F.when(path == "", "/").otherwise(path)
    special = set(".+?^${}()|[]\\")
    patterns = ["".join(".*" if c == "*" else "\\" + c if c in special else c for c in g) for g in globs]
    return F.coalesce(path.rlike("^(?:" + "|".join(patterns) + ")"), F.lit(False)) if patterns else F.lit(False)


_ASCII = "[A-Za-z0-9_]"


def ascii_words(pattern: str, strict: bool = False) -> str:
    r"""``pattern`` with each ``\b`` between ASCII letters, digits and underscores and all else, which Java's is not.

    A boundary before a letter or group is one that no word character precedes, any other one that none follows. That is
    fast, and the same where words stand inside the boundaries; ``strict`` serves patterns that may end in other signs."""
    if strict:
        return pattern.replace(r"\b", f"(?:(?<={_ASCII})(?!{_ASCII})|(?<!{_ASCII})(?={_ASCII}))")
    return re.sub(r"\\b(?=[A-Za-z(])", f"(?<!{_ASCII})", pattern).replace(r"\b", f"(?!{_ASCII})")


def is_refusal(answer: Column) -> Column:
    return answer.rlike("(?i)" + "|".join(f"(?:{ascii_words(p)})" for p in REFUSALS))


def round_half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


@F.pandas_udf(X.StringType())
def rolling_hash(texts: pd.Series) -> pd.Series:
    """31-fold rolling hash over UTF-16 units in 32 bits: its magnitude in hex, a dash, the length in hex."""

    def one(t: str | None) -> str | None:
        if t is None:
            return None
        units = np.frombuffer(t.encode("utf-16-le", "surrogatepass"), np.uint16).astype(np.uint32)
        h = np.uint32(0)
        with np.errstate(over="ignore"):
            if units.size:
                powers = np.cumprod(np.r_[np.uint32(1), np.full(units.size - 1, 31, np.uint32)], dtype=np.uint32)[::-1]
                h = (units * powers).sum(dtype=np.uint32)
        return f"{abs(int(h.astype(np.int32))):08x}-{units.size:x}"

    return texts.map(one)
