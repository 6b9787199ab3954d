"""Atomic facts: sentences, list items and code descriptions with category, confidence, entities and context.

Splitting a page into facts is sequential and runs per document in Arrow batches. Category, confidence and the filter
also exist as JVM columns for sentences that are already rows.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as X

from kelpwork.functions.text import ascii_words

# Abbreviations, keywords by category (English and German), and marks of what is no fact.
ABBREVIATIONS = (
    "dr", "mr", "mrs", "ms", "prof", "inc", "ltd", "jr", "sr", "vs", "etc", "e.g", "i.e", "M.Sc", "B.Sc", "Ph.D", "M.A", "B.A", "Mag", "Dipl", "inkl",
    "bzw", "ggf", "usw", "z.B", "d.h", "u.a", "sog", "ca", "Nr", "Str", "Abs", "Tel", "bzgl",
)
KEYWORDS = {
    "SPEC": (
        "parameter", "value", "dimension", "size", "width", "height", "version", "limit", "maximum", "minimum", "default", "configuration", "setting",
        "requirement", "specification", "standard", "format", "type", "unit", "measure", "metric", "kb", "mb", "gb", "ms", "seconds", "minutes",
        "maximal", "minimal", "bis zu", "mindestens", "größe", "anzahl", "kapazität", "speicher", "zeitlimit", "frist",
    ),
    "PROC": (
        "step", "first", "then", "next", "finally", "process", "procedure", "method", "approach", "how to", "install", "configure", "setup", "create",
        "build", "run", "execute", "deploy", "start", "stop", "click", "select", "enter", "press", "navigate", "open", "close", "schritt", "zuerst",
        "dann", "anschließend", "danach", "klicken", "wählen", "eingeben", "öffnen", "starten", "beenden", "installieren", "konfigurieren",
        "erstellen", "ausführen", "navigieren", "auswählen",
    ),
    "DEF": (
        "is", "are", "means", "refers to", "defined as", "known as", "represents", "describes", "indicates", "denotes", "consists of", "comprises",
        "includes", "contains", "explanation", "concept", "ist ein", "ist eine", "sind", "bedeutet", "bezeichnet", "umfasst", "beinhaltet",
        "besteht aus", "ermöglicht", "erlaubt", "definiert als",
    ),
    "REL": (
        "compared to", "versus", "vs", "similar to", "different from", "related to", "depends on", "requires", "uses", "based on", "derived from",
        "extends", "implements", "inherits", "connects", "integrates", "links", "associated", "connected", "verglichen mit", "im vergleich zu",
        "basiert auf", "verwendet", "benötigt", "integriert", "verbunden mit", "abhängig von", "erfordert", "unterstützt",
    ),
}
NOT_FACTS = (r"^\s*$", r"^(note|warning|tip|important|caution):", r"^(see also|related|learn more)", r"^(click here|read more|continue)", r"^\d+\.\s*$", r"^[-*•]\s*$", r"^(copyright|©|all rights reserved)")
HEDGES = ("maybe", "perhaps", "might", "could be", "possibly", "probably")
# Capitalised words that name nothing.
_COMMON = frozenset(("The", "This", "That", "These", "Those", "It", "They", "We", "You", "I"))
# Lengths and confidence of facts, and their most for a page.
SHORTEST, LONGEST, LEAST, MOST = 10, 500, 0.45, 200
# Patterns of units, definitions, names, technical words, assertions, vague and open words, and procedures.
_UNIT = r"\d+(\.\d+)?\s*(kb|mb|gb|ms|s|px|%|em|rem)"
_DEFINES = r"\bis\s+(a|an|the)\b|\bare\s+(a|an|the)?\s*\w+"
CAPITALS = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b"
TECHNICAL = r"\b([a-z]+[A-Z][a-zA-Z]*|[a-z]+_[a-z_]+|[a-z]+-[a-z-]+)\b"
_ASSERTS, _VAGUE, _OPEN = r"\bis\b|\bare\b|\bwill\b|\bcan\b", r"\bsome\b|\bseveral\b|\bmany\b|\bvarious\b", r"\betc\b|\band so on\b|\band more\b"
_PROCEEDS = r"\b(to\s+\w+|by\s+\w+ing)\b"


def is_fact(sentence: Column) -> Column:
    """Not empty, no note, pointer, notice, question or hedge."""
    low = F.lower(sentence)
    hedge = F.lit(False)
    for w in HEDGES:
        hedge = hedge | F.startswith(low, F.lit(w)) | F.contains(low, F.lit(", " + w))
    mark = "(?i)^(?:" + "|".join(p.removeprefix("^") for p in NOT_FACTS) + ")"
    return ~(sentence.rlike(mark) | F.endswith(sentence, F.lit("?")) | hedge)


def category(sentence: Column) -> Column:
    """Of the largest number of keywords; ties in the order SPEC, PROC, DEF, REL; OTHER for none."""
    low = F.lower(sentence)
    more = {"SPEC": F.when(sentence.rlike("(?i)" + _UNIT), 2).otherwise(0), "DEF": sentence.rlike("(?i)" + ascii_words(_DEFINES)).cast("int"), "PROC": sentence.rlike("(?i)" + ascii_words(_PROCEEDS)).cast("int")}
    found = lambda words: sum((F.contains(low, F.lit(k)).cast("int") for k in words), F.lit(0))
    scored = F.array(*(F.struct((found(ks) + more.get(c, F.lit(0))).alias("n"), F.lit(-i).alias("i"), F.lit(c).alias("c")) for i, (c, ks) in enumerate(KEYWORDS.items())))
    best = F.array_max(F.array_append(scored, F.struct(F.lit(0).alias("n"), F.lit(1).alias("i"), F.lit("OTHER").alias("c"))))
    return best["c"]


def entities(sentence: Column) -> Column:
    """Capitalised runs, technical words and quoted code, distinct, in order of kind and place."""
    runs = F.regexp_extract_all(sentence, F.lit(ascii_words(CAPITALS)), 1)
    lone = (F.size(runs) == 1) & F.startswith(sentence, F.coalesce(F.try_element_at(runs, F.lit(1)), F.lit("\0")))
    kept = F.filter(F.when(lone, F.array().cast("array<string>")).otherwise(runs), lambda x: ~x.isin(*_COMMON))
    technical = F.regexp_extract_all(sentence, F.lit(ascii_words(TECHNICAL, strict=True)), 1)
    return F.array_distinct(F.concat(kept, technical, F.regexp_extract_all(sentence, F.lit("`([^`]+)`"), 1)))


def confidence(sentence: Column, entity_count: Column) -> Column:
    low = F.lower(sentence)
    steps = ((entity_count > 0, 0.1), (entity_count > 2, 0.1), (sentence.rlike("`[^`]+`"), 0.1), (sentence.rlike(r"\d+"), 0.05), (low.rlike(ascii_words(_ASSERTS)), 0.1), (low.rlike(ascii_words(_VAGUE)), -0.1), (low.rlike(ascii_words(_OPEN)), -0.1))
    value = F.lit(0.5)
    for when, step in steps:
        value = value + F.when(when, step).otherwise(0.0)
    return F.round(F.greatest(F.least(value, F.lit(1.0)), F.lit(0.1)), 6)


def stripped(markdown: str) -> str:
    """Text of markdown: headings become sentences, marks, links, rules and bullets go, blanks collapse."""
    t = markdown.replace("\r\n", "\n").replace("\t", " ").strip()
    for pattern, to in (
        (r"(?m)^#{1,6}\s+(.+?)\.?\s*$", r"\1."), (r"\*{1,2}([^*\n]+)\*{1,2}", r"\1"), (r"_{1,2}([^_\n]+)_{1,2}", r"\1"), (r"\[([^\]]+)\]\([^)]+\)", r"\1"),
        (r"(?m)^\|[\s|:-]+\|$", ""), (r"(?m)^[-*_]{3,}\s*$", ""), (r"(?m)^[-*+]\s+", ""), ("[✓✗✘•◦▪▸►→]", ". "),
    ):
        t = re.sub(pattern, to, t)
    return re.sub(r"\s+", " ", t).strip()


_KNOWN = {a.lower() for a in ABBREVIATIONS}


def sentences(text: str) -> list[str]:
    """Cut behind . ! ? and a blank, but not behind abbreviations, single letters and numbers (dates)."""
    out, start = [], 0
    for m in re.finditer(r"[.!?]+[\"')\]]*\s+", text):
        before = text[start : m.start()].split(" ")[-1].lstrip("(\"'")
        if text[m.start()] == "." and (before.lower() in _KNOWN or re.fullmatch(r"[A-Za-z]|\d{1,2}(?:\.\d{1,2})?", before)):
            continue
        out.append(text[start : m.end()].strip())
        start = m.end()
    return [s for s in [*out, text[start:].strip()] if s]


def headings(markdown: str) -> list[tuple[int, str]]:
    out, at = [], 0
    for line in markdown.split("\n"):
        m = re.match(r"#{1,6}\s+(.+)", line.strip())
        if m:
            out.append((at, re.sub(r"_{1,2}([^_]+)_{1,2}", r"\1", re.sub(r"\*{1,2}([^*]+)\*{1,2}", r"\1", m[1].strip()))))
        at += len(line) + 1
    return out


def heading_of(markdown: str, sentence: str, found: list[tuple[int, str]]) -> str | None:
    """The last heading at or before the place where the sentence's first five words stand."""
    at = markdown.find(" ".join(sentence.split(" ")[:5]))
    return next((t for i, t in reversed(found) if i <= at), None) if at >= 0 else None


def raw_facts(markdown: str | None) -> list[dict]:
    """Candidates of a page in order: sentences, list items, code descriptions. Filters and scores come after, as columns."""
    text = (markdown or "").replace("\r\n", "\n")
    known = headings(text)
    out = []
    own = sentences(stripped(text))
    for i, s in enumerate(own):
        h = heading_of(text, s, known)
        around = " ".join(own[max(0, i - 1) : i + 2])
        out.append({"kind": "sentence", "content": s, "source_context": f"[{h}] {around}" if h else around, "heading": h, "code_block": None})
    lead, fence, code = "", None, []
    for line in text.split("\n"):
        item = re.match(r"\s*[-*•]\s+(.+)$", line)
        if line.startswith("```"):
            if fence is None:
                fence, code = lead, []
            else:
                body = "\n".join(code).strip()
                if len(fence) >= 15 and len(body) >= 20:
                    out.append({"kind": "code", "content": fence, "source_context": f"{fence}\n{body[:200]}", "heading": None, "code_block": body})
                fence = None
        elif fence is not None:
            code.append(line)
        elif item:
            t = item[1].strip()
            if len(t) >= SHORTEST:
                title = bool(lead) and len(lead) < 80 and not lead.endswith(".")
                out.append({"kind": "list", "content": t, "source_context": f"[{lead}] {t}" if title else f"{lead} {t}".strip(), "heading": lead if title else None, "code_block": None})
        elif line.strip() and not re.match(r"\s*\d+\.\s", line):
            lead = re.sub(r"^#{1,6}\s+", "", line.strip())
    return [{"position": n, **f} for n, f in enumerate(out)]


_TEXT = X.StringType()
_FACT = X.ArrayType(X.StructType([X.StructField("position", X.IntegerType()), *(X.StructField(n, _TEXT) for n in ("kind", "content", "source_context", "heading", "code_block"))]))


@F.pandas_udf(_TEXT)
def nearest_heading(markdown: pd.Series, sentence: pd.Series) -> pd.Series:
    return pd.Series([None if m is None or s is None else heading_of(m, s, headings(m)) for m, s in zip(markdown, sentence)], dtype=object)


@F.pandas_udf(_FACT)
def raw_facts_of(markdown: pd.Series) -> pd.Series:
    return markdown.map(raw_facts)


def fact_key(content: Column) -> Column:
    """Lower case, blanks collapsed, final marks off: equal keys are one fact."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(content), r"\s+", " ")), r"[.,;:!?]+$", "")


def extract_facts(pages: DataFrame, key: str = "doc_id", markdown: str = "markdown", least: float = LEAST, most: int = MOST) -> DataFrame:
    """One row a fact: (key, fact_index, content, category, confidence, source_context, heading, entities, code_block). Of equal facts
    of a page the first stays. One shuffle, by page, serves both windows."""
    rows = pages.select(key, F.explode(raw_facts_of(markdown)).alias("f")).select(key, "f.*")
    rows = rows.where((F.col("kind") != "sentence") | (F.length("content").between(SHORTEST, LONGEST) & is_fact(F.col("content"))))
    # each step is a row of its own (inline): else the optimiser would repeat every expression wherever it is used
    rows = rows.select("*", F.inline(F.array(F.struct(entities(F.col("content")).alias("entities")))))
    base = confidence(F.col("content"), F.size("entities"))
    scored = F.when(F.col("kind") == "code", 0.75).when(F.col("kind") == "list", F.round(base - 0.1, 6)).otherwise(base)
    kind = F.when(F.col("kind") == "code", "PROC").otherwise(category(F.col("content")))
    rows = rows.select("*", F.inline(F.array(F.struct(scored.alias("confidence"), kind.alias("category"), fact_key(F.col("content")).alias("fact_key"))))).where(F.col("confidence") >= least)
    first = W.partitionBy(key, "fact_key").orderBy("position")
    order = W.partitionBy(key).orderBy("position")
    rows = rows.withColumn("n", F.row_number().over(first)).where("n = 1")
    rows = rows.withColumn("fact_index", F.row_number().over(order) - 1).where(F.col("fact_index") < most)
    return rows.select(key, "fact_index", "kind", "content", "category", "confidence", "source_context", "heading", "entities", "code_block")
