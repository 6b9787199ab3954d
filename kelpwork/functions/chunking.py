"""Markdown into chunks: tables whole or split with their header, text packed by paragraph, sentence or window.

Packing is a fold over a document's pieces, so it runs per document in Arrow batches. Sizes are estimated tokens (a
quarter of the characters, rounded up). Chunks shorter than ``LEAST`` characters are dropped without renumbering.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as X

MOST, OVERLAP, LEAST, WINDOW, TAIL = 512, 128, 50, 2048, 512
_ROW = re.compile(r"^\s*\|.*\|\s*$")
_HEADING = re.compile(r"^#{1,6}\s+(.+)$", re.M)


def tokens(text: str) -> int:
    return -(-len(text) // 4)


def table_ranges(text: str) -> list[tuple[int, int]]:
    """Character ranges of the maximal runs of lines that begin and end with a pipe."""
    out, at, start = [], 0, None
    for line in [*text.split("\n"), None]:
        if line is not None and _ROW.match(line) and len(line.strip()) > 1:
            start = at if start is None else start
        elif start is not None:
            out.append((start, at - 1))
            start = None
        at += len(line) + 1 if line is not None else 0
    return out


def tail(text: str) -> str:
    """The last ``TAIL`` characters, from the next blank on unless that leaves fewer than ten."""
    if len(text) <= TAIL:
        return text
    end = text[-TAIL:]
    cut = end.find(" ")
    return end[cut + 1 :] if 0 <= cut and len(end) - cut - 1 >= 10 else end


def packed(pieces: list[str], joiner: str, most: int = MOST) -> list[tuple[str, int]]:
    """(text, start) of buffers filled piece by piece; a full buffer hands its tail to the next."""
    out, held, start, at = [], "", 0, 0
    for p in pieces:
        if held and tokens(held + joiner + p) > most:
            out.append((held, start))
            rest = tail(held)
            start = max(0, at - len(rest) - len(joiner))
            held = rest + joiner + p
        else:
            held = held + joiner + p if held else p
        at += len(p) + len(joiner)
    return out + ([(held, start)] if held else [])


def windows(text: str) -> list[tuple[str, int]]:
    """Windows of fixed size, cut at the last blank of their second half; only such a cut overlaps."""
    out, at = [], 0
    while at < len(text):
        end = min(at + WINDOW, len(text))
        blank = text.rfind(" ", at, end) if end < len(text) else -1
        soft = blank > at + WINDOW // 2
        end = blank if soft else end
        out.append((text[at:end], at))
        if end >= len(text):
            break
        at = max(end - TAIL, at + 1) if soft else end
    return out


def split_table(table: str, most: int = MOST) -> list[str]:
    """Rows packed under a repeated header (the first line, and the separator if it comes second)."""
    lines = table.split("\n")
    header = lines[:2] if len(lines) > 1 and "---" in lines[1] else lines[:1]
    if "---" not in lines[0] and len(header) == 1 and len(lines) > 1:
        header = lines[:2]  # without a separator the second line is header and row
        body = lines[1:]
    else:
        body = lines[len(header) :]
    out, held = [], list(header)
    for row in body:
        if len(held) > len(header) and tokens("\n".join([*held, row])) > most:
            out.append("\n".join(held))
            held = list(header)
        held.append(row)
    return out + (["\n".join(held)] if len(held) > len(header) or not out else [])


def strategy(text: str) -> tuple[str, list[str]]:
    """How a long text is cut, and its pieces: by paragraph if there are two, else by sentence if there are two, else by window."""
    paragraphs = [p for p in re.split(r"\n\n+", text) if p.strip()]
    if len(paragraphs) >= 2:
        return "paragraph", paragraphs
    sentences = [s for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]
    return ("sentence", sentences) if len(sentences) >= 2 else ("window", [text])


def _text_chunks(text: str, most: int) -> list[tuple[str, int]]:
    kind, pieces = strategy(text)
    return windows(text) if kind == "window" else packed(pieces, "\n\n" if kind == "paragraph" else " ", most)


def chunked(markdown: str | None, most: int = MOST, least: int = LEAST) -> list[dict]:
    text = (markdown or "").replace("\r\n", "\n").strip()
    parts, at = [], 0
    for a, b in table_ranges(text):
        parts += [("text", at, text[at:a]), ("table", a, text[a:b])]
        at = b
    parts.append(("text", at, text[at:]))
    found = []
    for kind, start, part in parts:
        if not part.strip():
            continue
        lead = len(part) - len(part.lstrip())
        part = part.strip()
        if kind == "table":
            pieces = [(part, 0)] if tokens(part) <= 2 * most else [(t, 0) for t in split_table(part, most)]
        else:
            pieces = [(part, 0)] if tokens(part) <= most else _text_chunks(part, most)
        found += [(kind, start + lead + s, p.strip()) for p, s in pieces]
    out = []
    for n, (kind, start, content) in enumerate(found):
        table = "|" in content and "---" in content
        title = _HEADING.search(content)
        out.append({"chunk_index": n, "content": content, "chunk_type": ("mixed" if kind == "text" else "table") if table else kind, "has_table": table, "section_title": title[1].strip() if title else None, "token_count": tokens(content), "start_char": start, "end_char": start + len(content)})
    return [c for c in out if len(c["content"]) >= least]


_TEXT, _INT = X.StringType(), X.IntegerType()
_CHUNK = X.ArrayType(X.StructType([X.StructField(n, t) for n, t in (("chunk_index", _INT), ("content", _TEXT), ("chunk_type", _TEXT), ("has_table", X.BooleanType()), ("section_title", _TEXT), ("token_count", _INT), ("start_char", _INT), ("end_char", _INT))]))


@F.pandas_udf(_TEXT)
def strategy_of(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else strategy(t)[0])


@F.pandas_udf(_CHUNK)
def chunks_of(markdown: pd.Series) -> pd.Series:
    return markdown.map(chunked)


def chunk_documents(pages: DataFrame, key: str = "doc_id", markdown: str = "markdown") -> DataFrame:
    """One row a chunk: (key, chunk_index, content, ...)."""
    return pages.select(key, F.explode(chunks_of(markdown)).alias("c")).select(key, "c.*")
