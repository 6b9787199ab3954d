"""Extraction of pages: boilerplate elements out, main element chosen, markdown and plain text made.

One Arrow batch at a time in Python, since pages with unclosed tags have no relational form; everything derived from the
text is a JVM column (see ``text``).
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as X

from kelpwork.functions import text as T

# Elements and classes that are never content.
DROPPED = frozenset("script style noscript iframe nav footer header".split())
DROPPED_CLASSES = frozenset("advertisement ads sidebar comments social-share".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_CLOSES = {"li": ("li",), "td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "p": ("p",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
_STOPS = {"li": ("ul", "ol"), "td": ("tr", "table"), "th": ("tr", "table"), "tr": ("table",), "dt": ("dl",), "dd": ("dl",)}
_BREAKS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_BLOCK = _BREAKS_P | {"li", "tr", "td", "th", "body", "html", "dt", "dd"}
LEAST_ARTICLE = 100


class Node:
    __slots__ = ("tag", "attrs", "parts")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.parts = tag, attrs, []

    def text(self) -> str:
        return "".join(p if isinstance(p, str) else p.text() for p in self.parts)

    def find(self, *tags: str):
        for p in self.parts:
            if isinstance(p, Node):
                if p.tag in tags:
                    yield p
                yield from p.find(*tags)


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in _BREAKS_P and self.open[-1].tag == "p":
            self.open.pop()
        if tag in _CLOSES:
            cut = len(self.open)
            for k in range(len(self.open) - 1, 0, -1):
                if self.open[k].tag in _STOPS.get(tag, ()):
                    break
                if self.open[k].tag in _CLOSES[tag]:
                    cut = k
            del self.open[cut:]
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].parts.append(node)
        if tag not in _VOID and len(self.open) < 200:
            self.open.append(node)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                break

    def handle_data(self, data):
        self.open[-1].parts.append(data)


def parse(markup: str) -> Node:
    b = _Builder()
    b.feed(markup)
    b.close()
    return b.root


def cleaned(node: Node) -> Node:
    """Without dropped elements and classes."""
    keep = []
    for p in node.parts:
        if isinstance(p, Node):
            if p.tag in DROPPED or DROPPED_CLASSES & set(p.attrs.get("class", "").split()):
                continue
            cleaned(p)
        keep.append(p)
    node.parts = keep
    return node


def main_element(root: Node) -> Node:
    """The article or main element if it holds text enough, else the body, else all."""
    for tags in (("article",), ("main",), ("body",)):
        for n in root.find(*tags):
            if tags == ("body",) or len(n.text().strip()) >= LEAST_ARTICLE:
                return n
    return root


def _flat(s: str) -> str:
    return re.sub(r"\s+", " ", s)


def _table(node: Node) -> str:
    rows = [[_flat(_inline(c)).strip().replace("|", "\\|") for c in r.find("td", "th")] for r in node.find("tr")]
    rows = [r for r in rows if r]
    if not rows:
        return ""
    width = max(map(len, rows))
    lines = ["| " + " | ".join(r + [" "] * (width - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "| " + " | ".join(["---"] * width) + " |", *lines[1:]])


def _inline(node: Node) -> str:
    """Markdown of inline content; a blank is put behind a closing tag that a letter or digit would touch."""
    out = ""
    for p in node.parts:
        if isinstance(p, str):
            piece, touched = _flat(p), p
        else:
            t = p.tag
            inner = _inline(p)
            bare = inner.strip()
            touched = None
            if t == "br":
                piece = "\n"
            elif t == "img" or not bare:
                piece = " " if inner else ""
            elif t in ("em", "i"):
                piece = inner.replace(bare, f"*{bare}*", 1)
            elif t in ("strong", "b"):
                piece = inner.replace(bare, f"**{bare}**", 1)
            elif t == "code":
                piece = f"`{bare}`"
            elif t == "a" and p.attrs.get("href"):
                piece = f"[{bare}]({p.attrs['href']})"
            else:
                piece = inner
        if out and piece[:1].isalnum() and touched is not None and node.parts.index(p) > 0 and isinstance(node.parts[node.parts.index(p) - 1], Node) and not out[-1].isspace():
            out += " "
        out += piece
    return out


def _blocks(node: Node, depth: int = 0) -> list[str]:
    out: list[str] = []
    run = Node("span", {})

    def flush():
        if run.parts:
            text = re.sub(r" *\n *", "\n", _inline(run)).strip()
            if text:
                out.append(text)
            run.parts = []

    for p in node.parts:
        if isinstance(p, str) or p.tag not in _BLOCK:
            run.parts.append(p)
            continue
        flush()
        t = p.tag
        if len(t) == 2 and t[0] == "h" and t[1].isdigit():
            text = _flat(_inline(p)).strip()
            out += [f"{'#' * int(t[1])} {text}"] if text else []
        elif t == "pre":
            code = next(p.find("code"), p)
            language = re.search(r"language-(\w+)", code.attrs.get("class", ""))
            out.append(f"```{language[1] if language else ''}\n{p.text().strip(chr(10))}\n```")
        elif t == "table":
            out += [x for x in [_table(p)] if x]
        elif t in ("ul", "ol"):
            items = [" ".join(_blocks(i, depth + 1)).strip() for i in p.parts if isinstance(i, Node) and i.tag == "li"]
            marks = [f"{k}. " if t == "ol" else "- " for k in range(1, len(items) + 1)]
            out += ["\n".join(m + i for m, i in zip(marks, items) if i)] if any(items) else []
        elif t == "blockquote":
            out += ["\n".join("> " + line for line in "\n\n".join(_blocks(p, depth + 1)).split("\n"))]
        elif t == "hr":
            out.append("---")
        else:
            out += _blocks(p, depth + 1)
    flush()
    return out


def extracted(markup: str | None) -> tuple[str | None, str | None, str | None]:
    """(title, markdown, text): the title is the first heading of level 1, else the document's title."""
    if markup is None:
        return None, None, None
    root = parse(markup)
    head = next((_flat(n.text()).strip() for n in root.find("title")), "")
    for n in list(root.find("head")):
        n.parts = [p for p in n.parts if isinstance(p, Node) and p.tag in _BLOCK]
    main = main_element(cleaned(root))
    title = next((t for n in main.find("h1") if (t := _flat(n.text()).strip())), head)
    blocks = _blocks(main)
    plain = _flat(_spaced(main)).strip()
    return title or None, "\n\n".join(blocks), plain


def _spaced(node: Node) -> str:
    return "".join(p if isinstance(p, str) else (f" {_spaced(p)} " if p.tag in _BLOCK or p.tag == "br" else _spaced(p)) for p in node.parts)


@F.pandas_udf(X.StructType([X.StructField(n, X.StringType()) for n in ("title", "markdown", "text")]))
def extract(pages: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([extracted(p) for p in pages], columns=["title", "markdown", "text"])


def spaced_tags(markup: Column) -> Column:
    """A blank behind a closing inline tag that a letter, a digit or another inline tag follows."""
    tags = "(?:a|abbr|b|code|em|i|mark|s|small|span|strong|sub|sup|u)"
    return F.regexp_replace(markup, f"(?i)(</{tags}>)(?=[A-Za-z0-9\\u00C0-\\u024F]|<{tags}[ >])", "$1 ")


def extract_pages(pages: DataFrame, key: str = "doc_id", markup: str = "raw_html") -> DataFrame:
    """(key, title, markdown, text, word_count, has_code, language, excerpt, content_hash) of each page."""
    e = pages.select(key, F.col(markup).alias("markup"), extract(markup).alias("e")).select(key, "markup", "e.*")
    return e.select(
        key, "title", "markdown", "text", T.word_count(F.col("text")).alias("word_count"), T.has_code(F.col("markdown"), F.col("markup")).alias("has_code"),
        T.stop_word_language(F.col("text")).alias("language"), T.excerpt(F.col("text")).alias("excerpt"), T.content_hash(F.col("text")).alias("content_hash"),
    )
