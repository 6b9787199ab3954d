"""Main body of web pages, by wrappers inferred from the pages of each site.

A page is a stream of tokens in page order, tags and lines. The streams of one host are aligned one after the other
(``page_streams``): what only some pages have becomes optional, what comes again becomes a repeated group, and the texts become
slots. The wrapper so inferred tells which slots are the main body: those of the list that holds the running text, between
the fixed tokens around its repeated group, unless all pages have one text there; and the fixed heading of the page. All other slots
are site matter. A second alignment, word by word, turns the texts of each slot of site matter into fields: word patterns in
which the words that differ are text slots.

A page is then read with the wrapper of its host. Lines in slots of site matter go; headings, code, cells and list items of the main list
stay; lines in slots of paragraphs stay unless a field of site matter matches their text, since site matter also comes in
plain paragraphs. Lines without markup, or behind the cut of a truncated page, are matched against the fields by their
text. Fields found on several hosts, with site names and rare words as slots, also serve hosts that say little about
themselves. A page without host is read with a wrapper of its own.

Scale: a page is parsed once; paths and texts are kept in the checkpoint folder. Streams are aligned in salted groups of at most about
``GROUP_ROWS`` distinct ones, then group by group, so a host with a third of all pages is many tasks; distinct texts of
site matter are what a partial aggregate leaves, and are aligned in the same two steps. Roles and fields are sent to all tasks only if
counted to be at most ``BROADCAST_BYTES`` and ``BROADCAST_FIELDS``; otherwise pages are joined with them by host. All
fields found on three or more hosts are kept: more of them than that are joined with the distinct lines by word, and more
than ``BROADCAST_WORDS`` words of several hosts are told by a join too.

Cases: null or empty markup: text only; null or empty text: no lines; markup that does not hold the text: text
only; a null host has no wrapper of its own; repeated ids give repeated rows; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import bisect
import html
import json
import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpwork.llm import page_streams
from kelpwork.sources.tables import cut, table

GROUP_ROWS, BROADCAST_FIELDS, BROADCAST_WORDS, BROADCAST_BYTES = 3_000, 100_000, 200_000, 32_000_000
ALIGNED_WORDS, ALIKE, SHARED_HOSTS, SHRINKING, DEEP = 30, 0.5, 3, 0.8, 64

_TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*)>|<!--.*?(?:-->|$)|<![^>]*>", re.S)
_ATTR = re.compile(r"""\b(class|role|id)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_SIGNS = re.compile(r"[\W_]+")
_DIGITS = re.compile(r"\d+")
# Elements of HTML by their part in the page.
_BLOCKS = frozenset("address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
_INLINE = frozenset("a abbr b big button cite em font i label mark q s small span strike strong sub sup u".split())
_SENTENCES = re.compile(r"[^\W\d][.!?] ")
_IMPLIED = {"li": ({"li"}, {"ul", "ol"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"})}
_CLOSE = {t: re.compile(rf"</{t}\s*>", re.I) for t in ("script", "style", "noscript", "template")}


def _attributes(raw: str) -> str:
    found = ".".join(f"{m[1].lower()}={m[2] or m[3] or m[4] or ''}" for m in _ATTR.finditer(raw) if m[1].lower() != "id") if "=" in raw else ""
    return " ".join(found.replace(">", " ").split())


def text_runs(markup: str) -> list[tuple[str, str, tuple[str, ...], tuple[int, ...]]]:
    """(path, text, inline marks, elements) of each run of text between tags, without head, scripts and styles. A path holds
    the open blocks with their classes, ``elements`` their numbers on the page."""
    stack: list[tuple[str, str, tuple[int, ...]]] = []
    number = 0
    inline: list[str] = []
    runs = []
    at, end, head = 0, len(markup), False
    while at < end:
        m = _TAG.search(markup, at)
        stop = m.start() if m else end
        if stop > at and not head and (text := markup[at:stop]) and not text.isspace():
            runs.append((stack[-1][1] if stack else "body", text, tuple(inline), stack[-1][2] if stack else ()))
        if not m:
            break
        at = m.end()
        name = m[2].lower() if m[2] else ""
        if not name:
            continue
        closing = bool(m[1])
        if name in _CLOSE:
            if not closing:
                c = _CLOSE[name].search(markup, at)
                at = c.end() if c else end
        elif name in ("head", "title"):
            head = not closing
        elif name in _BLOCKS:
            inline.clear()
            if closing:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] == name:
                        del stack[k:]
                        break
            elif name != "hr":
                head = False
                if stack and stack[-1][0] == "p":
                    stack.pop()
                if name in _IMPLIED:
                    shut, within = _IMPLIED[name]
                    for k in range(len(stack) - 1, -1, -1):
                        if stack[k][0] in within:
                            break
                        if stack[k][0] in shut:
                            del stack[k:]
                            break
                if name != "body":
                    marks = _attributes(m[3])
                    number += 1
                    path, own = stack[-1][1:] if stack else ("", ())
                    if len(own) < DEEP:  # deeper blocks, as thousands of unclosed ones make, count as their ancestor
                        path, own = (path + ">" if path else "") + (f"{name}.{marks}" if marks else name), (*own, number)
                    stack.append((name, path, own))
        elif name in _INLINE:
            if closing:
                if name in inline:
                    del inline[len(inline) - 1 - inline[::-1].index(name) :]
            elif not m[3].endswith("/"):
                inline.append(name)
    return runs


def _bare(text: str) -> str:
    return _SIGNS.sub("", html.unescape(text) if "&" in text else text)


def line_paths(lines: list[str], markup: str | None) -> tuple[list[str | None], list[int]]:
    """The path of each line, None where the markup lacks it, and how many open blocks it shares with the line before.

    The last part of a path has ``/a`` for blocks of links and ``/mark`` for blocks that are wholly in one inline mark."""
    if not markup:
        return [None] * len(lines), [0] * len(lines)
    runs = text_runs(markup)
    bare = [_bare(r[1]) for r in runs]
    whole = "".join(bare)
    starts = [0]
    for b in bare:
        starts.append(starts[-1] + len(b))
    at, out, joins = 0, [], []
    before: tuple[int, ...] = ()
    for t in lines:
        key = _SIGNS.sub("", t)
        pos = whole.find(key, at) if key else -1
        joins.append(0)
        if pos < 0:
            out.append(None)
            continue
        at = pos + len(key)
        first = bisect.bisect_right(starts, pos) - 1
        last = max(first, bisect.bisect_left(starts, at) - 1)
        own = [runs[i] for i in range(first, last + 1) if bare[i]]
        path = own[0][0]
        here = own[0][3]
        while joins[-1] < min(len(here), len(before)) and here[joins[-1]] == before[joins[-1]]:
            joins[-1] += 1
        before = here
        linked = sum(len(r[1]) for r in own if "a" in r[2])
        if 2 * linked > sum(len(r[1]) for r in own):
            path += "/a"
        else:
            marks = set(own[0][2])
            for r in own[1:]:
                marks &= set(r[2])
            if marks:
                path += "/" + sorted(marks)[0]
        out.append(path)
    return out, joins


def skeleton(text: str) -> str:
    return " ".join(_DIGITS.sub("0", text.lower()).split())


# patterns: tuples of words, None for a slot


def align(a: tuple, b: tuple) -> tuple[tuple, int]:
    """The union-free pattern of two patterns: their longest common words in order, slots between; and its words."""
    low, n, m = 0, len(a), len(b)
    while low < n and low < m and a[low] == b[low] and a[low] is not None:
        low += 1
    high = 0
    while high < n - low and high < m - low and a[n - 1 - high] == b[m - 1 - high] and a[n - 1 - high] is not None:
        high += 1
    x, y = a[low : n - high], b[low : m - high]
    core: list = []
    if x and y:
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            row, below = best[i], best[i + 1]
            for j in range(len(y) - 1, -1, -1):
                row[j] = below[j + 1] + 1 if x[i] == y[j] and x[i] is not None else max(below[j], row[j + 1])
        i = j = 0
        gap = False
        while i < len(x) and j < len(y):
            if x[i] == y[j] and x[i] is not None:
                if gap:
                    core.append(None)
                core.append(x[i])
                gap = False
                i, j = i + 1, j + 1
            else:
                gap = True
                if best[i + 1][j] >= best[i][j + 1]:
                    i += 1
                else:
                    j += 1
        if gap or i < len(x) or j < len(y):
            core.append(None)
    elif x or y:
        core = [None]
    merged = a[:low] + tuple(core) + a[n - high :]
    return merged, sum(w is not None for w in merged)


def matches(pattern: tuple, words: list[str]) -> bool:
    """Whether the pattern's words stand in ``words`` in order, with anything, but not nothing, in its slots."""
    n, at, k = len(words), 0, 0
    while k < len(pattern) and pattern[k] is not None:
        if at >= n or words[at] != pattern[k]:
            return False
        at, k = at + 1, k + 1
    if k == len(pattern):
        return at == n
    end, e = n, len(pattern)
    while pattern[e - 1] is not None:
        if end <= at or words[end - 1] != pattern[e - 1]:
            return False
        end, e = end - 1, e - 1
    slot = False
    for w in pattern[k:e]:
        if w is None:
            slot = True
            at += 1
            if at > end:
                return False
        else:
            try:
                at = words.index(w, at, end) + 1
            except ValueError:
                return False
            slot = False
    return slot or at == end


def telling(pattern: tuple) -> bool:
    """Whether a pattern has words enough to tell a field: two, or one that ends in a colon, or no slot at all."""
    words = [w for w in pattern if w is not None and (w.strip("|>·-—–,.") or w == "©")]
    return bool(words) and (None not in pattern or len(words) >= 2 or words[0].endswith(":"))


class Index:
    """Patterns by the words that a match must show at its ends."""

    def __init__(self, patterns: list[tuple]):
        self.first, self.last, self.inner = defaultdict(list), defaultdict(list), defaultdict(list)
        for p in patterns:
            if p[0] is not None:
                self.first[p[0]].append(p)
            elif p[-1] is not None:
                self.last[p[-1]].append(p)
            else:
                self.inner[next(w for w in p if w is not None)].append(p)

    def find(self, words: list[str]) -> tuple | None:
        if words:
            for p in self.first.get(words[0], ()):
                if matches(p, words):
                    return p
            for p in self.last.get(words[-1], ()):
                if matches(p, words):
                    return p
            if self.inner:
                for w in words[1:]:
                    for p in self.inner.get(w, ()):
                        if matches(p, words):
                            return p
        return None


def _labels(p: tuple) -> tuple:
    """The words up to the first that ends in a colon, if it is among the first four, also with a slot for the first."""
    for k, w in enumerate(p[:4]):
        if k and w is None:
            break
        if w is not None and w.endswith(":"):
            return (p[: k + 1], (None, *p[1 : k + 1])) if k and p[0] is not None else (p[: k + 1],)
    return ()


def align_all(rows: list[tuple[str, tuple, int, int]]) -> list[tuple[str, tuple, int, int]]:
    """Align rows (signature, pattern, pages, times) into fields, the most frequent first.

    A row is held against every field of its signature that can take it: fields whose slots it fills, by the words at
    their ends; fields with its label; and fields that share ``ALIKE`` of the words. Patterns that share so many words agree
    in one of their rarest words, as many as may differ and one more, so only those are looked up."""
    fields: list[list] = []
    sizes: list[int] = []
    has: list[frozenset] = []
    slotted: dict[tuple, dict[int, None]] = defaultdict(dict)
    labelled: dict[tuple, dict[int, None]] = defaultdict(dict)
    rare: dict[tuple, dict[int, None]] = defaultdict(dict)
    usual = Counter((r[0], w) for r in rows for w in r[1] if w is not None)

    def rarest(sig: str, own: list) -> list:
        """The rarest words, each occurrence of a word for itself."""
        times: dict[str, int] = defaultdict(int)
        told = []
        for w in own:
            times[w] += 1
            told.append((usual[sig, w], w, times[w]))
        return sorted(told)[: len(own) - math.ceil(ALIKE * len(own)) + 1]

    def enter(i: int) -> None:
        sig, p, *_ = fields[i]
        own = [w for w in p if w is not None]
        sizes[i], has[i] = len(own), frozenset(own)
        keys = [(rare, (sig, w, n)) for _, w, n in rarest(sig, own)] + [(labelled, (sig, x)) for x in _labels(p)]
        if None in p:
            ends = ("first", p[0], p[-1]) if p[0] is not None else ("last", p[-1]) if p[-1] is not None else ("inner", own[0])
            keys.append((slotted, (sig, *ends)))
        for by, k in keys:
            by[k][i] = None

    def filled(sig: str, p: tuple) -> int:
        """The first field whose slots ``p`` fills, or -1."""
        for k in (("first", p[0], p[-1]), ("first", p[0], None), ("last", p[-1]), *(("inner", w) for w in dict.fromkeys(p[1:]))):
            for i in slotted.get((sig, *k), ()):
                if None in fields[i][1] and matches(fields[i][1], p):
                    return i
        return -1

    for sig, p, pages, times in sorted(rows, key=lambda r: (-r[2], r[0], tuple(w or "" for w in r[1]))):
        best, made, share = -1, None, 0.0
        labels = _labels(p)
        if None not in p and (best := filled(sig, p)) >= 0:
            made, share = fields[best][1], 1.0
        elif found := next(((i, x) for x in labels for i in labelled.get((sig, x), ()) if x in _labels(fields[i][1])), None):
            best, made, share = found[0], found[1] + (None,), 1.0  # one label before different texts: the text is a slot
        else:
            words = [w for w in p if w is not None]
            own = len(words)
            near = set()
            for _, w, n in rarest(sig, words):
                near.update(rare.get((sig, w, n), ()))
            for i in sorted(near):
                least = max(own, sizes[i])
                bound = min(own, sizes[i])
                if bound < ALIKE * least or bound <= share * least:
                    continue
                bound = sum(w in has[i] for w in words)
                if bound < ALIKE * least or bound <= share * least:
                    continue
                merged, n = align(fields[i][1], p)
                s = n / least
                if s > share and telling(merged):
                    best, made, share = i, merged, s
        if best >= 0 and share >= ALIKE:
            f = fields[best]
            if made != f[1]:
                f[1] = made
                enter(best)
            f[2] += pages
            f[3] += times
        else:
            fields.append([sig, p, pages, times])
            sizes.append(0)
            has.append(frozenset())
            enter(len(fields) - 1)
    return [tuple(f) for f in fields]


def _words(p: tuple) -> str:
    return json.dumps(p, ensure_ascii=False)


def _pattern(raw: str) -> tuple:
    return tuple(json.loads(raw))


def _slots(p: tuple, slot) -> tuple:
    """``p`` with the words for which ``slot`` is true as slots; runs of slots are one."""
    out: list = []
    for w in p:
        w = None if w is None or slot(w) else w
        if w is not None or not out or out[-1] is not None:
            out.append(w)
    return tuple(out)


@lru_cache(maxsize=4096)
def _site_words(host: str) -> frozenset:
    parts = [x for x in re.split(r"[.\-_]+", (host or "").lower()) if x]
    return frozenset(parts[:-1] if len(parts) > 1 else parts)


def without_site(p: tuple, host: str) -> tuple:
    """The site's name, as its host spells it, is a slot: a word of the host of four letters, with a neighbour of any length."""
    own = _site_words(host)
    bare = [_SIGNS.sub("", w) if w else "" for w in p]
    mark = [bool(b) and b in own and len(b) >= 4 for b in bare]
    mark = [m or (bool(b) and b in own and (k > 0 and mark[k - 1] or k + 1 < len(mark) and mark[k + 1])) for k, (m, b) in enumerate(zip(mark, bare))]
    at = iter(mark)
    return _slots(p, lambda w: False) if not any(mark) else _slots(tuple(None if next(at) else w for w in p), lambda w: False)


def is_running(path: str, text: str) -> bool:
    """Running text: long, or several sentences in a block without class or mark."""
    tag = path[path.rfind(">") + 1 :]
    return text.count(" ") >= ALIGNED_WORDS or "." not in tag and "/" not in tag and bool(_SENTENCES.search(text))


def path_texts(lines: list[str], paths: list[str | None]) -> tuple[dict[str, list[int]], list[tuple[str, int]]]:
    """Lines, running lines and running words of each path, and the least and largest hash of its lines; and the hash of
    each running line, without its digits."""
    out: dict[str, list[int]] = {}
    runs = []
    for t, p in zip(lines, paths):
        if p is not None:
            h = zlib.crc32(t.strip().encode("utf-8", "replace"))
            x = out.setdefault(p, [0, 0, 0, h, h])
            x[0] += 1
            if is_running(p, t):
                x[1] += 1
                x[2] += t.count(" ") + 1
                runs.append((p, zlib.crc32(skeleton(t).encode("utf-8", "replace"))))
            x[3], x[4] = min(x[3], h), max(x[4], h)
    return out, runs


def read_pages(documents: DataFrame, doc: str, host: str, markup: str, content: str, title: str | None) -> DataFrame:
    """(doc_id, host, title, content, paths, joins, stream, known, texts, run_paths, runs) of each page with text: ``line_paths``,
    the stream of paths with neighbours of one path as one, and ``path_texts`` flattened. Markup is parsed here and nowhere else."""
    rows = documents.where(F.col(content).isNotNull()).select(F.col(doc).alias("doc_id"), F.col(host).cast("string").alias("host"), (F.col(title).cast("string") if title else F.lit(None).cast("string")).alias("title"), F.col(content).alias("content"), F.col(markup).alias("markup"))
    texts = pa.list_(pa.int64())
    strings = pa.list_(pa.string())

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, 200) for whole in batches for at in range(0, whole.num_rows, 200)):  # a few pages at a time as Python strings
            out: list[list] = [[], [], [], [], [], [], []]
            for c, m in zip(b.column(3).to_pylist(), b.column(4).to_pylist()):
                lines = c.split("\n")
                paths, joins = line_paths(lines, m)
                held = [p for p in paths if p is not None]
                told, runs = path_texts(lines, paths)
                out[0].append(paths if held else None)
                out[1].append("\n".join(p for k, p in enumerate(held) if k < 2 or p != held[k - 1] or p != held[k - 2]) if held else None)
                out[2].append(list(told))
                out[3].append([n for x in told.values() for n in x])
                out[4].append(joins if held else None)
                out[5].append([p for p, _ in runs])
                out[6].append([h for _, h in runs])
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(out[0], strings), pa.array(out[4], pa.list_(pa.int32())), pa.array(out[1], pa.string()), pa.array(out[2], strings), pa.array(out[3], texts), pa.array(out[5], strings), pa.array(out[6], texts)], ["doc_id", "host", "title", "content", "paths", "joins", "stream", "known", "texts", "run_paths", "runs"])

    return rows.mapInArrow(make, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, host string, title string, content string, paths array<string>, joins array<int>, stream string, known array<string>, texts array<bigint>, run_paths array<string>, runs array<bigint>")


def _inferred(pdf: pd.DataFrame) -> pd.DataFrame:
    rows = sorted(zip(-pdf["pages"], pdf["stream"]))
    wrapper, pages = page_streams.infer((json.loads(t) if t[:1] == "[" else page_streams.times(page_streams.stream(t.split("\n")), int(-n)), int(-n)) for n, t in rows)
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "stream": [json.dumps(wrapper, ensure_ascii=False)], "pages": [pages]})


def _judged(pdf: pd.DataFrame) -> pd.DataFrame:
    one = _inferred(pdf)
    told = json.loads(pdf["told"].iloc[0] or "[]")
    one["roles"] = json.dumps(page_streams.roles(json.loads(one["stream"].iloc[0]), int(one["pages"].iloc[0]), {p: tuple(map(int, x)) for p, *x in told}), ensure_ascii=False)
    return one.rename(columns={"stream": "wrapper"})


def site_streams(pages: DataFrame) -> DataFrame:
    """(host, wrapper, pages, roles): the wrapper of each host's pages as JSON, and what its slots are."""
    held = pages.where(F.col("host").isNotNull() & F.col("stream").isNotNull())
    streams = held.groupBy("host", "stream").agg(F.count(F.lit(1)).alias("pages"))
    groups = streams.groupBy("host").agg((F.floor(F.count(F.lit(1)) / GROUP_ROWS) + 1).alias("groups"))
    salted = streams.join(groups, "host").select("host", "stream", "pages", F.pmod(F.xxhash64("stream"), F.col("groups")).alias("salt"))
    part = salted.groupBy("host", "salt").applyInPandas(lambda pdf: _inferred(pdf.drop(columns="salt")), "host string, stream string, pages bigint")
    none, path, number = F.lit(None).cast("bigint"), F.col("x.path"), lambda k: F.col(f"x.s{k}")
    stats = F.transform("known", lambda p, at: F.struct(p.alias("path"), *(F.element_at("texts", at * 5 + k).alias(f"s{k}") for k in range(1, 6)), none.alias("run")))
    runs = F.transform(F.arrays_zip("run_paths", "runs"), lambda x: F.struct(x["run_paths"].alias("path"), *(none.alias(f"s{k}") for k in range(1, 6)), x["runs"].alias("run")))
    each = held.select("host", F.explode(F.concat(stats, runs)).alias("x"))
    summed = each.groupBy("host", path.alias("path")).agg(*(F.sum(number(k)).alias(f"s{k}") for k in (1, 2, 3)), F.min(number(4)).alias("s4"), F.max(number(5)).alias("s5"), F.hll_sketch_estimate(F.hll_sketch_agg("x.run", F.lit(10))).alias("kinds"))
    summed = summed.withColumn("s3", (F.col("s3") * F.least(F.coalesce(F.try_divide(F.col("kinds"), F.col("s2")), F.lit(1.0)), F.lit(1.0))).cast("bigint"))  # words of different texts
    told = summed.groupBy("host").agg(F.to_json(F.collect_list(F.array("path", *(F.col(f"s{k}").cast("string") for k in range(1, 6))))).alias("told"))
    return part.join(told, "host").groupBy("host").applyInPandas(_judged, "host string, wrapper string, pages bigint, roles string")


Roles = tuple[list, dict[str, str]]


def page_roles(lines: list[str], paths: list[str | None]) -> Roles:
    """Roles from one page alone."""
    wrapper, n = page_streams.infer([(page_streams.stream(p for p in paths if p is not None), 1)])
    return _roles(page_streams.roles(wrapper, n, path_texts(lines, paths)[0]))


def _roles(raw: dict | str | None) -> Roles:
    r = json.loads(raw or "{}") if not isinstance(raw, dict) else raw
    return [tuple(x) for x in r.get("lists", [])], r.get("paths", {})


def line_roles(lines: list[str], paths: list[str | None], joins: list[int], known: Roles) -> list[str | None]:
    """The role of each line on its page: lines of a main list before its fixed token, or behind the next, are site matter, and
    so are other blocks of the same path, if the one with the fixed token holds most of the text."""
    lists, by_path = known
    out = [None if p is None else by_path.get(p, page_streams.MATTER) for p in paths]
    for prefix, before, behind in lists:
        is_at = lambda p, token: p is not None and token and (p == token or token[-1] == ">" and p.startswith(token))
        depth, block, blocks = prefix.count(">"), 0, {}
        held = [i for i, p in enumerate(paths) if p is not None and p.startswith(prefix)]
        last = -1
        for i, p in enumerate(paths):
            if p is not None:
                if joins[i] < depth or last >= 0 and not paths[last].startswith(prefix):
                    block += 1
                if p.startswith(prefix):
                    blocks[i] = block
                last = i
        start = max((i for i, p in enumerate(paths) if is_at(p, before)), default=-1)
        end = next((i for i, p in enumerate(paths) if i > start and is_at(p, behind)), len(paths))
        own = blocks.get(start)
        if own is not None and 2 * sum(len(lines[i]) for i in held if blocks[i] == own) < sum(len(lines[i]) for i in held):
            own = None
        for i in held:
            if (i < start or i >= end or own is not None and blocks[i] != own) and out[i] in (page_streams.SLOT, page_streams.PARAGRAPH) and not any(paths[i].startswith(x[0]) for x in lists if len(x[0]) > len(prefix)):
                out[i] = page_streams.MATTER
    return out


class Wrappers:
    """The roles of every host's paths: sent to all tasks if they are counted to be small, a column of the rows otherwise."""

    def __init__(self, streams: DataFrame):
        self.streams = cut(streams.select("host", "roles"))
        size = self.streams.agg(F.sum(F.length("roles"))).first()[0] or 0
        self.sent = None
        if size <= BROADCAST_BYTES:
            self.sent = streams.sparkSession.sparkContext.broadcast({r["host"]: r["roles"] for r in self.streams.collect()})

    def beside(self, pages: DataFrame) -> DataFrame:
        return pages.withColumn("roles", F.lit(None).cast("string")) if self.sent else pages.join(self.streams, "host", "left")

    def reader(self):
        """A function that gives the roles of a page (host, lines, paths, column ``roles``)."""
        sent, kept = self.sent, {}

        def of(host: str | None, lines: list[str], paths: list[str | None], beside: str | None) -> Roles:
            if host not in kept:
                if len(kept) > 2000:
                    kept.clear()
                raw = (sent.value.get(host) if sent else beside) if host is not None else None
                kept[host] = _roles(raw) if raw else None
            return kept[host] or page_roles(lines, paths)

        return of


def page_blocks(pages: DataFrame, wrappers: Wrappers) -> DataFrame:
    """(host, sig, place, pattern, pages, times): the distinct blocks of site matter of each host."""
    reader = wrappers.reader()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total: dict[tuple, list[int]] = {}
            for at in range(0, b.num_rows, 200):
                for h, c, paths, joins, beside in zip(*(x.to_pylist() for x in b.slice(at, 200).columns)):
                    lines = c.split("\n")
                    rows = Counter()
                    for t, p, role in zip(lines, paths, line_roles(lines, paths, joins, reader(h, lines, paths, beside))):
                        if role == page_streams.MATTER:
                            rows[h, p[p.rfind(">") + 1 :], skeleton(t)] += 1
                    for k, n in rows.items():
                        x = total.setdefault(k, [0, 0])
                        x[0] += 1
                        x[1] += n
            cols = list(zip(*total)) if total else [[], [], []]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols), pa.array([v[0] for v in total.values()], pa.int64()), pa.array([v[1] for v in total.values()], pa.int64())], ["host", "sig", "pattern", "pages", "times"])

    rows = wrappers.beside(pages.where(F.col("host").isNotNull() & F.col("paths").isNotNull())).select("host", "content", "paths", "joins", "roles")
    found = rows.mapInArrow(make, "host string, sig string, pattern string, pages bigint, times bigint")
    return found.groupBy("host", "sig", "pattern").agg(F.sum("pages").alias("pages"), F.sum("times").alias("times"))


_FIELDS = "host string, sig string, pattern string, pages bigint, times bigint"


def _aligned(pdf: pd.DataFrame) -> pd.DataFrame:
    host = pdf["host"].iloc[0]
    rows = [(s, without_site(_pattern(t) if t[:1] == "[" and t[-1:] == "]" and t[1:2] in ('"', "n") else tuple(t.split(" ")), host), n, k) for s, t, n, k in zip(pdf["sig"], pdf["pattern"], pdf["pages"], pdf["times"]) if t]
    out = [(host, s, _words(t), n, k) for s, t, n, k in align_all([r for r in rows if any(w is not None for w in r[1])])]
    return pd.DataFrame(out, columns=["host", "sig", "pattern", "pages", "times"])


def wrapper_fields(blocks: DataFrame) -> DataFrame:
    """(host, sig, pattern, pages, times): the fields of each host's site matter, as JSON lists of words and nulls for slots.

    Blocks are aligned in salted groups of about ``GROUP_ROWS``, the patterns that these leave are added up and aligned in groups again,
    until the largest host is one group or aligning in groups leaves no fewer; then each host's patterns are aligned together."""
    rows, last = blocks, None
    while True:
        counted = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        most = counted.agg(F.max("n")).first()[0] or 0
        if last is not None and (most <= GROUP_ROWS or most > SHRINKING * last):
            break
        groups = counted.select("host", (F.floor(F.col("n") / GROUP_ROWS) + 1).alias("groups"))
        salted = rows.join(groups, "host").withColumn("salt", F.pmod(F.xxhash64("pattern", F.lit(most)), F.col("groups")))
        part = salted.select("host", "sig", "pattern", "pages", "times", "salt").groupBy("host", "salt").applyInPandas(lambda pdf: _aligned(pdf.drop(columns="salt")), _FIELDS)
        rows, last = cut(part.groupBy("host", "sig", "pattern").agg(F.sum("pages").alias("pages"), F.sum("times").alias("times"))), most
    return rows.groupBy("host").applyInPandas(_aligned, _FIELDS).where("pages > 1")  # only now: variants of a field may stand one to a group


def site_fields(documents: DataFrame, host: str = "domain", markup: str = "raw_html", content: str = "raw_content") -> DataFrame:
    """The fields of each host's site matter, from whole pages."""
    pages = cut(read_pages(documents, content, host, markup, content, None))
    return wrapper_fields(cut(page_blocks(pages, Wrappers(site_streams(pages)))))


def shared_fields(fields: DataFrame) -> DataFrame:
    """(pattern): the patterns of site matter found on several hosts, as JSON; words of fewer hosts are slots."""
    sites = fields.select("host", "pattern").distinct()
    words = sites.select("host", F.explode(F.array_distinct(F.from_json("pattern", "array<string>"))).alias("w")).where("w IS NOT NULL").distinct()
    usual = cut(words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SHARED_HOSTS).select("w"))
    if usual.count() <= BROADCAST_WORDS:
        known = fields.sparkSession.sparkContext.broadcast({r["w"] for r in usual.collect()})
    else:  # the words of each pattern that are not usual become null by a join
        known = None
        each = sites.select("host", "pattern", F.posexplode(F.from_json("pattern", "array<string>")).alias("at", "w"))
        kept = each.join(usual.select("w", F.col("w").alias("k")), "w", "left").groupBy("host", "pattern").agg(F.sort_array(F.collect_list(F.struct("at", "k"))).alias("ws"))
        sites = kept.select("host", F.to_json(F.col("ws.k"), {"ignoreNullFields": "false"}).alias("pattern"))

    def slotted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = [_slots(_pattern(x), lambda w: known is not None and w not in known.value) for x in b.column(1).to_pylist()]
            keep = [telling(x) for x in p]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep, pa.bool_())), pa.array([_words(x) for x, k in zip(p, keep) if k], pa.string())], ["host", "pattern"])

    sites = sites.mapInArrow(slotted, "host string, pattern string").distinct()
    return sites.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SHARED_HOSTS).select("pattern")


def page_matter(lines: list[str], paths: list[str | None], joins: list[int], title: str | None, host: str | None, known: Roles, own: Index, shared: Index, open_lines: list | None = None) -> list[int]:
    """Numbers of the lines that are not main body. ``open_lines`` takes (number, words) of the lines that the fields of several
    hosts may yet match."""
    told = line_roles(lines, paths, joins, known)
    headline = " ".join(title.split()).lower() if title else None
    start = -1
    if headline and all(r is None or r == page_streams.MATTER for r in told):
        start = next((i for i, t in enumerate(lines) if " ".join(t.split()).lower() == headline), -1)
    out = []
    for i, (role, text) in enumerate(zip(told, lines)):
        if role == page_streams.MATTER or role is None and i < start:
            out.append(i + 1)
        elif (role is None or role == page_streams.PARAGRAPH) and i != start:
            words = skeleton(text).split(" ")
            if words != [""]:
                words = list(without_site_words(words, host))
                if own.find(words) or shared.find(words):
                    out.append(i + 1)
                elif open_lines is not None:
                    open_lines.append((i + 1, " ".join(words)))
    return out


def without_site_words(words: list[str], host: str | None) -> list[str]:
    """Words with the site's name as one word that no pattern holds, as it stands in a pattern's slot."""
    if not host:
        return words
    return [w if w is not None else "\0" for w in without_site(tuple(words), host)]


def site_matter(documents: DataFrame, doc: str = "doc_id", host: str = "domain", markup: str = "raw_html", content: str = "raw_content", title: str = "title") -> DataFrame:
    """(doc_id, line_no) of each line that is not main body."""
    spark = documents.sparkSession
    pages = cut(read_pages(documents, doc, host, markup, content, title))
    wrappers = Wrappers(site_streams(pages))
    fields = cut(wrapper_fields(cut(page_blocks(pages, wrappers))))
    patterns = cut(shared_fields(fields))
    few = patterns.count() <= BROADCAST_FIELDS
    shared = spark.sparkContext.broadcast([_pattern(r["pattern"]) for r in patterns.sort("pattern").collect()] if few else [])
    rows = wrappers.beside(pages).select("doc_id", "host", "title", "content", "paths", "joins", "roles")
    small = fields.count() <= BROADCAST_FIELDS
    known = None
    if small:
        by = defaultdict(list)
        for r in fields.select("host", "pattern").distinct().sort("host", "pattern").collect():
            by[r["host"]].append(r["pattern"])
        known = spark.sparkContext.broadcast(dict(by))
    else:
        rows = rows.join(fields.groupBy("host").agg(F.sort_array(F.collect_set("pattern")).alias("fields")), "host", "left").select(*rows.columns, "fields")
    reader, kind = wrappers.reader(), rows.schema["doc_id"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = Index(shared.value)
        indexes: dict = {}
        for b in (whole.slice(at, 200) for whole in batches for at in range(0, whole.num_rows, 200)):
            ids, numbers, words = [], [], []
            beside = b.column(7).to_pylist() if not small else [None] * b.num_rows
            for k, (h, t, c, paths, joins, r, own) in enumerate(zip(*(b.column(j).to_pylist() for j in range(1, 7)), beside)):
                if h not in indexes:
                    if len(indexes) > 2000:
                        indexes.clear()
                    matter = (_pattern(x) for x in (known.value.get(h, ()) if small else own or ()))
                    indexes[h] = Index([p for p in matter if telling(p)])
                lines = c.split("\n")
                paths, joins = paths or [None] * len(lines), joins or [0] * len(lines)
                left = None if few else []
                found = [(n, None) for n in page_matter(lines, paths, joins, t, h, reader(h, lines, paths, r), indexes[h], common, left)] + (left or [])
                ids += [k] * len(found)
                numbers += [n for n, _ in found]
                words += [w for _, w in found]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids, pa.int64())), pa.array(numbers, pa.int32()), pa.array(words, pa.string())], ["doc_id", "line_no", "words"])

    lines = rows.mapInArrow(make, f"doc_id {kind}, line_no int, words string")
    if few:
        return lines.select("doc_id", "line_no")
    lines = cut(lines)
    matched = lines.join(_matched(lines.select("words").where("words IS NOT NULL").distinct(), patterns), "words", "left_semi")
    return lines.where("words IS NULL").select("doc_id", "line_no").unionByName(matched.select("doc_id", "line_no"))


def _matched(lines: DataFrame, patterns: DataFrame) -> DataFrame:
    """(words): the distinct ``words`` that one of ``patterns`` matches. Both meet on the word by which ``Index`` looks."""
    p = F.from_json("pattern", "array<string>")
    first, last, inner = F.element_at(p, 1), F.element_at(p, -1), F.get(F.filter(p, lambda w: w.isNotNull()), F.lit(0))
    keyed = patterns.select("pattern", F.when(first.isNotNull(), F.concat(F.lit("f"), first)).when(last.isNotNull(), F.concat(F.lit("l"), last)).otherwise(F.concat(F.lit("i"), inner)).alias("key"))
    w = F.split("words", " ")
    keys = F.concat(F.array(F.concat(F.lit("f"), F.element_at(w, 1)), F.concat(F.lit("l"), F.element_at(w, -1))), F.transform(F.array_distinct(F.slice(w, 2, F.size(w))), lambda x: F.concat(F.lit("i"), x)))

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [matches(_pattern(x), t.split(" ")) for t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep, pa.bool_()))], ["words"])

    met = lines.select("words", F.explode(keys).alias("key")).join(keyed, "key").select("words", "pattern")
    return met.mapInArrow(tell, "words string").distinct()


def main_body(documents: DataFrame, doc: str = "doc_id", content: str = "raw_content", **names: str) -> DataFrame:
    """(doc_id, body): the text of each page without site matter, line by line; null stays null."""
    out = site_matter(documents, doc=doc, content=content, **names).groupBy("doc_id").agg(F.collect_set("line_no").alias("out"))
    rows = documents.select(F.col(doc).alias("doc_id"), F.col(content).alias("whole")).join(out, "doc_id", "left")
    kept = F.array_join(F.filter(F.split("whole", "\n", -1), lambda x, i: ~F.array_contains("out", i + 1)), "\n")
    return rows.select("doc_id", F.when(F.col("out").isNull(), F.col("whole")).otherwise(kept).alias("body"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_matter(table(spark, sf_dir, "documents")).distinct()


SQL: dict[str, str] = {}
QUERIES = {"p1_found": p1_found}
