"""Union-free wrappers of the token streams of one host's pages.

A page is a stream of tokens in page order: the tags that open and close around each line, and the line itself. The
stream is written as the paths of its lines (``body>div>p``); neighbours of one path are one repeated token. A wrapper is a
union-free regular expression over such tokens: a list of items, each a token with its inner list, how many pages hold it
(fewer than all: optional), whether it is repeated, or a repeated group of optional items.

``merge`` aligns a wrapper with one more stream, or with another wrapper, in order, level by level of the tags. Tokens that
only one of both has become optional; a group takes all neighbours that it knows, and what stands between them. ``fold``
then looks for tokens that come again with nothing fixed between them: what they span is a repeated group. Tokens that nearly
every page has just once hold their places and are never inside a group, so that menus before and footers behind an article are
not drawn into it. Merging is done page after page in groups, and wrapper with wrapper after that.

``roles`` reads the wrapper with the lengths of the texts in its slots: the list that holds most running text is the
main list, cut at the fixed tokens around its repeated group.
"""

from __future__ import annotations

from collections.abc import Iterable

#: Share of the pages that hold a fixed token; pages cut off at the end lack some.
FIXED = 0.8
#: A list of which the running text has this share of the largest one's is a main list, too.
MAIN_SHARE = 0.2
#: Share of a path's lines that are running text, for a path of paragraphs.
RUNNING_SHARE = 0.25
#: Tokens of a list from which it is folded while pages are still being merged.
LONG_LIST, EARLY = 24, 8
#: Tokens of a list from which a page is folded by itself before it is aligned.
LONG_PAGE = 200
GROUP = ""
SLOT, PARAGRAPH, MATTER, HEADLINE = "slot", "paragraph", "matter", "headline"
# Elements of HTML whose texts are content by themselves.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CONTENT = HEADINGS | frozenset("pre pre/code li td th dd dt blockquote".split())

# An item is [key, pages, repeated, inner items or None]; the key of a token that has inner tokens ends in ">".


def stream(paths: Iterable[str]) -> list[list]:
    """The tokens of one page from the paths of its lines."""
    return _level([p.split(">") for p in paths], 0)


def _level(paths: list[list[str]], depth: int) -> list[list]:
    out: list[list] = []
    at = 0
    while at < len(paths):
        p = paths[at]
        leaf = len(p) == depth + 1
        end = at + 1
        while end < len(paths) and paths[end][depth] == p[depth] and (len(paths[end]) == depth + 1) == leaf:
            end += 1
        out.append([p[depth], 1, end - at > 1, None] if leaf else [p[depth] + ">", 1, False, _level(paths[at:end], depth + 1)])
        at = end
    return out


def _keys(item: list) -> set[str]:
    return {x[0] for x in item[3]} if item[0] == GROUP else {item[0]}


def _plus(x: list, y: list, pages: int) -> list:
    """Two items of one key."""
    return [x[0], pages, x[2] or y[2], None if x[3] is None else merge(x[3], y[3])]


def _grouped(x: list, y: list, pages: int) -> list:
    """A repeated group of the items of both."""
    members = [list(m) for m in (x[3] if x[0] == GROUP else [x])]
    where = {m[0]: k for k, m in enumerate(members)}
    for m in y[3] if y[0] == GROUP else [y]:
        if m[0] in where:
            k = where[m[0]]
            members[k] = _plus(members[k], m, members[k][1] + m[1])
        else:
            where[m[0]] = len(members)
            members.append(m)
    return [GROUP, pages, True, members]


def _weight(x: list, y: list) -> int:
    """What a pair of tokens counts: tokens with inner lists count as these do, so that they are aligned before single lines."""
    return 1 if x[3] is None or y[3] is None else 1 + min(len(x[3]), len(y[3]))


def merge(a: list[list], b: list[list]) -> list[list]:
    """The wrapper of what ``a`` and ``b`` match, by the alignment that keeps most tokens."""
    if not a or not b:
        return a or b
    keys_a, keys_b = [_keys(x) for x in a], [_keys(x) for x in b]
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, below, own, group = best[i], best[i + 1], keys_a[i], a[i][0] == GROUP
        for j in range(m - 1, -1, -1):
            s = below[j] if below[j] >= row[j + 1] else row[j + 1]
            if not own.isdisjoint(keys_b[j]):
                w = _weight(a[i], b[j])
                s = max(s, w + below[j + 1], w + row[j + 1] if group else 0, w + below[j] if b[j][0] == GROUP else 0)
            row[j] = s
    out: list[list] = []
    pending: list[list] = []
    i = j = 0
    last_i = last_j = -1
    while i < n and j < m:
        here = best[i][j]
        w = _weight(a[i], b[j])
        on_a, on_b = a[i][0] == GROUP and here == w + best[i][j + 1], b[j][0] == GROUP and here == w + best[i + 1][j]
        if not keys_a[i].isdisjoint(keys_b[j]) and (on_a or on_b or here == w + best[i + 1][j + 1]):
            x, y = a[i], b[j]
            if last_i == i or last_j == j:  # a group goes on; what stands between belongs to it
                g = out[-1]
                for p in [*pending, y if last_i == i else x]:
                    g = _grouped(g, p, max(g[1], p[1]))
                out[-1] = g
            else:
                out += pending
                out.append(_plus(x, y, x[1] + y[1]) if x[0] == y[0] != GROUP else _grouped(x, y, x[1] + y[1]))
            pending = []
            last_i, last_j = i, j
            if here == w + best[i + 1][j + 1]:
                i, j = i + 1, j + 1
            elif on_a:
                j += 1
            else:
                i += 1
        elif best[i + 1][j] >= best[i][j + 1]:
            if last_i != i:
                pending.append(a[i])
            i += 1
        else:
            if last_j != j:
                pending.append(b[j])
            j += 1
    rest_a = a[i + (last_i == i) :]
    rest_b = b[j + (last_j == j) :]
    return out + pending + rest_a + rest_b


def fold(items: list[list], pages: int) -> list[list]:
    """``items`` with repeated groups where tokens come again and nothing fixed stands between."""
    times: dict[str, int] = {}
    for x in items:
        for k in _keys(x):
            times[k] = times.get(k, 0) + 1
    out: list[list] = []
    segment: list[list] = []

    def close() -> None:
        first, last = {}, {}
        for at, x in enumerate(segment):
            for k in _keys(x):
                first.setdefault(k, at)
                last[k] = at
        at = 0
        while at < len(segment):
            end = max(last[k] for k in _keys(segment[at]))
            if end == at:
                out.append(segment[at])
                at += 1
                continue
            g, stop = segment[at], at
            while stop < end:
                stop += 1
                g = _grouped(g, segment[stop], min(pages, max(g[1], segment[stop][1])))
                end = max(end, *(last[k] for k in _keys(segment[stop])))
            out.append(g)
            at = end + 1
        segment.clear()

    for x in items:
        if not x[2] and x[0] != GROUP and times[x[0]] == 1 and x[1] >= FIXED * pages:
            close()
            out.append(x)
        else:
            segment.append(x)
    close()
    return [_inside(x) for x in out]


def _inside(x: list) -> list:
    if x[0] == GROUP:
        return [GROUP, x[1], True, [_inside(m) for m in x[3]]]
    return x if x[3] is None else [x[0], x[1], x[2], fold(x[3], x[1])]


def _longest(items: list[list]) -> int:
    return max([len(items), *(_longest(x[3]) for x in items if x[3])], default=0)


def times(items: list[list], n: int) -> list[list]:
    """The wrapper of ``n`` equal pages."""
    return items if n == 1 else [[k, p * n, many, None if inner is None else times(inner, n)] for k, p, many, inner in items]


def infer(parts: Iterable[tuple[list[list], int]]) -> tuple[list[list], int]:
    """(wrapper, pages) of (stream or wrapper, its pages), aligned one after the other."""
    whole, pages = [], 0
    for items, n in parts:
        if _longest(items) > LONG_PAGE:  # else alignment would take the square of a page's length
            items = fold(items, n)
        whole = merge(whole, items)
        pages += n
        if pages >= EARLY and _longest(whole) > LONG_LIST:
            whole = fold(whole, pages)
    return fold(whole, pages), pages


def show(items: list[list], pages: int) -> str:
    """The wrapper as a regular expression over tokens, for reading: ``(p? ul>[li+]?)+``."""
    parts = []
    for key, n, many, inner in items:
        text = f"({show(inner, n)})" if key == GROUP else key + (f"[{show(inner, n)}]" if inner is not None else "")
        parts.append(text + ("+" if many else "") + ("?" if n < pages else ""))
    return " ".join(parts)


def leaves(items: list[list], prefix: str = "") -> Iterable[tuple[str, list]]:
    """(path, item) of the tokens of lines, in order."""
    for x in items:
        if x[0] == GROUP:
            yield from leaves(x[3], prefix)
        elif x[3] is None:
            yield prefix + x[0], x
        else:
            yield from leaves(x[3], prefix + x[0])


def _find(items: list[list], path: str, prefix: str = "") -> tuple[str, list[list], list[int]] | None:
    """(prefix, list, places in it) of the list that holds the token of ``path``, the one of most pages."""
    own = [at for at, x in enumerate(items) if any(m[3] is None and prefix + m[0] == path for m in (x[3] if x[0] == GROUP else [x]))]
    if own:
        return prefix, items, own
    found = None
    for x in items:
        for m in x[3] if x[0] == GROUP else [x]:
            if m[3] is not None and path.startswith(prefix + m[0]):
                got = _find(m[3], path, prefix + m[0])
                if got and (found is None or got[1][got[2][0]][1] > found[1][found[2][0]][1]):
                    found = got
    return found


def _varies(text: tuple[int, ...] | None) -> bool:
    return text is not None and (text[3] != text[4] or text[0] < 3)


def roles(items: list[list], pages: int, texts: dict[str, tuple[int, int, int, int, int]]) -> dict:
    """What each path of a host is, and between which fixed tokens its main lists stand.

    ``texts`` holds the lines, running lines and words of different running texts of each path, and the least and largest hash
    of its lines: a path of one text only is no slot. Result: ``lists`` (prefix of the paths, fixed token before, fixed token
    behind) and ``paths`` (path: slot, paragraph, matter or headline)."""
    words = {p: t[2] for p, t in texts.items() if t[2]}
    most = max(words.values(), default=0)
    heading = lambda p, x: _tag(p) in HEADINGS and not x[2] and 2 * x[1] >= pages and _varies(texts.get(p))
    headline = next((p for p, x in leaves(items) if heading(p, x)), "")
    lists: list[tuple[str, str, str]] = []
    for path in sorted(words, key=lambda p: (-words[p], p)):
        if words[path] < MAIN_SHARE * most or lists and pages == 1:
            break
        if any(path.startswith(x[0]) for x in lists):
            continue
        got = _find(items, path)
        if got is None:
            continue
        prefix, inner, own = got
        inner_pages = max(x[1] for x in inner)

        def solid(x: list, prefix: str = prefix, least: float = FIXED * inner_pages) -> bool:
            """Fixed, no content by itself, and not itself full of text."""
            if x[2] or x[0] == GROUP or x[1] < least:
                return False
            inside = [prefix + x[0]] if x[3] is None else [p for p, _ in leaves(x[3], prefix + x[0])]
            return sum(words.get(p, 0) for p in inside) < MAIN_SHARE * most and not all(_tag(p) in CONTENT for p in inside)

        repeated = [at for at in own if inner[at][2]] or own
        before = next((prefix + inner[k][0] for k in range(repeated[0] - 1, -1, -1) if solid(inner[k])), "")
        behind = next((prefix + inner[k][0] for k in range(repeated[-1] + 1, len(inner)) if solid(inner[k])), "")
        if any(prefix + x[0] == headline for x in inner[: own[-1]]):
            before = headline
        lists.append((prefix, before, behind))
    paths: dict[str, str] = {}
    for path, text in texts.items():
        lines, running = text[:2]
        within = any(path.startswith(x[0]) for x in lists) and _varies(text)
        if within and _tag(path) in CONTENT:
            paths[path] = SLOT
        elif within and running and running >= RUNNING_SHARE * lines:
            paths[path] = PARAGRAPH
        else:
            paths[path] = MATTER
    if headline:
        paths[headline] = HEADLINE
    return {"lists": lists, "paths": paths}


def _tag(path: str) -> str:
    return path[path.rfind(">") + 1 :]
