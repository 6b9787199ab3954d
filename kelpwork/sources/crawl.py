"""Pages and sitemaps: fetching is a pluggable function, everything else works on stored text."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kelpwork.sources.tables import cut

#: Fetches one URL: (final url, status, body). No network by default.
Fetch = Callable[[str], tuple[str, int, str]]


class TokenBucket:
    """At most ``most`` permits each ``seconds``, refilled continuously. One bucket serves one Python worker."""

    def __init__(self, most: int, seconds: float = 1.0, clock: Callable[[], float] = time.monotonic):
        self.most, self.rate, self.clock = most, most / seconds, clock
        self.held, self.seen, self.lock = float(most), clock(), threading.Lock()

    def wait_time(self) -> float:
        now = self.clock()
        self.held = min(self.most, self.held + (now - self.seen) * self.rate)
        self.seen = now
        return 0.0 if self.held >= 1 else (1 - self.held) / self.rate

    def try_acquire(self) -> bool:
        with self.lock:
            if self.wait_time() > 0:
                return False
            self.held -= 1
            return True

    def acquire(self, sleep: Callable[[float], None] = time.sleep) -> None:
        while not self.try_acquire():
            sleep(self.wait_time())


def fetched(urls: DataFrame, fetch: Fetch, per_second: int = 2, url: str = "url") -> DataFrame:
    """(url, final_url, status, body, error): one row a URL, an error isolated in its row; each task keeps to its rate."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket = TokenBucket(per_second)
        for pdf in batches:
            rows = []
            for u in pdf["url"]:
                bucket.acquire()
                try:
                    rows.append((u, *fetch(u), None))
                except Exception as e:
                    rows.append((u, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["url", "final_url", "status", "body", "error"])

    return urls.select(F.col(url).alias("url")).mapInPandas(run, "url string, final_url string, status int, body string, error string")


def _tag(block: Column, name: str) -> Column:
    return F.nullif(F.trim(F.regexp_extract(block, rf"(?is)<{name}[^>]*>\s*(.*?)\s*</{name}>", 1)), F.lit(""))


def sitemap_entries(sitemaps: DataFrame, url: str = "url", xml: str = "xml") -> DataFrame:
    """(url, place, is_index, loc, lastmod, priority) in document order: the child sitemaps of an index only, else the pages;
    blocks without a location are dropped."""
    index = F.col(xml).rlike("(?i)<sitemapindex")
    blocks = F.when(index, F.regexp_extract_all(xml, F.lit(r"(?is)<sitemap(?:\s[^>]*)?>(.*?)</sitemap>"), 1)).otherwise(F.regexp_extract_all(xml, F.lit(r"(?is)<url(?:\s[^>]*)?>(.*?)</url>"), 1))
    rows = sitemaps.select(F.col(url).alias("url"), index.alias("is_index"), F.posexplode(blocks).alias("place", "block"))
    return rows.select("url", "place", "is_index", _tag(F.col("block"), "loc").alias("loc"), _tag(F.col("block"), "lastmod").alias("lastmod"), _tag(F.col("block"), "priority").try_cast("double").alias("priority")).where("loc IS NOT NULL")


def deep_entries(sitemaps: DataFrame, root: str, also_named: bool = False) -> DataFrame:
    """(loc, lastmod, priority, depth) of all pages below ``root``, level by level; a sitemap is read once, so cycles end.
    ``also_named``: locations that end in .xml or hold "sitemap" are read as sitemaps too."""
    entries = cut(sitemap_entries(sitemaps))
    named = F.col("loc").endswith(".xml") | F.contains("loc", F.lit("sitemap"))
    child = F.col("is_index") | (named if also_named else F.lit(False))
    front = sitemaps.select("url").where(F.col("url") == root)
    seen = front
    pages = None
    for depth in count():
        level = front.join(entries, "url")
        found = level.where(~child).select("loc", "lastmod", "priority", F.lit(depth).alias("depth"))
        pages = found if pages is None else pages.unionByName(found)
        front = cut(level.where(child).select(F.col("loc").alias("url")).distinct().join(seen, "url", "left_anti"))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return pages.groupBy("loc").agg(F.min(F.struct("depth", "lastmod", "priority")).alias("p")).select("loc", "p.lastmod", "p.priority", "p.depth")


def robots_sitemaps(robots: DataFrame, text: str = "text") -> DataFrame:
    """``robots`` with the distinct sitemap lines in order."""
    return robots.withColumn("sitemaps", F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), 1), lambda x: F.trim(x))))


# Where sitemaps usually stand, in the order of asking.
USUAL_PLACES = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap/sitemap.xml", "/sitemaps/sitemap.xml")


def discovered_sitemaps(sites: DataFrame, probe: Fetch, per_second: int = 2, origin: str = "origin", text: str = "text") -> DataFrame:
    """(origin, sitemaps): the sitemap lines of each site's robots file, or else the first of the usual places that answers ``probe``
    with a status of 200 to 299; none is an empty list. A place that fails is passed over."""
    named = robots_sitemaps(sites.select(F.col(origin).alias("origin"), F.coalesce(text, F.lit("")).alias("text"))).select("origin", "sitemaps")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bucket = TokenBucket(per_second)

        def answers(url: str) -> bool:
            bucket.acquire()
            try:
                return 200 <= probe(url)[1] < 300
            except Exception:
                return False

        for pdf in batches:
            places = [list(old) if len(old) else [x for x in (next((o + p for p in USUAL_PLACES if answers(o + p)), None),) if x] for o, old in zip(pdf["origin"], pdf["sitemaps"])]
            yield pd.DataFrame({"origin": pdf["origin"], "sitemaps": pd.Series(places, dtype=object)})

    return named.mapInPandas(run, "origin string, sitemaps array<string>")
