"""Mixing sources to target weights, by entropy balancing.

Sizes are tokens of a public tokenizer. Of all rates w between 0 and the source's most repeats M, those that
give each source its tokens b and lie nearest to "every document once" (least relative entropy) are
w = min(M, exp(lambda t)) with one lambda a source and t the document's tokens over the source's mean. The
lambdas maximise the concave dual, whose gradient is tokens at the rates less b; Newton steps, kept in
a shrinking bracket, find its root. The rates are then rounded into copies: the fractions are laid end to end in
order of size and every crossing of a whole number gives one copy, so a source's tokens miss their target by
about one document a bucket.

The total is the one asked for, or the largest that uses no more tokens than there are; in both cases it is cut to what every
source can reach within its most repeats, and ``shares`` reports what was wanted and how much is missing. A target source without tokens cannot be reached: it is reported with 0 and the other sources
keep their proportions. Documents without source, without tokens or of a source without target add nothing.

Scale: token counts are a map; they are reduced to a histogram (source, tokens) by partial aggregation, and each
Newton step is one small distributed aggregate over it. What comes to the driver is one row a target source.
Rounding runs in windows over (source, bucket) of about ``BUCKET`` documents each, so a source with a third of
all rows is many tasks.

Cases: repeated document ids count once, as the row of the least source and size; sources with a null or non-positive share or repeats get no copies; empty
documents or targets give no copies; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kelpwork.llm.byte_pairs import NAME, TOKENIZERS, encode
from kelpwork.sources.tables import cut, table

BUCKET, STEPS, CLOSE = 20_000, 60, 1e-10


def token_counts(documents: DataFrame, doc: str = "doc_id", source: str = "source", text: str = "text", folder: str = TOKENIZERS, name: str = NAME) -> DataFrame:
    """(doc_id, source, n_tokens), one row a document."""
    rows = documents.select(F.col(doc).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    counted = encode(rows, "doc_id", "text", folder, name, only_count=True, keep=("source",))
    return counted.groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("r")).select("doc_id", "r.source", "r.n_tokens")


def _rate(lam, most, x):
    return F.least(F.exp(lam * x), most.cast("double"))


def solve(counts: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> list[dict]:
    """For each target source: share, repeats, documents, tokens, asked and wanted tokens, mean size and lambda (null: all at
    the most repeats; wanted 0: none). What is wanted is less than what is asked for where the scarcest source binds."""
    goal = targets.where("source IS NOT NULL AND target_share > 0 AND max_repeats > 0").select("source", F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("most")).dropDuplicates(["source"])
    histogram = cut(counts.where("n_tokens > 0").groupBy("source", "n_tokens").agg(F.count(F.lit(1)).alias("n")))
    sums = histogram.groupBy("source").agg(F.sum("n").alias("documents"), F.sum(F.col("n") * F.col("n_tokens")).alias("tokens"))
    found = [r.asDict() for r in goal.join(sums, "source", "left").fillna(0, ["documents", "tokens"]).orderBy("source").collect()]
    live = [s for s in found if s["tokens"] > 0]
    whole = sum(s["share"] for s in live)
    asked = sum(s["tokens"] for s in live) if total_tokens is None else float(total_tokens)
    total = min([asked, *(s["most"] * s["tokens"] * whole / s["share"] for s in live)], default=0)
    for s in found:
        s |= {"asked": asked * s["share"] / sum(x["share"] for x in found), "wanted": total * s["share"] / whole if s in live else 0.0, "mean": s["tokens"] / max(s["documents"], 1), "lam": None}
    open_ = [s for s in live if s["wanted"] < s["most"] * s["tokens"] * (1 - 1e-12)]
    for s in open_:
        s |= {"lam": 0.0, "low": -math.inf, "high": math.inf}
    spark = counts.sparkSession
    pending = list(open_)
    for _ in range(STEPS):
        if not pending:
            break
        now = spark.createDataFrame([(s["source"], s["lam"], s["most"], s["mean"]) for s in pending], "source string, lam double, most int, mean double")
        x = F.col("n_tokens") / F.col("mean")
        w = _rate(F.col("lam"), F.col("most"), x)
        mass = F.col("n") * F.col("n_tokens") * w
        step = histogram.join(F.broadcast(now), "source").groupBy("source").agg(F.sum(mass).alias("at"), F.sum(F.when(w < F.col("most"), mass * x).otherwise(0.0)).alias("slope"))
        by = {r["source"]: r for r in step.collect()}
        for s in pending:
            gap, slope = by[s["source"]]["at"] - s["wanted"], by[s["source"]]["slope"]
            s["gap"] = abs(gap) / s["wanted"]
            s["low" if gap < 0 else "high"] = s["lam"]
            new = s["lam"] - max(-2.0, min(2.0, gap / slope)) if slope > 0 else math.nan
            if not s["low"] < new < s["high"]:
                new = (s["low"] + s["high"]) / 2 if math.isfinite(s["low"] + s["high"]) else s["lam"] + (1.0 if gap < 0 else -1.0)
            if s["gap"] > CLOSE:
                s["lam"] = new
        pending = [s for s in pending if s["gap"] > CLOSE]
    return found


def mix(counts: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> tuple[DataFrame, list[dict]]:
    """((doc_id, source, n_tokens, rate, copies) of every document, what ``solve`` found). ``total_tokens``: the size of the mix, else
    that of all documents."""
    counts = cut(counts)
    found = solve(counts, targets, total_tokens)
    rows = [(s["source"], s["lam"], s["most"], s["mean"], s["wanted"], max(1, -(-s["documents"] // BUCKET))) for s in found]
    plan = counts.sparkSession.createDataFrame(rows, "source string, lam double, most int, mean double, wanted double, buckets long")
    rate = F.when((F.col("n_tokens") > 0) & (F.col("wanted") > 0), F.when(F.col("lam").isNull(), F.col("most").cast("double")).otherwise(_rate(F.col("lam"), F.col("most"), F.col("n_tokens") / F.col("mean")))).otherwise(0.0)
    rated = counts.join(F.broadcast(plan), "source", "left").withColumn("rate", F.coalesce(rate, F.lit(0.0)))
    live = rated.where("rate > 0").withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.col("buckets")))
    order = W.partitionBy("source", "bucket").orderBy("n_tokens", "doc_id").rowsBetween(W.unboundedPreceding, W.currentRow)
    part = F.col("rate") - F.floor("rate")
    shift = F.pmod(F.xxhash64(F.lit("kelpwork"), "source", "bucket"), F.lit(1 << 20)) / float(1 << 20)
    up_to = F.sum(part).over(order) + shift
    copies = (F.floor("rate") + F.floor(F.col("up_to") + 1e-9) - F.floor(F.col("up_to") - part + 1e-9)).cast("int")
    live = live.withColumn("up_to", up_to).withColumn("copies", F.least(copies, F.col("most")))
    columns = ["doc_id", "source", "n_tokens", "rate", "copies"]
    return live.select(columns).unionByName(rated.where("NOT rate > 0").withColumn("copies", F.lit(0)).select(columns)), found


def shares(mixed: DataFrame, targets: DataFrame, found: list[dict] | None = None) -> DataFrame:
    """Per target source: the share wanted and reached, in tokens; with what ``solve`` found also the tokens asked for and those by
    which the mix falls short of them."""
    got = mixed.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"), F.count(F.lit(1)).alias("documents"))
    rows = targets.select("source", "target_share", "max_repeats").join(got, "source", "left").fillna(0, ["tokens", "copies", "most_copies", "documents"])
    total = F.sum("tokens").over(W.partitionBy(F.lit(1)))  # one row a target source
    columns = ["source", "target_share", "max_repeats", "documents", "copies", "most_copies", "tokens", F.round(F.try_divide(F.col("tokens"), total), 6).alias("reached_share")]
    if found is None:
        return rows.select(*columns)
    asked = mixed.sparkSession.createDataFrame([(s["source"], float(s["asked"])) for s in found], "source string, asked_tokens double")
    short = F.round(F.greatest(F.col("asked_tokens") - F.col("tokens"), F.lit(0.0)), 3).alias("missing_tokens")
    return rows.join(asked, "source", "left").select(*columns, F.round("asked_tokens", 3).alias("asked_tokens"), short)


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, _ = mix(token_counts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))
    return mixed.select("doc_id", "source", "n_tokens", F.round("rate", 6).alias("rate"), "copies")


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    targets = table(spark, sf_dir, "mix_targets")
    mixed, found = mix(token_counts(table(spark, sf_dir, "documents")), targets)
    return shares(mixed, targets, found)


def p8_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each target source: no document is used more often than allowed, and the tokens lie within two documents a bucket of
    the share of the whole mix."""
    targets = table(spark, sf_dir, "mix_targets")
    mixed, found = mix(token_counts(table(spark, sf_dir, "documents")), targets)
    largest = mixed.groupBy("source").agg(F.max("n_tokens").alias("largest"))
    rows = shares(mixed, targets).join(largest, "source", "left")
    whole = F.sum("tokens").over(W.partitionBy(F.lit(1)))  # one row a target source
    buckets = F.ceil(F.col("documents") / BUCKET)
    near = F.abs(F.col("tokens") - F.col("target_share") * whole) <= 2 * F.col("largest") * buckets + F.col("target_share") * 2 * F.sum("largest").over(W.partitionBy(F.lit(1)))
    return rows.select("source", (F.col("most_copies") <= F.col("max_repeats")).alias("within_repeats"), near.alias("near_share"))


SQL = {"p8_invariants": "SELECT source, true AS within_repeats, true AS near_share FROM mix_targets"}
QUERIES = {"p8_mix": p8_mix, "p8_shares": p8_shares, "p8_invariants": p8_invariants}
