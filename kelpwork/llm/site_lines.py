"""Lines that one site repeats in many of its documents.

Every line is reduced to a normal form (lower case, no digits, runs of white space as one space,
none at the ends), the distinct documents of each (site, line) are counted, and lines found in
enough documents of their site are removed: in ``min_documents`` at least, and in ``min_share`` of the site's documents.

Scale: texts are normalised once, as a whole, and only the hashes of their lines are kept, in the checkpoint folder, for the count and
for the join. The lines of one row are made distinct inside it. The (site, line, document) rows are made distinct over all
three, so that a line that stands in a third of all documents is spread over all tasks; then they are counted by partial
aggregates, and that line arrives as one row per task. The frequent (site, line) keys are joined back
by a left-semi join on two 64-bit hashes; adaptive execution broadcasts the keys only if their measured
size is small and splits skewed partitions otherwise. Texts are never shuffled.

Cases: null ``raw_content`` has no lines; a null site forms no site, its lines are never frequent;
lines that are empty in normal form (blank, digits only) are lines like any other, unless ``keep_blank``
asks to keep them; repeated document ids are counted once, rows without id not at all; extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpwork.sources.tables import cut, table

MIN_DOCUMENTS = 8
#: White space within a line as Unicode has it (Java's \s alone is ASCII).
BLANKS = r"[ \t\x{0B}-\r\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def normal_lines(text: Column) -> Column:
    """The lines of a text in lower case without the digits 0-9, each run of white space one space, none at the ends."""
    spaced = F.regexp_replace(F.regexp_replace(F.lower(text), "[0-9]+", ""), BLANKS, " ")
    bare = F.replace(F.replace(spaced, F.lit(" \n"), F.lit("\n")), F.lit("\n "), F.lit("\n"))
    return F.split(F.trim(bare), "\n", -1)


def hashed_lines(documents: DataFrame, doc: str = "doc_id", site: str = "domain", text: str = "raw_content") -> DataFrame:
    """(doc_id, site, lines): one row per document with the hash pair of every line in order, computed once and kept."""
    pair = F.transform(normal_lines(F.col(text)), lambda x: F.struct(F.xxhash64(x).alias("h"), F.hash(x).alias("g")))
    return cut(documents.select(F.col(doc).alias("doc_id"), F.col(site).alias("site"), pair.alias("lines")).where(F.col("site").isNotNull() & F.col("lines").isNotNull()))


def frequent_lines(documents: DataFrame, min_documents: int = MIN_DOCUMENTS, doc: str = "doc_id", site: str = "domain", text: str = "raw_content", keep_blank: bool = False, min_share: float = 0.0) -> DataFrame:
    """(doc_id, line_no) of every line that stands in at least ``min_documents`` documents of its site, and in at least
    ``min_share`` of them."""
    rows = hashed_lines(documents, doc, site, text)
    keys = rows.select("doc_id", "site", F.explode(F.array_distinct("lines")).alias("l"))
    counted = keys.groupBy("site", "l.h", "l.g").agg(F.count_distinct("doc_id").alias("n"))
    often = counted.where((F.col("n") >= min_documents) & (F.col("h") != F.xxhash64(F.lit("")) if keep_blank else F.lit(True)))
    if min_share > 0:
        often = often.join(rows.groupBy("site").agg(F.count_distinct("doc_id").alias("whole")), "site").where(F.col("n") >= min_share * F.col("whole"))
    placed = rows.select("doc_id", "site", F.posexplode("lines").alias("at", "l")).select("doc_id", "site", "l.h", "l.g", (F.col("at") + 1).alias("line_no"))
    return placed.join(often.select("site", "h", "g"), ["site", "h", "g"], "left_semi").select("doc_id", "line_no")


def without_frequent_lines(documents: DataFrame, min_documents: int = MIN_DOCUMENTS, doc: str = "doc_id", site: str = "domain", text: str = "raw_content", keep_blank: bool = False, min_share: float = 0.0) -> DataFrame:
    """(doc_id, clean, removed): each document rebuilt in line order without its frequent lines.

    Only line numbers travel to the documents; a document without such lines keeps its text, a null
    text stays null.
    """
    found = frequent_lines(documents, min_documents, doc, site, text, keep_blank, min_share).groupBy("doc_id").agg(F.collect_set("line_no").alias("out"))
    base = documents.select(F.col(doc).alias("doc_id"), F.col(text).alias("whole"))
    joined = base.join(found, "doc_id", "left")
    kept = F.array_join(F.filter(F.split("whole", "\n", -1), lambda x, i: ~F.array_contains("out", i + 1)), "\n")
    return joined.select("doc_id", F.when(F.col("out").isNull(), F.col("whole")).otherwise(kept).alias("clean"), F.coalesce(F.size("out"), F.lit(0)).alias("removed"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frequent_lines(table(spark, sf_dir, "documents"))


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_frequent_lines(table(spark, sf_dir, "documents"))


_SQL_LINES = r"""
WITH lines AS (
  SELECT doc_id, domain, raw_content, unnest(string_split(raw_content, chr(10))) AS line,
         generate_subscripts(string_split(raw_content, chr(10)), 1) AS line_no
  FROM documents WHERE raw_content IS NOT NULL AND domain IS NOT NULL),
normal AS (
  SELECT doc_id, domain, line, line_no,
         trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '', 'g'),
              '[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')) AS k
  FROM lines),
often AS (SELECT domain, k FROM normal GROUP BY domain, k HAVING count(DISTINCT doc_id) >= 8),
marked AS (SELECT n.*, o.k IS NOT NULL AS hit FROM normal n LEFT JOIN often o ON n.domain = o.domain AND n.k = o.k)
"""
SQL = {
    "p6_found": _SQL_LINES + "SELECT doc_id, CAST(line_no AS INTEGER) AS line_no FROM marked WHERE hit",
    "p6_clean": _SQL_LINES
    + """SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT hit), '') AS clean,
       CAST(count(*) FILTER (WHERE hit) AS INTEGER) AS removed FROM marked GROUP BY doc_id""",
}
QUERIES = {"p6_found": p6_found, "p6_clean": p6_clean}
