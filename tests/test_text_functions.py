import re

import pytest
from pyspark.sql import functions as F

from kelpwork.functions import chunking, facts, markup, terms, vectors
from kelpwork.functions import models as P
from kelpwork.functions import text as T


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_text_columns(spark):
    lit = F.lit
    assert one(spark, T.plain_text(lit(" a\n b\t c "))) == "a b c"
    assert one(spark, T.plain_text(lit("abcdef"), 3)) == "abc..."
    assert one(spark, T.word_count(lit("  a b\n\nc "))) == 3
    assert one(spark, T.stop_word_language(lit("the cat and the dog"))) == "en"
    assert one(spark, T.stop_word_language(lit("der Hund und die Katze"))) == "de"
    assert one(spark, T.stop_word_language(lit("the der"))) is None
    assert one(spark, T.token_estimate(lit("abcde"))) == 2
    assert one(spark, T.host(lit("https://Docs.Example/x"))) == "docs.example"
    assert one(spark, T.path_excluded(lit("https://a.b/blog/x"), ["/blog"])) is True
    assert one(spark, T.path_excluded(lit("https://a.b"), ["/"])) is True
    assert one(spark, T.path_excluded(lit("nonsense"), ["/blog"])) is False
    assert one(spark, T.path_excluded(lit("https://a.b/x.y"), ["/x.y"])) is True
    assert one(spark, T.path_excluded(lit("https://a.b/xzy"), ["/x.y"])) is False


@pytest.mark.parametrize("text", ["", "a", "hello world", "ümlaut 😀", "x" * 5000])
def test_rolling_hash(spark, text):
    h = 0
    units = [int.from_bytes(text.encode("utf-16-le")[i : i + 2], "little") for i in range(0, 2 * len(text.encode("utf-16-le")) // 2, 2)]
    for u in units:
        h = (31 * h + u) & 0xFFFFFFFF
    h = h - (1 << 32) if h >= 1 << 31 else h
    assert one(spark, T.rolling_hash(F.lit(text))) == f"{abs(h):08x}-{len(units):x}"


@pytest.mark.parametrize(("text", "refuses"), [
    ("The context doesn't contain that.", True), ("I don't have enough information to answer.", True), ("Das ist nicht direkt im bereitgestellten Text zu finden.", True),
    ("Es ist nicht möglich.", True), ("The limit is 5.", False), ("There is no additional data to show.", False),
])
def test_refusals(spark, text, refuses):
    assert one(spark, T.is_refusal(F.lit(text))) is refuses


def test_vectors(spark):
    arr = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    assert one(spark, vectors.cosine(arr(1, 0), arr(1, 1))) == pytest.approx(0.7071, abs=1e-4)
    assert one(spark, vectors.cosine(arr(0, 0), arr(1, 1))) == 0
    assert one(spark, vectors.cosine(arr(1), arr(1, 1), strict=False)) == 0
    with pytest.raises(Exception, match="lengths"):
        one(spark, vectors.cosine(arr(1), arr(1, 1)))
    m = lambda **k: F.create_map(*(x for a, b in k.items() for x in (F.lit(a), F.lit(float(b)))))
    assert one(spark, vectors.weighted_jaccard(m(a=1, b=2), m(b=1, c=1))) == pytest.approx(1 / 4)
    assert one(spark, vectors.weighted_jaccard(m(a=1), m(b=1))) == 0
    assert one(spark, vectors.weighted_jaccard(F.lit(None).cast("map<string,double>"), m(b=1))) == 0


@pytest.mark.parametrize(("word", "stem"), [("caresses", "caress"), ("ponies", "poni"), ("relational", "relat"), ("hopping", "hop"), ("hoping", "hope"), ("agreed", "agre"), ("generalization", "gener"), ("adoption", "adopt"), ("sky", "sky"), ("happy", "happi"), ("controlling", "control")])
def test_porter(word, stem):
    assert terms.porter(word) == stem


def test_sparse_weights():
    w = terms.weigh(["a", "a", "b"])
    assert 0 < w["b"] < w["a"] <= 1
    assert terms.weigh([]) == {}
    assert terms.stems("The running of the dogs, at it") == ["run", "dog"]


def test_models(spark):
    v = P.hashed_words(["alpha beta", ""], 8)
    assert v[0] @ v[0] == pytest.approx(1) and not v[1].any()
    assert list(P.fitted(v[0], 10)[8:]) == [0, 0] and len(P.fitted(v[0], 4)) == 4

    def fails(texts):
        if "bad" in texts:
            raise ValueError
        return [t.upper() for t in texts]

    df = spark.createDataFrame([("a",), ("bad",)], "t string").coalesce(1)
    assert [r[0] for r in df.select(P.generate(F.col("t"), fails)).collect()] == ["A", "[Generation failed]"]
    assert one(spark, P.summary(F.lit("abc"))) == "abc..."


PAGE = """<html><head><title>Doc</title></head><body><nav>menu</nav><article><h1>Big <b>Title</b></h1><p>One <em>two</em>three.<p>Second
paragraph with enough words to be an article of more than one hundred characters, so that it is chosen.
<ul><li>first<li>second</ul><table><tr><th>a<th>b|c<tr><td>1</table><pre><code class="language-py">x = 1
y = 2</code></pre><div class="ads">buy</div></article><footer>end</footer></body></html>"""


def test_markup():
    title, md, text = markup.extracted(PAGE)
    assert title == "Big Title"
    assert md.startswith("# Big **Title**")
    assert "*two* three." in md and "- first\n- second" in md and "| a | b\\|c |\n| --- | --- |\n| 1 |   |" in md and "```py\nx = 1\ny = 2\n```" in md
    assert "menu" not in text and "buy" not in text and "end" not in text
    assert markup.extracted(None) == (None, None, None)
    assert markup.extracted("") == (None, "", "")
    assert markup.extracted("<p>cut off <b>here")[2] == "cut off here"


def test_spaced_tags(spark):
    assert one(spark, markup.spaced_tags(F.lit("<b>a</b>c <i>d</i>, <b>x</b><i>y</i>"))) == "<b>a</b> c <i>d</i>, <b>x</b> <i>y</i>"


def test_chunks_cover_and_are_bounded():
    body = "\n\n".join(f"Paragraph {i} " + "word " * 60 + "end." for i in range(40))
    chunks = chunking.chunked("# Head\n\n" + body)
    assert len(chunks) > 3 and chunks[0]["section_title"] == "Head"
    assert all(c["token_count"] <= chunking.MOST + chunking.TAIL // 4 + 120 for c in chunks)
    for i in range(40):
        assert any(f"Paragraph {i} " in c["content"] for c in chunks)
    assert chunking.chunked(None) == [] == chunking.chunked("short")
    windows = chunking.windows("x" * 5000)
    assert "".join(t for t, _ in windows) == "x" * 5000  # a hard cut does not overlap


def test_tables_are_split_with_header():
    table = "| a | b |\n| --- | --- |\n" + "\n".join(f"| {i} | {'v' * 40} |" for i in range(200))
    chunks = chunking.chunked("Text before the table, long enough to be kept as a chunk of its own.\n\n" + table)
    tables = [c for c in chunks if c["chunk_type"] == "table"]
    assert len(tables) > 1 and all(c["content"].startswith("| a | b |\n| --- | --- |") for c in tables)
    assert sum(c["content"].count("\n| ") - 1 for c in tables) == 200
    odd = chunking.split_table("| h |\n| x |\n" + "\n".join("| row " + "y" * 90 + " |" for _ in range(60)))
    assert odd[0].count("| x |") == 2 and odd[1].startswith("| h |\n| x |")


MARKDOWN = """# Setup

The server is a tool. It uses `port_number` 8080 and Alpha Beta. Maybe it fails. Is it on? Am 3. Mai 2024 wurde es geändert.

Features:
- supports up to 200 pages
- tiny

Run the installer with this command

```sh
install --everything --now please
```
"""


def test_facts(spark):
    raw = facts.raw_facts(MARKDOWN)
    assert any(f["content"] == "Am 3. Mai 2024 wurde es geändert." for f in raw)
    assert [f["content"] for f in raw if f["kind"] == "list"] == ["supports up to 200 pages"]
    assert [f["content"] for f in raw if f["kind"] == "code"] == ["Run the installer with this command"]
    df = spark.createDataFrame([(1, MARKDOWN), (2, None), (3, "")], "doc_id bigint, markdown string")
    found = {r["content"]: r for r in facts.extract_facts(df, least=0.3).collect()}
    assert found["The server is a tool."]["heading"] == "Setup"
    assert "port_number" in found["It uses `port_number` 8080 and Alpha Beta."]["entities"]
    assert not any(re.search("Maybe|Is it on", c) for c in found)
    assert found["Run the installer with this command"]["category"] == "PROC"
