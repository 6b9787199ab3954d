"""Queries over vectors and retrieval (F, G, H)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kelpwork.functions import models, terms, vectors
from kelpwork.functions import text as T
from kelpwork.operators import ingest
from kelpwork.operators import retrieval as R
from kelpwork.operators.evaluation import FETCH
from kelpwork.plans import inputs as I
from kelpwork.plans.inputs import CHUNKS, FACTS, SUMMARIES

QUERIES: dict = {}
SQL: dict[str, str] = {}
K = 5


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


_NEXT = f"""WITH {CHUNKS}, p AS (SELECT a.id, a.dense_embedding AS x, b.dense_embedding AS y, a.sparse_vector AS s, b.sparse_vector AS t FROM chunks a JOIN chunks b ON a.document_id = b.document_id AND b.chunk_index = a.chunk_index + 1) """


def _next(s: SparkSession, d: str) -> DataFrame:
    c = I.chunks(s, d)
    b = c.select("document_id", (F.col("chunk_index") - 1).alias("chunk_index"), F.col("dense_embedding").alias("y"), F.col("sparse_vector").alias("t"))
    return c.select("id", "document_id", "chunk_index", F.col("dense_embedding").alias("x"), F.col("sparse_vector").alias("s")).join(b, ["document_id", "chunk_index"])


@query("F01_embed")
def f01(s, d):
    return I.queries(s, d).select("query_id", F.transform(models.embed(F.col("query_text")), lambda x: F.round(x, 6)).alias("dense"))


@query("F03_stems")
def f03(s, d):
    return I.chunks(s, d).select("id", terms.stemmed("content").alias("stems"))


# Examples of Porter's publication, each word with its stem.
_KNOWN_STEMS = "caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss failing fail filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit operator oper feudalism feudal decisiveness decis hopefulness hope triplicate triplic formative form formalize formal electrical electr hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin adjustable adjust replacement replac adoption adopt activate activ effective effect probate probat rate rate cease ceas controlling control roll roll".split()


@query("F03_known_stems", "SELECT * FROM (VALUES " + ", ".join(f"('{w}', ['{t}'])" for w, t in zip(_KNOWN_STEMS[::2], _KNOWN_STEMS[1::2])) + ") AS t(word, stems)")
def f03k(s, d):
    return s.createDataFrame([(w,) for w in _KNOWN_STEMS[::2]], "word string").select("word", terms.stemmed("word").alias("stems"))


@query("F05_known_weights", f"WITH {CHUNKS}, t AS (SELECT id, unnest(['gatewai', 'archiv', 'number' || id]) AS term, unnest([3, 2, 1]) AS n, 6 AS len FROM chunks) SELECT id, term, round(n / (n + 1.5 * (0.25 + 0.75 * len / 200)), 6) AS weight FROM t")
def f05k(s, d):
    """Six words of which stems and counts are known."""
    text = F.concat(F.lit("The gateway, gateways of the GATEWAY: archive archived number"), F.col("id").cast("string"))
    return I.chunks(s, d).select("id", F.explode(terms.sparse_vector(text)).alias("term", "weight")).select("id", "term", F.round("weight", 6).alias("weight"))


@query("F04_term_frequency")
def f04(s, d):
    words = I.chunks(s, d).select("id", F.explode(terms.stemmed("content")).alias("term"))
    return words.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("chunks"))


@query("F05_sparse_vector")
def f05(s, d):
    return I.chunks(s, d).select("id", F.explode(terms.sparse_vector("content")).alias("term", "weight")).select("id", "term", F.round("weight", 6).alias("weight"))


_SQL_COSINE = "CASE WHEN len(x) <> len(y) THEN 0.0 ELSE coalesce(CASE WHEN list_dot_product(x, x) = 0 OR list_dot_product(y, y) = 0 THEN 0.0 ELSE list_cosine_similarity(x, y) END, 0.0) END"
_USABLE_PAIR = "len(x) > 0 AND len(y) > 0"


@query("F06_cosine", _NEXT + f"SELECT id, round({_SQL_COSINE}, 6) AS cosine FROM p WHERE {_USABLE_PAIR}")
def f06(s, d):
    return _next(s, d).where("size(x) > 0 AND size(y) > 0").select("id", F.round(vectors.cosine(F.col("x"), F.col("y"), strict=False), 6).alias("cosine"))


_SQL_SHARED = "list_sum(list_transform(list_intersect(map_keys({a}), map_keys({b})), lambda k: least({a}[k], {b}[k])))"


def _sql_jaccard(a: str, b: str) -> str:
    shared = f"coalesce({_SQL_SHARED.format(a=a, b=b)}, 0)"
    whole = f"(coalesce(list_sum(map_values({a})), 0) + coalesce(list_sum(map_values({b})), 0) - {shared})"
    return f"coalesce(CASE WHEN {a} IS NULL OR {b} IS NULL THEN 0.0 WHEN {whole} > 0 THEN {shared} / {whole} END, 0.0)"


@query("F07_weighted_jaccard", _NEXT + f"SELECT id, round({_sql_jaccard('s', 't')}, 6) AS similarity FROM p")
def f07(s, d):
    return _next(s, d).select("id", F.round(vectors.weighted_jaccard(F.col("s"), F.col("t")), 6).alias("similarity"))


@query("F08_hybrid_similarity", _NEXT + f"SELECT id, round(0.7 * {_SQL_COSINE} + 0.3 * {_sql_jaccard('s', 't')}, 6) AS score FROM p WHERE {_USABLE_PAIR}")
def f08(s, d):
    both = vectors.hybrid(vectors.cosine(F.col("x"), F.col("y"), strict=False), vectors.weighted_jaccard(F.col("s"), F.col("t")))
    return _next(s, d).where("size(x) > 0 AND size(y) > 0").select("id", F.round(both, 6).alias("score"))


@query("F09_token_estimate", f"WITH {CHUNKS} SELECT id, CAST(ceil(length(content) / 4.0) AS INTEGER) AS tokens FROM chunks")
def f09(s, d):
    return I.chunks(s, d).select("id", T.token_estimate(F.col("content")).alias("tokens"))


@query("F11_fact_target", f"WITH {FACTS} SELECT f.id, CASE WHEN d.title IS NOT NULL THEN '[' || d.title || '] ' || f.content ELSE f.content END AS dense_target, coalesce(nullif(f.source_context, ''), f.content) AS sparse_target FROM facts f JOIN documents d ON f.document_id = d.doc_id")
def f11(s, d):
    f = I.facts(s, d).join(I.documents(s, d).select(F.col("doc_id").alias("document_id"), "title"), "document_id")
    return ingest.fact_targets(f, "title").select("id", "dense_target", "sparse_target")


@query("P04_summaries", f"WITH {SUMMARIES} SELECT id, summary, summary_token_count FROM summaries")
def p04(s, d):
    return I.summaries(s, d).select("id", "summary", "summary_token_count")


_ITEMS = {
    "chunk": f"{CHUNKS}, items AS (SELECT id, document_id, content, dense_embedding AS dense, sparse_vector AS sparse FROM chunks WHERE len(dense_embedding) = 64 AND list_dot_product(dense_embedding, dense_embedding) > 0)",
    "llm": f"{SUMMARIES}, items AS (SELECT id, document_id, original_content AS content, dense_embedding AS dense, sparse_vector AS sparse FROM summaries WHERE len(dense_embedding) = 64 AND list_dot_product(dense_embedding, dense_embedding) > 0)",
    "fact": f"{FACTS}, items AS (SELECT id, document_id, coalesce(nullif(source_context, ''), content) AS content, dense_embedding AS dense, NULL::MAP(VARCHAR, DOUBLE) AS sparse, upper(category) AS category, confidence FROM facts WHERE len(dense_embedding) = 64 AND list_dot_product(dense_embedding, dense_embedding) > 0)",
}


def _sql_search(pipeline: str, k: int = K, where: str = "true", alpha: float = 0.7, pool: int = 10, least: float = 0.1) -> str:
    return f"""WITH {_ITEMS[pipeline]}, live AS (SELECT * FROM items WHERE {where}), asked AS (SELECT id AS query_id, dense AS qd, sparse AS qs FROM items WHERE id % 50 = 0),
pool AS (SELECT * FROM (SELECT query_id, qs, i.*, round(list_cosine_similarity(qd, dense), 9) AS ds, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(qd, dense), 9) DESC, id) AS n FROM asked, live i) WHERE n <= {pool * k}),
scored AS (SELECT *, round({alpha} * ds + {round(1 - alpha, 9)} * {_sql_jaccard('qs', 'sparse')}, 9) AS score FROM pool),
found AS (SELECT * FROM (SELECT query_id, id, document_id, content, dense, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= {k} AND score >= {least}) """


_FOUND = "SELECT query_id, id, document_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM found"


def found(s: SparkSession, d: str, pipeline: str = "chunk", k: int = K, **more) -> DataFrame:
    return R.hybrid_search(I.asked(s, d, pipeline), I.items(s, d, pipeline), k, **more)


def _shown(df: DataFrame) -> DataFrame:
    return df.select("query_id", "id", "document_id", F.round("score", 6).alias("score"), "rank")


@query("G01_hybrid_search", _sql_search("chunk") + _FOUND)
def g01(s, d):
    return _shown(found(s, d))


@query("G02_dense_search", f"""WITH {_ITEMS['chunk']}, asked AS (SELECT id AS query_id, dense AS qd FROM items WHERE id % 50 = 0),
r AS (SELECT query_id, id, round(list_cosine_similarity(qd, dense), 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(qd, dense), 9) DESC, id) AS rank FROM asked, items)
SELECT query_id, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {K} AND score >= 0.3""")
def g02(s, d):
    r = R.dense_search(I.asked(s, d), I.items(s, d), K, 0.3)
    return r.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


def _firm():
    return (F.col("confidence") >= 0.5) & F.col("category").isin("SPEC", "DEF", "PROC")


@query("G03_fact_search")
def g03(s, d):
    """Terms are stems, which SQL does not have; the tests check it by brute force, G03_filtered_dense its dense part."""
    return _shown(found(s, d, "fact", where=_firm()))


@query("G03_filtered_dense", _sql_search("fact", where="confidence >= 0.5 AND category IN ('SPEC', 'DEF', 'PROC')", alpha=1.0) + _FOUND)
def g03d(s, d):
    return _shown(found(s, d, "fact", where=_firm(), alpha=1.0))


@query("G04_filter_then_slice", _sql_search("llm", k=10, least=0.5) + "SELECT query_id, id, document_id, content, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM found")
def g04(s, d):
    """Summaries are searched, their originals given."""
    return _shown(found(s, d, "llm", k=10, least=0.5)).join(I.items(s, d, "llm").select("id", "content"), "id")


@query("G05_search_rerank", _sql_search("chunk", k=3 * K) + f", r AS (SELECT query_id, id, document_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM found WHERE score >= 0.3) SELECT query_id, id, document_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {K}")
def g05(s, d):
    return _shown(R.reranked(found(s, d, k=3 * K), K))


def _sourced(s, d):
    docs = I.documents(s, d).select(F.col("doc_id").alias("document_id"), "url", "title")
    return found(s, d, k=10).join(I.items(s, d).select("id", "content"), "id").join(docs, "document_id", "left")


@query("G06_distinct_sources", _sql_search("chunk", k=10) + ", r AS (SELECT f.query_id, f.id, f.rank, row_number() OVER (PARTITION BY query_id, coalesce(nullif(url, ''), nullif(title, ''), nullif(content, '')) ORDER BY rank) AS n FROM found f LEFT JOIN documents d ON f.document_id = d.doc_id) SELECT query_id, id, CAST(rank AS INTEGER) AS rank FROM r WHERE n = 1")
def g06(s, d):
    return R.distinct_sources(_sourced(s, d)).select("query_id", "id", "rank")


@query("G07_snippets", _sql_search("chunk") + "SELECT query_id, id, CASE WHEN length(content) > 200 THEN substr(content, 1, 200) || '...' ELSE content END AS snippet FROM found")
def g07(s, d):
    return found(s, d).join(I.items(s, d).select("id", "content"), "id").select("query_id", "id", T.excerpt(F.col("content")).alias("snippet"))


@query("G08_context", _sql_search("chunk") + ", n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM found), c AS (SELECT query_id, string_agg('[' || i || '] ' || coalesce(content, ''), chr(10) || chr(10) ORDER BY i) AS context FROM n GROUP BY query_id) SELECT query_id, CASE WHEN length(context) > 8000 THEN substr(context, 1, 8000) || chr(10) || '[...]' ELSE context END AS context FROM c")
def g08(s, d):
    return R.context(found(s, d).join(I.items(s, d).select("id", "content"), "id"))


@query("A12_document_items", f"WITH {SUMMARIES}, {FACTS} SELECT 'chunk' AS pipeline, document_id, id, content AS shown, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, id) AS place, 1.0 AS score FROM chunks UNION ALL SELECT 'fact', document_id, id, content, row_number() OVER (PARTITION BY document_id ORDER BY fact_index, id), 1.0 FROM facts UNION ALL SELECT 'llm', document_id, id, 'Summary: ' || coalesce(summary, '') || chr(10) || chr(10) || 'Details: ' || coalesce(original_content, ''), row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, id), 1.0 FROM summaries")
def a12(s, d):
    """All items of every document, by pipeline."""
    parts = [(I.chunks(s, d), "chunk", "chunk_index", F.col("content")), (I.facts(s, d), "fact", "fact_index", F.col("content")), (I.summaries(s, d), "llm", "chunk_index", R.summary_text(F.col("summary"), F.col("original_content")))]
    shown = [R.of_documents(df.withColumn("shown", text), order).select(F.lit(name).alias("pipeline"), "document_id", "id", "shown", F.col("place").cast("bigint").alias("place"), "score") for df, name, order, text in parts]
    return shown[0].unionByName(shown[1]).unionByName(shown[2])


@query("A13_point_lookup", f"WITH {FACTS} SELECT id, content, category FROM facts WHERE id = (SELECT min(id) FROM facts)")
def a13(s, d):
    f = I.facts(s, d)
    return f.join(f.agg(F.min("id").alias("id")), "id", "left_semi").select("id", "content", "category")


_WORDS = "list_distinct(regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}]+'))".format
_OVERLAP = f"CASE WHEN len({_WORDS('q.content')}) > 0 THEN len(list_intersect({_WORDS('q.content')}, {_WORDS('f.content')})) / len({_WORDS('q.content')}) ELSE 0.0 END"


@query("H02_cross_encoder", _sql_search("chunk", k=10) + f", m AS (SELECT f.query_id, f.id, f.document_id, {_OVERLAP} AS score FROM found f JOIN items q ON q.id = f.query_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM m WHERE score >= 0.3) SELECT query_id, id, document_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= {K}")
def h02(s, d):
    f = found(s, d, k=10).join(I.items(s, d).select("id", "content"), "id")
    asked = I.items(s, d).select(F.col("id").alias("query_id"), F.col("content").alias("query"))
    return _shown(R.reranked(f.join(asked, "query_id"), K, model=models.word_overlap))


@query("H03_score_rerank", _sql_search("chunk", k=10) + ", r AS (SELECT query_id, id, document_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM found WHERE score >= 0.4) SELECT query_id, id, document_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3")
def h03(s, d):
    return _shown(R.reranked(found(s, d, k=10), 3, least=0.4))


@query("H04_rank_fusion", f"""WITH {_ITEMS['chunk']}, asked AS (SELECT id AS query_id, dense AS qd, sparse AS qs FROM items WHERE id % 50 = 0),
pool AS (SELECT * FROM (SELECT query_id, qs, i.*, round(list_cosine_similarity(qd, dense), 9) AS ds, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(qd, dense), 9) DESC, id) AS n FROM asked, items i) WHERE n <= 100),
one AS (SELECT query_id, id, ds AS score, n AS rank, document_id FROM pool WHERE n <= 10),
two AS (SELECT * FROM (SELECT query_id, id, round({_sql_jaccard('qs', 'sparse')}, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round({_sql_jaccard('qs', 'sparse')}, 9) DESC, id) AS rank, document_id FROM pool) WHERE rank <= 10)
SELECT query_id, id, round(sum(1.0 / (60 + rank)), 6) AS fused, round(max(score), 6) AS score FROM (SELECT * FROM one UNION ALL SELECT * FROM two) GROUP BY query_id, id""")
def h04(s, d):
    asked, items = I.asked(s, d), I.items(s, d)
    pool = R.dense_pool(asked, items, 100).join(items.select("id", "document_id", F.col("sparse").alias("item_sparse")), "id").join(asked.select("query_id", "sparse"), "query_id")
    one = R.best(pool.withColumnRenamed("dense_score", "score"), 10).withColumn("list_no", F.lit(0))
    two = R.best(pool.withColumn("score", F.round(vectors.weighted_jaccard(F.col("sparse"), F.col("item_sparse")), 9)), 10).withColumn("list_no", F.lit(1))
    columns = ["query_id", "id", "document_id", "score", "rank", "list_no"]
    return R.fused(one.select(columns).unionByName(two.select(columns))).select("query_id", "id", F.round("fused", 6).alias("fused"), F.round("score", 6).alias("score"))


def _sql_diverse() -> str:
    """Four greedy choices of ten, one after the other."""
    parts = ["c AS (SELECT query_id, count(*) AS c FROM found GROUP BY query_id), many AS (SELECT f.*, 0.0 AS near FROM found f JOIN c USING (query_id) WHERE c > 4)", "p1 AS (SELECT * FROM many WHERE rank = 1)"]
    for k in (2, 3, 4):
        old = "many" if k == 2 else f"s{k - 1}"
        parts.append(f"s{k} AS (SELECT s.* EXCLUDE (near), greatest(s.near, list_cosine_similarity(s.dense, p.dense)) AS near FROM {old} s JOIN p{k - 1} p ON s.query_id = p.query_id WHERE s.id <> p.id)")
        parts.append(f"p{k} AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY 0.5 * score - 0.5 * near DESC, rank) AS n FROM s{k}) WHERE n = 1)")
    taken = " UNION ALL ".join(f"SELECT query_id, id, {k} AS place FROM p{k}" for k in (1, 2, 3, 4))
    return _sql_search("chunk", k=10) + ", " + ", ".join(parts) + f" {taken} UNION ALL SELECT query_id, id, CAST(rank AS INTEGER) FROM found JOIN c USING (query_id) WHERE c <= 4"


@query("H05_diverse", _sql_diverse())
def h05(s, d):
    return R.diverse(found(s, d, k=10).join(I.items(s, d).select("id", "dense"), "id"), 4)


@query("F02_batched_embedding")
def f02(s, d):
    c = I.chunks(s, d)
    return c.select("id", F.transform(models.embed(F.col("content"), batch=32), lambda x: F.round(x, 6)).alias("dense"))


@query("F10_embedding_record", f"WITH {CHUNKS} SELECT id, 64 AS dimension, CASE WHEN regexp_matches(content, '[\\p{{L}}\\p{{N}}]') THEN 1.0 ELSE 0.0 END AS size, CAST(ceil(length(content) / 4.0) AS INTEGER) AS token_count FROM chunks")
def f10(s, d):
    made = ingest.embed_record(I.chunks(s, d).select("id", "content"), F.col("content"))
    norm = F.sqrt(F.aggregate("dense_embedding", F.lit(0.0), lambda a, x: a + x * x))
    return made.select("id", F.size("dense_embedding").alias("dimension"), F.round(norm, 6).alias("size"), "token_count")


@query("F12_summary_target", f"WITH {SUMMARIES} SELECT id, summary AS dense_target, original_content AS sparse_target FROM summaries")
def f12(s, d):
    return ingest.summary_targets(I.summaries(s, d)).select("id", "dense_target", "sparse_target")


@query("F13_cosine_distance", _NEXT + f"SELECT id, round(1 - {_SQL_COSINE}, 6) AS distance FROM p WHERE {_USABLE_PAIR}")
def f13(s, d):
    return _next(s, d).where("size(x) > 0 AND size(y) > 0").select("id", F.round(1 - vectors.cosine(F.col("x"), F.col("y"), strict=False), 6).alias("distance"))


_FAN = " UNION ALL ".join(f"SELECT * FROM ({_sql_search(p, k=n * K, alpha=1.0)} SELECT '{p}' AS pipeline, query_id, id, CAST(rank AS INTEGER) AS rank FROM found WHERE rank <= {K})" for p, n in (("chunk", 2), ("fact", 4), ("llm", 2)))


def _fan_out(s, d, **more):
    parts = [found(s, d, p, k=n * K, **more).where(F.col("rank") <= K).select(F.lit(p).alias("pipeline"), "query_id", "id", "rank") for p, n in FETCH.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("J02_fan_out")
def j02(s, d):
    """With the stems of the facts, which SQL does not have; J02_dense_fan_out checks the rest."""
    return _fan_out(s, d)


@query("J02_dense_fan_out", _FAN)
def j02d(s, d):
    return _fan_out(s, d, alpha=1.0)


@query("J06_mean_score", _sql_search("chunk") + "SELECT query_id, round(avg(score), 6) AS mean_score FROM found GROUP BY query_id")
def j06(s, d):
    return found(s, d).groupBy("query_id").agg(F.round(F.avg("score"), 6).alias("mean_score"))


@query("J07_stored_results", _sql_search("chunk") + ", f AS (SELECT query_id, document_id, min(rank) AS rank FROM found GROUP BY ALL) SELECT r.query_id, r.ids, d.documents FROM (SELECT query_id, list(document_id ORDER BY rank) AS ids FROM found GROUP BY query_id) r JOIN (SELECT query_id, list(document_id ORDER BY rank) AS documents FROM f GROUP BY query_id) d USING (query_id)")
def j07(s, d):
    from kelpwork.operators.evaluation import distinct_documents

    f = found(s, d)
    ids = f.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "document_id"))), lambda x: x["document_id"]).alias("ids"))
    return ids.join(distinct_documents(f, "query_id"), "query_id")


@query("L12_chat_turn", _sql_search("chunk", least=0.3) + ", n AS (SELECT query_id, content, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM found) SELECT a.query_id, CASE WHEN n.query_id IS NULL THEN 'No matching content was found.' ELSE string_split(substr('[1] ' || coalesce(content, ''), 1, 8000), chr(10))[1] END AS answer FROM asked a LEFT JOIN n ON n.query_id = a.query_id AND n.i = 1")
def l12(s, d):
    """Search, context, answer; no context gives a fixed reply. The stand-in answers with the first line of the prompt."""
    f = found(s, d, least=0.3).join(I.items(s, d).select("id", "content"), "id")
    turns = I.asked(s, d).select("query_id").join(R.context(f), "query_id", "left")
    answer = models.generate(F.coalesce("context", F.lit("")), lambda prompts: [p.split("\n")[0] for p in prompts])
    return turns.select("query_id", F.when(F.col("context").isNull(), "No matching content was found.").otherwise(answer).alias("answer"))


@query("P01_generate", f"WITH {CHUNKS} SELECT id, 'length ' || length(content) AS answer FROM chunks")
def p01(s, d):
    return I.chunks(s, d).select("id", models.generate(F.col("content"), lambda texts: [f"length {len(t)}" for t in texts]).alias("answer"))


@query("P05_generation_errors", f"WITH {CHUNKS} SELECT id, CASE WHEN contains(content, '7') THEN '[Generation failed]' ELSE 'ok' END AS answer FROM chunks")
def p05(s, d):
    def model(texts):
        if any("7" in t for t in texts):
            raise ValueError("no answer")
        return ["ok"] * len(texts)

    return I.chunks(s, d).select("id", models.generate(F.col("content"), model).alias("answer"))
