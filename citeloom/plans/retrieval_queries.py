"""Retrieval queries. Searches take every row whose id is divisible by 50 as a query, against all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom import constants as K
from citeloom.functions import text as X
from citeloom.operators import retrieval as R
from citeloom.plans import semantic_views as S
from citeloom.plans import views as V
from citeloom.session import table

DIM = 64


def _vectors(spark, sf):
    return R.usable_vectors(table(spark, sf, "embeddings_chunked").select(F.col("vec_id").alias("id"), "case_id", "embedding"), DIM)


def _queries(spark, sf):
    return _vectors(spark, sf).filter("id % 50 = 0").withColumnRenamed("id", "q")


_FINITE = "list_count(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64"
VEC = f"vec AS (SELECT vec_id AS id, case_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings_chunked WHERE embedding IS NOT NULL AND len(embedding) = 64 AND {_FINITE} AND list_count(list_filter(embedding, lambda x: x <> 0)) > 0)"
_COS = "list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)))"
_HITS = f"""{VEC}, hits AS (SELECT a.id AS q, b.id, b.case_id, round({_COS}, 12) AS cosine FROM vec a JOIN vec b ON a.id % 50 = 0 AND b.id <> a.id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY cosine DESC, id) AS rank FROM hits)"""


def l2_normalize(spark, sf):
    return _vectors(spark, sf).select("id", F.round(R.norm(F.col("embedding")), 6).alias("norm"), F.round(R.unit(F.col("embedding"))[0], 6).alias("first_value"))


def cosine_topk(spark, sf):
    return R.nearest(_queries(spark, sf), _vectors(spark, sf), K.TOP_K).select("q", "id", F.round("cosine", 6).alias("cosine"), "rank")


def chunk_maxpool(spark, sf):
    v = _vectors(spark, sf)
    pooled = R.case_pool(R.nearest(_queries(spark, sf), v, 5 * K.TOP_K), v.filter("case_id is not null"), K.TOP_K)
    return pooled.select("q", "case_id", F.round("dense", 6).alias("dense"), "rank")


def case_similarity(spark, sf):
    q = _queries(spark, sf).select("q", "case_id", F.col("embedding").alias("a"))
    j = q.join(_vectors(spark, sf).select("id", "case_id", F.col("embedding").alias("b")), "case_id", "left").filter("id is null or id <> q")
    s = j.groupBy("q").agg(F.max(R.cosine(F.col("a"), F.col("b"))).alias("s"))
    return _queries(spark, sf).select("q").join(s, "q", "left").select("q", F.round(F.coalesce(F.greatest("s", F.lit(0.0)), F.lit(0.0)), 6).alias("case_sim"))


def mean_pool(spark, sf):
    return R.mean_vectors(_vectors(spark, sf).filter("case_id is not null"), "case_id").select("case_id", "dim", F.round("value", 6).alias("value"))


def vector_checks(spark, sf):
    return R.vector_checks(table(spark, sf, "embeddings_chunked"), DIM)


def _tokens(spark, sf):
    return table(spark, sf, "documents").filter("text is not null").select(F.col("doc_id").alias("id"), F.filter(X.alpha_tokens(F.col("text")), lambda t: F.length(t) >= 2).alias("tokens"))


def _text_queries(spark, sf):
    b = table(spark, sf, "benchmark_items").filter("benchmark_id % 50 = 0 and context is not null")
    return b.select(F.col("benchmark_id").alias("q"), F.filter(X.alpha_tokens(F.col("context")), lambda t: F.length(t) >= 2).alias("tokens"))


_BM = """toks AS (SELECT doc_id AS id, list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) >= 2) AS t FROM documents WHERE text IS NOT NULL),
dl AS (SELECT id, len(t) AS dl FROM toks), post AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM toks) GROUP BY id, term),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM dfs CROSS JOIN st), mi AS (SELECT avg(raw) AS m FROM raw),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * m ELSE raw END AS idf FROM raw CROSS JOIN mi)"""
_BMTOP = f"""{_BM}, qt AS (SELECT benchmark_id AS q, unnest(list_filter(regexp_extract_all(lower(context), '[a-z]+'), lambda x: length(x) >= 2)) AS term FROM benchmark_items WHERE benchmark_id % 50 = 0 AND context IS NOT NULL),
qf AS (SELECT q, term, count(*) AS qtf FROM qt GROUP BY q, term),
sc AS (SELECT q, post.id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM qf JOIN idf USING (term) JOIN post USING (term) JOIN dl ON dl.id = post.id CROSS JOIN st GROUP BY q, post.id),
bm AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM sc)"""


def bm25_stats(spark, sf):
    b = R.Bm25(_tokens(spark, sf))
    return b.terms.agg(F.count("*").alias("n_terms"), F.sum("df").alias("n_postings"), F.round(F.avg("idf"), 6).alias("mean_idf"), F.round(F.max("idf"), 6).alias("max_idf")).withColumns({"n_docs": F.lit(b.n).cast("bigint"), "avgdl": F.round(F.lit(b.avgdl), 6)})


def bm25_topk(spark, sf):
    return R.Bm25(_tokens(spark, sf)).top(_text_queries(spark, sf), K.TOP_K).select("q", "id", F.round("score", 6).alias("score"), "rank")


def _contexts(spark, sf):
    b = table(spark, sf, "benchmark_items").filter("benchmark_id % 50 = 0 and context is not null")
    return b.select(F.col("benchmark_id").alias("q"), "context", "case_id")


def _fused(spark, sf):
    """Both lists of the same query, a context: cases by their chunks' vectors and by their words."""
    q = _contexts(spark, sf)
    vec = S.usable(S.embedded(q, "context").select("q", "embedding"))
    near = R.nearest(vec, S.chunk_vectors(spark, sf), 5 * K.TOP_K, others=False)
    dense = R.case_pool(near, S.chunk_vectors(spark, sf), K.TOP_K).select("q", F.col("case_id").alias("id"), "dense", "rank")
    sparse = S.sparse(spark, sf).top(q.select("q", X.query_tokens(F.col("context")).alias("tokens")), K.TOP_K)
    return R.fuse(dense, sparse, K.TOP_K)


def rrf_fuse(spark, sf):
    return _fused(spark, sf).select("q", "id", F.round("rrf", 9).alias("rrf"), "rank")


def top_matches(spark, sf):
    """Fused matches with what is known of the cases; roundings half to even."""
    n = V.cases(spark, sf, "case_name", "court_id", "date_filed", "cite_count").select(F.col("case_id").alias("id"), "case_name", "court_id", "date_filed", "cite_count")
    j = _fused(spark, sf).join(n, "id", "left")
    return j.select("q", "id", "rank", "case_name", "court_id", "date_filed", "cite_count", F.bround("rrf", 6).alias("rrf"), F.bround(F.round("dense", 9), 4).alias("dense"), F.bround(F.round("bm25", 9), 4).alias("bm25"))


def case_chunks(spark, sf):
    """The packed chunks of every case's latest text."""
    c = V.cases(spark, sf, "plain_text").filter("plain_text is not null")
    return c.select("case_id", F.posexplode(X.packed_chunks(X.paragraphs(F.col("plain_text")))).alias("chunk_index", "chunk"))


def relevance(spark, sf):
    """Whether each context bears on its case; where it has none, by the best fused rank."""
    s = S.semantic(spark, sf)(_contexts(spark, sf))
    return s.select("q", F.round("rrf_score", 9).alias("rrf_score"), F.round("dense_score", 6).alias("dense_score"), F.round("case_sim", 6).alias("case_sim"), "relevant")


_FUSE = f"""WITH RECURSIVE {V.CASES}, qs AS (SELECT benchmark_id AS q, context, case_id FROM benchmark_items WHERE benchmark_id % 50 = 0 AND context IS NOT NULL), {S.SQL}"""

_NAMES = "l2_normalize cosine_topk chunk_maxpool case_similarity mean_pool vector_checks bm25_stats bm25_topk rrf_fuse top_matches case_chunks relevance".split()
QUERIES = {n: globals()[n] for n in _NAMES}
ORACLES = {
    "l2_normalize": f"WITH {VEC} SELECT id, round(sqrt(list_dot_product(e, e)), 6) AS norm, round(e[1] / sqrt(list_dot_product(e, e)), 6) AS first_value FROM vec",
    "cosine_topk": f"WITH {_HITS} SELECT q, id, round(cosine, 6) AS cosine, CAST(rank AS INTEGER) AS rank FROM ranked WHERE rank <= 5",
    "chunk_maxpool": f"WITH {_HITS}, pool AS (SELECT q, case_id, greatest(max(cosine), 0.0) AS dense FROM ranked WHERE rank <= 25 AND case_id IS NOT NULL GROUP BY q, case_id), pr AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dense DESC, case_id) AS rank FROM pool) SELECT q, case_id, round(dense, 6) AS dense, CAST(rank AS INTEGER) AS rank FROM pr WHERE rank <= 5",
    "case_similarity": f"WITH {VEC} SELECT a.id AS q, round(coalesce(greatest(max({_COS}), 0.0), 0.0), 6) AS case_sim FROM vec a LEFT JOIN vec b ON b.case_id = a.case_id AND b.id <> a.id WHERE a.id % 50 = 0 GROUP BY a.id",
    "mean_pool": f"WITH {VEC}, f AS (SELECT case_id, generate_subscripts(e, 1) - 1 AS dim, unnest(e) AS x FROM vec WHERE case_id IS NOT NULL) SELECT case_id, CAST(dim AS INTEGER) AS dim, round(avg(x), 6) AS value FROM f GROUP BY case_id, dim",
    "vector_checks": f"""WITH v AS (SELECT embedding AS e, embedding IS NOT NULL AND len(embedding) = 64 AS ok, {_FINITE} AS fin FROM embeddings_chunked),
      n AS (SELECT *, CASE WHEN ok AND fin THEN sqrt(list_dot_product(CAST(e AS DOUBLE[]), CAST(e AS DOUBLE[]))) END AS n FROM v)
      SELECT count(*) AS n_rows, count_if(e IS NULL) AS n_null, count_if(e IS NOT NULL AND len(e) <> 64) AS n_length, count_if(ok AND NOT fin) AS n_not_finite, count_if(n = 0) AS n_zero, count_if(n > 0.98 AND n < 1.02) AS n_unit, round(avg(n) FILTER (WHERE n > 0), 6) AS mean_norm FROM n""",
    "bm25_stats": f"WITH {_BM} SELECT count(*) AS n_terms, CAST(sum(df) AS BIGINT) AS n_postings, round(avg(idf), 6) AS mean_idf, round(max(idf), 6) AS max_idf, (SELECT n FROM st) AS n_docs, round((SELECT avgdl FROM st), 6) AS avgdl FROM idf",
    "bm25_topk": f"WITH {_BMTOP} SELECT q, id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM bm WHERE rank <= 5",
    "rrf_fuse": f"{_FUSE} SELECT q, id, round(rrf, 9) AS rrf, CAST(rank AS INTEGER) AS rank FROM fused",
    "top_matches": f"{_FUSE} SELECT q, f.id, CAST(rank AS INTEGER) AS rank, case_name, court_id, date_filed, cite_count, round_even(rrf, 6) AS rrf, round_even(round(dense, 9), 4) AS dense, round_even(round(bm25, 9), 4) AS bm25 FROM fused f LEFT JOIN cases ON cases.case_id = f.id",
    "case_chunks": f"WITH RECURSIVE {V.CASES}, {S.CHUNKS} SELECT case_id, CAST(k AS INTEGER) AS chunk_index, chunk FROM chunks",
    "relevance": f"{_FUSE} SELECT q, round(rrf_score, 9) AS rrf_score, round(dense_score, 6) AS dense_score, round(case_sim, 6) AS case_sim, relevant FROM sem",
}
