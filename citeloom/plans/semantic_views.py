"""What the search by meaning is asked against: chunks of the cases' texts as vectors, and their words; with the same in SQL.

The stand-in encoder counts hashed words with signs, so that SQL can say what it does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom import constants as K
from citeloom.functions import text as X
from citeloom.operators import retrieval as R
from citeloom.plans import text_queries as TQ
from citeloom.plans import views as V
from citeloom.session import kept
from citeloom.sources import adapters

DIM = 64


def embedded(df: DataFrame, text: str) -> DataFrame:
    return adapters.embedded(df, text, adapters.hash_embedder(DIM))


def usable(df: DataFrame) -> DataFrame:
    return R.usable_vectors(df, DIM)


def chunk_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """(id, case_id, embedding): every chunk of the latest text of every case; written once for all searches of a session."""

    def make() -> DataFrame:
        c = V.cases(spark, sf, "plain_text").select("case_id", F.posexplode(X.packed_chunks(X.paragraphs(F.col("plain_text")))).alias("at", "chunk"))
        return usable(embedded(c, "chunk")).select((F.col("case_id") * 65536 + F.col("at")).alias("id"), "case_id", "embedding")

    return kept(spark, ("chunk_vectors", sf), make)


def sparse(spark: SparkSession, sf: str) -> R.Bm25:
    """The cases' words; texts of fewer than the least number of tokens are left out."""
    t = V.cases(spark, sf, "plain_text").filter("plain_text is not null").select(F.col("case_id").alias("id"), X.corpus_tokens(F.col("plain_text")).alias("tokens"))
    return kept(spark, ("sparse", sf), lambda: R.Bm25(t.filter(F.size("tokens") >= K.MIN_TOKENS)))


def semantic(spark: SparkSession, sf: str) -> Callable[[DataFrame], DataFrame]:
    return lambda q: R.semantic(q, embedded, chunk_vectors(spark, sf), sparse(spark, sf))


#: Chunks of the latest texts: running totals and, from each possible start, the last paragraph that fits; needs RECURSIVE and `cases`.
CHUNKS = f"""paras AS (SELECT case_id, list_filter(list_transform(string_split(plain_text, chr(10) || chr(10)), lambda x: regexp_replace(x, '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g')), lambda x: x <> '') AS p FROM cases WHERE plain_text IS NOT NULL),
pt AS (SELECT case_id, generate_subscripts(p, 1) AS pos, unnest(p) AS para FROM paras),
pn AS (SELECT *, {TQ.TOKENS_SQL.format(c='para')} AS toks FROM pt),
pc AS (SELECT *, len(toks) AS n, sum(least(len(toks), 511)) OVER (PARTITION BY case_id ORDER BY pos) AS upto FROM pn),
fits AS (SELECT a.case_id, a.pos, coalesce(max(b.pos) FILTER (WHERE b.upto <= a.upto - least(a.n, 511) + 510), a.pos - 1) AS last FROM pc a JOIN pc b ON b.case_id = a.case_id AND b.pos >= a.pos GROUP BY a.case_id, a.pos),
spans AS (SELECT f.case_id, f.pos, f.last, coalesce(x.n > 510, false) AS big FROM fits f LEFT JOIN pc x ON x.case_id = f.case_id AND x.pos = f.last + 1),
chain(case_id, pos, k) AS (SELECT case_id, CAST(1 AS BIGINT), 0 FROM spans WHERE pos = 1 UNION ALL SELECT c.case_id, CAST(c.pos + greatest(1, s.last + CAST(s.big AS INTEGER) - c.pos) AS BIGINT), c.k + 1 FROM chain c JOIN spans s ON s.case_id = c.case_id AND s.pos = c.pos),
chunks AS (SELECT c.case_id, c.k, string_agg(CASE WHEN p.n > 510 THEN array_to_string(p.toks[1:510], ' ') ELSE p.para END, chr(10) || chr(10) ORDER BY p.pos) AS chunk
 FROM chain c JOIN spans s ON s.case_id = c.case_id AND s.pos = c.pos JOIN pc p ON p.case_id = c.case_id AND p.pos BETWEEN c.pos AND s.last + CAST(s.big AS INTEGER) GROUP BY c.case_id, c.k)"""


def _vector_sql(source: str, key: str, text: str) -> str:
    """(key, dim, x): the signed counts of one text; {key}_n has their length."""
    words = f"SELECT {key}, unnest(regexp_extract_all(lower(replace({text}, chr(304), 'i' || chr(775))), '[a-z0-9]+')) AS w FROM {source}"
    return f"SELECT {key}, h % {DIM} AS dim, CAST(sum(CASE WHEN (h // {DIM}) % 2 = 1 THEN 1 ELSE -1 END) AS DOUBLE) AS x FROM (SELECT {key}, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) AS h FROM ({words})) GROUP BY {key}, dim"


#: Of queries qs (q, context, case_id): den, spa, fused and sem; needs RECURSIVE and `cases`.
SQL = f"""{CHUNKS}, ck AS (SELECT case_id * 65536 + k AS id, case_id, chunk FROM chunks),
cv AS MATERIALIZED ({_vector_sql('ck', 'id', 'chunk')}), cn AS (SELECT id, sqrt(sum(x * x)) AS n FROM cv GROUP BY id HAVING sum(x * x) > 0),
qv AS MATERIALIZED ({_vector_sql("qs", 'q', 'context')}), qn AS (SELECT q, sqrt(sum(x * x)) AS n FROM qv GROUP BY q HAVING sum(x * x) > 0),
dots AS (SELECT q, id, sum(a.x * b.x) AS d FROM qv a JOIN cv b USING (dim) GROUP BY q, id),
cosines AS MATERIALIZED (SELECT q, id, ck.case_id, round(d / (qn.n * cn.n), 12) AS cosine FROM dots JOIN qn USING (q) JOIN cn USING (id) JOIN ck USING (id)),
near AS (SELECT * FROM cosines QUALIFY row_number() OVER (PARTITION BY q ORDER BY cosine DESC, id) <= {5 * K.TOP_K}),
pool AS (SELECT q, case_id, greatest(max(cosine), 0.0) AS dense FROM near GROUP BY q, case_id),
den AS (SELECT q, case_id AS id, dense, row_number() OVER (PARTITION BY q ORDER BY dense DESC, case_id) AS rank FROM pool QUALIFY rank <= {K.TOP_K}),
ct AS (SELECT case_id AS id, {TQ._CORPUS.replace('text', 'plain_text')} AS t FROM cases WHERE plain_text IS NOT NULL), ctk AS (SELECT * FROM ct WHERE len(t) >= {K.MIN_TOKENS}),
cdl AS (SELECT id, len(t) AS dl FROM ctk), cpost AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM ctk) GROUP BY id, term),
cst AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM cdl), craw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM (SELECT term, count(*) AS df FROM cpost GROUP BY term) CROSS JOIN cst),
cidf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM craw) ELSE raw END AS idf FROM craw),
qterms AS (SELECT q, term, count(*) AS qtf FROM (SELECT q, unnest({TQ._QUERY.replace('text', 'context')}) AS term FROM qs) GROUP BY q, term),
csc AS (SELECT q, cpost.id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 9) AS score FROM qterms JOIN cidf USING (term) JOIN cpost USING (term) JOIN cdl ON cdl.id = cpost.id CROSS JOIN cst GROUP BY q, cpost.id),
spa AS (SELECT q, id, score, row_number() OVER (PARTITION BY q ORDER BY score DESC, id) AS rank FROM csc QUALIFY rank <= {K.TOP_K}),
nd AS (SELECT q, count(*) AS nd FROM den GROUP BY q), ns AS (SELECT q, count(*) AS ns FROM spa GROUP BY q),
fu AS (SELECT coalesce(d.q, s.q) AS q, coalesce(d.id, s.id) AS id, d.rank AS rd, s.rank AS rs, d.dense, s.score FROM den d FULL JOIN spa s ON s.q = d.q AND s.id = d.id),
fr AS (SELECT q, id, 1.0::DOUBLE / (60 + coalesce(rd, coalesce(nd, 0) + 60)) + 1.0::DOUBLE / (60 + coalesce(rs, coalesce(ns, 0) + 60)) AS rrf, coalesce(dense, 0.0) AS dense, coalesce(score, 0.0) AS bm25 FROM fu LEFT JOIN nd USING (q) LEFT JOIN ns USING (q)),
fused AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(rrf, 12) DESC, id) AS rank FROM fr QUALIFY rank <= {K.TOP_K}),
best AS (SELECT q, max(rrf) AS rrf_score FROM fused GROUP BY q), sims AS (SELECT c.q, greatest(max(c.cosine), 0.0) AS sim FROM cosines c JOIN qs ON qs.q = c.q AND qs.case_id = c.case_id GROUP BY c.q),
sem0 AS (SELECT qs.q, coalesce(rrf_score, 0.0) AS rrf_score, coalesce(den.dense, 0.0) AS dense_score, CASE WHEN qs.case_id IS NOT NULL THEN coalesce(sim, 0.0) END AS case_sim FROM qs LEFT JOIN best USING (q) LEFT JOIN den ON den.q = qs.q AND den.rank = 1 LEFT JOIN sims ON sims.q = qs.q),
sem AS (SELECT *, CASE WHEN case_sim IS NOT NULL THEN round(case_sim, 9) >= {K.CASE_SIM_CUT}::DOUBLE ELSE rrf_score >= {K.RELEVANT_RRF}::DOUBLE END AS relevant FROM sem0)"""
