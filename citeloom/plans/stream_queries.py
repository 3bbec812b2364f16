"""Streaming and adapter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom.functions import text as X
from citeloom.plans import semantic_views as S
from citeloom.plans import text_queries as TQ
from citeloom.plans import verdict_queries as VQ
from citeloom.plans import views as V
from citeloom.sources import adapters
from citeloom.streaming import incremental
from citeloom.session import table


def stream_citations(spark, sf):
    known = VQ.index(spark, sf).select("citation_string", "case_id", "case_name")
    service = VQ.lookup(spark, sf).groupBy("citation_string").agg(F.min("case_id").alias("case_id")).join(known, "citation_string", "left_anti").withColumn("case_name", F.lit(None).cast("string"))
    return incremental.checked_now(spark, f"{sf}/documents.parquet", known.unionByName(service), V.REPORTERS).select("doc_id", "citation_string", "case_id", "resolved")


def proposition_check(spark, sf):
    """Benchmark contexts judged against the excerpt of their case by the stand-in judge, where there is one to judge by."""
    b = table(spark, sf, "benchmark_items").select("benchmark_id", "context", "case_id")
    b = b.unionByName(VQ.benchmark_set(spark, sf).select((F.col("benchmark_id") + 1_000_000).alias("benchmark_id"), "context", "case_id"))
    text = V.cases(spark, sf, "plain_text")
    j = b.join(text.select("case_id", F.nullif(X.first_words(F.col("plain_text"), 2000), F.lit("")).alias("excerpt")), "case_id", "left").withColumn("gate", F.col("excerpt").isNotNull())
    return adapters.judged(j, "context", "excerpt", "gate").select("benchmark_id", "llm_checked", "llm_accurate")


def hashed_embeddings(spark, sf):
    d = adapters.embedded(table(spark, sf, "documents").select("doc_id", "text"), "text", adapters.hash_embedder(64))
    return d.select("doc_id", F.size("embedding").alias("n"), F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")).alias("norm2"))


QUERIES = {"stream_citations": stream_citations, "proposition_check": proposition_check, "hashed_embeddings": hashed_embeddings}
ORACLES = {
    "proposition_check": f"""WITH {VQ._MADE}, qs AS (SELECT benchmark_id AS q, context, case_id FROM benchmark_items UNION ALL SELECT benchmark_id + 1000000, context, case_id FROM bm), {VQ._judge_sql('true')}
      SELECT qs.q AS benchmark_id, llm.q IS NOT NULL AS llm_checked, coalesce(said, true) AS llm_accurate FROM qs LEFT JOIN llm ON llm.q = qs.q""",
    "hashed_embeddings": f"WITH v AS ({S._vector_sql('documents', 'doc_id', 'text')}), n AS (SELECT doc_id, sum(x * x) AS norm2 FROM v GROUP BY doc_id) SELECT doc_id, CASE WHEN text IS NOT NULL THEN {S.DIM} END AS n, CASE WHEN text IS NOT NULL THEN coalesce(norm2, 0.0) END AS norm2 FROM documents LEFT JOIN n USING (doc_id)",
    "stream_citations": f"WITH {TQ._EXTRACT.split('parts AS')[0].strip().rstrip(',')}, m AS (SELECT DISTINCT doc_id, m AS citation_string FROM found), {VQ._INDEX}, {VQ._LOOKUP}, res AS (SELECT citation_string, coalesce(i.case_id, l.case_id) AS case_id FROM idx i FULL JOIN look l USING (citation_string)) SELECT m.doc_id, m.citation_string, res.case_id, res.case_id IS NOT NULL AS resolved FROM m LEFT JOIN res USING (citation_string)",
}
