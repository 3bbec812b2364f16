"""Queries of the llm operators and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import bpe, forest, leaks, link, pieces, scans, toxic
from citeloom.plans.views import REPORTERS
from citeloom.session import table


def p1_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return forest.similar_vectors(table(spark, sf, "embeddings_chunked")).select("id", "near", F.round("cosine", 9).alias("cosine"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    near = forest.similar_vectors(table(spark, sf, "embeddings_chunked"))
    return near.select(F.least("id", "near").alias("vec_a"), F.greatest("id", "near").alias("vec_b")).distinct()


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    cases = table(spark, sf, "cases_enriched").select("case_id", "case_name").unionByName(table(spark, sf, "landmark_cases").select("case_id", "case_name"))
    return link.link_names(table(spark, sf, "name_checks"), cases, "check_id", "cited_name", "case_id", "case_name")


#: Words of the titles of reports that the texts cite; their stops end no sentence.
_TITLES = {w for r in REPORTERS for w in re.findall(r"[^\W\d_]+", r.lower())}


def p5_pieces(spark: SparkSession, sf: str) -> DataFrame:
    cut = pieces.split_oversized(table(spark, sf, "cases_enriched"), abbreviations=_TITLES)
    return cut.select("row_id", "boundary", F.posexplode("pieces").alias("p", "piece")).select("row_id", "boundary", (F.col("p") + 1).alias("piece_no"), "piece")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return pieces.split_oversized(table(spark, sf, "cases_enriched"), abbreviations=_TITLES).select("row_id", "boundary")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return scans.repairs(table(spark, sf, "cases_enriched"))


def p6_texts(spark: SparkSession, sf: str) -> DataFrame:
    return scans.repaired_texts(table(spark, sf, "cases_enriched"))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, sf, "documents"))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.leaked_items(table(spark, sf, "documents"), table(spark, sf, "benchmark_items"))


def p9_scores(spark: SparkSession, sf: str) -> DataFrame:
    return toxic.toxic_scores(table(spark, sf, "documents"), table(spark, sf, "review_labels")).select("doc_id", "source", F.round("score", 6).alias("score"), "toxic")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return toxic.toxic_scores(table(spark, sf, "documents"), table(spark, sf, "review_labels")).filter("toxic").select("doc_id").distinct()


def p9_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Documents, toxic documents and their rate per source."""
    scored = toxic.toxic_scores(table(spark, sf, "documents"), table(spark, sf, "review_labels"))
    flag = F.col("toxic").cast("long")
    return scored.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum(flag).alias("n_toxic"), F.avg(flag).alias("rate"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found, "p1_neighbours": p1_neighbours, "p3_found": p3_found, "p5_found": p5_found, "p5_pieces": p5_pieces, "p6_found": p6_found, "p6_texts": p6_texts, "p7_ids": p7_ids, "p8_found": p8_found,
    "p9_found": p9_found, "p9_scores": p9_scores, "p9_rates": p9_rates,
}

#: By brute force; the forest compares all pairs too while the collection is one block, as at the scale of the comparison.
_NEAREST = """v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings_chunked WHERE len(embedding) = 64 AND list_count(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND list_count(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS id, b.vec_id AS near, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 12) AS cosine FROM v a JOIN v b ON a.vec_id <> b.vec_id),
best AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY id ORDER BY cosine DESC, near) <= 5)"""
ORACLES: dict[str, str] = {
    "p1_neighbours": f"WITH {_NEAREST} SELECT id, near, round(cosine, 9) AS cosine FROM best",
    "p1_found": f"WITH {_NEAREST} SELECT DISTINCT least(id, near) AS vec_a, greatest(id, near) AS vec_b FROM best",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
