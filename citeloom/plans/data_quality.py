"""Queries p2_ and p4_: packed fields and orphan references over the case tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators.orphans import Orphans, entity_state, orphan_references
from citeloom.operators.unpack import unpack
from citeloom.session import table

#: Fixed pattern: an opinion's address in any of its forms, or the bare id.
OPINION_ID = r"^(?:(?:https?://[^/]+)?/(?:[\w.-]+/)*opinions?/)?(\d{1,18})(?:[/?#].*)?$"


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return unpack(table(spark, sf, "cases_enriched"), "row_id", ["citations", "opinions_cited"])


def p2_rates(spark: SparkSession, sf: str) -> DataFrame:
    """Lists and entries per field and court."""
    df = table(spark, sf, "cases_enriched")
    items = unpack(df, "row_id", ["citations", "opinions_cited"], keep=("court_id",))
    return items.groupBy("field_name", "court_id").agg(F.count("*").alias("n_items"), F.sum((F.col("pos") == 1).cast("long")).alias("n_lists"))


def case_references(spark: SparkSession, sf: str) -> DataFrame:
    """Every reference to a case: (ref_table, ref_key, owner, ref, at)."""
    cases = table(spark, sf, "cases_enriched")
    named = unpack(cases, "row_id", ["opinions_cited"], keep=("case_id", "fetched_at"))
    cited = named.select(
        F.lit("cases_enriched").alias("ref_table"), F.col("row_id").alias("ref_key"), F.col("case_id").cast("long").alias("owner"),
        F.regexp_extract("item_text", OPINION_ID, 1).try_cast("long").alias("ref"), F.col("fetched_at").alias("at"),
    )
    edges = table(spark, sf, "graph_edges").select(F.lit("graph_edges").alias("ref_table"), F.col("edge_id").alias("ref_key"), F.col("src").alias("owner"), F.col("dst").alias("ref"), F.col("loaded_at").alias("at"))
    vectors = table(spark, sf, "embeddings_chunked").select(F.lit("embeddings_chunked").alias("ref_table"), F.col("vec_id").alias("ref_key"), F.lit(None).cast("long").alias("owner"), F.col("case_id").alias("ref"), F.col("embedded_at").alias("at"))
    return cited.filter("ref is not null").unionByName(edges).unionByName(vectors)


def _orphans(spark: SparkSession, sf: str) -> Orphans:
    state = entity_state(
        table(spark, sf, "cases_enriched").select(F.col("case_id").alias("id"), F.col("fetched_at").alias("at")),
        table(spark, sf, "landmark_cases").select(F.col("case_id").alias("id")),
        table(spark, sf, "case_removals").select(F.col("case_id").alias("id")),
    )
    return orphan_references(case_references(spark, sf), state)


def _month(df: DataFrame) -> DataFrame:
    return df.withColumn("ref_month", F.date_format("at", "yyyy-MM"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    direct = _month(_orphans(spark, sf).direct)
    return direct.select("ref_table", "ref_key", F.col("ref").alias("ref_id"), "reason", "ref_month").distinct()


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    """Orphan references and the ids they name per table and month, direct by reason and inherited by level; repeated ones of one record count once."""
    found = _month(_orphans(spark, sf).found).select("ref_table", "ref_month", "reason", "level", "ref_key", "ref").distinct()
    return found.groupBy("ref_table", "ref_month", "reason", "level").agg(F.count("*").alias("n_refs"), F.countDistinct("ref").alias("n_ids"))


QUERIES = {"p2_found": p2_found, "p2_rates": p2_rates, "p4_found": p4_found, "p4_report": p4_report}

_REFS = r"""live AS (SELECT case_id AS id, min(fetched_at) AS first_at FROM cases_enriched WHERE case_id IS NOT NULL GROUP BY 1),
named AS (
  SELECT row_id, case_id, fetched_at, unnest(regexp_extract_all(opinions_cited, '(?:^|[^0-9A-Za-z/._-])([0-9]+)(?:$|[^0-9A-Za-z/._?-])', 1)) AS x FROM cases_enriched
  UNION ALL
  SELECT row_id, case_id, fetched_at, unnest(regexp_extract_all(opinions_cited, 'opinions?/([0-9]+)', 1)) AS x FROM cases_enriched),
refs AS (
  SELECT 'cases_enriched' AS ref_table, row_id AS ref_key, case_id AS owner, CAST(x AS BIGINT) AS ref_id, fetched_at AS seen_at FROM named
  UNION SELECT 'graph_edges', edge_id, src, dst, loaded_at FROM graph_edges
  UNION SELECT 'embeddings_chunked', vec_id, NULL, case_id, embedded_at FROM embeddings_chunked),
judged AS (
  SELECT r.*, CASE WHEN l.id IS NOT NULL AND l.first_at > r.seen_at THEN 'late' WHEN l.id IS NOT NULL OR m.case_id IS NOT NULL THEN NULL
    WHEN d.case_id IS NOT NULL THEN 'deleted' ELSE 'missing' END AS reason
  FROM refs r LEFT JOIN live l ON l.id = r.ref_id LEFT JOIN landmark_cases m ON m.case_id = r.ref_id LEFT JOIN case_removals d ON d.case_id = r.ref_id
  WHERE r.ref_id IS NOT NULL)"""

#: The lists' grammar is no SQL; the orphans are, from the same entry patterns over the raw text. The cascade's levels end long before 30.
ORACLES: dict[str, str] = {
    "p4_found": f"WITH {_REFS} SELECT DISTINCT ref_table, ref_key, ref_id, reason, strftime(seen_at, '%Y-%m') AS ref_month FROM judged WHERE reason IS NOT NULL",
    "p4_report": f"""WITH RECURSIVE {_REFS}, walk(id, level) AS (SELECT DISTINCT ref_id, 0 FROM judged WHERE reason IN ('missing', 'deleted')
      UNION SELECT j.owner, w.level + 1 FROM walk w JOIN judged j ON j.ref_id = w.id WHERE j.owner IS NOT NULL AND j.owner <> j.ref_id AND w.level < 30),
    reached AS (SELECT id, min(level) AS level FROM walk GROUP BY id),
    both_kinds AS (SELECT *, 0 AS level FROM judged WHERE reason IS NOT NULL UNION ALL SELECT j.* REPLACE ('inherited' AS reason), r.level FROM judged j JOIN reached r ON r.id = j.ref_id WHERE j.reason IS NULL AND r.level > 0)
    SELECT ref_table, strftime(seen_at, '%Y-%m') AS ref_month, reason, CAST(level AS INTEGER) AS level, count(DISTINCT (ref_key, ref_id)) AS n_refs, count(DISTINCT ref_id) AS n_ids FROM both_kinds GROUP BY ALL""",
}
