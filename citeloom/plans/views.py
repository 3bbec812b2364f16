"""Views that several queries share, as DataFrames and as SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeloom import constants as K
from citeloom.functions import text as X
from citeloom.session import kept, table

#: The reporters of the texts these queries are about, all invented, beside the known ones.
REPORTERS = [
    *K.REPORTERS,
    "Vell. Rep.", "Vell. Rep. 2d", "Prov. Ct. R.", "App. Qm.", "App. Qm. 3d", "Ost. Ch.", "Q.M.L.R. 2d", "Lor. L.J.", "Sorrel App.", "Tams. § Dec.", "Harl. & T., N.S.", "Esk. 4th", "N.D.R.", "Dunvale's Ch.", "Rev. Céd.", "Cal. Rec., Ser. B", 'Q. "Red" Rep.',
]

#: The latest fetch of each case.
CASES = "cases AS (SELECT * FROM cases_enriched WHERE case_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY row_id DESC) = 1)"
NODES = (
    CASES
    + """,
nodes AS (
  SELECT case_id AS id, case_name AS name, TRY_CAST(substr(date_filed, 1, 4) AS INTEGER) AS year, court_id, false AS stub, false AS landmark FROM cases
  UNION ALL
  SELECT case_id, case_name, TRY_CAST(substr(date_filed, 1, 4) AS INTEGER), court_id, false, true FROM landmark_cases)"""
)
EDGES = "edges AS (SELECT DISTINCT src, dst FROM graph_edges WHERE src IS NOT NULL AND dst IS NOT NULL AND src <> dst)"


def cases(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    """The latest fetch of each case; only the named columns are read."""
    df = table(spark, sf, "cases_enriched").filter("case_id is not null")
    if cols:
        df = df.select(*dict.fromkeys(["row_id", "case_id", *cols]))
    if "plain_text" in cols:  # texts are left where they are: the few earlier fetches are found by their ids
        return df.join(_superseded(spark, sf), "row_id", "left_anti")
    w = Window.partitionBy("case_id").orderBy(F.col("row_id").desc())
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def _superseded(spark: SparkSession, sf: str) -> DataFrame:
    """row_id of every fetch of a case but its latest."""

    def make() -> DataFrame:
        w = Window.partitionBy("case_id").orderBy(F.col("row_id").desc())
        ids = table(spark, sf, "cases_enriched").filter("case_id is not null").select("row_id", F.row_number().over(w).alias("_r"))
        return ids.filter("_r > 1").select("row_id")

    return kept(spark, ("superseded", sf), make)


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Full nodes: cases and landmarks, (id, name, year, court_id, stub, landmark)."""
    full = cases(spark, sf, "case_name", "date_filed", "court_id").withColumn("landmark", F.lit(False))
    marked = table(spark, sf, "landmark_cases").withColumn("landmark", F.lit(True))
    cols = [F.col("case_id").alias("id"), F.col("case_name").alias("name"), X.year_of(F.col("date_filed")).alias("year"), "court_id", F.lit(False).alias("stub"), "landmark"]
    return full.select(*cols).unionByName(marked.select(*cols))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct citations without self loops and nulls."""
    return table(spark, sf, "graph_edges").filter("src is not null and dst is not null and src <> dst").select("src", "dst").distinct()
