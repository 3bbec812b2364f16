"""JSON, CSV and parquet scans and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import text as X
from citeloom.operators import upsert as U
from citeloom.session import cut
from citeloom.sources import schemas


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file, or files, that each hold one JSON array; malformed fields become null."""
    return spark.read.schema(schema).json(path, multiLine=True)


def flatten_hits(hits: DataFrame, least: int = 100) -> DataFrame:
    """Search hits as case rows: the first opinion's id and text; hits without opinions or with a stripped text under `least` are dropped."""
    first = F.get("opinions", F.lit(0))
    rows = hits.select(
        first["id"].alias("case_id"), "cluster_id", F.col("caseName").alias("case_name"), F.col("dateFiled").alias("date_filed"), "court_id", F.col("citation").alias("citations"), first["plain_text"].alias("plain_text"),
        F.array().cast("array<string>").alias("opinions_cited"), F.col("citeCount").alias("cite_count"), F.col("docketNumber").alias("docket_number"), "status",
    )
    return rows.filter(F.col("case_id").isNotNull() & (F.length(F.trim("plain_text")) >= least))


def batch_name(after: str, before: str | None) -> str:
    return f"batch_{after}_{before or 'present'}"


def write_cases(df: DataFrame, path: str) -> None:
    """Case rows as parquet, their lists as JSON text."""
    df.withColumns({c: F.to_json(c) for c in ("citations", "opinions_cited")}).write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_scores(df: DataFrame, path: str) -> None:
    """Raw scores as CSV with their columns in order; others are left out."""
    names = [f.split()[0].strip("`") for f in schemas.RAW_SCORES.split(", ")]
    df.select(*names).write.mode("overwrite").csv(path, header=True)


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Raw scores; booleans may be written True/False."""
    return spark.read.schema(schemas.RAW_SCORES).csv(path, header=True, nullValue="")


def upsert_parquet(spark: SparkSession, new: DataFrame, path: str, keys: list[str]) -> None:
    """New rows merged into a parquet table, the last of each key kept; a missing table is made."""
    try:
        old = spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        new.write.parquet(path)
        return
    cut(U.keep_last(old, new, keys)).write.mode("overwrite").parquet(path)


def landmark_text(opinions: DataFrame) -> DataFrame:
    """Plain text where there is some, else the first of the HTML fields with over 100 characters, stripped."""
    html = ["html_lawbox", "html_columbia", "html_with_citations", "html"]
    pick = F.coalesce(*[F.when(F.length(c) > 100, F.col(c)) for c in html if c in opinions.columns])
    return opinions.withColumn("plain_text", F.coalesce(F.when(F.length(F.trim("plain_text")) > 0, F.col("plain_text")), X.strip_html(pick)))
