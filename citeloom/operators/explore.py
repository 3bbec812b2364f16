"""Rows behind maps and charts; drawing them is left to the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def standardize(df: DataFrame, cols: list[str]) -> DataFrame:
    """Columns less their mean over the population's deviation; constant columns become 0."""
    s = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    return df.withColumns({c: (F.col(c) - F.lit(s[f"m_{c}"])) / F.lit(s[f"s_{c}"] or 1.0) for c in cols})


def project(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, x, y): the two principal components, in place of a manifold projection."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    d = df.select(key, array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("_v"))
    out = PCA(k=2, inputCol="_v", outputCol="_p").fit(d).transform(d).withColumn("_p", vector_to_array("_p"))
    return out.select(key, F.col("_p")[0].alias("x"), F.col("_p")[1].alias("y"))


def overlay(targets: DataFrame, coords: DataFrame, matches: DataFrame) -> DataFrame:
    """(q, x, y, placed_by): a target's own place, else the centroid of its matches', else none."""
    own = targets.join(coords.select(F.col("case_id"), F.col("x").alias("ox"), F.col("y").alias("oy")), "case_id", "left")
    mid = matches.join(coords, "case_id").groupBy("q").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    j = own.join(mid, "q", "left")
    return j.select("q", F.coalesce("ox", "mx").alias("x"), F.coalesce("oy", "my").alias("y"), F.when(F.col("ox").isNotNull(), "own").when(F.col("mx").isNotNull(), "centroid").otherwise("none").alias("placed_by"))
