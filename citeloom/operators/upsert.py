"""Merges into tables by key: node, stub, edge and property upserts as joins, without row-by-row writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def upsert_nodes(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Full nodes of `new` update or join `old`; stubs they meet become full; fields that are null in `new` stay."""
    cols = [c for c in old.columns if c not in (key, "stub")]
    j = old.alias("o").join(new.withColumn("_new", F.lit(True)).alias("n"), key, "full_outer")
    pick = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) if c in new.columns else F.col(f"o.{c}").alias(c)
    return j.select(key, *[pick(c) for c in cols], F.when(F.col("_new"), False).otherwise(F.col("o.stub")).alias("stub"))


def insert_stubs(nodes: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Stubs for ids that no node has; full nodes stay as they are."""
    missing = ids.filter(F.col(key).isNotNull()).select(key).distinct().join(nodes.select(key), key, "left_anti")
    return nodes.unionByName(missing.withColumn("stub", F.lit(True)), allowMissingColumns=True)


def merge_edges(old: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends both exist, each once, added to those there are."""
    ids = nodes.select("id")
    ok = new.select("src", "dst").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return old.select("src", "dst").unionByName(ok).distinct()


def set_property(nodes: DataFrame, values: DataFrame, name: str, key: str = "id") -> DataFrame:
    """A property set from (key, value) for the ids there are; others keep theirs."""
    v = values.select(key, F.col("value").alias("_v"))
    return nodes.join(v, key, "left").withColumn(name, F.coalesce("_v", F.col(name)) if name in nodes.columns else F.col("_v")).drop("_v")


def keep_last(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both by key, the new ones before the old; within one table a key must be unique."""
    both = old.withColumn("_g", F.lit(0)).unionByName(new.withColumn("_g", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(F.col("_g").desc())
    return both.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_g")


def fill_from(df: DataFrame, lookup: DataFrame, key: str, column: str, empty) -> DataFrame:
    """A column filled from lookup (key, value) where `empty` holds of it."""
    j = df.join(lookup.select(key, F.col("value").alias("_v")), key, "left")
    return j.withColumn(column, F.when(empty, F.coalesce("_v", F.col(column))).otherwise(F.col(column))).drop("_v")


def first_of_batches(batches: list[DataFrame], key: str) -> DataFrame:
    """The union of ordered batches with each key's first row, and its batch number."""
    all_ = None
    for i, b in enumerate(batches):
        b = b.withColumn("batch", F.lit(i))
        all_ = b if all_ is None else all_.unionByName(b, allowMissingColumns=True)
    order = [F.col("batch")] + ([F.col("row_id")] if "row_id" in all_.columns else [])
    return all_.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).withColumn("added", F.col("_r") == 1).drop("_r")
