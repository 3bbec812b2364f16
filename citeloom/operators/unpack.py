"""Several values packed in one field: one row per value with its place in the list.

The tokenizer of citeloom.functions.packed runs over Arrow batches; nothing is shuffled, so the
operator costs one pass over the packed column at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.functions.packed import split_packed


@F.pandas_udf(T.ArrayType(T.StringType()))
def _split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(split_packed)


def packed_values(col: Column | str) -> Column:
    """The values of a packed string as array<string>; null, blank and empty lists give []."""
    return _split(F.col(col) if isinstance(col, str) else col)


def unpack(df: DataFrame, key: str, fields: list[str], field_col: str = "field_name", pos_col: str = "pos", item_col: str = "item_text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows (key, *keep, field_name, pos, item_text) of each packed field.

    pos counts from 1. Null, blank and entry-less lists give no row, repeats count each time, texts of
    any length are read whole. Other columns of df are ignored, so clashing names do no harm.
    """
    lists = F.array(*[F.struct(F.lit(f).alias("f"), F.col(f"`{f}`").cast("string").alias("s")) for f in fields])
    long = df.select(F.col(f"`{key}`").alias("k0"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.explode(lists).alias("x"))
    long = long.select("k0", *[f"c{i}" for i in range(len(keep))], F.col("x.f").alias("f"), F.col("x.s").alias("s")).filter("s is not null and s <> ''")
    out = long.withColumn("v", _split("s")).select("*", F.posexplode("v").alias("p", "item"))
    return out.select(F.col("k0").alias(key), *[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], F.col("f").alias(field_col), (F.col("p") + 1).cast("int").alias(pos_col), F.col("item").alias(item_col))
