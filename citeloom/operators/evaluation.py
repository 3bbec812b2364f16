"""Metrics, sweeps, folds, calibration and the learned scorer over tables of raw scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeloom import constants as K
from citeloom.session import cut

POSITIVE = ("HALLUCINATED", "SUSPICIOUS")


def confusion(pred: Column, truth: Column) -> list[Column]:
    """Counts tp, fp, fn, tn of boolean columns; null counts as false."""
    p, t = F.coalesce(pred, F.lit(False)), F.coalesce(truth, F.lit(False))
    return [F.count_if(p & t).alias("tp"), F.count_if(p & ~t).alias("fp"), F.count_if(~p & t).alias("fn"), F.count_if(~p & ~t).alias("tn")]


def rates(df: DataFrame, places: int = 4) -> DataFrame:
    """precision, recall, f1, accuracy from counts; 0 where the denominator is."""
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    df = df.withColumns({"_p": div(tp, tp + fp), "_r": div(tp, tp + fn)})
    out = {"precision": F.col("_p"), "recall": F.col("_r"), "f1": div(2 * F.col("_p") * F.col("_r"), F.col("_p") + F.col("_r")), "accuracy": div(tp + tn, tp + fp + fn + tn)}
    return df.withColumns({k: F.bround(v, places) for k, v in out.items()}).drop("_p", "_r")


def order_key(id_col: str, seed: int) -> Column:
    """A repeatable order that depends on the id and the seed alone (a linear congruence, the same in any engine)."""
    return (F.col(id_col).cast("bigint") % 2_147_483_647 * F.lit(1_103_515_245) + F.lit(seed) * 12_345) % F.lit(2_147_483_647)


def placed(df: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """df with `place`, from 1, and `size` of each row's group, though a group be most of the table.

    Rows are range-partitioned by group and order and written; a task ranks its own rows, and what the tasks before it hold of the same group (a
    row per task and group) is added. Null is a group like any other.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    p = cut(df.repartitionByRange(parts, *groups, *order).withColumn("_p", F.spark_partition_id()))
    n = p.groupBy(*groups, "_p").agg(F.count("*").alias("_n"))
    g = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    n = n.withColumns({"_before": F.coalesce(F.sum("_n").over(g.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "size": F.sum("_n").over(g)})
    n = n.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(groups)], F.col("_p").alias("_q"), "_before", "size")
    p = p.withColumn("_r", F.row_number().over(Window.partitionBy(*groups, "_p").orderBy(*order)))
    same = reduce(Column.__and__, [p[c].eqNullSafe(n[f"_g{i}"]) for i, c in enumerate(groups)], p["_p"] == n["_q"])
    j = p.join(n, same)
    return j.withColumn("place", F.col("_before") + F.col("_r")).drop("_p", "_q", "_r", "_before", *[f"_g{i}" for i in range(len(groups))])


def stratified_split(df: DataFrame, id_col: str, strata: list[str], share: float = 0.8, seed: int = 42) -> DataFrame:
    """`split` train or test, by rank within each stratum."""
    r = placed(df.withColumn("_k", order_key(id_col, seed)), strata, ["_k", id_col])
    return r.withColumn("split", F.when(F.col("place") <= F.floor(F.col("size") * F.lit(share)), "train").otherwise("test")).drop("_k", "place", "size")


def folds(df: DataFrame, id_col: str, strata: list[str], k: int = 10, seed: int = 42) -> DataFrame:
    r = placed(df.withColumn("_k", order_key(id_col, seed)), strata, ["_k", id_col])
    return r.withColumn("fold", ((F.col("place") - 1) % k).cast("int")).drop("_k", "place", "size")


def grid(spark) -> DataFrame:
    rows = [(i, s, r, d) for i, (s, r, d) in enumerate((s, r, d) for s in K.SIM_GRID for r in K.RRF_GRID for d in K.DENSITY_GRID)]
    return spark.createDataFrame(rows, "grid_idx int, sim_cut double, rrf_cut double, density_cut int")


def sweep(scores: DataFrame, verdict) -> DataFrame:
    """Counts and rates of every threshold setting: the 180 settings are an array in each row, so rows meet them without a join."""
    g = [F.struct(F.lit(i).alias("grid_idx"), F.lit(s).alias("sim_cut"), F.lit(r).alias("rrf_cut"), F.lit(d).alias("density_cut")) for i, (s, r, d) in enumerate((s, r, d) for s in K.SIM_GRID for r in K.RRF_GRID for d in K.DENSITY_GRID)]
    rows = scores.withColumn("g", F.explode(F.array(*g))).select("*", "g.*").drop("g")
    rows = rows.withColumn("pred", verdict(F.col("sim_cut"), F.col("rrf_cut"), F.col("density_cut")))
    return rates(rows.groupBy("grid_idx", "sim_cut", "rrf_cut", "density_cut").agg(*confusion(F.col("pred").isin(*POSITIVE), F.col("label").isin(*POSITIVE))))


def auc(df: DataFrame, score: str, truth: str) -> DataFrame:
    """ROC-AUC by rank sums with average ranks of ties; null with one class only. Scores are counted before they are ranked."""
    # One row per distinct score; the rows before a score are those of the tasks before and of its own task.
    per = df.groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"), F.count_if(truth).alias("pos"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    per = cut(per.repartitionByRange(parts, "s").withColumn("_p", F.spark_partition_id()))
    before = per.groupBy("_p").agg(F.sum("n").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row per task
    w = Window.partitionBy("_p").orderBy("s").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    r = per.withColumn("upto", F.sum("n").over(w)).join(before.select("_p", "_before"), "_p")
    r = r.withColumn("rank", F.col("_before") + F.col("upto") - (F.col("n") - 1) / 2.0)
    t = r.agg(F.sum("pos").alias("p"), (F.sum("n") - F.sum("pos")).alias("m"), F.sum(F.col("rank") * F.col("pos")).alias("rs"))
    return t.select(F.when((F.col("p") > 0) & (F.col("m") > 0), (F.col("rs") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("m"))).alias("auc"))


def calibration(df: DataFrame, p: str, truth: str) -> DataFrame:
    b = F.least(F.floor(F.col(p) * 5), F.lit(4)).cast("int")
    return df.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"), F.bround(F.avg(F.col(truth).cast("double")), 4).alias("rate"))


def histogram(df: DataFrame, group: Column, value: str, bins: int = 20) -> DataFrame:
    """Equal-width bins of each series between its least and greatest value, the last one closed."""
    d = df.select(group.alias("series"), F.col(value).cast("double").alias("x")).filter("x is not null")
    ends = d.groupBy("series").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    per = d.groupBy("series", "x").agg(F.count("*").alias("c")).join(ends, "series")
    b = F.when(F.col("hi") == F.col("lo"), 0).otherwise(F.least(F.floor((F.col("x") - F.col("lo")) * bins / (F.col("hi") - F.col("lo"))), F.lit(bins - 1))).cast("int")
    return per.groupBy("series", b.alias("bin")).agg(F.sum("c").alias("n"))


def train_scorer(rows: DataFrame, features: list[Column], truth: str, c: float = 1.0) -> dict:
    """Balanced, standardized logistic regression: {mean, scale, coef, intercept}; the deviation is the population's, zero counts as 1."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    x = rows.select(F.array(*features).alias("x"), F.col(truth).cast("double").alias("label"))
    k = len(features)
    s = x.agg(F.count("*").alias("n"), F.sum("label").alias("p"), *[F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(k)], *[F.stddev_pop(F.col("x")[i]).alias(f"s{i}") for i in range(k)]).first()
    mean, scale = [s[f"m{i}"] for i in range(k)], [s[f"s{i}"] or 1.0 for i in range(k)]
    z = F.array(*[(F.col("x")[i] - mean[i]) / scale[i] for i in range(k)])
    w = F.when(F.col("label") == 1, s["n"] / (2 * s["p"])).otherwise(s["n"] / (2 * (s["n"] - s["p"])))
    data = x.select(array_to_vector(z).alias("features"), "label", w.alias("w"))
    m = LogisticRegression(weightCol="w", standardization=False, regParam=1.0 / (c * s["n"]), elasticNetParam=0.0, maxIter=1000, tol=1e-10).fit(data)
    return {"mean": mean, "scale": scale, "coef": list(m.coefficients), "intercept": m.intercept}
