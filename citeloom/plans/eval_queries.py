"""Evaluation queries over the benchmark's raw scores."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeloom import constants as K
from citeloom.operators import evaluation as E
from citeloom.operators import gates as D
from citeloom.plans import verdict_queries as Q
from citeloom.session import table

_POS = "('HALLUCINATED', 'SUSPICIOUS')"
_CNT = "count_if({p} AND {t}) AS tp, count_if({p} AND NOT {t}) AS fp, count_if(NOT {p} AND {t}) AS fn, count_if(NOT {p} AND NOT {t}) AS tn"
_PT = _CNT.format(p=f"coalesce(pred IN {_POS}, false)", t=f"coalesce(label IN {_POS}, false)")
_PR = "(CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0.0 END)"
_RE = "(CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0.0 END)"
_RATES = f"round_even({_PR}, 4) AS precision, round_even({_RE}, 4) AS recall, round_even(CASE WHEN {_PR} + {_RE} > 0 THEN 2 * {_PR} * {_RE} / ({_PR} + {_RE}) ELSE 0.0 END, 4) AS f1, round_even(CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn) / (tp + fp + fn + tn)::DOUBLE ELSE 0.0 END, 4) AS accuracy"


def _conf(df, *by):
    return E.rates(df.groupBy(*by).agg(*E.confusion(F.col("pred").isin(*E.POSITIVE), F.col("label").isin(*E.POSITIVE))))


def confusion_overall(spark, sf):
    return _conf(Q._bench(spark, sf))


def confusion_by_subtype(spark, sf):
    return _conf(Q._bench(spark, sf).withColumn("subtype", F.coalesce("subtype", F.lit("REAL"))), "subtype")


def confusion_rollup(spark, sf):
    """Both levels in one pass by grouping sets."""
    r = Q._bench(spark, sf).withColumn("subtype", F.coalesce("subtype", F.lit("REAL")))
    g = r.rollup("subtype").agg(*E.confusion(F.col("pred").isin(*E.POSITIVE), F.col("label").isin(*E.POSITIVE)))
    return E.rates(g.withColumn("subtype", F.coalesce("subtype", F.lit("ALL"))))


def layer_metrics(spark, sf):
    """Each layer alone, on the rows it decides about."""
    r = Q.benchmark_rows(spark, sf)
    hit = (F.col("rrf_score") >= K.RRF_CUT) | (F.col("dense_score") >= K.SIM_CUT)
    layers = [("L1", F.lit(True), ~F.col("exists")), ("L2", F.col("exists"), ~hit), ("L2b", F.col("exists") & F.col("llm_checked"), ~F.col("llm_accurate")), ("L3", F.col("exists"), ~F.coalesce(F.col("density_score") >= 1, F.lit(False))), ("L4", F.col("exists") & F.col("meta_checked"), ~F.col("metadata_valid"))]
    rows = r.select("label", F.explode(F.array(*[F.struct(F.lit(n).alias("layer"), k.alias("kept"), p.alias("pred")) for n, k, p in layers])).alias("x")).select("label", "x.*").filter("kept")
    return E.rates(rows.groupBy("layer").agg(*E.confusion(F.col("pred"), F.col("label").isin(*E.POSITIVE))))


def _sweep(spark, sf):
    r = Q.benchmark_rows(spark, sf)
    return E.sweep(r, lambda s, rr, d: D.bench_verdict(*[F.col(c) for c in ("exists", "meta_checked", "metadata_valid", "llm_checked", "llm_accurate", "rrf_score", "dense_score", "density_score")], s, rr, d))


def threshold_sweep(spark, sf):
    return _sweep(spark, sf)


def best_threshold(spark, sf):
    return _sweep(spark, sf).orderBy(F.col("f1").desc(), F.col("precision").desc(), "grid_idx").limit(1)


def sweep_top20(spark, sf):
    return _sweep(spark, sf).orderBy(F.col("f1").desc(), "grid_idx").limit(20).select("grid_idx", "f1")


_KEY = "(benchmark_id * 1103515245 + 42 * 12345) % 2147483647"
_STRATA = "label, subtype"


def _strata():
    return ["label", "subtype"]


def stratified_split(spark, sf):
    return E.stratified_split(Q.benchmark_rows(spark, sf), "benchmark_id", _strata()).select("benchmark_id", "split")


def _folds(spark, sf):
    return E.folds(Q._bench(spark, sf), "benchmark_id", _strata())


def kfold_metrics(spark, sf):
    return _conf(_folds(spark, sf), "fold")


def fold_anomalies(spark, sf):
    m = kfold_metrics(spark, sf).select("fold", "f1")
    mean = F.avg("f1").over(Window.partitionBy())  # ten rows
    return m.select("fold", "f1", (mean - F.col("f1") > 0.05).alias("anomalous"))


def cv_summary(spark, sf):
    m = kfold_metrics(spark, sf)
    return m.agg(*[F.bround(f(c), 4).alias(f"{n}_{c}") for c in ("precision", "recall", "f1") for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))])


def _scored(spark, sf):
    r = Q.benchmark_rows(spark, sf).filter(F.col("exists") & F.coalesce("metadata_valid", F.lit(True)))
    return r.select("benchmark_id", D.probability(D.logit(Q.MODEL)).alias("p"), F.col("label").isin(*E.POSITIVE).alias("y"))


_SCORED = f"{Q.RAW}, s AS (SELECT benchmark_id, {Q._PROB} AS p, coalesce(label IN {_POS}, false) AS y FROM raw WHERE \"exists\" AND coalesce(metadata_valid, true))"


def calibration(spark, sf):
    return E.calibration(_scored(spark, sf), "p", "y")


def roc_auc(spark, sf):
    d = _scored(spark, sf).select(F.round("p", 9).alias("p"), "y")
    return E.auc(d, "p", "y").select(F.round("auc", 9).alias("auc"))


def classification_report(spark, sf):
    d = _scored(spark, sf).select((F.col("p") >= 0.5).alias("h"), "y")
    both = d.select(F.explode(F.array(F.struct(F.lit("positive").alias("class"), F.col("h").alias("pred"), F.col("y").alias("t")), F.struct(F.lit("negative").alias("class"), (~F.col("h")).alias("pred"), (~F.col("y")).alias("t")))).alias("x")).select("x.*")
    r = E.rates(both.groupBy("class").agg(*E.confusion(F.col("pred"), F.col("t"))))
    return r.select("class", "precision", "recall", "f1", (F.col("tp") + F.col("fn")).alias("support"))


def density_histogram(spark, sf):
    return E.histogram(Q.benchmark_rows(spark, sf), F.col("label"), "density_score")


def fn_fp_lists(spark, sf):
    b = Q._bench(spark, sf)
    kind = F.when((F.col("label") == "HALLUCINATED") & (F.col("pred") == "REAL"), "false_negative").when((F.col("label") == "REAL") & (F.col("pred") == "HALLUCINATED"), "false_positive")
    return b.withColumn("kind", kind).filter("kind is not null").select("kind", "benchmark_id", "label", "pred")


def prediction_rows(spark, sf):
    return Q._bench(spark, sf).select("benchmark_id", "label", "pred", (F.col("label") == F.col("pred")).alias("correct"))


def label_counts(spark, sf):
    b = table(spark, sf, "benchmark_items")
    name = lambda c: F.coalesce(F.col(c), F.lit("none")).alias(c)
    return b.groupBy(name("label"), name("subtype"), name("corruption_type")).agg(F.count("*").alias("n"))


def verdict_counts(spark, sf):
    return Q._bench(spark, sf).groupBy(F.col("pred").alias("verdict")).agg(F.count("*").alias("n"))


def suspicious_breakdown(spark, sf):
    return Q._bench(spark, sf).filter("pred = 'SUSPICIOUS'").groupBy("label").agg(F.count("*").alias("n"))


def feature_stats(spark, sf):
    r = Q.benchmark_rows(spark, sf).select(F.posexplode(F.array(*D.features())).alias("i", "x"))
    return r.groupBy("i").agg(F.round(F.avg("x"), 9).alias("mean"), F.round(F.stddev_pop("x"), 9).alias("std"))


def trained_weights(spark, sf):
    m = E.train_scorer(Q.benchmark_rows(spark, sf).filter(F.col("exists") & F.coalesce("metadata_valid", F.lit(True))).withColumn("y", F.col("label").isin(*E.POSITIVE)), D.features(), "y")
    rows = [(n, float(c), float(mu), float(sc)) for n, c, mu, sc in zip(K.FEATURES, m["coef"], m["mean"], m["scale"])] + [("intercept", float(m["intercept"]), 0.0, 1.0)]
    return spark.createDataFrame(rows, "feature string, weight double, mean double, scale double")


_NAMES = (
    "confusion_overall confusion_by_subtype confusion_rollup layer_metrics threshold_sweep best_threshold sweep_top20 stratified_split kfold_metrics fold_anomalies cv_summary calibration roc_auc classification_report density_histogram fn_fp_lists prediction_rows "
    "label_counts verdict_counts suspicious_breakdown feature_stats trained_weights"
).split()
QUERIES = {n: globals()[n] for n in _NAMES}
_SWEEP = f"""{Q.RAW}, simc AS (SELECT unnest({K.SIM_GRID}::DOUBLE[]) AS sim_cut, generate_subscripts({K.SIM_GRID}::DOUBLE[], 1) - 1 AS si), rrfs AS (SELECT unnest({K.RRF_GRID}::DOUBLE[]) AS rrf_cut, generate_subscripts({K.RRF_GRID}::DOUBLE[], 1) - 1 AS ri), dens AS (SELECT unnest({K.DENSITY_GRID}) AS density_cut, generate_subscripts({K.DENSITY_GRID}, 1) - 1 AS di),
g AS (SELECT CAST(si * 30 + ri * 5 + di AS INTEGER) AS grid_idx, sim_cut, rrf_cut, CAST(density_cut AS INTEGER) AS density_cut FROM simc, rrfs, dens),
pr AS (SELECT g.*, label, CASE WHEN NOT "exists" THEN 'HALLUCINATED' WHEN meta_checked AND NOT metadata_valid THEN 'HALLUCINATED' WHEN llm_checked AND NOT llm_accurate THEN 'SUSPICIOUS'
  WHEN (rrf_score >= rrf_cut OR dense_score >= sim_cut) AND density_score >= density_cut THEN 'REAL' WHEN NOT (rrf_score >= rrf_cut OR dense_score >= sim_cut) AND NOT coalesce(density_score >= density_cut, false) THEN 'HALLUCINATED' ELSE 'SUSPICIOUS' END AS pred FROM raw, g),
c AS (SELECT grid_idx, sim_cut, rrf_cut, density_cut, {_PT} FROM pr GROUP BY ALL), sw AS (SELECT *, {_RATES} FROM c)"""
_FOLD = f"{Q.BENCH}, f AS (SELECT *, CAST((row_number() OVER (PARTITION BY {_STRATA} ORDER BY {_KEY}, benchmark_id) - 1) % 10 AS INTEGER) AS fold FROM bench), fc AS (SELECT fold, {_PT} FROM f GROUP BY fold), km AS (SELECT *, {_RATES} FROM fc)"
_LAYERS = [("L1", "true", 'NOT "exists"'), ("L2", '"exists"', "NOT (rrf_score >= 0.01::DOUBLE OR dense_score >= 0.6::DOUBLE)"), ("L2b", '"exists" AND llm_checked', "NOT llm_accurate"), ("L3", '"exists"', "NOT coalesce(density_score >= 1, false)"), ("L4", '"exists" AND meta_checked', "NOT metadata_valid")]
ORACLES = {
    "confusion_overall": f"WITH {Q.BENCH}, c AS (SELECT {_PT} FROM bench) SELECT *, {_RATES} FROM c",
    "confusion_by_subtype": f"WITH {Q.BENCH}, c AS (SELECT coalesce(subtype, 'REAL') AS subtype, {_PT} FROM bench GROUP BY 1) SELECT *, {_RATES} FROM c",
    "confusion_rollup": f"WITH {Q.BENCH}, c AS (SELECT coalesce(subtype, 'REAL') AS subtype, {_PT} FROM bench GROUP BY 1 UNION ALL SELECT 'ALL', {_PT} FROM bench) SELECT *, {_RATES} FROM c",
    "layer_metrics": f"WITH {Q.RAW}, c AS (" + " UNION ALL ".join(f"SELECT '{n}' AS layer, {_CNT.format(p=f'coalesce({p}, false)', t=f'coalesce(label IN {_POS}, false)')} FROM raw WHERE {k}" for n, k, p in _LAYERS) + f") SELECT *, {_RATES} FROM c",
    "threshold_sweep": f"WITH {_SWEEP} SELECT * FROM sw",
    "best_threshold": f"WITH {_SWEEP} SELECT * FROM sw ORDER BY f1 DESC, precision DESC, grid_idx LIMIT 1",
    "sweep_top20": f"WITH {_SWEEP} SELECT grid_idx, f1 FROM sw ORDER BY f1 DESC, grid_idx LIMIT 20",
    "stratified_split": f"WITH {Q.RAW} SELECT benchmark_id, CASE WHEN row_number() OVER (PARTITION BY {_STRATA} ORDER BY {_KEY}, benchmark_id) <= floor(count(*) OVER (PARTITION BY {_STRATA}) * 0.8::DOUBLE) THEN 'train' ELSE 'test' END AS split FROM raw",
    "kfold_metrics": f"WITH {_FOLD} SELECT * FROM km",
    "fold_anomalies": f"WITH {_FOLD} SELECT fold, f1, avg(f1) OVER () - f1 > 0.05 AS anomalous FROM km",
    "cv_summary": f"WITH {_FOLD} SELECT " + ", ".join(f"round_even({f}({c}), 4) AS {n}_{c}" for c in ("precision", "recall", "f1") for n, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max"))) + " FROM km",
    "calibration": f"WITH {_SCORED} SELECT CAST(least(floor(p * 5), 4) AS INTEGER) AS bucket, count(*) AS n, round_even(avg(CAST(y AS DOUBLE)), 4) AS rate FROM s GROUP BY 1",
    "roc_auc": f"WITH {_SCORED}, r AS (SELECT y, rank() OVER (ORDER BY round(p, 9)) + (count(*) OVER (PARTITION BY round(p, 9)) - 1) / 2.0 AS rk FROM s) SELECT round((sum(CASE WHEN y THEN rk ELSE 0 END) - count_if(y) * (count_if(y) + 1) / 2) / (count_if(y) * count_if(NOT y))::DOUBLE, 9) AS auc FROM r",
    "classification_report": f"WITH {_SCORED}, x AS (SELECT 'positive' AS class, p >= 0.5 AS pred, y AS t FROM s UNION ALL SELECT 'negative', NOT p >= 0.5, NOT y FROM s), c AS (SELECT class, {_CNT.format(p='pred', t='t')} FROM x GROUP BY class), r AS (SELECT *, {_RATES} FROM c) SELECT class, precision, recall, f1, tp + fn AS support FROM r",
    "density_histogram": f"WITH {Q.RAW}, ds AS (SELECT label AS series, CAST(density_score AS DOUBLE) AS x FROM raw WHERE density_score IS NOT NULL), e AS (SELECT series, min(x) AS lo, max(x) AS hi FROM ds GROUP BY series) SELECT ds.series AS series, CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((x - lo) * 20 / (hi - lo)), 19) END AS INTEGER) AS bin, count(*) AS n FROM ds JOIN e ON ds.series IS NOT DISTINCT FROM e.series GROUP BY 1, 2",
    "fn_fp_lists": f"WITH {Q.BENCH} SELECT CASE WHEN label = 'HALLUCINATED' THEN 'false_negative' ELSE 'false_positive' END AS kind, benchmark_id, label, pred FROM bench WHERE (label = 'HALLUCINATED' AND pred = 'REAL') OR (label = 'REAL' AND pred = 'HALLUCINATED')",
    "prediction_rows": f"WITH {Q.BENCH} SELECT benchmark_id, label, pred, label = pred AS correct FROM bench",
    "label_counts": "SELECT coalesce(label, 'none') AS label, coalesce(subtype, 'none') AS subtype, coalesce(corruption_type, 'none') AS corruption_type, count(*) AS n FROM benchmark_items GROUP BY ALL",
    "verdict_counts": f"WITH {Q.BENCH} SELECT pred AS verdict, count(*) AS n FROM bench GROUP BY pred",
    "suspicious_breakdown": f"WITH {Q.BENCH} SELECT label, count(*) AS n FROM bench WHERE pred = 'SUSPICIOUS' GROUP BY label",
    "feature_stats": f"WITH {Q.RAW}, x AS (" + " UNION ALL ".join(f"SELECT {i} AS i, {x} AS x FROM raw" for i, x in enumerate(Q._feature_sql())) + ") SELECT i, round(avg(x), 9) AS mean, round(stddev_pop(x), 9) AS std FROM x GROUP BY i",
}
