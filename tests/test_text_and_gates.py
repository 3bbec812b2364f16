import itertools
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from citeloom.functions import citations as C
from citeloom.functions import text as X
from citeloom.operators import evaluation as E
from citeloom.operators import gates as D
from citeloom.operators import retrieval as R
from citeloom.operators import synth as S


def one(spark, col, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(col.alias("x")).first()["x"]


def test_clean_steps(spark):
    t = "No. 12-34 foo\nFiled: May 1, 2020\nBody “x” text.   \n\n\n\nPage 5\n*12\nSee Smith v. Jones, 1 F.3d 2 (2d Cir. 1999).\r\nEnd  "
    assert one(spark, X.clean(F.col("t")), t=t) == 'Body "x" text.\n\n[CITATION].\nEnd'
    assert one(spark, X.clean(F.lit(None).cast("string"))) == "" and one(spark, X.clean(F.lit("  "))) == ""


def test_composes_unicode(spark):
    assert one(spark, X.fix_encoding(F.col("t")), t="é’�\xa0") == "é' "


def test_extraction_keeps_first_of_equal_ones_and_drops_leading_zeros(spark):
    d = spark.createDataFrame([(1, "12 U.S. 5 and 012 U.S. 05, 9 F. Supp. 2d 10; 3 F.2d"), (2, None), (3, "")], "doc_id int, text string")
    assert sorted((r["pos"], r["citation_string"]) for r in C.extract(d, "doc_id", "text").collect()) == [(1, "12 U.S. 5"), (3, "9 F. Supp. 2d 10")]


@pytest.mark.parametrize(("s", "want"), [("Smith v. Jones, 923 F.3d 1027 (9th Cir. 2019)", "Smith v. Jones"), ("392 U.S. 1", None), ("United States v. Jones", "United States v. Jones")])
def test_parties(spark, s, want):
    assert one(spark, C.party_names(F.col("s")), s=s) == want


@pytest.mark.parametrize(("s", "court", "year"), [("476 U.S. 207 (ca11)", "ca11", None), ("923 F.3d 1 (4th Cir. 2019)", "ca4", 2019), ("1 U.S. 2", None, None), ("5 F. 6 [1999]", None, 1999)])
def test_court_and_year(spark, s, court, year):
    assert one(spark, C.cited_court(F.col("s")), s=s) == court and one(spark, C.cited_year(F.col("s")), s=s) == year


def test_context(spark):
    s = F.array(*[F.lit(f"s{i}") for i in range(10)])
    assert one(spark, C.sentence_context(s, F.lit("s5"))) == "s2 s3 s4 s5 s6 s7 s8"
    assert one(spark, C.sentence_context(s, F.lit("zz"))) is None and one(spark, C.sentence_context(s, F.lit("s0"))) == "s0 s1 s2 s3"


def test_packer_adds_a_tail_chunk():
    assert X.pack_paragraphs(["a b", "c d", "e f"]) == ["a b\n\nc d\n\ne f", "e f"]
    assert X.pack_paragraphs([]) == [] and len(X.pack_paragraphs([" ".join(["w"] * 600)])[0].split()) == 510


def test_packer_closes_a_chunk_with_an_oversized_paragraph():
    paras = ["a b", "c d e f g h", "i"]
    assert X.pack_paragraphs(paras, most=6, overlap=1) == ["a b\n\nc d e f", "c d e f", "i"]
    assert X.pack_paragraphs(paras, most=6, overlap=0) == ["a b\n\nc d e f", "i"]
    assert X.chunk_spans([3, 3, 3, 3], 6, 1) == [(0, 2, False), (1, 3, False), (2, 4, False), (3, 4, False)]


def test_bench_verdict_truth_table(spark):
    rows = list(itertools.product([True, False], [True, False, None], [True, False, None], [True, False], [True, False], [0.0, 0.02, None], [0, 1, None]))
    df = spark.createDataFrame(rows, "e boolean, mc boolean, mv boolean, lc boolean, la boolean, rrf double, d int")
    v = D.bench_verdict(F.col("e"), F.col("mc"), F.col("mv"), F.col("lc"), F.col("la"), F.col("rrf"), F.lit(0.1), F.col("d"), F.lit(0.6), F.lit(0.01), F.lit(1))
    for r in df.withColumn("v", v).collect():
        l2, l3 = (r["rrf"] or 0) >= 0.01, (r["d"] or 0) >= 1
        want = "HALLUCINATED" if not r["e"] or (r["mc"] and r["mv"] is False) else "SUSPICIOUS" if r["lc"] and not r["la"] else "REAL" if l2 and l3 else "SUSPICIOUS" if l2 or l3 else "HALLUCINATED"
        assert r["v"] == want, r


def test_online_verdict_truth_table(spark):
    rows = list(itertools.product([True, False, None], [True, False], [True, False], [True, False], [True, False, None], [None, 0.39, 0.4, 0.69, 0.7], [True, False, None]))
    df = spark.createDataFrame(rows, "e boolean, mc boolean, mv boolean, lr boolean, la boolean, p double, ok boolean")
    for r in df.withColumn("v", D.online_verdict(*[F.col(c) for c in df.columns])).collect():
        if not r["e"] or (r["mc"] and not r["mv"]):
            want = "HALLUCINATED"
        elif r["lr"] and r["la"] is False:
            want = "SUSPICIOUS"
        elif r["p"] is not None:
            want = "HALLUCINATED" if r["p"] >= 0.7 else "SUSPICIOUS" if r["p"] >= 0.4 else "REAL"
        else:
            want = "SUSPICIOUS" if r["ok"] is False else "REAL"
        assert r["v"] == want, r


def test_name_ratio(spark):
    df = spark.createDataFrame([("a b", "b a"), ("abc", "acb"), (None, "x"), ("é", "")], "a string, b string")
    got = [tuple(r) for r in df.withColumns(D.name_check(F.col("a"), F.col("b"))).select("name_checked", "name_valid", "name_score").collect()]
    assert got == [(True, True, 1.0), (True, False, 0.667), (False, True, 1.0), (True, False, 0.0)]


def test_fusion_bounds(spark):
    d = spark.createDataFrame([(1, i, i, 0.5) for i in range(1, 6)], "q int, id int, rank int, dense double")
    same = R.fuse(d, d.withColumnRenamed("dense", "score"), 5).orderBy("rank").first()["rrf"]
    apart = R.fuse(d, d.withColumn("id", F.col("id") + 10).withColumnRenamed("dense", "score"), 5).orderBy("rank").first()["rrf"]
    alone = R.fuse(d, d.limit(0).withColumnRenamed("dense", "score"), 5).orderBy("rank").first()["rrf"]
    assert (same, apart, alone) == (pytest.approx(2 / 61), pytest.approx(1 / 61 + 1 / 125), pytest.approx(1 / 61 + 1 / 120))


def test_bm25_floors_negative_idf(spark):
    t = spark.createDataFrame([(1, ["a", "b"]), (2, ["a", "c"]), (3, ["a", "a"]), (4, ["d"])], "id int, tokens array<string>")
    b = R.Bm25(t)
    idf = {r["term"]: r["idf"] for r in b.terms.collect()}
    assert idf["a"] == pytest.approx(0.25 * b.mean_idf) and idf["b"] == pytest.approx(0.8472978603872034)
    top = b.top(spark.createDataFrame([(9, ["b", "b", "zz"])], "q int, tokens array<string>"), 5).collect()
    assert [(r["q"], r["id"]) for r in top] == [(9, 1)]


def test_bm25_by_brute_force_without_exchanging_pairs(spark, monkeypatch):
    monkeypatch.setattr(R, "TEXT_BLOCK", 30)
    g = random.Random(5)
    texts = {i: [f"w{int(g.random() ** 3 * 60)}" for _ in range(g.randint(0, 40))] for i in range(200)}
    asked = {i: [f"w{g.randint(0, 70)}" for _ in range(12)] for i in range(20)} | {20: ["w0"], 21: ["none"], 22: []}
    b = R.Bm25(spark.createDataFrame(list(texts.items()), "id bigint, tokens array<string>"))
    top = b.top(spark.createDataFrame(list(asked.items()), "q bigint, tokens array<string>"), 4, block=7)
    assert "Join" not in top._jdf.queryExecution().executedPlan().toString()
    avg, want = sum(map(len, texts.values())) / 200, []
    df = Counter(t for x in texts.values() for t in set(x))
    raw = {t: math.log(200 - n + 0.5) - math.log(n + 0.5) for t, n in df.items()}
    idf = {t: x if x >= 0 else 0.25 * sum(raw.values()) / len(raw) for t, x in raw.items()}
    for q, ts in asked.items():
        scores = [(-round(sum(idf[t] * x.count(t) * 2.5 / (x.count(t) + 1.5 * (0.25 + 0.75 * len(x) / avg)) for t in ts if t in x), 9), i) for i, x in texts.items() if set(ts) & set(x)]
        want += [(q, i, -s, r) for r, (s, i) in enumerate(sorted(scores)[:4], 1)]
    got = sorted(top.collect(), key=lambda r: (r["q"], r["rank"]))
    assert [(r["q"], r["id"], r["rank"]) for r in got] == [(q, i, r) for q, i, _, r in want]
    assert [r["score"] for r in got] == pytest.approx([s for _, _, s, _ in want], abs=2e-9)


def test_auc_ties_and_one_class(spark):
    d = spark.createDataFrame([(0.1, False), (0.5, True), (0.5, False), (0.9, True)], "p double, y boolean")
    assert E.auc(d, "p", "y").first()["auc"] == pytest.approx(0.875)
    assert E.auc(d.filter("y"), "p", "y").first()["auc"] is None


def test_rates_of_nothing(spark):
    r = E.rates(spark.createDataFrame([(0, 0, 0, 0)], "tp int, fp int, fn int, tn int")).first()
    assert (r["precision"], r["recall"], r["f1"], r["accuracy"]) == (0, 0, 0, 0)


def test_scorer_matches_newton(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    X_, y = rng.normal(size=(120, 3)), rng.random(120) < 0.3
    df = spark.createDataFrame([(*map(float, x), bool(t)) for x, t in zip(X_, y)], "a double, b double, c double, y boolean")
    m = E.train_scorer(df, [F.col("a"), F.col("b"), F.col("c")], "y")
    Z = (X_ - X_.mean(0)) / X_.std(0)
    A, w, t = np.c_[Z, np.ones(120)], np.where(y, 120 / (2 * y.sum()), 120 / (2 * (~y).sum())), y.astype(float)
    b = np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-A @ b))
        reg = np.r_[b[:3], 0]
        H = A.T @ (A * (w * p * (1 - p))[:, None]) + np.diag([1, 1, 1, 0])
        b -= np.linalg.solve(H, A.T @ (w * (p - t)) + reg)
    assert np.allclose([*m["coef"], m["intercept"]], b, atol=1e-4)


def test_corruption_stays_in_range(spark):
    df = spark.createDataFrame([(i, f"{i} U.S. 1", 2024, "ca1") for i in range(40)], "k bigint, c string, y int, ct string")
    for r in S.corrupted(df, "k", "c", "y", "ct", spark.createDataFrame([(["dx"],)], "courts array<string>")).collect():
        assert ("[" in r["corrupted_citation"]) == (r["corruption_type"] == "year") and "(ca1)" not in r["corrupted_citation"]


def test_nearest_is_exact_and_skips_itself(spark):
    import numpy as np

    v = np.random.default_rng(0).normal(size=(200, 8))
    v[3] = v[4]
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id bigint, embedding array<float>")
    got = R.nearest(df.filter("id < 20").withColumnRenamed("id", "q"), df, 3, 8, block=7).collect()
    u = v.astype("float32").astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    for q in range(20):
        s = np.round(u @ u[q], 12)
        s[q] = -9
        want = sorted(range(200), key=lambda i: (-s[i], i))[:3]
        assert [r["id"] for r in sorted((r for r in got if r["q"] == q), key=lambda r: r["rank"])] == want
