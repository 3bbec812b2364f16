import numpy as np
import pytest

from citeloom.llm import forest


def frame(spark, rows, dim=8):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 7, "d") for i, v in rows], "vec_id bigint, embedding array<float>, id int, near string")


def brute(V, ids, k):
    D = V.astype(np.float32).astype(float)
    D /= np.linalg.norm(D, axis=1)[:, None]
    S = np.round(D @ D.T, 12)
    np.fill_diagonal(S, -9)
    return {i: [ids[j] for j in sorted(range(len(ids)), key=lambda j: (-S[a, j], ids[j]))[:k] if S[a, j] > -5] for a, i in enumerate(ids)}


def found(df, **kw):
    got = {}
    for r in sorted(forest.similar_vectors(df, **kw).collect(), key=lambda r: (r["id"], -r["cosine"], r["near"])):
        got.setdefault(r["id"], []).append(r["near"])
    return got


def test_small_collection_is_exact_with_copies_ties_and_unusable_rows(spark):
    rng = np.random.default_rng(3)
    V = rng.normal(size=(60, 8))
    V[10:22] = V[5]  # a group of copies larger than k
    V[30] = V[31] * 1.0
    rows = [(i, v) for i, v in enumerate(V)] + [(100, None), (101, [0.0] * 8), (102, [1.0] * 7), (103, [float("nan")] * 8), (104, [float("inf")] + [1.0] * 7), (105, [None] + [1.0] * 7)]
    assert found(frame(spark, rows), dim=8, k=5) == brute(V, list(range(60)), 5)


def test_repeated_rows_count_once_and_few_vectors(spark):
    assert found(frame(spark, [(1, [1] * 8), (1, [1] * 8), (2, [2] * 8)]), dim=8) == {1: [2], 2: [1]}
    assert found(frame(spark, []), dim=8) == {} and found(frame(spark, [(1, [1] * 8)]), dim=8) == {}


def test_recall_beyond_one_block(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 16))
    V = centres[rng.integers(0, 40, 3000)] + 0.7 * rng.normal(size=(3000, 16))
    df = frame(spark, list(enumerate(V)), 16)
    want = brute(V, list(range(3000)), 5)
    got = found(df, dim=16, k=5, block=400)
    hit = sum(len(set(got[i]) & set(want[i])) for i in want) / (5 * len(want))
    assert hit >= 0.9, hit


def test_recall_over_several_stretches(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16))
    V = centres[rng.integers(0, 40, 2000)] + 0.7 * rng.normal(size=(2000, 16))
    want = brute(V, list(range(2000)), 5)
    got = found(frame(spark, list(enumerate(V)), 16), dim=16, k=5, block=300, stretch=800)
    assert sum(len(set(got[i]) & set(want[i])) for i in want) / (5 * len(want)) >= 0.9


@pytest.mark.parametrize("noise", [0.05, 0.001])
def test_a_crowd_of_near_copies_is_parted(spark, noise):
    rng = np.random.default_rng(9)
    V = rng.normal(size=(3000, 16))
    V[::3] = V[0] + noise * rng.normal(size=(1000, 16))  # a third of all rows, many blocks and two stretches
    want = brute(V, list(range(3000)), 5)
    got = found(frame(spark, list(enumerate(V)), 16), dim=16, k=5, block=200, stretch=800)
    hit = [len(set(got[i]) & set(want[i])) / 5 for i in want]
    assert np.mean(hit[::3]) >= 0.9 and np.mean(hit) >= 0.9, (np.mean(hit[::3]), np.mean(hit))


def test_blocks_cover_every_row_once_also_where_all_hashes_agree():
    for h in (np.sort(np.random.default_rng(0).integers(0, 1 << 60, 5000)), np.zeros(5000, np.int64), np.array([5], np.int64)):
        seen = np.zeros(len(h), int)
        for lo, hi, a, b in forest.blocks(h, 300, 75):
            assert a <= lo and hi <= b and (b - a <= 600 or (h[lo:hi] == h[lo]).all())
            seen[lo:hi] += 1
        assert (seen == 1).all()


@pytest.mark.parametrize("n", [0, 1, 5])
def test_moments(spark, n):
    V = np.random.default_rng(1).normal(size=(n, 4))
    df = spark.createDataFrame([([float(x) for x in v],) for v in V], "v array<float>")
    c, mean, cov = forest.moments(df, 4)
    assert c == n and (n < 2 or np.allclose(mean, (V / np.linalg.norm(V, axis=1)[:, None]).mean(0), atol=1e-6))
