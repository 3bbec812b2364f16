"""The k most similar vectors of every vector with a hash-prefix forest.

Every tree gives each vector one long hash string: signs of projections around a mean, on random directions drawn with the
collection's covariance, which part near neighbours less often. The strings are sorted. In a sorted array the
operator descends to the longest prefix that still holds enough vectors; a prefix with too few ascends to its
neighbours in the array. All vectors under a prefix are compared as one block, in single precision, and the best
re-ranked in double.

Trees come in two layers. An outer tree's array is range-partitioned into stretches, the only exchange of vectors; within its
stretch every task grows INNER trees of its own, whose directions are drawn around the stretch's mean with its covariance.
So the exchange carries the vectors once per outer tree, and near copies of one vector, which no direction of the whole collection
parts, are parted by those of their stretch. The first bits of an outer string come from splits learned on a bounded sample, each in
the middle of its part: they part a crowd as well as anything else, so that no stretch has to be cut blindly.

Exact copies are one node that carries the few smallest ids of its group, so a group that holds a third of
the rows costs one row in the forest and no pair more than the result has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeloom.session import cut

BITS = 60
#: Rows of one sorted stretch that a task holds at once, and trees grown within it.
STRETCH, INNER = 60_000, 5
#: Vectors on which the first bits of the outer strings are learned, and the fewest of them that are split further.
SAMPLE, FEWEST = 40_000, 128


def usable(df: DataFrame, key: str, col: str, dim: int) -> DataFrame:
    """(id, v): vectors that are not null, have dim finite numbers and are not all zero."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    d = df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{col}`").alias("v")).filter("id is not null and v is not null")
    return d.filter((F.size("v") == dim) & finite & F.exists("v", lambda x: x != 0))


def copy_groups(vectors: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """One row (id, ids, v) per distinct vector with its k + 1 smallest ids; and (h1, h2, id) of all rows.

    The window keeps k + 1 rows of a group in each map task before anything is shuffled.
    """
    keyed = vectors.select("id", "v", F.xxhash64("v").alias("h1"), F.hash("v").alias("h2"))
    w = Window.partitionBy("h1", "h2").orderBy("id")
    first = keyed.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k + 1)
    nodes = first.groupBy("h1", "h2").agg(F.min("id").alias("id"), F.sort_array(F.collect_set("id")).alias("ids"), F.min_by("v", "id").alias("v"))
    return nodes, keyed.select("h1", "h2", "id")


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    flat = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return np.asarray(flat.flatten()).reshape(-1, dim)


def blocks(h: np.ndarray, most: int, least: int) -> Iterator[tuple[int, int, int, int]]:
    """(lo, hi, from, to): rows lo..hi of the sorted array are compared with rows from..to."""
    n, work = len(h), [(0, len(h), BITS - 1)]
    while work:
        lo, hi, bit = work.pop()
        if hi - lo <= 0:
            continue
        if hi - lo < least and n > hi - lo:  # too short a prefix: ascend on both sides at once
            mid, half = (lo + hi) // 2, most // 2
            a = max(0, min(mid - half, n - most))
            yield lo, hi, min(a, lo), max(min(n, a + most), hi)
        elif hi - lo <= most:
            yield lo, hi, lo, hi
        elif bit < 0:  # one string for more rows than a block holds
            yield lo, hi, lo, hi
        else:
            cutoff = (h[lo] >> (bit + 1) << (bit + 1)) | (1 << bit)
            mid = lo + int(np.searchsorted(h[lo:hi], cutoff))
            work += [(mid, hi, bit - 1), (lo, mid, bit - 1)]


def _strings(X: np.ndarray, R: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """The signs of X's projections on R's directions around shift, the first one in the highest bit."""
    bits = (X @ R) > shift
    return bits @ (1 << np.arange(R.shape[1] - 1, -1, -1, dtype=np.int64))


def _directions(mean: np.ndarray, cov: np.ndarray, n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """n random directions drawn with a covariance, and the mean's place on each."""
    lam, axes = np.linalg.eigh(cov)
    R = (axes @ (np.sqrt(np.maximum(lam, lam[-1] * 1e-9 + 1e-30))[:, None] * rng.standard_normal((len(mean), n)))).astype(np.float32)
    R /= np.maximum(np.sqrt((R * R).sum(0)), 1e-30)
    return R, mean.astype(np.float32) @ R


def _merge(near: np.ndarray, cos: np.ndarray, r: np.ndarray, c: np.ndarray, s: np.ndarray, ids: np.ndarray) -> None:
    """Take further candidates c with cosines s of rows r into the lists near, cos: by cosine, then by id, each once."""
    rows, k = np.unique(r), near.shape[1]
    r = np.concatenate([np.repeat(rows, k), r])
    c = np.concatenate([near[rows].ravel(), c])
    s = np.concatenate([cos[rows].ravel(), s])
    r, c, s = r[c >= 0], c[c >= 0], s[c >= 0]
    o = np.lexsort((ids[c], -s, r))
    r, c, s = r[o], c[o], s[o]
    # Equal candidates of a row have equal cosines and ids, so they stand side by side.
    once = np.concatenate([[True], (r[1:] != r[:-1]) | (c[1:] != c[:-1])])
    r, c, s = r[once], c[once], s[once]
    start = np.concatenate([[0], np.flatnonzero(r[1:] != r[:-1]) + 1])
    at = np.arange(len(r)) - np.repeat(start, np.diff(np.concatenate([start, [len(r)]])))
    keep = at < k
    near[r[keep], at[keep]], cos[r[keep], at[keep]] = c[keep], s[keep]


def _exact(D: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(r))
    for a in range(0, len(r), 50_000):
        out[a : a + 50_000] = np.einsum("ij,ij->i", D[r[a : a + 50_000]], D[c[a : a + 50_000]])
    return np.round(out, 12)


def _descents(D: np.ndarray, ids: np.ndarray, k: int, most: int, rng: np.random.Generator) -> Iterator[tuple[np.ndarray, int, int, int, int]]:
    """(order, lo, hi, from, to): the blocks of one tree over all rows.

    Rows that share a whole string and are more than a block grow a tree of their own, around their own mean; only where that parts
    nothing more (directions equal to the last digit) neighbouring windows are compared.
    """
    work = [np.arange(len(ids))]
    while work:
        part = work.pop()
        E = D[part]
        mean = E.mean(0)
        E = E - mean
        R, _ = _directions(mean, E.T @ E / len(part), BITS, rng)
        h = _strings(E.astype(np.float32), R, np.zeros(BITS, np.float32))
        o = np.lexsort((ids[part], h))
        order = part[o]
        for lo, hi, a, b in blocks(h[o], most, max(k + 2, most // 4)):
            if hi - lo <= most:
                yield order, lo, hi, a, b
            elif hi - lo < len(part):
                work.append(order[lo:hi])
            else:
                for x in range(lo, hi, most // 2):
                    yield order, x, min(hi, x + most // 2), max(lo, x - most // 4), min(hi, x + most // 2 + most // 4)


def neighbours(ids: np.ndarray, V: np.ndarray, k: int, most: int, trees: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The best k of each row by `trees` trees over these rows: ids (-1: none) and cosines in double precision.

    A tree after the first looks only for what beats a row's worst so far, which costs a comparison instead of a selection.
    """
    n = len(ids)
    D = V.astype(np.float64)
    D /= np.sqrt((D * D).sum(1))[:, None]
    near, cos = np.full((n, k), -1, np.int64), np.full((n, k), -9.0)
    if n < 2:
        return near, cos
    rng = np.random.default_rng(seed)
    for t in range(trees if n > most else 1):
        for order, lo, hi, a, b in _descents(D, ids, k, most, rng):
            # Around the block's mean single precision tells also near copies apart: cos - 1 = yi.yj - |yi|²/2 - |yj|²/2.
            cand = order[a:b]
            Y = D[cand]
            Y = (Y - Y.mean(0)).astype(np.float32)
            half, one = (Y * Y).sum(1, keepdims=True) / 2, np.ones((len(Y), 1), np.float32)
            left, right, slack = np.hstack([Y, -half, one]), np.hstack([Y, one, -half]).T.copy(), 4e-6 * float(half.max()) + 1e-12
            for r in range(lo, hi, 1024):
                to = min(hi, r + 1024)
                rows = order[r:to]
                S = left[r - a : to - a] @ right
                S[np.arange(to - r), np.arange(r - a, to - a)] = -9
                hit = S > (cos[rows, -1] - 1 - slack)[:, None].astype(np.float32) if t else None
                if hit is not None and np.count_nonzero(hit) <= 48 * len(rows):
                    i, j = np.nonzero(hit)
                else:
                    m = min(k + 3, S.shape[1] - 1)
                    i, j = np.repeat(np.arange(len(rows)), m), np.argpartition(S, S.shape[1] - m, axis=1)[:, S.shape[1] - m :].ravel()
                i, j = rows[i], cand[j]
                i, j = i[i != j], j[i != j]
                if len(i):
                    _merge(near, cos, i, j, _exact(D, i, j), ids)
    return np.where(near >= 0, ids[near], -1), cos


class Splits:
    """The first bits of an outer tree: a part of the sample is split in the middle of a direction drawn with its own covariance.

    Arrays by node: direction, place of the split, children (0: none). A leaf knows its mean, around which the further bits are taken.
    """

    def __init__(self, S: np.ndarray, deep: int, rng: np.random.Generator):
        self.way, self.at, self.kids, self.mean, self.path = [], [], [], [], []
        self.deep = deep

        def grow(part: np.ndarray, level: int, path: int) -> int:
            me = len(self.way)
            mean = part.mean(0) if len(part) else np.zeros(S.shape[1])
            self.way.append(np.zeros(S.shape[1], np.float32))
            self.at.append(np.float32(0))
            self.kids.append((0, 0))
            self.mean.append(mean)
            self.path.append(path << (deep - level))
            if level < deep and len(part) >= FEWEST:
                R, _ = _directions(mean, np.cov(part.T, bias=True), 1, rng)
                x = part.astype(np.float32) @ R[:, 0]
                middle = np.float32(np.median(x))
                if (x > middle).any():
                    self.way[me], self.at[me] = R[:, 0], middle
                    self.kids[me] = (grow(part[x <= middle], level + 1, path << 1), grow(part[x > middle], level + 1, path << 1 | 1))
            return me

        grow(S, 0, 0)
        self.way, self.at, self.kids, self.mean, self.path = np.array(self.way), np.array(self.at), np.array(self.kids), np.array(self.mean), np.array(self.path, np.int64)

    def leaf(self, X: np.ndarray) -> np.ndarray:
        at = np.zeros(len(X), np.int64)
        for _ in range(self.deep):
            low, high = self.kids[at, 0], self.kids[at, 1]
            right = np.einsum("ij,ij->i", X, self.way[at]) > self.at[at]
            at = np.where(low > 0, np.where(right, high, low), at)
        return at


def moments(nodes: DataFrame, dim: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and covariance of all vectors at unit length; each task sums its own rows first."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, one, two = 0, np.zeros(dim), np.zeros((dim, dim))
        for b in batches:
            V = _matrix(b.column(0), dim).astype(np.float64)
            V /= np.sqrt((V * V).sum(1))[:, None]
            n, one, two = n + len(V), one + V.sum(0), two + V.T @ V
        if n:
            flat = np.concatenate([[n], one, two.ravel()])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["i", "x"])

    rows = nodes.select("v").mapInArrow(sums, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()  # 1 + dim + dim^2 numbers
    flat = np.zeros(1 + dim + dim * dim)
    for r in rows:
        flat[r["i"]] = r["x"]
    n = max(1.0, flat[0])
    mean = flat[1 : 1 + dim] / n
    return int(flat[0]), mean, flat[1 + dim :].reshape(dim, dim) / n - np.outer(mean, mean)


def similar_vectors(df: DataFrame, key: str = "vec_id", col: str = "embedding", dim: int = 64, k: int = 5, outer: int | None = None, inner: int = INNER, block: int = 4000, stretch: int = STRETCH, seed: int = 7) -> DataFrame:
    """(id, near, cosine): for every usable vector its k most similar others; equal cosines (12 decimals) by smaller id.

    Unusable vectors (null, wrong length, non-finite, all zero) neither ask nor answer. Scale plays no part.
    Exact copies are others with cosine 1. Fewer than k + 1 vectors give what there is; an empty table nothing. Repeated ids count once.
    Crowds of nearly equal vectors larger than a stretch are parted by learned splits; within the last decimals their order may be missed.
    """
    nodes, members = copy_groups(usable(df, key, col, dim), k)
    nodes = cut(nodes)
    count, mean, cov = moments(nodes, dim)
    level = max(0, math.ceil(math.log2(max(1.0, count / stretch))))
    if outer is None:
        outer = 3 + 2 * level
    rng = np.random.default_rng(seed)
    ways = [_directions(mean, cov, BITS, rng) for _ in range(outer)]
    deep, splits = 0, []
    if level:
        deep = min(10, level + 2)
        rows = nodes.select("v").sample(min(1.0, 1.2 * SAMPLE / max(1, count)), seed).limit(SAMPLE).toArrow()  # bounded
        S = _matrix(rows["v"], dim).astype(np.float64)
        S /= np.sqrt((S * S).sum(1))[:, None]
        splits = [Splits(S, deep, rng) for _ in range(outer)]
    sent = nodes.sparkSession.sparkContext.broadcast((splits, ways))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splits, ways = sent.value
        for b in batches:
            V = _matrix(b.column(1), dim).astype(np.float64)
            X = (V / np.sqrt((V * V).sum(1))[:, None]).astype(np.float32)
            for t in range(outer):
                R, shift = ways[t]
                if splits:
                    at, R = splits[t].leaf(X), R[:, : BITS - deep]
                    h = _strings(X, R, (splits[t].mean.astype(np.float32) @ R)[at]) | splits[t].path[at] << (BITS - deep)
                else:
                    h = _strings(X, R, shift)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), t, np.int32)), pa.array(h.astype(np.int64)), b.column(0), b.column(1)], names=["tree", "h", "id", "v"])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        t = pa.Table.from_batches(got).combine_chunks()
        tree = np.asarray(t["tree"])
        for x in np.unique(tree):
            at = np.flatnonzero(tree == x)
            part = t.take(pa.array(at)).combine_chunks() if len(at) < len(tree) else t
            ids, V = np.asarray(part["id"]), _matrix(part["v"], dim)
            near, cos = neighbours(ids, V, k + 1, block, inner, seed + 1 + int(x))
            keep = near.ravel() >= 0
            flat = pa.StructArray.from_arrays([pa.array(-cos.ravel()[keep]), pa.array(near.ravel()[keep])], names=["d", "near"])
            ends = np.concatenate([[0], np.cumsum((near >= 0).sum(1))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.ListArray.from_arrays(pa.array(ends), flat)], names=["id", "best"])

    stretches = outer * max(1, math.ceil(count / stretch))
    arrays = nodes.select("id", "v").mapInArrow(hashed, "tree int, h bigint, id bigint, v array<float>")
    # Without splits every outer tree is one stretch, which its number names; else stretches are ranges of the sorted strings.
    arrays = arrays.repartitionByRange(stretches, "tree", "h", "id") if level else arrays.repartitionById(stretches, "tree")
    found = arrays.mapInArrow(searched, "id bigint, best array<struct<d: double, near: bigint>>")
    # Written once: both the copies' lists and the others' go on from it.
    merged = cut(found.groupBy("id").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("best")))), 1, k).alias("best")))

    # Copies: a neighbour stands for its group's smallest ids; a group's own ids come first with cosine 1.
    groups = nodes.filter(F.size("ids") > 1).select("id", "ids", "h1", "h2")
    flat = merged.select("id", F.explode("best").alias("x")).select("id", "x.d", "x.near")
    flat = flat.join(groups.select(F.col("id").alias("near"), "ids"), "near", "left")
    flat = flat.select("id", "d", F.explode(F.coalesce("ids", F.array("near"))).alias("near"))
    own = groups.select("id", F.lit(-1.0).alias("d"), F.explode("ids").alias("near"))
    lists = flat.unionByName(own).groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "near"))), 1, k + 1).alias("best"))
    lists = lists.join(groups.select("id", "h1", "h2"), "id", "left")
    lone = lists.filter("h1 is null").select("id", "best")
    many = members.join(lists.filter("h1 is not null").select("h1", "h2", "best"), ["h1", "h2"]).select("id", "best")
    both = lone.unionByName(many).select("id", F.slice(F.filter("best", lambda x: x["near"] != F.col("id")), 1, k).alias("best"))
    return both.select("id", F.explode("best").alias("x")).select("id", F.col("x.near").alias("near"), (-F.col("x.d")).alias("cosine"))
