"""Evaluation texts leaking into training text: BM25 with block-max WAND, then verification.

Items are indexed by five-word terms: postings in item order, cut into blocks with the greatest
weight of each. Every passage of every document is a query. An item's threshold is the least score a
passage can have that holds a run of 30 of its words with three of them changed, so retrieval loses no
case. What is retrieved is verified by alignment of the item's words with the document's.

The index is built in blocks of items, each of a checked size, and broadcast block by block; documents are read once
for each block and never shuffled.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TERM, RUN, STEP, WIDTH, BLOCK = 5, 30, 30, 66, 32
#: Terms of a run that three edits spoil at most.
SPOILT = 3 * TERM
K1, B = 1.2, 0.75
#: Distinct item texts of one broadcast index.
ITEMS = 20_000


def words_of(text: str | None) -> list[str]:
    """Lower-case runs of letters and digits; case, punctuation, layout and quotation marks don't count."""
    if not text:
        return []
    t = unicodedata.normalize("NFKC", text).replace("­", "")
    for q in "'’‘ʼ`´​‌‍⁠﻿":
        t = t.replace(q, "")
    return _WORD().findall(t.lower())


def _WORD():
    import re
    import sys

    kept = sys.__dict__.setdefault("_citeloom_words", {})
    if "w" not in kept:
        kept["w"] = re.compile(r"[^\W_]+")
    return kept["w"]


def grams(w: list[str], n: int = TERM) -> list[str]:
    return [" ".join(w[i : i + n]) for i in range(len(w) - n + 1)]


class Index:
    """Inverted index of items with block maxima; passages are queries."""

    def __init__(self, items: list[tuple[int, list[str]]]):
        self.items = [(key, w) for key, w in items if len(w) >= RUN]
        lists = [grams(w) for _, w in self.items]
        df = Counter(g for gs in lists for g in set(gs))
        n, mean = len(self.items), sum(map(len, lists)) / max(1, len(self.items))
        self.idf = {g: math.log(1 + (n - d + 0.5) / (d + 0.5)) for g, d in df.items()}
        postings: dict[str, list[tuple[int, float]]] = defaultdict(list)
        self.threshold = []
        self.fewest = RUN
        for i, gs in enumerate(lists):
            tf, norm = Counter(gs), K1 * (1 - B + B * len(gs) / mean)
            weight = {g: self.idf[g] * f * (K1 + 1) / (f + norm) for g, f in tf.items()}
            for g, x in weight.items():
                postings[g].append((i, x))
            # What three edits leave of a run's terms and weight at least, over all runs.
            least = math.inf
            for s in range(len(gs) - (RUN - TERM)):
                run = sorted({g: weight[g] for g in gs[s : s + RUN - TERM + 1]}.values())
                left = max(1, len(run) - SPOILT)
                least, self.fewest = min(least, sum(run[:left])), min(self.fewest, left)
            self.threshold.append(least * 0.999)
        self.postings = {g: ([i for i, _ in p], [x for _, x in p], [max(x for _, x in p[a : a + BLOCK]) for a in range(0, len(p), BLOCK)], max(x for _, x in p)) for g, p in postings.items()}
        self.floor = min(self.threshold, default=math.inf)

    def retrieve(self, query: set[str]) -> list[int]:
        """Items whose score reaches their threshold, by block-max WAND."""
        cursors = [[p[0][0], 0, p] for g in query if (p := self.postings.get(g))]
        out, floor = [], self.floor
        while cursors:
            cursors.sort(key=lambda c: c[0])
            bound, pivot = 0.0, -1
            for n, c in enumerate(cursors):
                bound += c[2][3]
                if bound >= floor:
                    pivot = n
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            upper, jump = 0.0, math.inf
            for c in cursors[: pivot + 1]:
                ids, maxima = c[2][0], c[2][2]
                b = c[1] // BLOCK
                while (b + 1) * BLOCK <= len(ids) and ids[min(len(ids), (b + 1) * BLOCK) - 1] < item:
                    b += 1
                if b < len(maxima):
                    upper += maxima[b]
                    jump = min(jump, ids[min(len(ids), (b + 1) * BLOCK) - 1] + 1)
            if upper >= floor:
                score = 0.0
                for c in cursors[: pivot + 1]:
                    self._to(c, item)
                    if c[0] == item:
                        score += c[2][1][c[1]]
                        self._to(c, item + 1)
                if score >= self.threshold[item]:
                    out.append(item)
            else:
                to = int(min(max(jump, item + 1), cursors[pivot + 1][0] if pivot + 1 < len(cursors) else math.inf))
                for c in cursors[: pivot + 1]:
                    self._to(c, to)
            cursors = [c for c in cursors if c[0] < math.inf]
        return out

    @staticmethod
    def _to(c: list, item: int) -> None:
        from bisect import bisect_left

        ids = c[2][0]
        c[1] = bisect_left(ids, item, c[1])
        c[0] = ids[c[1]] if c[1] < len(ids) else math.inf


def holds_run(item: list[str], text: list[str], run: int = RUN) -> bool:
    """Whether the text holds a run of at least `run` of the item's words in order, one in ten changed, dropped or added at most.

    Edit distances of all the item's runs to any stretch of the text, all starts at once.
    """
    n, m = len(item), len(text)
    if n < run or m < run * 9 // 10:
        return False
    codes: dict[str, int] = {}
    a = np.array([codes.setdefault(w, len(codes)) for w in item])
    t = np.array([codes.setdefault(w, len(codes)) for w in text])
    same = a[:, None] == t[None, :]
    starts = np.arange(n - run + 1)
    D = np.zeros((len(starts), m + 1), np.int32)
    ramp = np.arange(m + 1)
    for length in range(1, min(n, 2 * run) + 1):
        live = starts + length - 1 < n
        D = D[live[: len(D)]]
        if not len(D):
            return False
        miss = 1 - same[starts[: len(D)] + length - 1]
        step = D + 1
        step[:, 1:] = np.minimum(step[:, 1:], D[:, :-1] + miss)
        D = np.minimum.accumulate(step - ramp, axis=1) + ramp
        least = D.min()
        if length >= run and least <= length // 10:
            return True
        if least > 2 * run // 10:
            return False
    return False


def leaked(w: list[str], index: Index) -> list[int]:
    """The items of the index that one document leaks."""
    gs = grams(w)
    hits = [i for i, g in enumerate(gs) if g in index.postings]
    if not hits:
        return []
    out: set[int] = set()
    tried: dict[int, tuple[int, int]] = {}
    at = 0
    starts = range(0, max(1, len(w) - WIDTH + STEP), STEP)
    for s in starts:
        e = s + WIDTH - TERM + 1
        while at < len(hits) and hits[at] < s:
            at += 1
        k = at
        while k < len(hits) and hits[k] < e:
            k += 1
        if k - at < index.fewest:
            continue
        query = {gs[i] for i in hits[at:k]}
        if len(query) < index.fewest:
            continue
        for item in index.retrieve(query):
            if item in out:
                continue
            lo, hi = max(0, s - STEP), min(len(w), s + WIDTH + STEP)
            if item in tried and tried[item][1] >= hi:
                continue
            tried[item] = (lo, hi)
            if holds_run(index.items[item][1], w[lo:hi]):
                out.add(item)
    return sorted(out)


def leaked_items(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", text_col: str = "text", item_key: str = "benchmark_id", item_text: str = "context") -> DataFrame:
    """(doc_key, item_key): documents that hold a run of an item's words; items with the same text are all leaked.

    Null and empty texts and items under 30 words give nothing; copies of documents each give their rows; texts are
    read whole; other columns are ignored.
    """
    spark = docs.sparkSession
    texts = items.select(F.col(item_text).alias("t"), F.col(item_key).alias("k")).filter("t is not null and k is not null")
    distinct = texts.groupBy("t").agg(F.min("k").alias("g"))
    n = distinct.count()
    parts = max(1, math.ceil(n / ITEMS))
    two = docs.select(F.col(doc_key).alias("d"), F.col(text_col).alias("t")).filter("t is not null and t <> ''")
    out = None
    for p in range(parts):
        rows = distinct.filter(F.pmod(F.xxhash64("t"), F.lit(parts)) == p).collect()  # a block of bounded size
        index = spark.sparkContext.broadcast(Index([(r["g"], words_of(r["t"])) for r in rows]))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ds, gs = [], []
                for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    for i in leaked(words_of(t), index.value):
                        ds.append(d)
                        gs.append(index.value.items[i][0])
                yield pa.RecordBatch.from_arrays([pa.array(ds, pa.int64()), pa.array(gs, pa.int64())], names=["d", "g"])

        part = two.mapInArrow(run, "d bigint, g bigint")
        out = part if out is None else out.unionByName(part)
    same = texts.join(distinct, "t").select("g", "k")
    return out.join(same, "g").select(F.col("d").alias(doc_key), F.col("k").alias(item_key)).distinct()
