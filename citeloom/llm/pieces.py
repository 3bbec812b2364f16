"""Cutting oversized texts at natural boundaries by agglomerative merging.

A text is laid out as atomic segments of the coarsest units that fit (paragraphs, else sentences,
else words, else single stretches of characters). Adjacent pieces wait in a heap by the strength of the boundary
between them; the weakest boundaries merge first while the joined size plus the overlap fits.
One text is one task's row: nothing is shuffled, and cost is n log n in a text's segments.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Collection, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_CHARS, OVERLAP = 4000, 200
KINDS = ("char", "word", "sentence", "paragraph")

#: Words whose stop ends no sentence, in lower case and without it.
ABBREVIATIONS = frozenset(
    "v vs no nos inc corp co cos ltd llc llp jr sr mr mrs ms mx dr prof hon rev st mt ft rep reps app ct cts ch cl cir dist div supp dept art arts sec secs "
    "par pars cf ed eds id ibid al etc viz e.g i.e seq op cit ex rel ser vol vols pp p n nn art bros mfg ry rd ave blvd gov sen gen col capt lt sgt "
    "assn assoc natl intl mut ins hldgs chem elec eng servs svcs props indus inds labs dev sav hosp tel transp prov cal rec "
    "jan feb mar apr jun jul aug sept sep oct nov dec mon tue wed thu fri sat sun sra srta ud uds sr núm art pág mme mlle".split()
)
_BLANK = re.compile(r"(?:\r\n?|\n)[^\S\r\n]*(?:(?:\r\n?|\n)[^\S\r\n]*)+")
_STOP = re.compile(r"[.!?…]+[\"'”’»)\]]*\s+(?=(\S))")
_LAST = re.compile(r"[^\s(\[\"“‘]*$")
#: A reporter citation: a number, an abbreviated title, a number.
_CITATION = re.compile(r"\b\d{1,4} (?:[A-Z&§\"][\w.,'’&§\"]*\s+){1,5}?(?:\d[a-z]{1,2}\s+)?\d{1,5}\b")


def sentence_spans(text: str, more: Collection[str] = ()) -> list[tuple[int, int]]:
    """Spans of sentences, each with the white space after it. Stops of abbreviations (known ones, and `more` that the texts use), initials and citations end none."""
    cites, spans, at, c = [m.span() for m in _CITATION.finditer(text)], [], 0, 0
    for m in _STOP.finditer(text):
        i = m.start()
        while c < len(cites) and cites[c][1] <= i:
            c += 1
        if c < len(cites) and cites[c][0] <= i:
            continue
        nxt = m[1]
        if text[i] == "." and not text.startswith("..", i):
            word = _LAST.search(text[max(0, i - 40) : i])[0].strip("'’*_")
            low = word.lower()
            if low in ABBREVIATIONS or low in more or (len(word) == 1 and word.isalpha() and word.isupper()) or "." in word.strip(".") or nxt.islower():
                continue
        elif nxt.islower():
            continue
        spans.append((at, m.end()))
        at = m.end()
    if at < len(text):
        spans.append((at, len(text)))
    return spans


def _paragraph_spans(text: str) -> list[tuple[int, int]]:
    spans, at = [], 0
    for m in _BLANK.finditer(text):
        spans.append((at, m.end()))
        at = m.end()
    if at < len(text):
        spans.append((at, len(text)))
    return spans


def _word_spans(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(r"\s*\S+\s*", text)] or ([(0, len(text))] if text else [])


def _net(text: str, a: int, b: int) -> int:
    return len(text[a:b].strip())


def atoms(text: str, room: int, more: Collection[str] = ()) -> tuple[list[tuple[int, int, int]], int]:
    """Segments (start, end, strength of the boundary before it) that tile the text, and the coarsest kind that was enough."""
    out, kind = [], 3
    work = [(a, b, 3, 3) for a, b in reversed(_paragraph_spans(text))]
    split = {2: lambda t: sentence_spans(t, more), 1: _word_spans}
    while work:
        a, b, level, strength = work.pop()
        if _net(text, a, b) <= room:
            out.append((a, b, strength))
            continue
        kind = min(kind, level - 1)
        if level == 1:
            cuts = [(x, min(x + room, b)) for x in range(a, b, room)]
        else:
            cuts = [(a + x, a + y) for x, y in split[level - 1](text[a:b])]
        inner = [(x, y, level - 1, strength if n == 0 else level - 1) for n, (x, y) in enumerate(cuts)]
        work.extend(reversed(inner))
    return out, kind


def cut_text(text: str, most: int = MAX_CHARS, overlap: int = OVERLAP, more: Collection[str] = ()) -> tuple[str, list[str]]:
    """The kind of boundary that was enough, and the pieces, each at most `most` characters, each from the second on beginning with the last `overlap` characters before it."""
    room = most - overlap
    segs, kind = atoms(text, room, more)
    n = len(segs)
    start, end, strength = [s[0] for s in segs], [s[1] for s in segs], [s[2] for s in segs]
    right, left, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(strength[j], _net(text, start[j - 1], end[j]), j - 1, j) for j in range(1, n)]
    heapq.heapify(heap)
    while heap:
        _, size, i, j = heapq.heappop(heap)
        if size > room or not (alive[i] and alive[j]) or right[i] != j or size != _net(text, start[i], end[j]):
            continue
        alive[j], end[i], right[i] = False, end[j], right[j]
        if right[i] < n:
            left[right[i]] = i
            heapq.heappush(heap, (strength[right[i]], _net(text, start[i], end[right[i]]), i, right[i]))
        if left[i] >= 0:
            heapq.heappush(heap, (strength[i], _net(text, start[left[i]], end[i]), left[i], i))
    pieces, before = [], 0
    for i in range(n):
        if alive[i]:
            core = text[start[i] : end[i]]
            if len(core) > room:
                core = core.strip()
            pieces.append(text[max(0, before - overlap) : before] + core if pieces else core)
            before = end[i]
    return KINDS[kind], pieces


_PIECES = T.StructType([T.StructField("boundary", T.StringType()), T.StructField("pieces", T.ArrayType(T.StringType()))])


def pieces_of(text: Column, most: int = MAX_CHARS, overlap: int = OVERLAP, more: Collection[str] = ()) -> Column:
    @F.pandas_udf(_PIECES)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([cut_text(t, most, overlap, more) if t is not None else (None, None) for t in s], columns=["boundary", "pieces"])

    return run(text)


def split_oversized(df: DataFrame, key: str = "row_id", text_col: str = "plain_text", most: int = MAX_CHARS, overlap: int = OVERLAP, abbreviations: Collection[str] = ()) -> DataFrame:
    """(key, boundary, pieces) of each text of more than `most` characters.

    `abbreviations` (lower case, without their stop) are those of the texts beside the known ones. Null, empty and short texts give no row; repeated rows each give one; white space alone counts as one
    paragraph; other columns are ignored.
    """
    long = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{text_col}`").alias("t")).filter(F.length("t") > most)
    cut = long.withColumn("x", pieces_of(F.col("t"), most, overlap, frozenset(abbreviations)))
    return cut.select(key, F.col("x.boundary").alias("boundary"), F.col("x.pieces").alias("pieces"))
