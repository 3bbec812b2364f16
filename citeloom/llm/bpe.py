"""Corpus encoding with a public byte-level BPE vocabulary by corpus-level merge replay.

Each task gathers the distinct words of a block of documents, lays them out as one symbol sequence
and keeps an inverted index from symbol pair to the positions that hold it. Merges are replayed in
rank order over all words at once; a merge touches only its own positions and their neighbours.
Ids depend on the word alone, so blocks need no exchange: the operator never shuffles, and its
state is one block's distinct words, whatever the corpus' size.
"""

from __future__ import annotations

import base64
import heapq
import sys
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Fixed pattern of the vocabulary's pre-tokenizer.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Distinct words remembered by a task before it starts a new table; a matter of memory only.
REMEMBERED = 400_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id, which is also the rank of the merge that makes it."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def replay(words: list[str], ranks: dict[bytes, int]) -> list[list[int]]:
    """The ids of each word: every merge in rank order over the inverted index of pairs."""
    sym: list[bytes | None] = []
    start: list[int] = []
    for w in words:
        start.append(len(sym))
        sym.extend(bytes((b,)) for b in w.encode("utf-8"))
        sym.append(None)  # a wall between words
    n = len(sym)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    index: dict[tuple[bytes, bytes], list[int]] = defaultdict(list)
    for i in range(n - 1):
        a, b = sym[i], sym[i + 1]
        if a is not None and b is not None:
            index[a, b].append(i)
    heap = [(r, p) for p in index if (r := ranks.get(p[0] + p[1])) is not None]
    heapq.heapify(heap)
    gone = bytearray(n)
    while heap:
        _, pair = heapq.heappop(heap)
        left, right = pair
        made = left + right
        touched: dict[tuple[bytes, bytes], list[int]] = {}
        for i in sorted(index.pop(pair, ())):
            if gone[i] or sym[i] != left or sym[j := after[i]] != right:
                continue
            k = after[j]
            sym[i], gone[j], after[i], before[k] = made, 1, k, i
            if (c := sym[k]) is not None:
                touched.setdefault((made, c), []).append(i)
            if (h := before[i]) >= 0 and (c := sym[h]) is not None:
                touched.setdefault((c, made), []).append(h)
        for p, at in touched.items():
            if p not in index and (r := ranks.get(p[0] + p[1])) is not None:
                heapq.heappush(heap, (r, p))
            index[p].extend(at)
    out = []
    for i in start:
        ids = []
        while (s := sym[i]) is not None:
            ids.append(ranks[s])
            i = after[i]
        out.append(ids)
    return out


def _kept(path: str) -> tuple:
    """The vocabulary and pattern, loaded once for each worker process."""
    import regex

    kept = sys.__dict__.setdefault("_citeloom_bpe", {})
    if path not in kept:
        kept[path] = (load_ranks(path), regex.compile(PATTERN))
    return kept[path]


def encode_texts(texts: list[str | None], path: str, known: dict[str, list[int]]) -> list[list[int]]:
    ranks, pattern = _kept(path)
    split = [pattern.findall(t) if t else [] for t in texts]
    new = list({w for ws in split for w in ws if w not in known})
    known.update(zip(new, replay(new, ranks)))
    out = []
    for ws in split:
        ids: list[int] = []
        for w in ws:
            ids += known[w]
        out.append(ids)
    return out


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, ids): the token ids of every document, without special tokens.

    Null and empty texts give an empty list; strings of special tokens are ordinary text; repeated
    rows each give a row; texts of any length are encoded whole; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                if len(known) > REMEMBERED:
                    known = {}
                ids = encode_texts(part.column(1).to_pylist(), vocabulary, known)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], names=[id_col, "ids"])

    two = docs.select(id_col, text_col)
    return two.mapInArrow(run, f"`{id_col}` {two.schema[0].dataType.simpleString()}, ids array<int>")
