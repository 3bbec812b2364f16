"""What needs models or services, behind small interfaces with deterministic stand-ins."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def hash_embedder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """Signed counts of hashed words; stands for an encoder where none is installed. Vectors are not yet at unit length; a text without words gives zeros."""
    word, known = re.compile("[a-z0-9]+"), {}

    def place(w: str) -> tuple[int, int]:
        at = known.get(w)
        if at is None:
            h = int(hashlib.md5(w.encode()).hexdigest()[:8], 16)
            if len(known) > 200_000:
                known.clear()
            at = known[w] = (h % dim, 1 if h // dim % 2 else -1)
        return at

    def embed(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim))
        for i, t in enumerate(texts):
            for w in word.findall(t.lower()):
                at, sign = place(w)
                out[i, at] += sign
        return out

    return embed


def embedded(df: DataFrame, text: str, embed: Callable[[list[str]], np.ndarray], out: str = "embedding") -> DataFrame:
    """df with a vector for each text, embedded once per different text of a batch."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            different = s.dropna().unique()
            got = dict(zip(different, embed(list(different)))) if len(different) else {}
            yield s.map(lambda t: got[t].astype("float32") if t in got else None)

    return df.withColumn(out, run(F.col(text)))


def word_overlap_judge(proposition: str, excerpt: str) -> bool:
    """Stands for a language model's judgement: whether a fifth of the proposition's words occur in the excerpt."""
    p, e = (set(re.findall("[a-z0-9]+", x.lower())) for x in (proposition, excerpt))
    return not p or 5 * len(p & e) >= len(p)


def template_writer(kind: str, citation: str, context: str) -> str:
    """Stands for a language model that writes a passage: what `kind` asks for, in one sentence around what it is given."""
    if kind == "proposition":
        return f"As held in {citation}, {context}"
    return f"{context} See {citation}."


def written(df: DataFrame, kind: str, citation: str, context: str, out: str, write: Callable[[str, str, str], str] = template_writer, attempts: int = 3) -> DataFrame:
    """df with a passage written for each row; a writer that fails `attempts` times leaves null."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        def one(c, x):
            for _ in range(attempts if c is not None and x is not None else 0):
                try:
                    return write(kind, c, x)
                except Exception:  # noqa: BLE001 - asked again, then left out
                    continue
            return None

        for c, x in batches:
            yield pd.Series([one(a, b) for a, b in zip(c, x)], dtype=object)

    return df.withColumn(out, run(F.col(citation), F.col(context)))


def judged(df: DataFrame, proposition: str, excerpt: str, gate: str, judge: Callable[[str, str], bool] = word_overlap_judge) -> DataFrame:
    """df with llm_checked and llm_accurate. Only rows whose gate is true reach the judge; failures and missing excerpts count as accurate."""

    @F.pandas_udf(T.BooleanType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for p, e in batches:
            out = []
            for a, b in zip(p, e):
                try:
                    out.append(None if a is None or b is None else bool(judge(a, b)))
                except Exception:  # noqa: BLE001 - a failing judge skips the row
                    out.append(None)
            yield pd.Series(out, dtype=object)

    open_ = F.coalesce(F.col(gate), F.lit(False))
    asked = df.filter(open_).withColumn("_v", run(F.col(proposition), F.col(excerpt)))
    rest = df.filter(~open_).withColumn("_v", F.lit(None).cast("boolean"))
    both = asked.unionByName(rest)
    return both.withColumns({"llm_checked": F.col("_v").isNotNull(), "llm_accurate": F.coalesce("_v", F.lit(True))}).drop("_v")
