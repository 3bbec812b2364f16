"""Citation functions: extraction, canonical form, parts, and context."""

from __future__ import annotations

import ast
import json
import re
import warnings
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from citeloom import constants as K

#: Fixed patterns: parties of a name, a year, a bare court id, a plain citation, an opinion's address.
PARTY = r"^([A-Za-z][^,]+?[ \t\n\r\f]+v\.[ \t\n\r\f]+[A-Za-z][^,0-9]+?)(?:,|[ \t\n\r\f]+[0-9]|[ \t\n\r\f]*$)"
YEAR = r"\b(19[0-9]{2}|20[0-9]{2})\b"
COURT = r"\(([a-z][a-z0-9]{1,10})\)[ \t\n\r\f]*$"
CLEAN_REPORTER = r"^[0-9]{1,4}[ \t\n\r\f]+[A-Z][A-Za-z0-9.]*(?:[ \t\n\r\f]?[0-9a-z]+)?[ \t\n\r\f]+[0-9]{1,4}$"
OPINION = r"/(?:opinions?)/([0-9]+)"


def reporter_pattern(reporters: Sequence[str] = tuple(K.REPORTERS)) -> str:
    """Volume, reporter, page; longer reporters first, so that series aren't cut short."""
    names = "|".join(re.sub(r"([.&$()\[\]])", r"\\\1", r) for r in sorted(reporters, key=lambda r: (-len(r), r)))
    return rf"\b([0-9]{{1,4}}) ({names}) ([0-9]{{1,5}})\b"


def canonical(volume: Column, reporter: Column, page: Column) -> Column:
    return F.concat_ws(" ", volume.cast("int"), reporter, page.cast("int"))


def extract(df: DataFrame, key: str, text: str, reporters: Sequence[str] = tuple(K.REPORTERS), keep: Sequence[str] = ()) -> DataFrame:
    """(key, keep..., pos, volume, reporter, page, citation_string): full citations of each text, the first of equal ones, in order.

    pos counts all matches from 1. Null texts and texts without citations give nothing. Columns in `keep` come along; they follow from the key.
    """
    p = reporter_pattern(reporters)
    found = df.select(key, *keep, F.posexplode(F.regexp_extract_all(F.col(text), F.lit(p), F.lit(0))).alias("_at", "_m"))
    part = lambda i: F.regexp_extract("_m", p, i)
    rows = found.select(key, *keep, (F.col("_at") + 1).alias("pos"), part(1).cast("int").alias("volume"), part(2).alias("reporter"), part(3).cast("int").alias("page"))
    first = [F.first(c).alias(c) for c in keep]
    rows = rows.groupBy(key, "volume", "reporter", "page").agg(F.min("pos").alias("pos"), *first)
    return rows.select(key, *keep, "pos", "volume", "reporter", "page", canonical(F.col("volume"), F.col("reporter"), F.col("page")).alias("citation_string"))


def _found(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def party_names(citation: Column) -> Column:
    return F.trim(_found(F.regexp_extract(F.trim(citation), PARTY, 1)))


def cited_year(citation: Column) -> Column:
    return F.regexp_extract(citation, YEAR, 1).try_cast("int")


def cited_court(citation: Column) -> Column:
    """A bare court id in the last parenthesis, else the first court one of whose names occurs."""
    low = F.lower(citation)
    named = F.coalesce(*[F.when(F.contains(low, F.lit(a)), F.lit(c)) for c, names in K.COURT_ALIASES.items() for a in names])
    return F.coalesce(_found(F.regexp_extract(F.trim(low), COURT, 1)), named)


def is_clean_reporter(citation: Column) -> Column:
    return citation.rlike(CLEAN_REPORTER)


def opinion_id(url: Column) -> Column:
    return F.regexp_extract(url, OPINION, 1).try_cast("bigint")


def literal_list(text: str | None) -> list[str | None] | None:
    """The items of a JSON list, else of a Python list or tuple; None for anything else."""
    if text is None:
        return None
    for parse in (json.loads, ast.literal_eval):
        try:
            with warnings.catch_warnings(action="ignore"):
                found = parse(text.strip())
        except Exception:  # noqa: BLE001 - whatever fails is no list
            continue
        if isinstance(found, list | tuple):
            return [x if x is None or isinstance(x, str) else str(x) for x in found]
    return None


@F.pandas_udf(T.ArrayType(T.StringType()))
def _literal_lists(texts: pd.Series) -> pd.Series:
    return texts.map(literal_list)


def json_list(text: Column, keep_raw: bool) -> Column:
    """A JSON or quoted list as an array; otherwise [text] or [], as the caller's rule has it. A null text has no items under either rule."""
    empty = F.array().cast("array<string>")
    return F.coalesce(_literal_lists(text), F.when(text.isNotNull(), F.array(text)).otherwise(empty) if keep_raw else empty)


def citation_strings(cites: Column) -> Column:
    """'volume reporter page' of citation objects of types 1 to 3 with all three parts."""
    solid = lambda c: (F.trim(c) != "") & c.isNotNull()
    ok = F.filter(cites, lambda c: c["type"].isin(1, 2, 3) & solid(c["volume"]) & solid(c["reporter"]) & solid(c["page"]))
    return F.transform(ok, lambda c: F.concat_ws(" ", c["volume"], c["reporter"], c["page"]))


def sentence_context(sentences: Column, citation: Column, window: int = 3) -> Column:
    """The sentences up to `window` before and after the first one that holds the citation; null if none does."""
    at = F.array_position(F.transform(sentences, lambda s: F.contains(s, citation)), True)
    start = F.greatest(at - window, F.lit(1))
    part = F.slice(sentences, start.cast("int"), (at + window - start + 1).cast("int"))
    return F.when(at > 0, F.array_join(part, " "))


def char_context(text: Column, citation: Column, radius: int = 300) -> Column:
    """Up to `radius` characters on either side of the citation's first occurrence; null if it has none."""
    at = F.instr(text, citation)
    start = F.greatest(at - radius, F.lit(1))
    return F.when(at > 0, F.substr(text, start, at + F.length(citation) + radius - start))


def last_writer(df: DataFrame, key: str | list[str], order: list[Column]) -> DataFrame:
    """One row per key, the last in order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
