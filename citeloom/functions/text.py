"""Text functions as column expressions; null in, null out unless said otherwise."""

from __future__ import annotations

import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom import constants as K

#: White space that the patterns below name explicitly, alike in every regular-expression engine.
WS = r"[ \t\n\r\f]"

#: Fixed patterns: lines that page extraction and procedure add, removed in this order.
HEADER_PATTERNS = [
    r"(?md)^(?:No\.|Case No\.|Docket No\.)[ \t\n\r\f]+[0-9A-Za-z_\-]+.*$",
    r"(?mid)^(?:Filed|Argued|Decided|Submitted|Rehearing Denied)[: \t\n\r\f]+[0-9A-Za-z_].{0,40}$",
    r"(?id)(?:Counsel|Attorney|Argued by|Submitted by|For (?:Appellant|Appellee|Petitioner|Respondent)).*?\n",
    r"(?md)^\*[0-9]+[ \t\n\r\f]*$|^Page[ \t\n\r\f]+[0-9]+[ \t\n\r\f]*$",
    r"(?mid)^UNITED STATES (?:COURT OF APPEALS|DISTRICT COURT).*$",
]
#: Fixed patterns: case names, then reporter citations, replaced by one mark.
CASE_NAME = (
    r"(?:[A-Z][A-Za-z'\-]+(?:[ \t\n\r\f]+[A-Z][A-Za-z'\-]+)*[ \t\n\r\f]+v\.[ \t\n\r\f]+[A-Z][A-Za-z'\-]+(?:[ \t\n\r\f]+[A-Z][A-Za-z'\-]+)*|In[ \t\n\r\f]+re[ \t\n\r\f]+[A-Z][A-Za-z'\-]+(?:[ \t\n\r\f]+[A-Z][A-Za-z'\-]+)*)"
    r"(?:,[ \t\n\r\f]*[0-9]{1,3}[ \t\n\r\f]+[^ \t\n\r\f]+\.?[ \t\n\r\f]+[0-9]+(?:[ \t\n\r\f]*\([0-9A-Za-z_][0-9A-Za-z_ \t\n\r\f.,]*[0-9]{4}\))?)?"
)
REPORTER = (
    r"[0-9]{1,3}[ \t\n\r\f]+(?:U\.S\.|S\.Ct\.|L\.Ed\.(?:2d)?|F\.(?:2d|3d|4th|Supp(?:\.2d|\.3d)?)|A\.(?:2d|3d)|B\.R\.|F\.R\.D\.|Fed\.[ \t\n\r\f]*Cl\.|Fed\.[ \t\n\r\f]*Appx?\.|WL)"
    r"[ \t\n\r\f]+[0-9]+(?:[ \t\n\r\f]*\([0-9A-Za-z_][0-9A-Za-z_ \t\n\r\f.,]*[0-9]{4}\))?"
)
#: Characters replaced after composition.
REPLACED = {"\x92": "'", "\x93": '"', "\x94": '"', "\x96": "-", "\x97": "-", "’": "'", "“": '"', "”": '"', "–": "-", "—": "-", " ": " ", "�": ""}


def year_of(date: Column) -> Column:
    """The year that a date string begins with; null where it begins with none."""
    return F.substring(date, 1, 4).try_cast("int")


def sentences(text: Column) -> Column:
    """Split after . ! ? followed by white space."""
    return F.split(text, r"(?<=[.!?])[ \t\n\r\f]+")


@F.pandas_udf(T.StringType())
def _nfc(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def fix_encoding(text: Column) -> Column:
    """Composed Unicode (only texts with other than ASCII leave the JVM's string as it is), then the replacements."""
    composed = F.when(text.rlike(r"[^\x00-\x7F]"), _nfc(text)).otherwise(text)
    return F.translate(composed, "".join(REPLACED), "".join(REPLACED.values()))


def strip_headers(text: Column) -> Column:
    return reduce(lambda c, p: F.regexp_replace(c, p, ""), HEADER_PATTERNS, text)


def normalize_citations(text: Column) -> Column:
    marked = F.regexp_replace(F.regexp_replace(text, CASE_NAME, "[CITATION]"), REPORTER, "[CITATION]")
    return F.regexp_replace(marked, r"(?:\[CITATION\][ \t\n\r\f]*){2,}", "[CITATION] ")


def normalize_space(text: Column) -> Column:
    few = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return F.regexp_replace(F.regexp_replace(few, r"(?md)[ \t\r\f]+$", ""), r"^[ \t\n\r\f]+|[ \t\n\r\f]+$", "")


def clean(text: Column) -> Column:
    """The four steps in order; null and blank give ''."""
    t = F.coalesce(text, F.lit(""))
    return F.when(F.trim(t) == "", "").otherwise(normalize_space(normalize_citations(strip_headers(fix_encoding(t)))))


def strip_html(html: Column) -> Column:
    steps = [r"<[^>]+>", r"&[a-zA-Z]+;", r"&#[0-9]+;", r"[ \t\n\r\f]+"]
    return F.trim(reduce(lambda c, p: F.regexp_replace(c, p, " "), steps, html))


def words(text: Column) -> Column:
    """White-space words; none of a blank text."""
    return F.filter(F.split(text, r"[ \t\n\r\f]+"), lambda w: w != "")


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(words(text), 1, n), " ")


def alpha_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]+"), F.lit(0))


def corpus_tokens(text: Column, stop: Sequence[str] = tuple(K.STOP_WORDS), keep: Sequence[str] = tuple(K.PRESERVED)) -> Column:
    """Tokens of the index: preserved words always, others if no stop word and at least two letters."""
    return F.filter(alpha_tokens(text), lambda t: t.isin(*keep) | (~t.isin(*stop) & (F.length(t) >= 2)))


def query_tokens(text: Column, stop: Sequence[str] = tuple(K.STOP_WORDS), keep: Sequence[str] = tuple(K.PRESERVED)) -> Column:
    """Tokens of a query: its first 5,000 characters; preserved words also need two letters."""
    return F.filter(alpha_tokens(F.substring(text, 1, 5000)), lambda t: (t.isin(*keep) | ~t.isin(*stop)) & (F.length(t) > 1))


def landmark_tokens(text: Column) -> Column:
    return F.filter(words(F.lower(text)), lambda t: t.rlike("(?s)^.."))


def doctrines(text: Column) -> Column:
    """Ids of the doctrines whose phrases occur in the first 3,000 words, in table order."""

    def hits(head: Column) -> Column:
        return F.array_compact(F.array(*[F.when(reduce(lambda a, b: a | b, [F.contains(head, F.lit(k)) for k in keys]), F.lit(name)) for name, keys in K.DOCTRINES.items()]))

    # Bound as a lambda's variable, the head is computed once instead of once for each phrase.
    return F.get(F.transform(F.array(first_words(F.lower(text), 3000)), hits), F.lit(0))


def display_name(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def paragraphs(text: Column) -> Column:
    parts = F.transform(F.split(text, "\n\n"), lambda p: F.regexp_replace(p, r"^[ \t\n\r\f]+|[ \t\n\r\f]+$", ""))
    return F.filter(parts, lambda p: p != "")


def text_hash(text: Column) -> Column:
    return F.md5(F.encode(text, "UTF-8"))


def label(text: Column, most: int = 40) -> Column:
    """At most `most` characters; longer ones end in three dots."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 3), F.lit("..."))).otherwise(text)


def node_size(cites: Column) -> Column:
    """15 to 50 by citations, as many as 500."""
    return 15 + F.least(F.coalesce(cites, F.lit(0)), F.lit(500)) / 500.0 * 35


def fenced_json(reply: Column) -> Column:
    """A model's reply without its code fence."""
    return F.trim(F.regexp_replace(F.trim(reply), r"^```(?:json)?[ \t\n\r\f]*|[ \t\n\r\f]*```$", ""))


def is_federal(court: Column, prefixes: Sequence[str] = tuple(K.FEDERAL_PREFIXES)) -> Column:
    return reduce(lambda a, b: a | b, [court.startswith(p) for p in prefixes])


def circuit_label(court: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in K.CIRCUIT_LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(court)), F.lit("State/Other"))


def estimated_tokens(text: Column) -> Column:
    return F.floor(F.size(words(text)) * F.lit(0.75)).cast("bigint")


def chunk_spans(sizes: Sequence[int], room: int, overlap: int) -> list[tuple[int, int, bool]]:
    """(from, to, cut) of each chunk over paragraphs of the given sizes; `cut` where its last paragraph alone exceeds the room and is cut to it.

    Running totals are searched for the last paragraph that still fits; an oversized paragraph counts as more than any room, so
    the search stops before it, and it then closes the chunk.
    """
    total = [0, *accumulate(min(n, room + 1) for n in sizes)]
    spans, at = [], 0
    while at < len(sizes):
        to = bisect_right(total, total[at] + room) - 1
        big = to < len(sizes) and sizes[to] > room
        spans.append((at, to + big, big))
        at += max(1, to + big - at - overlap)
    return spans


def pack_paragraphs(paras: Sequence[str], most: int = 512, overlap: int = 1, tokens: Callable[[str], list[str]] = str.split) -> list[str]:
    """Chunks of whole paragraphs under `most` tokens (two are kept for marks), parted by blank lines; each begins with the last `overlap` of the one before.

    An oversized paragraph is cut to what there is room for and closes its chunk. After the last paragraph the start goes on by what was
    not overlapped, so a short tail chunk may follow. No paragraphs give no chunks.
    """
    split = [tokens(p) for p in paras]
    out = []
    for a, b, big in chunk_spans([len(t) for t in split], most - 2, overlap):
        part = list(paras[a:b])
        if big:
            part[-1] = " ".join(split[b - 1][: most - 2])
        out.append("\n\n".join(part))
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def packed_chunks(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(lambda p: [] if p is None else pack_paragraphs(list(p)))
