"""Repairing text of scanned pages by noisy-channel correction.

A text counts as scanned by its layout: lines cut at one width. Page furniture is told by page-number
lines and what stands beside them; words broken at line ends are rejoined over furniture. A word's
candidates come from character confusions; their probability times the likelihood of corpus unigrams and bigrams
decides, by Viterbi over each line.

Corpus counts come from all texts that aren't scanned, summed in each task before they are shuffled.
Scanned texts never meet the whole table: only the word types they hold, the candidates of rare types
and the bigrams of real alternatives are joined with it, so nothing is broadcast or collected.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.session import cut

#: A candidate must occur LEAST times in clean text, and weigh, by channel and count, at least WEIGHT times the token itself: what is less likely no context makes up for.
LEAST, WEIGHT = 3, 0.002
#: Letters of the longest words there are, and readings of a token's beginning that are followed up.
LONGEST, BEAM = 60, 3000
#: What is read -> (what it may stand for, probability). Signs and digits within words always stand for something else.
SIGNS = {
    "|": (("", 0.3), ("l", 0.2), ("i", 0.2)), "!": (("i", 0.7), ("l", 0.2)), "@": (("a", 0.95),), "0": (("o", 0.95),), "1": (("l", 0.5), ("i", 0.45)), "5": (("s", 0.95),), "6": (("b", 0.9), ("g", 0.05)),
    "9": (("g", 0.9),), "8": (("b", 0.8),), "3": (("e", 0.6),), "4": (("a", 0.6),), "7": (("t", 0.6),), "2": (("z", 0.6),), "$": (("s", 0.9),), "€": (("e", 0.9),), "£": (("e", 0.4),), "¢": (("c", 0.6),), "§": (("s", 0.3),),
    "·": (("", 0.95),), "~": (("", 0.95),), "^": (("", 0.95),), "*": (("", 0.9),), "_": (("", 0.9),), "`": (("", 0.9),), "°": (("", 0.5), ("o", 0.3)), "•": (("", 0.9),), "¨": (("", 0.9),), "\\": (("", 0.5), ("l", 0.2)), "/": (("l", 0.3),), "=": (("", 0.5),), "+": (("t", 0.3),),
    "ﬁ": (("fi", 1.0),), "ﬂ": (("fl", 1.0),), "ﬀ": (("ff", 1.0),), "ﬃ": (("ffi", 1.0),), "ﬄ": (("ffl", 1.0),), "ſ": (("s", 0.9),), "¬": (("", 0.9),), "\xad": (("", 0.95),), "‐": (("-", 0.9),), "«": (("", 0.5),), "»": (("", 0.5),),
}
#: Letters read for others, with probabilities; each such reading counts against the two that a word may have.
LETTERS = {
    "c": (("e", 0.01), ("o", 0.001)), "e": (("c", 0.002), ("o", 0.0005)), "f": (("t", 0.01),), "t": (("f", 0.002), ("l", 0.001)), "b": (("h", 0.01), ("d", 0.0005)), "h": (("b", 0.003), ("li", 0.0003)), "v": (("y", 0.008),), "y": (("v", 0.002),),
    "cl": (("d", 0.05),), "ii": (("u", 0.05),), "rn": (("m", 0.05),), "vv": (("w", 0.1),), "n": (("ri", 0.003), ("u", 0.001), ("h", 0.0003)), "m": (("rn", 0.005), ("nn", 0.0005), ("in", 0.0005)), "d": (("cl", 0.003),), "u": (("ii", 0.0005), ("n", 0.001)), "w": (("vv", 0.001),),
    "li": (("h", 0.01), ("b", 0.001)), "tl": (("d", 0.001), ("th", 0.002)), "nn": (("m", 0.005),), "ni": (("m", 0.003),), "in": (("m", 0.003),), "iii": (("m", 0.02),), "l": (("i", 0.003), ("t", 0.002), ("1", 0.0005)), "i": (("l", 0.003), ("j", 0.001), ("t", 0.0005)), "j": (("i", 0.002),),
    "o": (("c", 0.0005), ("e", 0.0005), ("a", 0.0005)), "a": (("o", 0.0005), ("e", 0.0003)), "s": (("a", 0.0003),), "g": (("q", 0.001), ("y", 0.0003)), "q": (("g", 0.003),), "r": (("t", 0.0003), ("n", 0.0003)), "k": (("h", 0.0005),), "hn": (("lm", 0.001),), "ri": (("n", 0.01),), "z": (("s", 0.0003),), "lc": (("k", 0.01),), "ln": (("in", 0.002),),
}
#: Letters and signs that are read for digits.
DIGITS = {"s": "5", "o": "0", "l": "1", "i": "1", "|": "1", "!": "1", "b": "8", "z": "2", "g": "9", "q": "9", "d": "0", "t": "7", "]": "1", "[": "1", "/": "1", "$": "5", "&": "8", "?": "7", "a": "4", "e": "3"}
_STRAY = "·~^*_`•¨°\\=«»|"
_NUMBER = re.compile(r"\d(?:[\d:,.\-–()/]*[\d)])?")
_ORDINAL = re.compile(r"\d+(?:st|nd|rd|th|d)")
_WORD = re.compile(r"[^\W\d_]+(?:['’.\-][^\W\d_]+)*")
_CLEAN = re.compile(r"[^\W_]+(?:['’.\-:,][^\W_]+)*")
_EDGE = " \t\f\v.,;:()[]{}\"“”„«»‘’'?—–…<>"
_BREAK = re.compile(r"([^\W_])([-‐‑¬\xad])\s*$")
_LINES = re.compile(r"\r\n|[\n\r\x0b\x85 ]")
#: Page numbers alone on a line, in the ways printers set them; digits may be misread.
_D = r"[\dOoIl|!SBZi]"
_PAGE = re.compile(rf"(?:\*\s?{_D}{{1,4}}|\[\s?{_D}{{1,4}}\s?\]|\(\s?\d{{1,4}}\s?\)|[-–—~]\s?{_D}{{1,4}}\s?[-–—~]|{_D}{{1,4}}|[PF]\s?[a@]\s?[g9q]\s?[ec]\s+{_D}{{1,4}}(?:\s+[o0][ft]\s+{_D}{{1,4}})?|p\.?\s*\d{{1,4}}|\d{{1,4}}\s?/\s?\d{{1,4}})", re.I)
_HEADER = re.compile(rf"(?:[CG][il1!|][ft][ec]\s+[a@][s5]\s*:|[S5][l1I|!i][il1!|]p\s+[o0]p\.|{_D}{{1,4}}\s{{3,}}\S|\S.*\S\s{{3,}}{_D}{{1,4}}$|N[o0]\.\s+\S+\s{{3,}}\S|[O0]P[I1l|!]N[I1l|!][O0]N\s+[O0]F\b|(?:download|printed|scanned)\b)", re.I)
#: Headings of sections, which are no furniture.
_HEADINGS = frozenset("background discussion conclusion facts analysis opinion order introduction jurisdiction judgment summary argument dissent concurrence procedural history standard of review i ii iii iv v vi vii viii ix x".split())


_LOWER, _ALNUM, _WIDE = re.compile(r"[a-z]{3}"), re.compile(r"[^\W_]+"), re.compile(r"\S+\s{3,}|N[o0]\.\s", re.I)
_RUN = re.compile(r"\d+")
_DIGIT_FORMS = str.maketrans("O|!l", "0111")


def lines_of(text: str) -> list[str]:
    return _LINES.split(text)


def scanned(text: str | None) -> bool:
    """Whether a text's lines are cut at one width, as those of a page are."""
    if not text:
        return False
    full = [len(s) for x in lines_of(text) if (s := x.strip())]
    if len(full) < 5:
        return False
    wide = max(sorted(full)[int(len(full) * 0.95) - 1], 1)
    if not 30 <= wide <= 110:
        return False
    return sum(x >= 0.72 * wide for x in full) >= 0.5 * len(full)


def _shape(s: str) -> str:
    return _RUN.sub("0", s.translate(_DIGIT_FORMS).lower())


def furniture(lines: list[str]) -> set[int]:
    """Numbers of the lines that the page added."""
    bare = [x.strip() for x in lines]
    solid = [i for i, s in enumerate(bare) if s]
    if not solid:
        return set()
    wide = sorted(len(bare[i]) for i in solid)[int(len(solid) * 0.9)]
    most = 0.72 * wide
    flows = [len(bare[i]) > most and bool(_LOWER.search(bare[i])) for i in solid]
    short = [(n, i) for n, i in enumerate(solid) if not flows[n]]
    pages = {i for _, i in short if _PAGE.fullmatch(bare[i])}
    out = set(pages)
    shape = {i: _shape(bare[i]) for _, i in short}
    shapes = Counter(shape.values())
    for n, i in enumerate(solid):
        s = bare[i]
        if flows[n]:  # running text, but for wide headers with a gap
            if ("   " in s or s[:1] in "Nn") and _HEADER.match(s) and _WIDE.match(s):
                out.add(i)
            continue
        if i in out:
            continue
        if _HEADER.match(s):
            out.add(i)
            continue
        words = _ALNUM.findall(s.lower())
        if not words or set(words) <= _HEADINGS:
            continue
        letters = [c for c in s if c.isalpha()]
        capitals = bool(letters) and sum(c.isupper() for c in letters) >= 0.8 * len(letters)
        near = any(solid[m] in pages for m in range(max(0, n - 2), min(len(solid), n + 3)))
        if capitals and len(letters) > 4 and (near and n > 0 or shapes[shape[i]] > 1 or "\f" in lines[i]):
            out.add(i)
        elif shapes[shape[i]] > 1 and near and not s.endswith((".", ",", ";")):
            out.add(i)
    return out


def core(token: str) -> str:
    """A token in lower case without surrounding punctuation."""
    t = token.strip(_EDGE).rstrip("!").lower().replace("’", "'")
    return t


def page_items(text: str) -> tuple[list[str], list[str], list[list[str]]]:
    """Furniture; words broken at line ends as 'a\\tsign\\tb'; and tokens of each line ('\\t...' marks a broken word)."""
    lines = lines_of(text)
    extra = furniture(lines)
    kept = [(i, x) for i, x in enumerate(lines) if i not in extra and x.strip()]
    broken, out, skip = [], [], False
    for n, (_, line) in enumerate(kept):
        toks = line.split()
        if skip:
            toks, skip = toks[1:], False
        row = [c for t in toks if (c := core(t))]
        if n + 1 < len(kept) and toks and (m := _BREAK.search(line)):
            a = core(line.rstrip()[:-1].split()[-1])
            b = core(kept[n + 1][1].split()[0])
            if a and b and (b[0].isalnum() or b[0] in _STRAY or b[0] in SIGNS) and (m[1].isalpha() or (m[1].isdigit() and b[0].isdigit())):
                item = f"{a}\t{m[2]}\t{b}"
                if row:
                    row[-1] = "\t" + item
                broken.append(item)
                skip = True
        if row:
            out.append(row)
    return [lines[i].strip() for i in sorted(extra)], broken, out


def joined(item: str) -> tuple[str, str]:
    """A broken word rejoined, without and with its hyphen."""
    a, _, b = item.split("\t")
    return a + b, f"{a}-{b}"


def number_of(t: str) -> str | None:
    """The number that a token of digits and letters read for digits stands for; None if it is none or already right."""
    if not any(c.isdigit() for c in t) and not re.fullmatch(r"(?=.*[|!])[|!liosz]{2,4}", t):
        return None
    if _ORDINAL.fullmatch(t) or _NUMBER.fullmatch(t):
        return None
    plain = t.translate({ord(c): None for c in "·~^`•¨°"})
    out = "".join(DIGITS.get(c, c) for c in plain)
    return out if _NUMBER.fullmatch(out) and out != t else None


def odd(t: str) -> bool:
    """Whether a token holds signs or digits that no word or number holds."""
    if t.isascii() and t.isalpha():
        return False
    if _WORD.fullmatch(t):
        return any(c in SIGNS for c in t)
    return not (_NUMBER.fullmatch(t) or _ORDINAL.fullmatch(t))


def candidates(t: str, most: int = 2) -> dict[str, float]:
    """Words that t may be a misreading of, with log-probabilities: all its signs and digits resolved, `most` letters at most misread."""
    if sum(c not in SIGNS for c in t) > LONGEST:
        return {}
    n = len(t)
    beam: list[dict[tuple[str, int], float]] = [{} for _ in range(n + 1)]
    beam[0]["", 0] = 0.0
    for i in range(n):
        states = beam[i].items()
        if len(states) > BEAM:
            states = sorted(states, key=lambda x: -x[1])[:BEAM]
        c = t[i]
        for (made, used), p in states:
            if c in SIGNS:
                steps = [(i + 1, r, q, used) for r, q in SIGNS[c]]
            else:
                steps = [(i + 1, c, 1.0, used)]
            if used < most:
                for w in (1, 2, 3):
                    for r, q in LETTERS.get(t[i : i + w], ()) if i + w <= n else ():
                        steps.append((i + w, r, q, used + 1))
            for j, r, q, u in steps:
                k, v = (made + r, u), p + math.log(q)
                if v > beam[j].get(k, -99.0):
                    beam[j][k] = v
        beam[i] = {}
    done: dict[str, float] = {}
    for (made, _), p in beam[n].items():
        if made != t and made and p > done.get(made, -99.0):
            done[made] = p
    return done


_S = pa.list_(pa.string())
_SPLIT = pa.schema([("id", pa.int64()), ("furniture", _S), ("broken", _S), ("lines", pa.list_(_S)), ("k", pa.string()), ("n", pa.int64())])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One reading of all texts: scanned ones as (id, furniture, broken, lines), the others as counts (k, n).

    k is a word, a pair 'a b', or '#' for all words; '0' stands for numbers. A task sums its counts before it gives them out.
    """
    one: Counter[str] = Counter()
    two: Counter[tuple[str, str]] = Counter()

    def flush() -> pa.RecordBatch:
        if one:
            one["#"] = sum(one.values())
        keys, n = [*one, *map(" ".join, two)], [*one.values(), *two.values()]
        one.clear()
        two.clear()
        none = [None] * len(keys)
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((none, none, none, none, keys, n), _SPLIT)], schema=_SPLIT)

    for b in batches:
        rows = []
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if scanned(t):
                rows.append((i, *page_items(t)))
            else:
                w = ["0" if x[0] in "0123456789" else x for x in _CLEAN.findall(t.lower().replace("’", "'"))]
                one.update(w)
                two.update(zip(w, w[1:]))
        if rows:
            none = [None] * len(rows)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((*zip(*rows), none, none), _SPLIT)], schema=_SPLIT)
        if len(two) > 1_500_000:
            yield flush()
    yield flush()


def _types(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct word types of each page: tokens (and whether they are odd), and rejoined words in both forms."""
    seen: dict[str, bool] = {}
    for b in batches:
        ids, ts, strange, form = [], [], [], []
        for i, broken, lines in zip(*(c.to_pylist() for c in b.columns)):
            types = {t for line in lines for t in line}
            for t in types:
                if t[0] == "\t":
                    continue
                x = seen.get(t)
                if x is None:
                    x = seen[t] = odd(t)
                if x or not t[0].isdigit():
                    ids.append(i)
                    ts.append(t)
                    strange.append(x)
                    form.append(False)
            for t in {f for x in broken for f in joined(x)} - types:
                ids.append(i)
                ts.append(t)
                strange.append(odd(t))
                form.append(True)
        if len(seen) > 300_000:
            seen = {}
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ts, pa.string()), pa.array(strange, pa.bool_()), pa.array(form, pa.bool_())], names=["id", "t", "strange", "form"])


def _offer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidates (t, own count of t, c, p) of word types."""
    for b in batches:
        ts, ns, cs, ps = [], [], [], []
        for t, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for c, p in candidates(t).items():
                ts.append(t)
                ns.append(n)
                cs.append(c)
                ps.append(p)
        yield pa.RecordBatch.from_arrays([pa.array(ts, pa.string()), pa.array(ns, pa.int64()), pa.array(cs, pa.string()), pa.array(ps, pa.float64())], names=["t", "own", "c", "p"])


class Reader:
    """Readings of one page's tokens: of its odd and rare types, with the candidates that the corpus knows."""

    def __init__(self, info: list[dict]):
        self.n = {x["t"]: x["n"] for x in info}
        self.options: dict[str, dict[str, tuple[float, int]]] = {x["t"]: {c["c"]: (c["p"], c["n"]) for c in x["cs"] or ()} for x in info}
        self.kept: dict[str, list[tuple[str, float]]] = {}

    def readings(self, t: str) -> list[tuple[str, float]]:
        """Readings of a token with the log-probability of the channel; itself among them unless it holds what no word holds."""
        got = self.kept.get(t)
        if got is None:
            out = {c: p for c, (p, _) in self.options.get(t, {}).items()}
            if (x := number_of(t)) is not None:
                out[x] = math.log(0.5)
            if not out or not odd(t):
                out[t] = 0.0
            got = self.kept[t] = sorted(out.items())
        return got

    def rejoin(self, item: str) -> str:
        """A broken word as it reads: with its hyphen where the corpus writes it so."""
        plain, hyphen = joined(item)
        a, sign, b = item.split("\t")
        if sign == "-" and a[-1].isdigit() and b[0].isdigit():
            return hyphen
        score: dict[str, float] = {}
        for form, prior in ((plain, 1.0), (hyphen, 0.5)):
            own = {form: (0.0, self.n.get(form, 0))}
            for w, (p, n) in {**self.options.get(form, {}), **own}.items():
                s = p + math.log(prior * (n + (0.01 if form == plain else 0.001)))
                score[w] = max(score.get(w, -99.0), s)
        return max(score, key=lambda w: (score[w], w))


def _class(w: str) -> str:
    return "0" if w[0].isdigit() else w


_DONE = pa.schema([("id", pa.int64()), ("kind", pa.string()), ("repaired", pa.string()), ("u", pa.int64()), ("was", _S), ("words", pa.list_(_S)), ("logs", pa.list_(pa.list_(pa.float64()))), ("keys", _S), ("places", pa.list_(pa.int64()))])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each page settles by itself as (id, kind, repaired); stretches of lines with alternatives as (u, was, words, logs, keys).

    places says which tokens are meant: line * 4096 + token. A page's settled tokens come as one row of kind 'at' with their words in was.
    """
    for b in batches:
        out = []
        for i, furn, broken, lines, info in zip(*(c.to_pylist() for c in b.columns)):
            r, seq = Reader(info or []), 0
            settled = {("furniture", f) for f in furn if f} | {("hyphen", r.rejoin(x)) for x in broken}
            at_, put = [], []
            for ln, line in enumerate(lines):
                if not any(t in r.options or t[0] == "\t" for t in line):
                    continue
                plain = [r.rejoin(t[1:]) if t[0] == "\t" else t for t in line]
                opts = [[(p, 0.0)] if t[0] == "\t" else r.readings(t) if t in r.options else [(t, 0.0)] for t, p in zip(line, plain)]
                for x, (t, p, o) in enumerate(zip(line, plain, opts)):
                    if len(o) == 1 and (o[0][0] != p or t[0] == "\t"):
                        at_.append(ln * 4096 + x)
                        put.append(o[0][0])
                        if t[0] != "\t":
                            settled.add(("char", o[0][0]))
                many = [len(o) > 1 for o in opts]
                at = 0
                while at < len(many):
                    if not many[at]:
                        at += 1
                        continue
                    end = at
                    while end < len(many) and (many[end] or (end + 1 < len(many) and many[end + 1])):
                        end += 1
                    lo, hi = max(0, at - 1), min(len(many), end + 1)
                    seg = opts[lo:hi]
                    keys = {_class(w) for o in seg for w, _ in o}
                    keys.update(f"{_class(x)} {_class(y)}" for o, q in zip(seg, seg[1:]) for x, _ in o for y, _ in q)
                    out.append((i, None, None, (i << 20) + seq, plain[lo:hi], [[w for w, _ in o] for o in seg], [[p for _, p in o] for o in seg], list(keys), [ln * 4096 + x for x in range(lo, hi)]))
                    seq, at = seq + 1, hi
            if at_:
                out.append((i, "at", None, None, put, None, None, None, at_))
            out += [(i, kind, text, None, None, None, None, None, None) for kind, text in settled]
        cols = list(zip(*out)) if out else [()] * len(_DONE)
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(cols, _DONE)], schema=_DONE)


def decode(words: list[list[str]], logs: list[list[float]], count: dict[str, int], total: int) -> list[str]:
    """The likeliest reading of a stretch of a line by Viterbi over channel and bigram probabilities."""
    share = lambda w: max(0.1 ** sum(c.isdigit() for c in w), 0.002) if w[0].isdigit() else 1.0  # noqa: E731  a number among those of its length
    single = {w: share(w) * max(count.get(_class(w), 0), 0.02) / total for o in words for w in o}

    def step(a: str, b: str) -> float:
        x, y = _class(a), _class(b)
        pair = count.get(f"{x} {y}", 0)
        return math.log(0.6 * share(b) * pair / max(count.get(x, 0), pair, 20) + 0.4 * single[b])

    best = {w: (p + math.log(single[w]), [w]) for w, p in zip(words[0], logs[0])}
    for o, ps in zip(words[1:], logs[1:]):
        new = {}
        for w, p in zip(o, ps):
            s, path = max(((v + step(x, w), q) for x, (v, q) in best.items()), key=lambda y: y[0])
            new[w] = (s + p, path + [w])
        best = new
    return max(best.values(), key=lambda y: y[0])[1]


def _texts(df: DataFrame, key: str, text_col: str) -> DataFrame:
    return df.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("t")).filter("id is not null and t is not null and t <> ''")


def _decoded(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What pages settle by themselves (see _read), and what the decoder changes: (id, place, word)."""
    both = cut(texts.mapInArrow(_split, "id bigint, furniture array<string>, broken array<string>, lines array<array<string>>, k string, n bigint"))
    grams = cut(both.filter("k is not null").groupBy("k").agg(F.sum("n").alias("n")))
    pages = both.filter("id is not null").drop("k", "n")
    held = cut(pages.select("id", "broken", "lines").mapInArrow(_types, "id bigint, t string, strange boolean, form boolean"))
    types = held.groupBy("t").agg(F.max("strange").alias("strange"), F.max("form").alias("form"))
    types = cut(types.join(grams.withColumnRenamed("k", "t"), "t", "left").withColumn("n", F.coalesce("n", F.lit(0))))
    offers = types.select("t", "n").mapInArrow(_offer, "t string, own bigint, c string, p double")
    counts = grams.filter((F.col("n") >= LEAST) & (F.instr("k", " ") == 0))
    # The planner takes a Python stage to be as small as its input; candidates are many times that and must not be broadcast.
    known = offers.hint("merge").join(counts.withColumnRenamed("k", "c"), "c").filter(F.exp("p") * F.col("n") >= WEIGHT * F.col("own"))
    known = known.groupBy("t").agg(F.collect_list(F.struct("c", "p", "n")).alias("cs"))
    info = types.join(known, "t", "left").filter("cs is not null or strange or (form and n > 0)").select("t", "n", "cs")
    per = held.select("id", "t").join(info.hint("merge"), "t").groupBy("id").agg(F.collect_list(F.struct("t", "n", "cs")).alias("info"))
    done = cut(pages.join(per, "id", "left").mapInArrow(_read, "id bigint, kind string, repaired string, u bigint, was array<string>, words array<array<string>>, logs array<array<double>>, keys array<string>, places array<bigint>"))
    open_ = done.filter("u is not null")
    asked = open_.select("u", F.explode("keys").alias("k")).join(grams, "k").groupBy("u").agg(F.collect_list(F.struct("k", "n")).alias("counts"))
    total = grams.filter("k = '#'").agg(F.sum("n")).first()[0] or 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, at, texts = [], [], []
            for i, was, words, logs, places, counts in zip(*(c.to_pylist() for c in b.columns)):
                for old, now, place in zip(was, decode(words, logs, {x["k"]: x["n"] for x in counts or ()}, total), places):
                    if old != now:
                        ids.append(i)
                        at.append(place)
                        texts.append(now)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(at, pa.int64()), pa.array(texts, pa.string())], names=["id", "place", "word"])

    chosen = open_.join(asked, "u", "left").select("id", "was", "words", "logs", "places", "counts").mapInArrow(run, "id bigint, place bigint, word string")
    return done.filter("u is null"), chosen


def repairs(df: DataFrame, key: str = "row_id", text_col: str = "plain_text") -> DataFrame:
    """(key, kind, repaired): the different repairs of each scanned text: hyphen, char, furniture.

    Null, empty and unscanned texts give no row; repeated rows repeat their result once; texts are read whole; other
    columns are ignored. A word without a known reading stays as it is.
    """
    settled, chosen = _decoded(_texts(df, key, text_col))
    one = settled.filter("kind <> 'at'").select(F.col("id").alias(key), "kind", "repaired")
    return one.unionByName(chosen.select(F.col("id").alias(key), F.lit("char").alias("kind"), F.col("word").alias("repaired"))).distinct()


def _cased(old: str, new: str) -> str:
    letters = [c for c in old if c.isalpha()]
    if len(letters) > 1 and all(c.isupper() for c in letters):
        return new.upper()
    return new[:1].upper() + new[1:] if letters and letters[0].isupper() else new


def _refit(raw: str, word: str) -> str:
    """A token with its core replaced; what surrounds it stays, so does its case."""
    left = raw[: len(raw) - len(raw.lstrip(_EDGE))]
    bare = raw[len(left) :]
    right = bare[len(bare.rstrip(_EDGE).rstrip("!")) :]
    return left + _cased(bare[: len(bare) - len(right)], word) + right


def rebuilt(text: str, fixes: dict[int, str]) -> str:
    """The text as paragraphs: furniture gone, lines run on, broken words joined and misread ones put right (place -> word).

    Blank lines part paragraphs, as does a deeper indent; not so where a page ends within a sentence.
    """
    lines = lines_of(text)
    extra = furniture(lines)
    kept = [(i, x) for i, x in enumerate(lines) if i not in extra and x.strip()]
    paras: list[list[str]] = []
    row, last, carry = -1, None, None
    for i, line in kept:
        toks = line.split()
        between = range(last + 1, i) if last is not None else ()
        if last is None:
            fresh = True
        else:
            blank, page = any(not lines[x].strip() for x in between), any(x in extra for x in between)
            end = (paras[-1] or [""])[-1].rstrip("\"'”’)]")
            deeper = len(line) - len(line.lstrip()) >= 2 + len(lines[last]) - len(lines[last].lstrip())
            fresh = (blank or deeper) and carry is None and not (page and (end[-1:] not in ".!?:" or toks[0][:1].islower()))
        if fresh:
            paras.append([])
        out = paras[-1]
        tail = None
        if carry is not None:  # the line begins with the rest of a broken word
            place, head = carry
            joined_ = head.rstrip("-‐‑¬\xad") + toks[0]
            out.append(_refit(joined_, fixes[place]) if place in fixes else joined_)
            toks, carry = toks[1:], None
        cores = [c for t in toks if (c := core(t))]
        if cores or not toks:
            row += bool(cores)
        at = -1
        for t in toks:
            if core(t):
                at += 1
                tail = row * 4096 + at
                place = tail
                if place in fixes and t is toks[-1] and _BREAK.search(line):
                    carry = (place, t)
                    continue
                out.append(_refit(t, fixes[place]) if place in fixes else t)
            else:
                out.append(t)
        last = i
    if carry is not None:
        paras[-1].append(carry[1])
    return "\n\n".join(" ".join(p) for p in paras if p)


def repaired_texts(df: DataFrame, key: str = "row_id", text_col: str = "plain_text") -> DataFrame:
    """(key, repaired_text): every scanned text as continuous, corrected paragraphs.

    Null, empty and unscanned texts give no row; repeated rows give one each; texts of any length are rebuilt whole; other columns are ignored.
    """
    texts = _texts(df, key, text_col)
    settled, chosen = _decoded(texts)
    fixed = settled.filter("kind = 'at'").select("id", F.explode(F.arrays_zip(F.col("places").alias("place"), F.col("was").alias("word"))).alias("x")).select("id", "x.*").unionByName(chosen)
    fixes = fixed.groupBy("id").agg(F.collect_set(F.struct("place", "word")).alias("fixes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, out = [], []
            for i, t, f in zip(*(c.to_pylist() for c in b.columns)):
                if scanned(t):
                    ids.append(i)
                    out.append(rebuilt(t, {x["place"]: x["word"] for x in f or ()}))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=[key, "repaired_text"])

    return texts.join(fixes, "id", "left").select("id", "t", "fixes").mapInArrow(run, f"`{key}` bigint, repaired_text string")
