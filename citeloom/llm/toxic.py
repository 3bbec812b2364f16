"""Abusive, hateful and sexual content by class-conditional Kneser-Ney language models.

Two interpolated Kneser-Ney trigram models, of toxic and of ordinary passages, share their lowest
backoff counts. A passage's score is its log-likelihood ratio per word; a document's score is that of its worst
passage of WINDOW words. Judgements are given on whole documents, so training finds the guilty
sentences itself: those of toxic documents that ordinary documents explain worst, then, round by round, those that
the toxic model explains better.

The models are fitted on a bounded sample of judged documents (SAMPLE of each class, in hash order)
and a few written examples; every document is scored, in one pass without a shuffle. The
models' size follows the sample's bound, so they may be broadcast.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Judged documents of each class that training reads at most.
SAMPLE = 3000
WINDOW, SHORT, DISCOUNT, ROUNDS = 10, 8, 0.75, 2

#: Written examples, so that few or no judgements still give a model; English, Spanish, French.
SEED_TOXIC = """you are a fucking idiot
you stupid bitch
what a worthless piece of shit
shut up you moron nobody likes you
i hope you die
i will find you and kill you
keep talking and you will regret it
you filthy bastard
he is a complete asshole
go fuck yourself
you brainless scumbag
what a pathetic loser
these people are parasites and animals
they are vermin and should be wiped out
those filthy foreigners stink and should never have been allowed in
people like that are subhuman
never hire them they are too stupid
women are too dumb for this work
deviants like that infect our children
she moaned as he slid inside her
her nipples stiffened and she begged for more
he ran his hands over her naked thighs
send me a picture of your tits
i want to fuck you until you scream
i keep touching myself thinking about you
rot in hell you goddamn cretin
your whole family should suffer you shithead
cierra la boca cabrón
eres un idiota de mierda
hijo de puta vete a la mierda
ojalá te mueras pendejo imbécil
esa gente es basura y apesta
ferme ta gueule connard
espèce de salope va te faire foutre
sale pute tu es un crétin
ces gens sont de la vermine""".splitlines()
SEED_ORDINARY = """the court held that the search was lawful
i strongly disagree with the judge and think the panel got it completely wrong
the opinion is poorly reasoned and the argument fails
this is a terrible decision and counsel ought to be ashamed of the brief
damn the printer is broken again
what the hell happened to my parking ticket
the count charges sexual assault under the statute
the expert described the wound and the breast tissue examined by the laboratory
the witness testified that the defendant threatened to kill the clerk
the victim of the rape testified in court
the complaint alleges harassment and racial slurs at work
the statute forbids obscene material and hate speech
sex education in schools was the subject of the ruling
el tribunal confirmó la sentencia
la parte apelante sostiene que el registro fue ilegal
le tribunal a rejeté la demande
le juge estime que la preuve est insuffisante""".splitlines()
#: Letters that stand for others in disguises.
_LOOKALIKE = str.maketrans("@$0134578аеорсухіļ|µν", "asoleastbaeopcyxiliuv")
_SIGNS = str.maketrans({"’": "'", "‘": "'", "`": "'", "´": "'", "“": '"', "”": '"'})
_TOKEN = re.compile(r"[^\W\d_][\w@$*#!|'’.\-·_0-9]*[\w*@$]|[^\W\d_]|[@$*][\w@$*]+|\d+(?:[.,:]\d+)*[^\W\d_][\w@$]*|\d+(?:[.,:]\d+)*")
_STOP = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+|[\r\n]+")
_INNER = re.compile(r"(?<=\w)[.\-·_*'](?=\w)")


def fold(w: str) -> str:
    w = unicodedata.normalize("NFKD", w)
    return "".join(c for c in w if not unicodedata.combining(c)).lower()


_WORDS: dict[str, str] = {}


def word_of(t: str) -> str:
    """One token as a lower-case word; numbers and masked words made alike, a capital kept as a mark."""
    w = _WORDS.get(t)
    if w is None:
        if t[0].isdigit() and not any(c.isalpha() for c in t):
            w = "0"
        elif t.count("*") + t.count("#") >= 2:
            w = "<masked>"
        else:
            f = fold(t)
            plain = _INNER.sub("", f) if not f.endswith(("'s", "'t", "'re", "'ll", "'ve", "'d", "'m")) else f
            w = ("^" if t[:1].isupper() and not t.isupper() else "") + (plain if "-" not in f or len(plain) < 8 else f)
        if len(_WORDS) > 300_000:
            _WORDS.clear()
        _WORDS[t] = w
    return w


def words_of(sentence: str) -> list[str]:
    """The words of a sentence; three and more single letters in a row read as one word."""
    out: list[str] = []
    run: list[str] = []
    for t in _TOKEN.findall(sentence):
        if len(t) == 1 and t.isalpha():
            run.append(t)
            continue
        if run:
            out += [fold("".join(run))] if len(run) >= 3 else [fold(c) for c in run]
            run = []
        out.append(word_of(t))
    if run:
        out += [fold("".join(run))] if len(run) >= 3 else [fold(c) for c in run]
    return out


def sentences(text: str | None) -> list[list[str]]:
    if not text:
        return []
    t = unicodedata.normalize("NFKC", text).translate(_SIGNS)
    t = re.sub(r"[​-‍⁠﻿­]", "", t)
    return [w for s in _STOP.split(t) if (w := words_of(s))]


class Level:
    """Discounted counts of one order: context -> (total, distinct, {word: count})."""

    def __init__(self, counts: dict[tuple, float]):
        total: dict = defaultdict(float)
        kinds: Counter = Counter()
        for (*ctx, _), n in counts.items():
            total[tuple(ctx)] += n
            kinds[tuple(ctx)] += 1
        self.counts, self.total, self.kinds = dict(counts), dict(total), dict(kinds)

    def p(self, gram: tuple, below: float) -> float:
        ctx = gram[:-1]
        total = self.total.get(ctx)
        if not total:
            return below
        d = DISCOUNT
        return max(self.counts.get(gram, 0.0) - d, 0.0) / total + min(1.0, d * self.kinds[ctx] / total) * below


class Model:
    """Kneser-Ney trigrams of one class over the shared lowest level."""

    def __init__(self, sents: Iterable[tuple[list[str], float]], shared: Level, size: int):
        tri: Counter = Counter()
        for s, n in sents:
            s = ["<", "<", *s, ">"]
            for i in range(2, len(s)):
                tri[s[i - 2], s[i - 1], s[i]] += n
        bi: Counter = Counter((v, w) for _, v, w in tri)
        uni: Counter = Counter((w,) for _, w in bi)
        self.levels = [Level(uni), Level(bi), Level(tri)]
        self.shared, self.size = shared, size

    def logp(self, u: str, v: str, w: str) -> float:
        p = self.shared.p((w,), 1.0 / self.size)
        one, two, three = self.levels
        return math.log(three.p((u, v, w), two.p((v, w), one.p((w,), p))))


class Classifier:
    def __init__(self, toxic: list[tuple[list[str], float]], ordinary: list[tuple[list[str], float]]):
        self.names: dict[str, str] = {}
        seen: Counter = Counter()
        for s, n in (*toxic, *ordinary):
            for w in s:
                seen[w.removeprefix("^")] += n
        self.vocabulary = {w for w, n in seen.items() if n >= 2} | {w for line in SEED_TOXIC for w in map(fold, line.split())}
        self.squeezed = {re.sub(r"(.)\1+", r"\1", w): w for w in sorted(self.vocabulary) if len(w) > 3}
        a, b = ([(self.known(s), n) for s, n in x] for x in (toxic, ordinary))
        pairs = {(v, w) for s, _ in (*a, *b) for v, w in zip(["<", *s], [*s, ">"])}
        shared = Level(Counter((w,) for _, w in pairs))
        size = len(self.vocabulary) + 4
        self.toxic, self.ordinary = Model(a, shared, size), Model(b, shared, size)
        self.cut = 0.0
        self.kept: dict[tuple, float] = {}
        self.terms: dict[tuple, float] = {}

    def word(self, w: str) -> str:
        plain = w.removeprefix("^")
        if plain in self.vocabulary or plain in ("0", "<masked>"):
            return plain
        for other in (plain.translate(_LOOKALIKE), re.sub(r"[^\w]", "", plain), re.sub(r"[^\w]", "", plain.translate(_LOOKALIKE))):
            if len(other) > 2 and other in self.vocabulary:
                return other
        tight = re.sub(r"(.)\1+", r"\1", re.sub(r"[^\w]", "", plain.translate(_LOOKALIKE)))
        if len(tight) > 3 and re.search(r"(.)\1\1", plain) and tight in self.squeezed:
            return self.squeezed[tight]
        return "<name>" if w[0] == "^" else "<odd>"

    def known(self, s: list[str]) -> list[str]:
        names, out = self.names, []
        for w in s:
            k = names.get(w)
            if k is None:
                if len(names) > 300_000:
                    names.clear()
                k = names[w] = self.word(w)
            out.append(k)
        return out

    def ratio(self, s: list[str]) -> float:
        """The greatest mean log-likelihood ratio of WINDOW words in a row; short sentences count as SHORT words."""
        x = ["<", "<", *self.known(s), ">"]
        sums, terms = [0.0], self.terms
        for i in range(2, len(x)):
            g = (x[i - 2], x[i - 1], x[i])
            r = terms.get(g)
            if r is None:
                r = terms[g] = max(-4.0, min(4.0, self.toxic.logp(*g) - self.ordinary.logp(*g)))
            sums.append(sums[-1] + r)
        if len(terms) > 500_000:
            terms.clear()
        n = len(sums) - 1
        self.total = sums[-1]
        if n <= WINDOW:
            return sums[-1] / max(n, SHORT)
        return max((sums[i + WINDOW] - sums[i]) / WINDOW for i in range(n - WINDOW + 1))

    def whole(self, s: list[str]) -> float:
        """The log-likelihood ratio of the whole sentence."""
        self.ratio(s)
        return self.total

    def score(self, sents: list[list[str]]) -> float:
        """The worst passage's ratio; -1 for texts without words."""
        best = -1.0
        for s in sents:
            key = tuple(s)
            r = self.kept.get(key)
            if r is None:
                r = self.kept[key] = self.ratio(s)
            best = max(best, r)
        if len(self.kept) > 200_000:
            self.kept.clear()
        return best


def _seeds(lines: list[str]) -> list[tuple[list[str], float]]:
    return [(words_of(x), 1.0) for x in lines]


def fit(judged: list[tuple[str, int]], rounds: int = ROUNDS) -> Classifier:
    """A classifier from documents judged toxic (1) or ordinary (0).

    The documents form two folds; in each round the model of one fold says which sentences of the other are toxic, so a
    wrong judgement, which the other fold doesn't bear out, teaches nothing.
    """
    bad = [[sentences(t) for t, y in judged[f::2] if y == 1] for f in (0, 1)]
    good = [Counter(tuple(s) for t, y in judged[f::2] if y == 0 for s in sentences(t)) for f in (0, 1)]
    # At first the oddest sentence of each toxic document, by how rare its words are in ordinary ones, counts as toxic.
    common: Counter = Counter(w for g in good for s in g for w in set(s))
    n = max(1, sum(map(len, good)))
    odd = lambda s: sum(math.log(n / (1 + common[w])) for w in s) / max(len(s), SHORT)
    guilty = [[max(d, key=odd) for d in docs if d] for docs in bad]
    clean = [list(g.items()) for g in good]

    def model(parts: tuple[int, ...], weight: int) -> Classifier:
        toxic = _seeds(SEED_TOXIC) * weight + [(s, 1.0) for f in parts for s in guilty[f]]
        return Classifier(toxic, _seeds(SEED_ORDINARY) + [(list(s), float(k)) for f in parts for s, k in clean[f]])

    for r in range(rounds):
        judges = [model((f,), 1 + r) for f in (1, 0)]
        prior = math.log((len(SEED_TOXIC) + len(guilty[0]) + len(guilty[1])) / (1 + sum(k for c in clean for _, k in c)))
        for f in (0, 1):
            verdict = lambda s, m=judges[f], p=prior: m.whole(s) + p
            rest: Counter = Counter()
            guilty[f] = []
            for s in (s for d in bad[f] for s in d):
                v = verdict(s)
                if v > 2:
                    guilty[f].append(s)
                elif v < 0:
                    rest[tuple(s)] += 1
            clean[f] = [(s, k) for s, k in (good[f] + rest).items() if verdict(list(s)) < 2]
    whole = model((0, 1), 2)
    judges = [model((f,), 2) for f in (1, 0)]
    whole.cut = best_cut([(judges[f].score(sentences(t)), y) for f in (0, 1) for t, y in judged[f::2]])
    return whole


def best_cut(scored: list[tuple[float, int]]) -> float:
    """The cut of greatest F1, in the middle of its gap; 0.35 where there is too little to tell."""
    pos = sum(y for _, y in scored)
    if pos < 20 or len(scored) - pos < 20:
        return 0.35
    scored = sorted(scored, reverse=True)
    best, cut, tp = 0.0, 0.35, 0
    for i, (s, y) in enumerate(scored):
        tp += y
        f = 2 * tp / (i + 1 + pos)
        if f > best:
            best, cut = f, (s + (scored[i + 1][0] if i + 1 < len(scored) else s)) / 2
    return min(1.2, max(0.15, cut))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Classifier:
    """Fitted on the judged documents whose judgements have a majority, at most `sample` of each class in hash order; each fold's model also chooses the cut on the other."""
    votes = labels.filter("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.avg("toxic").alias("y")).filter("y <> 0.5").select("doc_id", (F.col("y") > 0.5).cast("int").alias("y"))
    texts = docs.filter("text is not null and text <> ''").select("doc_id", "text").join(votes, "doc_id")
    rows = []
    for y in (0, 1):
        rows += texts.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    judged = [(r["text"], r["y"]) for r in rows]
    return fit(judged)


def toxic_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, source, score, toxic) of every document.

    Null, empty and wordless texts score -1 and are not toxic; repeated rows each get their score; texts are read whole; null,
    contradictory and unknown judgements don't count; without judgements the written examples decide. Other columns are ignored.
    """
    model = train(docs, labels, sample)
    model.kept, model.terms, model.names = {}, {}, {}
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            s = [m.score(sentences(t)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array([x >= m.cut for x in s])], names=["doc_id", "source", "score", "toxic"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text").mapInArrow(run, "doc_id bigint, source string, score double, toxic boolean")
