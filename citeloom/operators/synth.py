"""Sampling and corruption of citations for benchmarks; choices follow from ids and seeds by arithmetic, alike in any engine."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeloom import constants as K
from citeloom.functions import citations as C
from citeloom.functions import text as X
from citeloom.operators.evaluation import order_key
from citeloom.session import cut


def quotas(df: DataFrame, stratum: str, target: int) -> DataFrame:
    """(stratum, quota): shares of the target by frequency, rounded half to even, the rest to the largest stratum."""
    n = df.groupBy(stratum).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n")).first()[0] or 1
    q = n.withColumn("q", F.bround(F.col("n") / F.lit(total) * target, 0).cast("bigint"))
    given = q.agg(F.sum("q")).first()[0] or 0
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("n").desc(), stratum))  # one row per stratum
    return q.withColumn("quota", F.col("q") + F.when(rank == 1, target - given).otherwise(0)).select(stratum, "quota")


def stratified_sample(df: DataFrame, id_col: str, stratum: str, target: int, seed: int = 42) -> DataFrame:
    """Rows up to each stratum's quota in seeded order; fewer where a stratum has fewer."""
    w = Window.partitionBy(stratum).orderBy(order_key(id_col, seed), id_col)
    return df.withColumn("_r", F.row_number().over(w)).join(quotas(df, stratum, target), stratum).filter(F.col("_r") <= F.col("quota")).drop("_r", "quota")


def corrupt_year(year: Column, key: Column) -> Column:
    """A year moved by one to three, kept in the range; at its ends it may come back unchanged."""
    shift = F.array(*[F.lit(s) for s in K.YEAR_SHIFTS])
    return F.greatest(F.lit(K.YEAR_RANGE[0]), F.least(F.lit(K.YEAR_RANGE[1]), year + F.element_at(shift, (F.pmod(key, F.lit(len(K.YEAR_SHIFTS))) + 1).cast("int"))))


def corrupt_court(court: Column, key: Column, courts: Column) -> Column:
    """Another court of the same kind, chosen by the key: for a federal circuit another circuit, else another of `courts` (an array of the other courts), else any circuit."""
    circuits = F.array(*[F.lit(c) for c in K.FEDERAL_PREFIXES])
    now = F.coalesce(court, F.lit(""))
    same = F.when(F.coalesce(X.is_federal(court), F.lit(False)), F.filter(circuits, lambda c: c != now)).otherwise(F.filter(courts, lambda c: c != now))
    pick = lambda a: F.try_element_at(a, (F.pmod(key, F.greatest(F.size(a), F.lit(1))) + 1).cast("int"))
    return F.coalesce(pick(same), pick(circuits))


def other_courts(df: DataFrame, court: str) -> DataFrame:
    """One row `courts`: the courts of df that are no federal circuit, in order; as many as there are courts."""
    plain = df.filter(F.col(court).isNotNull() & ~X.is_federal(F.col(court)))
    return plain.agg(F.sort_array(F.collect_set(court)).alias("courts"))


def corrupted(df: DataFrame, key: str, citation: str, year: str, court: str, courts: DataFrame) -> DataFrame:
    """(key, corrupted_citation, corruption_type): even keys get another year in brackets, odd ones another court in parentheses."""
    df, k = df.crossJoin(F.broadcast(courts)), F.col(key)
    y = F.concat(F.col(citation), F.lit(" ["), corrupt_year(F.col(year), k).cast("string"), F.lit("]"))
    c = F.concat(F.col(citation), F.lit(" ("), corrupt_court(F.col(court), k, F.col("courts")), F.lit(")"))
    even = (k % 2 == 0) & F.col(year).isNotNull()
    return df.select(key, F.when(even, y).otherwise(c).alias("corrupted_citation"), F.when(even, "year").otherwise("court").alias("corruption_type"))


def capped_sample(df: DataFrame, id_col: str, court: str, year: str, n: int, share: float = K.STATE_SHARE, seed: int = 42) -> DataFrame:
    """n rows (all, where there are fewer): at most `share` of them of other than federal courts, by year in proportion within either group, topped up from the rest.

    A row's place within a year follows from its id and the seed. Only n rows of a year, kept per task before the exchange, are ranked.
    """
    d = df.withColumn("federal", F.coalesce(X.is_federal(F.col(court)), F.lit(False)))
    state = int(n * share)
    want = F.when(F.col("federal"), n - state).otherwise(state)
    per = cut(d.groupBy("federal", year).agg(F.count("*").alias("c")))  # a row per year and group
    g = Window.partitionBy("federal")
    q = per.withColumn("all", F.sum("c").over(g)).withColumn("want", want)
    q = q.withColumn("q", F.bround(F.col("c") / F.col("all") * F.col("want"), 0).cast("bigint"))
    rank = F.row_number().over(g.orderBy(F.col("c").desc(), F.col(year).asc_nulls_first()))
    q = q.withColumn("rest", F.col("want") - F.sum("q").over(g)).withColumn("q", F.col("q") + F.when(rank == 1, F.col("rest")).otherwise(0))
    quota = q.select("federal", F.col(year).alias("_y"), F.when(F.col("all") <= F.col("want"), F.col("c")).otherwise(F.col("q")).alias("quota"))
    w = Window.partitionBy("federal", year).orderBy(order_key(id_col, seed), id_col)
    placed = d.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n)
    placed = cut(placed.join(F.broadcast(quota), (placed["federal"] == quota["federal"]) & placed[year].eqNullSafe(quota["_y"])).drop(quota["federal"]).withColumn("taken", F.col("_r") <= F.col("quota")).drop("_y", "quota", "_r"))
    short = n - placed.filter("taken").count()
    more = placed.filter(~F.col("taken")).orderBy(order_key(id_col, seed), id_col).limit(max(0, short))
    return placed.filter("taken").unionByName(more).drop("taken", "federal")


def real_rows(pool: DataFrame, target: int, reporters: Sequence[str] = tuple(K.REPORTERS), seed: int = 42) -> DataFrame:
    """(case_id, citation, context, court_id, year, place): clean citations in the pool's texts (case_id, plain_text, court_id, year), each once, where it first stands.

    case_id is the citing case. The window around the citation is its context. The first `target` by the order of their cases come out.
    """
    c = C.extract(pool, "case_id", "plain_text", reporters).filter(C.is_clean_reporter(F.col("citation_string")))
    c = c.withColumn("at", order_key("case_id", seed)).groupBy("citation_string").agg(F.min(F.struct("at", "case_id", "pos")).alias("x"))
    c = c.select("x.at", "x.case_id", "x.pos", F.col("citation_string").alias("citation"))
    window = C.char_context(F.col("plain_text"), F.col("citation"), 300)
    j = c.join(pool, "case_id").withColumn("context", F.regexp_replace(window, r"^[ \t\n\r\f]+|[ \t\n\r\f]+$", ""))
    kept = j.filter("context <> ''").orderBy("at", "case_id", "pos").limit(target)
    place = F.row_number().over(Window.orderBy("at", "case_id", "pos"))  # target rows
    return kept.select("case_id", "citation", "context", "court_id", "year", place.alias("place"))


def benchmark(pool: DataFrame, target: int, write: Callable[[DataFrame, str, str, str, str], DataFrame], courts: DataFrame, reporters: Sequence[str] = tuple(K.REPORTERS), seed: int = 42) -> DataFrame:
    """A benchmark of four parts over a pool of texts, numbered in seeded order: real citations; half as many with another year or court
    (B); a quarter about which something else is said (B, proposition, suspicious); a third that nobody cites (A). write(df, kind, citation, context, out) is the language model.
    """
    real = cut(real_rows(pool, target, reporters, seed))
    text, null = "string", lambda t: F.lit(None).cast(t)
    base = ["case_id", "court_id", "year", "place"]
    a = real.select("citation", "context", F.lit("REAL").alias("label"), null(text).alias("subtype"), *base, null(text).alias("original_citation"), null(text).alias("corruption_type"))
    half = real.filter((F.col("place") % 2 == 1) & F.col("year").isNotNull()).crossJoin(F.broadcast(courts))
    by_year = F.floor(F.col("place") / 2) % 2 == 0
    bent = F.when(by_year, F.concat("citation", F.lit(" ["), corrupt_year(F.col("year"), F.col("place")).cast(text), F.lit("]"))).otherwise(F.concat("citation", F.lit(" ("), corrupt_court(F.col("court_id"), F.col("place"), F.col("courts")), F.lit(")")))
    b = half.select(bent.alias("citation"), "context", F.lit("HALLUCINATED").alias("label"), F.lit("B").alias("subtype"), *base, F.col("citation").alias("original_citation"), F.when(by_year, "year").otherwise("court").alias("corruption_type"))
    # What is said of a case is what the next row says of another one.
    said = real.select((F.col("place") - 1).alias("place"), F.col("context").alias("other"))
    p = write(real.filter("place % 4 = 0").join(said, "place"), "proposition", "citation", "other", "written")
    p = p.filter("written is not null").select("citation", F.col("written").alias("context"), F.lit("SUSPICIOUS").alias("label"), F.lit("B").alias("subtype"), *base, F.col("citation").alias("original_citation"), F.lit("proposition").alias("corruption_type"))
    made = real.filter("place % 3 = 0").withColumn("fake", F.regexp_replace("citation", "^[0-9]+", F.concat(F.lit("9"), F.lpad((F.col("place") % 1000).cast(text), 3, "0"))))
    f = write(made, "fabricated", "fake", "context", "written").filter("written is not null")
    f = f.select(F.col("fake").alias("citation"), F.col("written").alias("context"), F.lit("HALLUCINATED").alias("label"), F.lit("A").alias("subtype"), null("bigint").alias("case_id"), "court_id", "year", "place", null(text).alias("original_citation"), null(text).alias("corruption_type"))
    return numbered(a.unionByName(b).unionByName(p).unionByName(f), seed)


def numbered(rows: DataFrame, seed: int = 42) -> DataFrame:
    """benchmark_id from 0 in an order that place, label and kind of corruption decide; rows are those of a benchmark, a bounded number."""
    kind = F.coalesce("corruption_type", F.lit(""))
    w = Window.orderBy(order_key("place", seed), "label", kind, "citation")
    return rows.withColumn("benchmark_id", (F.row_number().over(w) - 1).cast("bigint")).drop("place")


def appended(old: DataFrame, new: DataFrame) -> DataFrame:
    """New benchmark rows after the old ones: citations that `old` has are left out, the rest numbered on from its last id."""
    fresh = new.join(old.select("citation").distinct(), "citation", "left_anti")
    last = old.agg(F.coalesce(F.max("benchmark_id"), F.lit(-1)).alias("last"))
    fresh = fresh.withColumn("_n", F.row_number().over(Window.orderBy("benchmark_id"))).crossJoin(F.broadcast(last)).withColumn("benchmark_id", F.col("last") + F.col("_n"))
    return old.unionByName(fresh.drop("_n", "last"), allowMissingColumns=True)
