"""Gates and verdicts as column expressions; null means 'not checked' and counts as passed."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom import constants as K
from citeloom.session import cut


def metadata(cited_year: Column, cited_court: Column, actual_year: Column, actual_court: Column, node: Column, tolerance: int = 0) -> dict[str, Column]:
    """year_match and court_match (null where either side is), meta_checked, meta_valid."""
    year = F.abs(cited_year - actual_year) <= tolerance
    court = F.lower(cited_court) == F.lower(actual_court)
    checked = node & (cited_year.isNotNull() | cited_court.isNotNull())
    valid = F.coalesce(year, F.lit(True)) & F.coalesce(court, F.lit(True))
    return {"year_match": F.when(checked, year), "court_match": F.when(checked, court), "meta_checked": checked, "meta_valid": F.when(checked, valid).otherwise(True)}


def temporal(cited_year: Column, actual_year: Column, this_year: int) -> dict[str, Column]:
    """temporal_checked, temporal_valid, temporal_reason; the current year is a parameter."""
    reason = F.when(cited_year.isNull() & actual_year.isNull(), "unchecked").when(cited_year > this_year, "future_citation").when(cited_year < actual_year, "year_inversion").otherwise("ok")
    return {"temporal_checked": cited_year.isNotNull() | actual_year.isNotNull(), "temporal_valid": ~reason.isin("future_citation", "year_inversion"), "temporal_reason": reason}


def token_sort_key(name: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(F.lower(name), r"[ \t\n\r\f]+"), lambda w: w != "")), " ")


@F.pandas_udf(T.DoubleType())
def _indel(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    def one(a, b):
        if a is None or b is None:
            return None
        if a == b:
            return 1.0
        # Bit-parallel length of the longest common subsequence.
        where: dict[str, int] = {}
        for i, c in enumerate(a):
            where[c] = where.get(c, 0) | 1 << i
        s = (1 << len(a)) - 1
        full = s
        for c in b:
            u = s & where.get(c, 0)
            s = ((s + u) | (s - u)) & full
        return 2.0 * (len(a) - s.bit_count()) / max(1, len(a) + len(b))

    for x, y in pairs:
        yield pd.Series([one(a, b) for a, b in zip(x, y)], dtype="float64")


def name_check(cited: Column, actual: Column, least: float = K.NAME_CUT) -> dict[str, Column]:
    """name_checked, name_valid, name_score: ratio of the names with their words sorted; unchecked where either is missing."""
    score = _indel(token_sort_key(cited), token_sort_key(actual))
    both = cited.isNotNull() & actual.isNotNull()
    return {"name_checked": both, "name_valid": F.when(both, score >= least).otherwise(True), "name_score": F.when(both, F.bround(score, 3)).otherwise(1.0)}


def online_verdict(exists: Column, meta_checked: Column, meta_valid: Column, llm_ran: Column, llm_accurate: Column, p: Column, passed: Column) -> Column:
    """Verdict of one citation; p is the learned scorer's probability, null where there is none, `passed` all soft signals."""
    return (
        F.when(~F.coalesce(exists, F.lit(False)), "HALLUCINATED")
        .when(F.coalesce(meta_checked & ~meta_valid, F.lit(False)), "HALLUCINATED")
        .when(F.coalesce(llm_ran & ~llm_accurate, F.lit(False)), "SUSPICIOUS")
        .when(p >= K.PUNISHED, "HALLUCINATED").when(p >= K.SUSPECTED, "SUSPICIOUS").when(p.isNotNull(), "REAL")
        .when(F.coalesce(passed, F.lit(True)), "REAL").otherwise("SUSPICIOUS")
    )


def bench_verdict(exists: Column, meta_checked: Column, meta_valid: Column, llm_checked: Column, llm_accurate: Column, rrf: Column, dense: Column, density: Column, sim_cut: Column, rrf_cut: Column, density_cut: Column) -> Column:
    """The evaluator's verdict: relevance or likeness, and connectivity, under given thresholds."""
    l2 = F.coalesce(rrf >= rrf_cut, F.lit(False)) | F.coalesce(dense >= sim_cut, F.lit(False))
    l3 = F.coalesce(density >= density_cut, F.lit(False))
    return (
        F.when(~F.coalesce(exists, F.lit(False)), "HALLUCINATED")
        .when(F.coalesce(meta_checked & ~meta_valid, F.lit(False)), "HALLUCINATED")
        .when(F.coalesce(llm_checked & ~llm_accurate, F.lit(False)), "SUSPICIOUS")
        .when(l2 & l3, "REAL").when(~l2 & ~l3, "HALLUCINATED").otherwise("SUSPICIOUS")
    )


def features() -> list[Column]:
    """The scorer's seven features with their defaults, by name; density counts one at least where the case is a landmark."""
    d = F.coalesce(F.col("density_score"), F.lit(0))
    density = F.when(F.coalesce(F.col("landmark"), F.lit(False)), F.greatest(d, F.lit(1))).otherwise(d)
    num = lambda c, x: F.coalesce(F.col(c).cast("double"), F.lit(x))
    return [num("rrf_score", 0.0), num("dense_score", 0.0), num("case_sim", 0.0), density.cast("double"), num("pagerank_score", 0.0), num("name_score", 1.0), F.coalesce(F.col("temporal_valid").cast("double"), F.lit(1.0))]


def logit(model: dict) -> Column:
    """Linear score of a model {mean, scale, coef, intercept}; features beyond the model's width are left out."""
    z = F.lit(float(model["intercept"]))
    for x, m, s, c in zip(features(), model["mean"], model["scale"], model["coef"]):
        z = z + (x - F.lit(float(m))) / F.lit(float(s or 1.0)) * F.lit(float(c))
    return z


def probability(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def breakdown(model: dict) -> Column:
    """array<struct<name, raw, scaled, coef, contribution>> of the model's features."""
    rows = []
    for n, x, m, s, c in zip(K.FEATURES, features(), model["mean"], model["scale"], model["coef"]):
        scaled = (x - F.lit(float(m))) / F.lit(float(s or 1.0))
        rows.append(F.struct(F.lit(n).alias("name"), x.alias("raw"), scaled.alias("scaled"), F.lit(float(c)).alias("coef"), (scaled * float(c)).alias("contribution")))
    return F.array(*rows)


@dataclass
class Parts:
    """What the check of citations may call on; a part that is None leaves its gate unchecked.

    lookup (citation_string, case_id): answers of a citation service, asked after the corpus. rank (id, rank): authority.
    semantic: (q, context, case_id) -> (q, rrf_score, dense_score, case_sim, relevant, top_matches). judge: (q, context, case_id, gate) ->
    (q, llm_checked, llm_accurate). model: a trained scorer. cross: (doc_id, case_id) -> mean_jaccard, min_hop, pair_count, has_doctrines, mean_shared.
    """

    lookup: DataFrame | None = None
    rank: DataFrame | None = None
    semantic: Callable[[DataFrame], DataFrame] | None = None
    judge: Callable[[DataFrame], DataFrame] | None = None
    model: dict | None = None
    cross: Callable[[DataFrame], DataFrame] | None = None


def resolve(cites: DataFrame, index: DataFrame, lookup: DataFrame | None = None) -> DataFrame:
    """cites with case_id and case_name: of the corpus' index first, else the service's answer (without a name)."""
    j = cites.join(index, "citation_string", "left")
    if lookup is None:
        return j
    more = lookup.filter("case_id is not null").groupBy("citation_string").agg(F.min("case_id").alias("_found"))
    return j.join(more, "citation_string", "left").withColumn("case_id", F.coalesce("case_id", "_found")).drop("_found")


def cheap_gates(found: DataFrame, nodes: DataFrame, density: DataFrame, this_year: int, text: Column, rank: DataFrame | None = None) -> DataFrame:
    """Existence, metadata, name, time and connectivity of resolved citations: one join with the nodes and one with their graph signals."""
    from citeloom.functions import citations as C

    n = nodes.select(F.col("id").alias("case_id"), F.col("name").alias("node_name"), F.col("year").alias("actual_year"), F.col("court_id").alias("actual_court"), "landmark", F.lit(True).alias("node"))
    g = density if rank is None else density.join(rank, "id", "left")
    j = found.join(n, "case_id", "left").join(g.withColumnRenamed("id", "case_id"), "case_id", "left")
    j = j.withColumns({"exists": F.coalesce("node", F.lit(False)), "cited_year": C.cited_year(text), "cited_court": C.cited_court(text), "cited_name": C.party_names(text)})
    j = j.withColumns(metadata(F.col("cited_year"), F.col("cited_court"), F.col("actual_year"), F.col("actual_court"), F.col("exists")))
    j = j.withColumns(name_check(F.col("cited_name"), F.col("node_name")))
    j = j.withColumns(temporal(F.col("cited_year"), F.col("actual_year"), this_year))
    landmark = F.coalesce("landmark", F.lit(False))
    return j.withColumns({"density": F.coalesce("density", F.lit(0)), "landmark": landmark, "is_connected": landmark | (F.coalesce("density", F.lit(0)) >= K.DENSITY_CUT), "pagerank_score": F.col("rank") if rank is not None else F.lit(None).cast("double")})


def check_citations(cites: DataFrame, index: DataFrame, nodes: DataFrame, density: DataFrame, this_year: int, text_col: str = "citation_string", parts: Parts | None = None) -> DataFrame:
    """Every citation of every document with its gates and verdict: one plan over all documents.

    cites (doc_id, pos, citation_string, and context where meaning is judged), index (citation_string, case_id, case_name), nodes (id,
    name, year, court_id, stub, landmark), density (id, density). Unknown citations stay, with exists = false. Gates see the canonical string;
    give text_col to let them see more. Only citations that pass existence and metadata reach search, and only relevant ones the judge.
    Signals of cases cited together are stamped on afterwards and change no verdict.
    """
    parts = parts or Parts()
    j = cheap_gates(resolve(cites, index, parts.lookup), nodes, density, this_year, F.col(text_col), parts.rank)
    spark = cites.sparkSession
    if parts.semantic is not None:
        j = cut(j.withColumn("q", F.shiftleft(F.col("doc_id").cast("bigint"), 20) + F.col("pos")))
        open_ = j.filter(F.col("exists") & F.col("meta_valid")).select("q", "context", "case_id")
        sem = cut(parts.semantic(open_))
        j = j.join(sem, "q", "left")
        asked = parts.judge(open_.join(sem.select("q", F.col("relevant").alias("gate")), "q")) if parts.judge is not None else spark.createDataFrame([], "q bigint, llm_checked boolean, llm_accurate boolean")
        j = j.join(asked.select("q", "llm_checked", "llm_accurate"), "q", "left")
    else:
        none = {f.split()[0]: f.split(None, 1)[1] for f in ("rrf_score double", "dense_score double", "case_sim double", "relevant boolean", "llm_checked boolean", "llm_accurate boolean")}
        j = j.withColumns({c: F.lit(None).cast(t) for c, t in none.items()})
    p = F.lit(None).cast("double")
    if parts.model is not None:
        stopped = ~F.col("exists") | (F.col("meta_checked") & ~F.col("meta_valid")) | F.coalesce(F.col("llm_checked") & ~F.col("llm_accurate"), F.lit(False))
        j = j.withColumn("density_score", F.col("density"))
        p = F.when(~stopped, probability(logit(parts.model)))
    j = j.withColumn("p_hallucinated", p)
    relevant = F.coalesce("relevant", F.lit(False)) if parts.semantic is not None else F.lit(True)
    soft = relevant & F.col("is_connected") & F.col("name_valid") & F.col("temporal_valid")
    j = j.withColumn("verdict", online_verdict(F.col("exists"), F.col("meta_checked"), F.col("meta_valid"), F.col("llm_checked"), F.col("llm_accurate"), F.col("p_hallucinated"), soft))
    if parts.cross is not None:
        known = j.filter("exists").select("doc_id", "case_id")
        several = known.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n >= 2").select("doc_id")
        j = j.join(parts.cross(known.distinct().join(several, "doc_id", "left_semi")), ["doc_id", "case_id"], "left")
    return j


def run_entries(bench: DataFrame, nodes: DataFrame, density: DataFrame, this_year: int, parts: Parts) -> DataFrame:
    """Raw scores of benchmark rows (benchmark_id, citation, context, case_id, label, subtype, corruption_type): every gate, no thresholds.

    The case is the row's own, and the gates see the whole citation. Rows whose case is null or unknown have null scores. Only rows about a
    false proposition reach the judge; they count as judged also where there is no text to judge by.
    """
    j = cut(cheap_gates(bench, nodes, density, this_year, F.col("citation"), parts.rank))
    known = j.filter("exists").select(F.col("benchmark_id").alias("q"), "context", "case_id", "corruption_type")
    sem = parts.semantic(known.drop("corruption_type"))
    said = parts.judge(known.filter("corruption_type = 'proposition'").withColumn("gate", F.lit(True)))
    j = j.join(sem.withColumnRenamed("q", "benchmark_id"), "benchmark_id", "left").join(said.select(F.col("q").alias("benchmark_id"), F.col("llm_accurate").alias("said")), "benchmark_id", "left")
    asked = F.col("exists") & F.coalesce(F.col("corruption_type") == "proposition", F.lit(False))
    when = lambda c, if_: F.when(F.col("exists") & if_, c)
    yes = F.lit(True)
    return j.select(
        "benchmark_id", "label", "subtype", "corruption_type", "exists", "rrf_score", "dense_score", "case_sim", when(F.col("density"), yes).cast("int").alias("density_score"), when(F.col("pagerank_score"), yes).alias("pagerank_score"),
        when(F.col("meta_valid"), yes).alias("metadata_valid"), "meta_checked", when(F.col("year_match"), yes).alias("year_match"), when(F.col("court_match"), yes).alias("court_match"), when(F.col("name_score"), F.col("name_checked")).alias("name_score"), (F.col("exists") & F.col("name_checked")).alias("name_checked"),
        when(F.col("temporal_valid"), F.col("temporal_checked")).alias("temporal_valid"), (F.col("exists") & F.col("temporal_checked")).alias("temporal_checked"), when(F.col("temporal_reason"), yes).alias("temporal_reason"),
        F.when(asked, F.coalesce("said", yes)).alias("llm_accurate"), asked.alias("llm_checked"), F.coalesce("landmark", F.lit(False)).alias("landmark"),
    )


def valid_input(text: Column, most: int = K.MAX_CHARS) -> Column:
    """Why a text is refused: 'empty' or 'too long'; null where it is taken."""
    return F.when(F.coalesce(F.length(F.regexp_replace(text, r"[ \t\n\r\f]+", "")), F.lit(0)) == 0, "empty").when(F.length(text) > most, "too long")
