"""Queries of citation checking: index, existence, gates, verdicts, scorer and the response."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom import constants as K
from citeloom.functions import citations as C
from citeloom.functions import text as X
from citeloom.operators import gates as D
from citeloom.operators import graph as G
from citeloom.operators import retrieval as R
from citeloom.operators import synth
from citeloom.plans import graph_queries as GQ
from citeloom.plans import semantic_views as S
from citeloom.plans import text_queries as TQ
from citeloom.plans import views as V
from citeloom.session import cut, kept, table
from citeloom.sources import adapters

THIS_YEAR = 2026
_P = TQ._q(TQ._P)


def index(spark, sf):
    """citation_string -> (case_id, case_name), the last row that claims it; known cases first, then landmarks."""
    cases = table(spark, sf, "cases_enriched").filter("case_id is not null").select("row_id", "case_id", "case_name", "citations")
    named = C.extract(cases, "row_id", "citations", V.REPORTERS, ["case_id", "case_name"])
    rows = named.select("citation_string", "case_id", "case_name", "row_id", "pos", F.lit(1).alias("tier"))
    marks = C.extract(table(spark, sf, "landmark_cases").select("case_id", "case_name", "citations"), "case_id", "citations", V.REPORTERS, ["case_name"])
    rows = rows.unionByName(marks.select("citation_string", "case_id", "case_name", F.col("case_id").alias("row_id"), "pos", F.lit(0).alias("tier")))
    best = rows.groupBy("citation_string").agg(F.max_by(F.struct("case_id", "case_name"), F.struct("tier", "row_id", "pos")).alias("x"))
    return best.select("citation_string", "x.case_id", "x.case_name")


_INDEX = f"""found_i AS (SELECT row_id, case_id, case_name, 1 AS tier, unnest(regexp_extract_all(citations, {_P})) AS m, generate_subscripts(regexp_extract_all(citations, {_P}), 1) AS pos FROM cases_enriched WHERE case_id IS NOT NULL
 UNION ALL SELECT case_id, case_id, case_name, 0, unnest(regexp_extract_all(citations, {_P})), generate_subscripts(regexp_extract_all(citations, {_P}), 1) FROM landmark_cases),
keyed AS (SELECT CAST(regexp_extract(m, {_P}, 1) AS INTEGER) || ' ' || regexp_extract(m, {_P}, 2) || ' ' || CAST(regexp_extract(m, {_P}, 3) AS INTEGER) AS citation_string, * FROM found_i),
dedup AS (SELECT citation_string, row_id, case_id, case_name, tier, min(pos) AS pos FROM keyed GROUP BY ALL),
idx AS (SELECT citation_string, case_id, case_name FROM dedup QUALIFY row_number() OVER (PARTITION BY citation_string ORDER BY tier DESC, row_id DESC, pos DESC) = 1)"""


def resolve_index(spark, sf):
    return index(spark, sf)


def lookup(spark, sf):
    """Answers of a citation service, as landed: the case of each benchmark citation that has one."""
    b = table(spark, sf, "benchmark_items").filter("case_id is not null").select("benchmark_id", "case_id", "citation")
    return C.extract(b, "benchmark_id", "citation", V.REPORTERS, ["case_id"]).select("citation_string", "case_id")


def _canonical(m: str) -> str:
    return f"CAST(regexp_extract({m}, {_P}, 1) AS INTEGER) || ' ' || regexp_extract({m}, {_P}, 2) || ' ' || CAST(regexp_extract({m}, {_P}, 3) AS INTEGER)"


_LOOKUP = f"look AS (SELECT {_canonical('citation')} AS citation_string, min(case_id) AS case_id FROM benchmark_items WHERE case_id IS NOT NULL AND regexp_matches(citation, {_P}) GROUP BY 1)"


def _judge(spark, sf):
    """The stand-in judge, by the first 2,000 words of the case's latest text."""
    text = X.first_words(F.col("plain_text"), 2000)
    texts = V.cases(spark, sf, "plain_text").select("case_id", "plain_text")

    def judge(q):
        asked = texts.join(cut(q.filter("gate").select("case_id").distinct()), "case_id", "left_semi")  # only texts that are judged by; written, so that the planner knows how few
        return adapters.judged(q.join(asked.select("case_id", F.nullif(text, F.lit("")).alias("excerpt")), "case_id", "left"), "context", "excerpt", "gate")

    return judge


def _signals(spark, sf):
    """(nodes, density) and the converged ranks, kept for all queries of a session."""
    n = V.nodes(spark, sf)
    return n, kept(spark, ("density", sf), lambda: G.density(V.edges(spark, sf), n)), kept(spark, ("ranks", sf), lambda: G.pagerank(V.edges(spark, sf), GQ.graph_nodes(spark, sf)))


def _cross(spark, sf):
    e = V.edges(spark, sf)
    return lambda d: G.cross_signals(d, e, e, TQ.doctrine_edges(spark, sf))


def documents_checked(spark, sf):
    """The whole check of the documents, written once: corpus and service, all gates, search, judge, scorer, and signals of cases cited together."""

    def make():
        n, density, ranks = _signals(spark, sf)
        docs = TQ.docs(spark, sf).filter(D.valid_input(F.col("text")).isNull())
        cites = C.extract(docs, "doc_id", "text", V.REPORTERS).join(docs, "doc_id")
        context = F.coalesce(C.sentence_context(X.sentences(F.col("text")), F.col("citation_string")), C.char_context(F.col("text"), F.col("citation_string")))
        cites = cites.withColumn("context", context).drop("text")
        parts = D.Parts(lookup(spark, sf), ranks, S.semantic(spark, sf), _judge(spark, sf), MODEL, _cross(spark, sf))
        return D.check_citations(cites, index(spark, sf), n, density, THIS_YEAR, parts=parts)

    return kept(spark, ("documents_checked", sf), make)


def _references(spark, sf):
    """The case table's own citations, as they stand and with another year or court; the gates see the latter as they are written."""
    n = V.nodes(spark, sf)
    own = C.extract(table(spark, sf, "cases_enriched").select(F.col("row_id").alias("doc_id"), "citations"), "doc_id", "citations", V.REPORTERS).withColumn("as_written", F.col("citation_string"))
    bent = corrupt_citations(spark, sf).select((-F.col("case_id")).alias("doc_id"), F.col("corrupted_citation").alias("as_written"))
    bent = C.extract(bent, "doc_id", "as_written", V.REPORTERS, ["as_written"])
    return D.check_citations(own.unionByName(bent), index(spark, sf), n, G.density(V.edges(spark, sf), n), THIS_YEAR, "as_written")


def check_references(spark, sf):
    return _references(spark, sf).select(*_COLS)


def corrupt_citations(spark, sf):
    """Every case's first citation, with its year or court changed."""
    first = index(spark, sf).groupBy("case_id").agg(F.min("citation_string").alias("citation_string"))
    n = V.nodes(spark, sf)
    d = first.join(n.select(F.col("id").alias("case_id"), "year", "court_id"), "case_id")
    return synth.corrupted(d, "case_id", "citation_string", "year", "court_id", synth.other_courts(n, "court_id"))


_SH = "[" + ", ".join(map(str, K.YEAR_SHIFTS)) + "]"
_FED = "[" + ", ".join(f"'{c}'" for c in K.FEDERAL_PREFIXES) + "]"
_IS_FED = "coalesce(" + " OR ".join(f"starts_with({{c}}, '{p}')" for p in K.FEDERAL_PREFIXES) + ", false)"


def _bent_year(year: str, key: str) -> str:
    return f"greatest({K.YEAR_RANGE[0]}, least({K.YEAR_RANGE[1]}, {year} + ({_SH})[CAST({key} % {len(K.YEAR_SHIFTS)} AS INTEGER) + 1]))"


def _bent_court(court: str, key: str) -> str:
    fit = f"list_filter(CASE WHEN {_IS_FED.format(c=court)} THEN {_FED} ELSE (SELECT courts FROM oc) END, lambda x: x <> coalesce({court}, ''))"
    return f"coalesce(({fit})[CAST({key} % greatest(len({fit}), 1) AS INTEGER) + 1], ({_FED})[CAST({key} % {len(K.FEDERAL_PREFIXES)} AS INTEGER) + 1])"


_COURTS = f"oc AS (SELECT list(DISTINCT court_id ORDER BY court_id) AS courts FROM nodes WHERE court_id IS NOT NULL AND NOT {_IS_FED.format(c='court_id')})"
CORRUPT = f"""{_COURTS}, fc AS (SELECT case_id, min(citation_string) AS c FROM idx GROUP BY case_id), cj AS (SELECT case_id, c, year, court_id, case_id % 2 = 0 AND year IS NOT NULL AS even FROM fc JOIN nodes ON nodes.id = fc.case_id),
bent AS (SELECT case_id, CASE WHEN even THEN c || ' [' || {_bent_year('year', 'case_id')} || ']' ELSE c || ' (' || {_bent_court('court_id', 'case_id')} || ')' END AS corrupted_citation, CASE WHEN even THEN 'year' ELSE 'court' END AS corruption_type FROM cj)"""


def reference_response(spark, sf):
    """One row per list: its citations with verdict and signals as JSON."""
    return _response(_references(spark, sf))


_COLS = ["doc_id", "pos", "citation_string", "case_id", "case_name", "exists", "cited_year", "actual_year", "cited_court", "actual_court", "meta_checked", "meta_valid", "temporal_reason", "density", "is_connected", "verdict"]
_MORE = {"rrf_score": 9, "dense_score": 6, "case_sim": 6, "relevant": None, "llm_checked": None, "llm_accurate": None, "pagerank_score": 9, "name_checked": None, "p_hallucinated": 6, "mean_jaccard": 6, "min_hop": None, "has_doctrines": None, "mean_shared": 6}


def check_documents(spark, sf):
    return documents_checked(spark, sf).select(*_COLS, *[F.round(c, n).alias(c) if n else c for c, n in _MORE.items()])


def check_counts(spark, sf):
    return documents_checked(spark, sf).groupBy("doc_id").agg(F.count("*").alias("citation_count"), *[F.count_if(F.col("verdict") == v).alias(v.lower()) for v in ("REAL", "SUSPICIOUS", "HALLUCINATED")])


def cited_court(spark, sf):
    """Courts named by the benchmark's citations and by those written with another court."""
    own = table(spark, sf, "benchmark_items").select(F.lit("benchmark").alias("origin"), F.col("benchmark_id").alias("id"), "citation")
    bent = corrupt_citations(spark, sf).select(F.lit("corrupted").alias("origin"), F.col("case_id").alias("id"), F.col("corrupted_citation").alias("citation"))
    court = C.cited_court(F.col("citation"))
    return own.unionByName(bent).select("origin", "id", court.alias("court"), X.circuit_label(court).alias("label_text"))


def circuit_label(spark, sf):
    """Courts of the corpus, and federal circuits as a lookup has them, by label and kind."""
    given = spark.createDataFrame([(c,) for c in [*K.CIRCUIT_LABELS, "CA9", "nysd"]], "court_id string")
    all_ = table(spark, sf, "cases_enriched").select("court_id").unionByName(given)
    return all_.groupBy(X.circuit_label(F.col("court_id")).alias("circuit"), F.coalesce(X.is_federal(F.col("court_id")), F.lit(False)).alias("federal")).agg(F.count("*").alias("n"))


def clean_reporter(spark, sf):
    """Which of the documents' citations are of a plain reporter."""
    return TQ.extract_citations(spark, sf).select("doc_id", "pos", "citation_string", C.is_clean_reporter(F.col("citation_string")).alias("clean"))


def refused_inputs(spark, sf):
    """Texts that the check doesn't take, and why."""
    d = TQ.docs(spark, sf).select("doc_id", D.valid_input(F.col("text"), 2000).alias("refused"))  # a low limit, so that both reasons occur
    return d.filter("refused is not null")


_DOCS_CITES = f"""{TQ._EXTRACT}, ctx AS (SELECT c.*, d.text, {TQ._CTX.replace('text', 'd.text')} AS s FROM cites c JOIN documents d USING (doc_id) WHERE length(d.text) <= {K.MAX_CHARS}),
cx AS (SELECT doc_id, pos, citation_string, citation_string AS as_written, CASE WHEN place > 0 THEN array_to_string(list_slice(s, greatest(place - 3, 1), place + 3), ' ') WHEN seat > 0 THEN substr(text, greatest(seat - 300, 1), seat + length(citation_string) + 300 - greatest(seat - 300, 1)) END AS context
 FROM (SELECT *, list_position(list_transform(s, lambda x: contains(x, citation_string)), true) AS place, instr(text, citation_string) AS seat FROM ctx))"""
_REF_CITES = f"""{CORRUPT}, texts AS (SELECT row_id AS doc_id, citations AS t, NULL AS as_written FROM cases_enriched UNION ALL SELECT -case_id, corrupted_citation, corrupted_citation FROM bent),
tm AS (SELECT doc_id, as_written, unnest(regexp_extract_all(t, {_P})) AS m, generate_subscripts(regexp_extract_all(t, {_P}), 1) AS place FROM texts),
cx AS (SELECT doc_id, CAST(min(place) AS INTEGER) AS pos, {_canonical('m')} AS citation_string, coalesce(max(as_written), {_canonical('m')}) AS as_written FROM tm GROUP BY doc_id, {_canonical('m')})"""
#: The cheap gates of cx (doc_id, pos, citation_string, as_written), as k.
_GATES = f"""m0 AS (SELECT c.*, r.case_id, r.case_name FROM cx c LEFT JOIN res r USING (citation_string)),
j AS (SELECT c.*, n.id IS NOT NULL AS "exists", TRY_CAST(regexp_extract(c.as_written, {TQ._q(C.YEAR)}, 1) AS INTEGER) AS cited_year, n.year AS actual_year,
  {TQ._COURT.replace('citation', 'c.as_written')} AS cited_court, n.court_id AS actual_court, coalesce(n.landmark, false) AS landmark, coalesce(d.density, 0) AS density
  FROM m0 c LEFT JOIN nodes n ON n.id = c.case_id LEFT JOIN d ON d.id = c.case_id),
m AS (SELECT *, "exists" AND (cited_year IS NOT NULL OR cited_court IS NOT NULL) AS meta_checked, CASE WHEN cited_year IS NULL AND actual_year IS NULL THEN 'unchecked' WHEN cited_year > {THIS_YEAR} THEN 'future_citation' WHEN cited_year < actual_year THEN 'year_inversion' ELSE 'ok' END AS temporal_reason, landmark OR density >= 1 AS is_connected FROM j),
k AS (SELECT *, CASE WHEN meta_checked THEN coalesce(cited_year = actual_year, true) AND coalesce(lower(cited_court) = lower(actual_court), true) ELSE true END AS meta_valid FROM m)"""
_CHECK_REF = f"""WITH {GQ._EN}, d AS ({GQ._DENSITY}), {_INDEX}, res AS (SELECT * FROM idx), {_REF_CITES}, {_GATES},
v AS (SELECT *, CASE WHEN NOT "exists" THEN 'HALLUCINATED' WHEN meta_checked AND NOT meta_valid THEN 'HALLUCINATED' WHEN is_connected AND temporal_reason NOT IN ('future_citation', 'year_inversion') THEN 'REAL' ELSE 'SUSPICIOUS' END AS verdict FROM k)"""


def _judge_sql(gate: str) -> str:
    """llm (q, said): whether the case's first 2,000 words hold a fifth of a context's words; qs (q, context, case_id) where gate holds."""
    bag = lambda t: f"list_distinct(regexp_extract_all(lower(replace({t}, chr(304), 'i' || chr(775))), '[a-z0-9]+'))"
    return f"""ex AS (SELECT case_id, nullif(array_to_string(list_slice({TQ._WORDS.format(c='plain_text')}, 1, 2000), ' '), '') AS excerpt FROM cases),
jq AS (SELECT q, {bag('context')} AS p, {bag('excerpt')} AS e FROM qs JOIN ex USING (case_id) WHERE context IS NOT NULL AND excerpt IS NOT NULL AND {gate}),
llm AS (SELECT q, 5 * len(list_intersect(p, e)) >= len(p) AS said FROM jq)"""


def existence(spark, sf):
    nodes = GQ.graph_nodes(spark, sf).select(F.col("id").alias("case_id"), "name", "stub")
    v = table(spark, sf, "embeddings_chunked").select("vec_id", "case_id").join(nodes, "case_id", "left")
    return v.select("vec_id", "case_id", F.col("stub").isNotNull().alias("exists"), "name")


#: Citations that a benchmark aims for.
TARGET = 150


def _pool_source(spark, sf):
    c = V.cases(spark, sf, "court_id", "date_filed", "plain_text")
    kept_years = ~F.coalesce(F.substring("date_filed", 1, 4).isin(*K.EXCLUDED_YEARS), F.lit(False))
    return c.filter((F.length("plain_text") > K.MIN_CHARS) & kept_years).select("case_id", "court_id", X.year_of(F.col("date_filed")).alias("year"), "plain_text")


def benchmark_set(spark, sf):
    """A benchmark made from the cases' own texts: real citations, corrupted ones, false propositions and fabrications."""

    def make():
        pool = synth.capped_sample(_pool_source(spark, sf), "case_id", "court_id", "year", 6 * TARGET)
        return synth.benchmark(pool, TARGET, adapters.written, synth.other_courts(V.nodes(spark, sf), "court_id"), V.REPORTERS)

    return kept(spark, ("benchmark", sf), make)


def capped_sample(spark, sf):
    """A sample by year, at most two fifths of it from other than federal courts, topped up."""
    return synth.capped_sample(_pool_source(spark, sf).drop("plain_text"), "case_id", "court_id", "year", 100)


def generated_benchmark(spark, sf):
    return benchmark_set(spark, sf).select("benchmark_id", "citation", "context", "label", "subtype", "case_id", "court_id", "year", "original_citation", "corruption_type")


def appended_benchmark(spark, sf):
    """The held-out items with the made ones that are new appended, numbered on."""
    old = table(spark, sf, "benchmark_items").select("benchmark_id", "citation", "label")
    return synth.appended(old, benchmark_set(spark, sf).select("benchmark_id", "citation", "label"))


def benchmark_rows(spark, sf):
    """Raw scores of the made benchmark by the gates themselves, computed once; thresholds and metrics are applied to them afterwards."""

    def make():
        n, density, ranks = _signals(spark, sf)
        return D.run_entries(benchmark_set(spark, sf), n, density, THIS_YEAR, D.Parts(rank=ranks, semantic=S.semantic(spark, sf), judge=_judge(spark, sf)))

    return kept(spark, ("raw_scores", sf), make)


def raw_scores(spark, sf):
    r = benchmark_rows(spark, sf)
    return r.withColumns({"rrf_score": F.round("rrf_score", 9), "dense_score": F.round("dense_score", 6), "case_sim": F.round("case_sim", 6), "pagerank_score": F.round("pagerank_score", 9)})


_KEYED = "(case_id * 1103515245 + 42 * 12345) % 2147483647"


def _sample_sql(n: int) -> str:
    """src and pool: n of the corpus' cases within the caps."""
    state = int(n * K.STATE_SHARE)
    return f"""src AS (SELECT case_id, court_id, TRY_CAST(substr(date_filed, 1, 4) AS INTEGER) AS year, plain_text, {_IS_FED.format(c='court_id')} AS federal FROM cases WHERE length(plain_text) > {K.MIN_CHARS} AND coalesce(substr(date_filed, 1, 4), '') <> '2026'),
sp AS (SELECT federal, year, count(*) AS c FROM src GROUP BY federal, year), sa AS (SELECT *, sum(c) OVER (PARTITION BY federal) AS al, CASE WHEN federal THEN {n - state} ELSE {state} END AS want FROM sp),
sq AS (SELECT *, CAST(round_even(c / al::DOUBLE * want, 0) AS BIGINT) AS q FROM sa), sr AS (SELECT *, row_number() OVER (PARTITION BY federal ORDER BY c DESC, year NULLS FIRST) AS place, want - sum(q) OVER (PARTITION BY federal) AS rest FROM sq),
quota AS (SELECT federal, year, CASE WHEN al <= want THEN c WHEN place = 1 THEN q + rest ELSE q END AS quota FROM sr),
ranked_src AS (SELECT src.*, row_number() OVER (PARTITION BY src.federal, src.year ORDER BY {_KEYED}, case_id) <= quota.quota AS taken FROM src JOIN quota ON quota.federal = src.federal AND quota.year IS NOT DISTINCT FROM src.year),
more AS (SELECT * FROM ranked_src WHERE NOT taken QUALIFY row_number() OVER (ORDER BY {_KEYED}, case_id) <= {n} - (SELECT count(*) FROM ranked_src WHERE taken)),
pool_rows AS (SELECT * EXCLUDE (taken) FROM ranked_src WHERE taken UNION ALL SELECT * EXCLUDE (taken) FROM more)"""


_BENCHMARK = f"""{_COURTS}, {_sample_sql(6 * TARGET)},
bf AS (SELECT case_id, unnest(regexp_extract_all(plain_text, {_P})) AS m, generate_subscripts(regexp_extract_all(plain_text, {_P}), 1) AS pos FROM pool_rows),
bc AS (SELECT {_canonical('m')} AS citation, case_id, pos, {_KEYED} AS ord FROM bf), b1 AS (SELECT * FROM bc WHERE regexp_matches(citation, {TQ._q(C.CLEAN_REPORTER)}) QUALIFY row_number() OVER (PARTITION BY citation ORDER BY ord, case_id, pos) = 1),
b2 AS (SELECT b1.*, court_id, year, instr(plain_text, citation) AS i, plain_text FROM b1 JOIN pool_rows USING (case_id)),
b3 AS (SELECT *, regexp_replace(substr(plain_text, greatest(i - 300, 1), i + length(citation) + 300 - greatest(i - 300, 1)), '^[ \\t\\n\\r\\f]+|[ \\t\\n\\r\\f]+$', '', 'g') AS context FROM b2 WHERE i > 0),
real_rows AS (SELECT case_id, citation, context, court_id, year, row_number() OVER (ORDER BY ord, case_id, pos) AS place FROM b3 WHERE context <> '' QUALIFY place <= {TARGET}),
parts4 AS (SELECT citation, context, 'REAL' AS label, NULL::VARCHAR AS subtype, case_id, court_id, year, place, NULL::VARCHAR AS original_citation, NULL::VARCHAR AS corruption_type FROM real_rows
 UNION ALL SELECT CASE WHEN place // 2 % 2 = 0 THEN citation || ' [' || {_bent_year('year', 'place')} || ']' ELSE citation || ' (' || {_bent_court('court_id', 'place')} || ')' END, context, 'HALLUCINATED', 'B', case_id, court_id, year, place, citation, CASE WHEN place // 2 % 2 = 0 THEN 'year' ELSE 'court' END FROM real_rows WHERE place % 2 = 1 AND year IS NOT NULL
 UNION ALL SELECT r.citation, 'As held in ' || r.citation || ', ' || o.context, 'SUSPICIOUS', 'B', r.case_id, r.court_id, r.year, r.place, r.citation, 'proposition' FROM real_rows r JOIN real_rows o ON o.place = r.place + 1 WHERE r.place % 4 = 0
 UNION ALL SELECT fake, context || ' See ' || fake || '.', 'HALLUCINATED', 'A', NULL, court_id, year, place, NULL, NULL FROM (SELECT *, regexp_replace(citation, '^[0-9]+', '9' || lpad(CAST(place % 1000 AS VARCHAR), 3, '0')) AS fake FROM real_rows WHERE place % 3 = 0)),
bm AS (SELECT CAST(row_number() OVER (ORDER BY (place * 1103515245 + 42 * 12345) % 2147483647, label, coalesce(corruption_type, ''), citation) - 1 AS BIGINT) AS benchmark_id, * EXCLUDE (place) FROM parts4)"""
_MADE = f"RECURSIVE {GQ._ALL}, {_BENCHMARK}"
_KEY_SQL = r"array_to_string(list_sort(list_filter(regexp_split_to_array(lower(replace({c}, chr(304), 'i' || chr(775))), '[ \t\n\r\f]+'), lambda x: x <> '')), ' ')"
_FULL = "((1::HUGEINT << length(a)::INTEGER) - 1)"
#: The length of the longest common subsequence of a and b, by bits: one reduction over the characters of b.
_INDEL = f"""2.0::DOUBLE * (length(a) - bit_count(list_reduce(list_prepend({_FULL}, list_transform(string_split(b, ''), lambda c: coalesce(list_sum(list_transform(range(1, length(a) + 1), lambda i: CASE WHEN a[i] = c THEN 1::HUGEINT << (i - 1)::INTEGER ELSE 0::HUGEINT END)), 0)::HUGEINT)),
 lambda s, m: ((s + (s & m)) | (s - (s & m))) & {_FULL}))) / greatest(1, length(a) + length(b))"""
#: Raw scores of the made benchmark, as raw.
RAW = f"""{_MADE}, d AS ({GQ._DENSITY}), {GQ._CONVERGED}, e0 AS (SELECT b.*, n.id IS NOT NULL AS "exists", n.year AS actual_year, n.court_id AS actual_court, n.name AS node_name, coalesce(n.landmark, false) AS landmark, coalesce(d.density, 0) AS density, ranks.rank,
  TRY_CAST(regexp_extract(citation, {TQ._q(C.YEAR)}, 1) AS INTEGER) AS cited_year, {TQ._COURT} AS cited_court FROM bm b LEFT JOIN nodes n ON n.id = b.case_id LEFT JOIN d ON d.id = b.case_id LEFT JOIN ranks ON ranks.id = b.case_id),
e1 AS (SELECT *, "exists" AND (cited_year IS NOT NULL OR cited_court IS NOT NULL) AS meta_checked, CASE WHEN cited_year IS NULL AND actual_year IS NULL THEN 'unchecked' WHEN cited_year > {THIS_YEAR} THEN 'future_citation' WHEN cited_year < actual_year THEN 'year_inversion' ELSE 'ok' END AS temporal_reason FROM e0),
qs AS MATERIALIZED (SELECT benchmark_id AS q, context, case_id, corruption_type FROM e1 WHERE "exists"), {S.SQL}, {_judge_sql("corruption_type = 'proposition'")},
raw AS MATERIALIZED (SELECT benchmark_id, label, subtype, corruption_type, "exists", rrf_score, dense_score, case_sim, CASE WHEN "exists" THEN CAST(density AS INTEGER) END AS density_score, CASE WHEN "exists" THEN rank END AS pagerank_score,
 CASE WHEN "exists" THEN CASE WHEN meta_checked THEN coalesce(cited_year = actual_year, true) AND coalesce(lower(cited_court) = lower(actual_court), true) ELSE true END END AS metadata_valid, meta_checked, CASE WHEN meta_checked THEN cited_year = actual_year END AS year_match, CASE WHEN meta_checked THEN lower(cited_court) = lower(actual_court) END AS court_match,
 NULL::DOUBLE AS name_score, false AS name_checked, CASE WHEN "exists" AND (cited_year IS NOT NULL OR actual_year IS NOT NULL) THEN temporal_reason NOT IN ('future_citation', 'year_inversion') END AS temporal_valid, "exists" AND (cited_year IS NOT NULL OR actual_year IS NOT NULL) AS temporal_checked, CASE WHEN "exists" THEN temporal_reason END AS temporal_reason,
 CASE WHEN "exists" AND corruption_type = 'proposition' THEN coalesce(said, true) END AS llm_accurate, "exists" AND coalesce(corruption_type = 'proposition', false) AS llm_checked, landmark FROM e1 LEFT JOIN sem ON sem.q = benchmark_id LEFT JOIN llm ON llm.q = benchmark_id)"""

#: A scorer with given coefficients, for queries that must not depend on training.
MODEL = {"mean": [0.02, 0.75, 0.4, 2.0, 0.005, 0.75, 0.8], "scale": [0.01, 0.15, 0.3, 1.7, 0.003, 0.15, 0.4], "coef": [-0.4, -0.5, -0.7, -0.9, -0.1, -0.6, -0.3], "intercept": 0.2}


def metadata_gate(spark, sf):
    b = table(spark, sf, "benchmark_items").select("benchmark_id", "case_id", C.cited_year(F.col("citation")).alias("cy"), C.cited_court(F.col("citation")).alias("cc"))
    n = V.nodes(spark, sf).select(F.col("id").alias("case_id"), "year", "court_id")
    j = b.join(n, "case_id", "left").withColumn("node", F.col("year").isNotNull() | F.col("court_id").isNotNull())
    return j.withColumns(D.metadata(F.col("cy"), F.col("cc"), F.col("year"), F.col("court_id"), F.col("node"))).select("benchmark_id", "year_match", "court_match", "meta_checked", "meta_valid")


def temporal_gate(spark, sf):
    b = table(spark, sf, "benchmark_items").select("benchmark_id", "case_id", C.cited_year(F.col("citation")).alias("cy"))
    j = b.join(V.nodes(spark, sf).select(F.col("id").alias("case_id"), "year"), "case_id", "left")
    return j.withColumns(D.temporal(F.col("cy"), F.col("year"), 2015)).select("benchmark_id", "temporal_checked", F.coalesce("temporal_valid", F.lit(True)).alias("temporal_valid"), "temporal_reason")


def name_gate(spark, sf):
    n = table(spark, sf, "name_checks").select("check_id", "cited_name", "node_name")
    return n.withColumns(D.name_check(F.col("cited_name"), F.col("node_name"))).select("check_id", "name_checked", "name_valid", "name_score")


def token_sort_key(spark, sf):
    return table(spark, sf, "name_checks").select("check_id", D.token_sort_key(F.col("cited_name")).alias("k"))


def verdict_online(spark, sf):
    """Every other row by the scorer, the rest by its soft signals."""
    r = benchmark_rows(spark, sf)
    passed = (F.round(F.coalesce("case_sim", F.lit(0.0)), 9) >= K.CASE_SIM_CUT) & (F.col("landmark") | (F.coalesce("density_score", F.lit(0)) >= 1)) & F.coalesce("temporal_valid", F.lit(True))
    p = F.when(F.col("benchmark_id") % 2 == 0, D.probability(D.logit(MODEL)))
    return r.select("benchmark_id", D.online_verdict(F.col("exists"), F.col("meta_checked"), F.col("metadata_valid"), F.col("llm_checked"), F.col("llm_accurate"), p, passed).alias("verdict"))


def _bench(spark, sf):
    r = benchmark_rows(spark, sf)
    v = D.bench_verdict(*[F.col(c) for c in ("exists", "meta_checked", "metadata_valid", "llm_checked", "llm_accurate", "rrf_score", "dense_score", "density_score")], F.lit(K.SIM_CUT), F.lit(K.RRF_CUT), F.lit(K.DENSITY_CUT))
    return r.withColumn("pred", v)


def verdict_bench(spark, sf):
    return _bench(spark, sf).select("benchmark_id", "label", F.col("pred").alias("verdict"))


def scorer_score(spark, sf):
    return benchmark_rows(spark, sf).select("benchmark_id", F.round(D.probability(D.logit(MODEL)), 9).alias("p_hallucinated"))


def scorer_breakdown(spark, sf):
    r = benchmark_rows(spark, sf).select("benchmark_id", F.explode(D.breakdown(MODEL)).alias("x"))
    return r.select("benchmark_id", F.col("x.name").alias("feature"), F.round(F.col("x.raw") + 0.0, 6).alias("raw_value"), F.round(F.col("x.contribution") + 0.0, 6).alias("contribution"))


def response_struct(spark, sf):
    """One row per document: its citations with verdict and signals as JSON."""
    return _response(documents_checked(spark, sf))


def _response(c):
    """(doc_id, citation_count, citations): each citation with its signals, those of unchecked gates null; as JSON with all fields."""
    signals = F.struct(
        F.round("rrf_score", 6).alias("rrf_score"), F.round("dense_score", 4).alias("dense_score"), F.round("case_sim", 4).alias("case_sim"), F.when(F.col("exists"), F.col("density")).alias("density_score"), F.when(F.col("meta_checked"), F.col("meta_valid")).alias("metadata_valid"), F.when(F.col("name_checked"), F.col("name_score")).alias("name_score"),
        F.when(F.col("exists") & F.col("temporal_checked"), F.col("temporal_valid")).alias("temporal_valid"), F.when(F.col("exists") & F.col("temporal_checked"), F.col("temporal_reason")).alias("temporal_reason"), F.round("p_hallucinated", 4).alias("p_hallucinated"), F.round(1 - F.col("p_hallucinated"), 4).alias("p_real"), F.col("p_hallucinated").isNotNull().alias("scorer_used"),
    )
    judged = F.when(F.col("llm_checked").isNotNull(), F.struct(F.col("llm_accurate").alias("is_accurate"), (~F.col("llm_checked")).alias("skipped")))
    one = F.struct("pos", "citation_string", "verdict", "case_id", "case_name", "exists", judged.alias("llm_check"), signals.alias("confidence_signals"))
    return c.groupBy("doc_id").agg(F.count("*").alias("citation_count"), F.to_json(F.array_sort(F.collect_list(one)), {"ignoreNullFields": "false"}).alias("citations"))


def graphable(spark, sf):
    return documents_checked(spark, sf).filter(F.col("verdict").isin("REAL", "SUSPICIOUS")).select("doc_id", "pos", "case_id", "verdict")


def case_relevance(spark, sf):
    r = benchmark_rows(spark, sf)
    return r.select("benchmark_id", R.relevant(F.round("case_sim", 9), F.col("rrf_score")).alias("relevant"))


def _feature_sql() -> list[str]:
    d = "coalesce(density_score, 0)"
    return ["coalesce(rrf_score, 0.0)", "coalesce(dense_score, 0.0)", "coalesce(case_sim, 0.0)", f"CAST(CASE WHEN landmark THEN greatest({d}, 1) ELSE {d} END AS DOUBLE)", "coalesce(pagerank_score, 0.0)", "coalesce(name_score, 1.0)", "coalesce(CAST(temporal_valid AS DOUBLE), 1.0)"]


def _logit_sql() -> str:
    return f"{MODEL['intercept']}::DOUBLE" + "".join(f" + ({x} - {m}::DOUBLE) / {s}::DOUBLE * ({c}::DOUBLE)" for x, m, s, c in zip(_feature_sql(), MODEL["mean"], MODEL["scale"], MODEL["coef"]))


_PROB = f"1.0 / (1.0 + exp(-({_logit_sql()})))"
BENCH = f"""{RAW}, bench AS (SELECT *, CASE WHEN NOT "exists" THEN 'HALLUCINATED' WHEN meta_checked AND NOT metadata_valid THEN 'HALLUCINATED' WHEN llm_checked AND NOT llm_accurate THEN 'SUSPICIOUS'
  WHEN (rrf_score >= 0.01::DOUBLE OR dense_score >= 0.6::DOUBLE) AND density_score >= 1 THEN 'REAL' WHEN NOT (rrf_score >= 0.01::DOUBLE OR dense_score >= 0.6::DOUBLE) AND NOT coalesce(density_score >= 1, false) THEN 'HALLUCINATED' ELSE 'SUSPICIOUS' END AS pred FROM raw)"""
_SIGNAL = {"rrf_score": "rrf_score", "dense_score": "dense_score", "case_sim": "case_sim", "density_score": "density", "pagerank_score": "rank", "name_score": "NULL::DOUBLE", "temporal_valid": "temporal_reason NOT IN ('future_citation', 'year_inversion')"}
_CHECK = f"""WITH RECURSIVE {GQ._ALL}, d AS ({GQ._DENSITY}), {GQ._CONVERGED}, {_INDEX}, {_LOOKUP}, {_DOCS_CITES},
res AS (SELECT citation_string, coalesce(i.case_id, l.case_id) AS case_id, i.case_name FROM idx i FULL JOIN look l USING (citation_string)), {_GATES},
qs AS MATERIALIZED (SELECT doc_id * 1048576 + pos AS q, context, case_id FROM k WHERE "exists" AND meta_valid), {S.SQL}, {_judge_sql('q IN (SELECT q FROM sem WHERE relevant)')},
g AS (SELECT k.*, sem.q, rrf_score, dense_score, case_sim, relevant, CASE WHEN sem.q IS NOT NULL THEN llm.q IS NOT NULL END AS llm_checked, CASE WHEN sem.q IS NOT NULL THEN coalesce(said, true) END AS llm_accurate, ranks.rank FROM k LEFT JOIN sem ON sem.q = doc_id * 1048576 + pos LEFT JOIN llm ON llm.q = sem.q LEFT JOIN ranks ON ranks.id = k.case_id),
gs AS (SELECT *, {', '.join(f'{v} AS f_{c}' for c, v in _SIGNAL.items())}, NOT "exists" OR (meta_checked AND NOT meta_valid) OR coalesce(llm_checked AND NOT llm_accurate, false) AS stopped FROM g),
gp AS (SELECT *, CASE WHEN NOT stopped THEN {_PROB.replace('density_score', 'f_density_score').replace('pagerank_score', 'f_pagerank_score').replace('name_score', 'f_name_score').replace('temporal_valid', 'f_temporal_valid')} END AS p FROM gs),
v AS (SELECT *, CASE WHEN NOT "exists" THEN 'HALLUCINATED' WHEN meta_checked AND NOT meta_valid THEN 'HALLUCINATED' WHEN llm_checked AND NOT llm_accurate THEN 'SUSPICIOUS' WHEN p >= 0.7 THEN 'HALLUCINATED' WHEN p >= 0.4 THEN 'SUSPICIOUS' WHEN p IS NOT NULL THEN 'REAL'
  WHEN relevant AND is_connected AND f_temporal_valid THEN 'REAL' ELSE 'SUSPICIOUS' END AS verdict FROM gp)"""
_STAMPS = f"""several AS (SELECT doc_id FROM v WHERE "exists" GROUP BY doc_id HAVING count(*) >= 2), dk AS (SELECT DISTINCT doc_id, case_id FROM v WHERE "exists" AND doc_id IN (SELECT doc_id FROM several)),
xp AS (SELECT x.doc_id, x.case_id AS a, y.case_id AS b FROM dk x JOIN dk y ON y.doc_id = x.doc_id AND y.case_id > x.case_id), pairs AS (SELECT DISTINCT a, b FROM xp), {GQ._JACCARD}, {GQ._SHARED}, {GQ._SHARE}, {GQ._WALK},
xe AS (SELECT doc_id, unnest([a, b]) AS case_id, jaccard, hops, shared FROM xp JOIN jac USING (a, b) JOIN sh USING (a, b) JOIN short USING (a, b)), xm AS (SELECT doc_id, case_id, avg(jaccard) AS mean_jaccard, min(hops) AS min_hop, avg(shared) AS mean_shared FROM xe GROUP BY doc_id, case_id),
xs AS (SELECT dk.doc_id, dk.case_id, mean_jaccard, min_hop, mean_shared, dk.case_id IN (SELECT case_id FROM de) AS has_doctrines FROM dk LEFT JOIN xm USING (doc_id, case_id)),
vv AS (SELECT v.* EXCLUDE (p), p AS p_hallucinated, rank AS pagerank_score, false AS name_checked, mean_jaccard, min_hop, has_doctrines, mean_shared FROM v LEFT JOIN xs USING (doc_id, case_id))"""


def _response_sql(source: str, sem: bool) -> str:
    """The response of rows v; without search its scores are null."""
    score = (lambda c, n: f"round({c}, {n})") if sem else (lambda c, n: "NULL::DOUBLE")
    p, judge = ("p", "CASE WHEN llm_checked IS NOT NULL THEN {'is_accurate': llm_accurate, 'skipped': NOT llm_checked} END") if sem else ("NULL::DOUBLE", "NULL")
    timed = '"exists" AND (cited_year IS NOT NULL OR actual_year IS NOT NULL)'
    name = "NULL::DOUBLE"
    return f"""{source} SELECT doc_id, count(*) AS citation_count, CAST(to_json(list({{'pos': pos, 'citation_string': citation_string, 'verdict': verdict, 'case_id': case_id, 'case_name': case_name, 'exists': "exists", 'llm_check': {judge}, 'confidence_signals': {{'rrf_score': {score('rrf_score', 6)}, 'dense_score': {score('dense_score', 4)}, 'case_sim': {score('case_sim', 4)},
      'density_score': CASE WHEN "exists" THEN density END, 'metadata_valid': CASE WHEN meta_checked THEN meta_valid END, 'name_score': {name}, 'temporal_valid': CASE WHEN {timed} THEN temporal_reason NOT IN ('future_citation', 'year_inversion') END, 'temporal_reason': CASE WHEN {timed} THEN temporal_reason END,
      'p_hallucinated': round({p}, 4), 'p_real': round(1 - {p}, 4), 'scorer_used': {p} IS NOT NULL}}}} ORDER BY pos, citation_string)) AS VARCHAR) AS citations FROM v GROUP BY doc_id"""


_GATE = f"g AS (SELECT benchmark_id, TRY_CAST(regexp_extract(citation, {TQ._q(C.YEAR)}, 1) AS INTEGER) AS cy, {TQ._COURT} AS cc, n.year, n.court_id FROM benchmark_items b LEFT JOIN nodes n ON n.id = b.case_id)"

_NAMES = "check_references reference_response resolve_index check_documents check_counts existence metadata_gate temporal_gate name_gate token_sort_key verdict_online verdict_bench scorer_score scorer_breakdown response_struct refused_inputs graphable case_relevance corrupt_citations capped_sample generated_benchmark appended_benchmark raw_scores cited_court circuit_label clean_reporter".split()
QUERIES = {n: globals()[n] for n in _NAMES}
ORACLES = {
    "resolve_index": f"WITH {_INDEX} SELECT citation_string, case_id, case_name FROM idx",
    "check_documents": f"{_CHECK}, {_STAMPS} SELECT {', '.join(chr(34) + c + chr(34) for c in _COLS)}, {', '.join(f'round({c}, {n}) AS {c}' if n else c for c, n in _MORE.items())} FROM vv",
    "response_struct": _response_sql(_CHECK, True),
    "reference_response": _response_sql(_CHECK_REF, False),
    "refused_inputs": r"SELECT * FROM (SELECT doc_id, CASE WHEN coalesce(length(regexp_replace(text, '[ \t\n\r\f]+', '', 'g')), 0) = 0 THEN 'empty' WHEN length(text) > 2000 THEN 'too long' END AS refused FROM documents) WHERE refused IS NOT NULL",
    "corrupt_citations": f"WITH {GQ._EN}, {_INDEX}, {CORRUPT} SELECT * FROM bent",
    "capped_sample": f"WITH {V.NODES}, {_sample_sql(100)} SELECT case_id, court_id, year FROM pool_rows",
    "generated_benchmark": f"WITH {_MADE} SELECT * FROM bm",
    "appended_benchmark": f"WITH {_MADE}, o AS (SELECT max(benchmark_id) AS last FROM benchmark_items) SELECT benchmark_id, citation, label FROM benchmark_items UNION ALL SELECT last + row_number() OVER (ORDER BY benchmark_id), citation, label FROM bm, o WHERE citation NOT IN (SELECT citation FROM benchmark_items)",
    "cited_court": f"WITH {GQ._EN}, {_INDEX}, {CORRUPT}, al AS (SELECT 'benchmark' AS origin, benchmark_id AS id, citation FROM benchmark_items UNION ALL SELECT 'corrupted', case_id, corrupted_citation FROM bent), c AS (SELECT origin, id, {TQ._COURT} AS court FROM al) SELECT origin, id, court, {TQ._LABEL.format(c='court')} AS label_text FROM c",
    "circuit_label": f"WITH al AS (SELECT court_id FROM cases_enriched UNION ALL SELECT unnest([{', '.join(TQ._q(c) for c in [*K.CIRCUIT_LABELS, 'CA9', 'nysd'])}])) SELECT {TQ._LABEL.format(c='court_id')} AS circuit, {_IS_FED.format(c='court_id')} AS federal, count(*) AS n FROM al GROUP BY 1, 2",
    "clean_reporter": f"WITH {TQ._EXTRACT} SELECT doc_id, pos, citation_string, regexp_matches(citation_string, {TQ._q(C.CLEAN_REPORTER)}) AS clean FROM cites",
    "raw_scores": f"WITH {RAW} SELECT * REPLACE (round(rrf_score, 9) AS rrf_score, round(dense_score, 6) AS dense_score, round(case_sim, 6) AS case_sim, round(pagerank_score, 9) AS pagerank_score) FROM raw",
    "check_references": f"{_CHECK_REF} SELECT {', '.join(chr(34) + c + chr(34) for c in _COLS)} FROM v",
    "check_counts": f"{_CHECK} SELECT doc_id, count(*) AS citation_count, count_if(verdict = 'REAL') AS real, count_if(verdict = 'SUSPICIOUS') AS suspicious, count_if(verdict = 'HALLUCINATED') AS hallucinated FROM v GROUP BY doc_id",
    "existence": f"WITH {GQ._ALL} SELECT vec_id, case_id, n.id IS NOT NULL AS \"exists\", n.name FROM embeddings_chunked e LEFT JOIN all_nodes n ON n.id = e.case_id",
    "metadata_gate": f"""WITH {V.NODES}, {_GATE}, c AS (SELECT *, (year IS NOT NULL OR court_id IS NOT NULL) AND (cy IS NOT NULL OR cc IS NOT NULL) AS ch FROM g)
      SELECT benchmark_id, CASE WHEN ch THEN cy = year END AS year_match, CASE WHEN ch THEN lower(cc) = lower(court_id) END AS court_match, ch AS meta_checked, CASE WHEN ch THEN coalesce(cy = year, true) AND coalesce(lower(cc) = lower(court_id), true) ELSE true END AS meta_valid FROM c""",
    "temporal_gate": f"""WITH {V.NODES}, {_GATE}, r AS (SELECT benchmark_id, cy IS NOT NULL OR year IS NOT NULL AS temporal_checked, CASE WHEN cy IS NULL AND year IS NULL THEN 'unchecked' WHEN cy > 2015 THEN 'future_citation' WHEN cy < year THEN 'year_inversion' ELSE 'ok' END AS temporal_reason FROM g)
      SELECT benchmark_id, temporal_checked, temporal_reason NOT IN ('future_citation', 'year_inversion') AS temporal_valid, temporal_reason FROM r""",
    "token_sort_key": f"SELECT check_id, {_KEY_SQL.format(c='cited_name')} AS k FROM name_checks",
    "name_gate": f"""WITH k AS (SELECT check_id, {_KEY_SQL.format(c='cited_name')} AS a, {_KEY_SQL.format(c='node_name')} AS b FROM name_checks), s AS (SELECT check_id, a IS NOT NULL AND b IS NOT NULL AS both_there, CASE WHEN a = b THEN 1.0::DOUBLE ELSE {_INDEL} END AS s FROM k)
      SELECT check_id, both_there AS name_checked, CASE WHEN both_there THEN s >= {K.NAME_CUT} ELSE true END AS name_valid, CASE WHEN both_there THEN round_even(s, 3) ELSE 1.0 END AS name_score FROM s""",
    "verdict_online": f"""WITH {RAW}, p AS (SELECT *, CASE WHEN benchmark_id % 2 = 0 THEN {_PROB} END AS p FROM raw)
      SELECT benchmark_id, CASE WHEN NOT "exists" THEN 'HALLUCINATED' WHEN meta_checked AND NOT metadata_valid THEN 'HALLUCINATED' WHEN llm_checked AND NOT llm_accurate THEN 'SUSPICIOUS' WHEN p >= 0.7 THEN 'HALLUCINATED' WHEN p >= 0.4 THEN 'SUSPICIOUS' WHEN p IS NOT NULL THEN 'REAL'
      WHEN round(coalesce(case_sim, 0), 9) >= 0.8::DOUBLE AND (landmark OR coalesce(density_score, 0) >= 1) AND coalesce(temporal_valid, true) THEN 'REAL' ELSE 'SUSPICIOUS' END AS verdict FROM p""",
    "verdict_bench": f"WITH {BENCH} SELECT benchmark_id, label, pred AS verdict FROM bench",
    "scorer_score": f"WITH {RAW} SELECT benchmark_id, round({_PROB}, 9) AS p_hallucinated FROM raw",
    "scorer_breakdown": f"WITH {RAW} " + " UNION ALL ".join(f"SELECT benchmark_id, '{n}' AS feature, round({x}, 6) AS raw_value, round(({x} - {m}::DOUBLE) / {s}::DOUBLE * ({c}::DOUBLE) + 0.0::DOUBLE, 6) AS contribution FROM raw" for n, x, m, s, c in zip(K.FEATURES, _feature_sql(), MODEL["mean"], MODEL["scale"], MODEL["coef"])),
    "graphable": f"{_CHECK} SELECT doc_id, pos, case_id, verdict FROM v WHERE verdict IN ('REAL', 'SUSPICIOUS')",
    "case_relevance": f"WITH {RAW} SELECT benchmark_id, CASE WHEN case_sim IS NOT NULL THEN round(case_sim, 9) >= 0.8::DOUBLE ELSE coalesce(rrf_score, 0) >= 0.02 END AS relevant FROM raw",
}
