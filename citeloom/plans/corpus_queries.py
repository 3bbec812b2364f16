"""Corpus building, synthesis and exploration queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from citeloom import constants as K
from citeloom.functions import citations as C
from citeloom.functions import text as X
from citeloom.operators import explore as E
from citeloom.operators import retrieval as R
from citeloom.operators import synth as S
from citeloom.operators import upsert as U
from citeloom.plans import retrieval_queries as RQ
from citeloom.plans import text_queries as TQ
from citeloom.plans import verdict_queries as VQ
from citeloom.plans import views as V
from citeloom.session import table


def _fetched(spark, sf):
    return table(spark, sf, "cases_enriched").filter("case_id is not null").select("row_id", "case_id", "case_name", F.date_format("fetched_at", "yyyy").alias("batch_year"))


def merge_batches(spark, sf):
    """Yearly batches in order: rows, rows that add a case, and repeats."""
    f = _fetched(spark, sf)
    from pyspark.sql.window import Window

    w = Window.partitionBy("case_id").orderBy("batch_year", "row_id")
    r = f.withColumn("first", F.row_number().over(w) == 1)
    return r.groupBy("batch_year").agg(F.count("*").alias("total"), F.count_if("first").alias("added"), F.count_if(~F.col("first")).alias("duplicates"))


def embedding_upsert(spark, sf):
    """The latest embedding of each chunk, as an incremental load keeps it: the last month's rows are loaded into those of before."""
    v = table(spark, sf, "embeddings_chunked").filter("case_id is not null").select("vec_id", "case_id", "chunk_index", "embedded_at")
    month = v.agg(F.date_trunc("month", F.max("embedded_at")).alias("month"))
    v = v.crossJoin(F.broadcast(month)).withColumn("is_new", F.coalesce(F.col("embedded_at") >= F.col("month"), F.lit(False)))
    key = ["case_id", "chunk_index"]
    old, new = (C.last_writer(v.filter(c), key, [F.col("embedded_at").desc(), F.col("vec_id").desc()]) for c in (~F.col("is_new"), F.col("is_new")))
    return U.keep_last(old, new, key).select("case_id", "vec_id", "chunk_index")


def resume_anti(spark, sf):
    done = table(spark, sf, "embeddings_chunked").select("case_id")
    return V.cases(spark, sf).select("case_id").join(done, "case_id", "left_anti")


def semi_align(spark, sf):
    done = table(spark, sf, "embeddings_chunked").select("case_id")
    t = V.cases(spark, sf, "plain_text").join(done, "case_id", "left_semi")
    return t.select("case_id", F.size(X.corpus_tokens(F.col("plain_text"))).alias("n_tokens")).filter(F.col("n_tokens") >= K.MIN_TOKENS)


def _corpus(spark, sf):
    c = V.cases(spark, sf, "case_name", "date_filed", "court_id", "plain_text")
    year = F.substring("date_filed", 1, 4)
    return c.filter((F.length("plain_text") > K.MIN_CHARS) & ~F.coalesce(year.isin(*K.EXCLUDED_YEARS), F.lit(False))).withColumn("year", F.coalesce(year, F.lit("none")))


def stratified_sample(spark, sf):
    d = _corpus(spark, sf).withColumn("stratum", F.substring("year", 1, 3))
    return S.stratified_sample(d.select("case_id", "stratum"), "case_id", "stratum", 100)


def fill_citations(spark, sf):
    """Missing citation lists filled from the landmark and benchmark lookups."""
    look = table(spark, sf, "benchmark_items").filter("case_id is not null").groupBy("case_id").agg(F.min("citation").alias("value"))
    d = V.cases(spark, sf, "citations").select("case_id", "citations")
    empty = F.col("citations").isNull() | F.trim("citations").isin("", "[]")
    return U.fill_from(d, look, "case_id", "citations", empty)


def map_rows(spark, sf):
    """Rows of the corpus map with defaults: the first two mean-vector values stand for a projection's coordinates."""
    m = R.mean_vectors(RQ._vectors(spark, sf).filter("case_id is not null"), "case_id").filter("dim < 2")
    xy = m.groupBy("case_id").agg(F.round(F.max(F.when(F.col("dim") == 0, F.col("value"))), 6).alias("x"), F.round(F.max(F.when(F.col("dim") == 1, F.col("value"))), 6).alias("y"))
    n = V.nodes(spark, sf).select(F.col("id").alias("case_id"), "name", "court_id", "year")
    doc = TQ.doctrine_edges(spark, sf).groupBy("case_id").agg(F.min("doctrine").alias("primary_doctrine"))
    j = xy.join(n, "case_id", "left").join(doc, "case_id", "left")
    return j.select("case_id", "x", "y", F.coalesce("name", F.lit("Unknown")).alias("name"), X.circuit_label(F.col("court_id")).alias("circuit"), F.coalesce("year", F.lit(0)).alias("year"), F.coalesce("primary_doctrine", F.lit("No doctrine")).alias("primary_doctrine"))


def overlay_centroid(spark, sf):
    coords = map_rows(spark, sf).select("case_id", "x", "y")
    hits = RQ.chunk_maxpool(spark, sf).select("q", "case_id")
    targets = RQ._queries(spark, sf).select("q", "case_id")
    return E.overlay(targets, coords, hits).select("q", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "placed_by")


def primary_doctrine(spark, sf):
    return TQ.doctrine_edges(spark, sf).groupBy("case_id").agg(F.min("doctrine").alias("primary_doctrine"), F.count("*").alias("n"))


def projection(spark, sf):
    return E.project(RQ._vectors(spark, sf), "id", "embedding").select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def cite_sizes(spark, sf):
    return V.cases(spark, sf, "cite_count").select("case_id", F.round(X.node_size(F.col("cite_count")), 6).alias("size"))


def landmark_presence(spark, sf):
    """Which stores hold each landmark."""
    m = table(spark, sf, "landmark_cases").select("case_id")
    flag = lambda df, col, name: df.select(F.col(col).alias("case_id")).distinct().withColumn(name, F.lit(True))
    j = m.join(flag(table(spark, sf, "graph_edges"), "dst", "g"), "case_id", "left").join(flag(table(spark, sf, "embeddings_chunked"), "case_id", "v"), "case_id", "left").join(flag(table(spark, sf, "documents"), "case_id", "d"), "case_id", "left")
    return j.select("case_id", *[F.coalesce(c, F.lit(False)).alias(n) for c, n in (("g", "in_graph"), ("v", "in_vectors"), ("d", "in_documents"))])


def expectations(spark, sf):
    """Checks of the case table as rows: name, count of failures."""
    t = table(spark, sf, "cases_enriched")
    t = t.agg(F.count_if(F.col("case_id").isNull()).alias("null_id"), F.count_if(F.col("case_name").isNull()).alias("null_name"), F.count_if(X.year_of(F.col("date_filed")).isNull()).alias("no_year"), F.count_if(F.coalesce(F.length("plain_text"), F.lit(0)) <= 100).alias("short_text"), (F.count("*") - F.countDistinct("row_id")).alias("repeated_row_id"))
    return t.unpivot([], ["null_id", "null_name", "no_year", "short_text", "repeated_row_id"], "check_name", "failures")


def corpus_context(spark, sf):
    """Numbered lines of a query's matches with their likeness, as they go into a prompt."""
    n = V.nodes(spark, sf).select(F.col("id").alias("case_id"), "name", "court_id", "year")
    h = RQ.chunk_maxpool(spark, sf).join(n, "case_id", "left")
    line = F.concat(F.col("rank").cast("string"), F.lit(". "), F.coalesce("name", F.lit("Unknown")), F.lit(" ("), F.coalesce("court_id", F.lit("unknown")), F.lit(", "), F.coalesce(F.col("year").cast("string"), F.lit("n.d.")), F.lit(") — similarity score: "), F.format_string("%.4f", F.bround(F.round("dense", 6), 4)))
    return h.groupBy("q").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))), lambda x: x["l"]), "\n").alias("context_lines"))


_NAMES = "merge_batches embedding_upsert resume_anti semi_align stratified_sample fill_citations map_rows overlay_centroid primary_doctrine projection cite_sizes landmark_presence expectations corpus_context".split()
QUERIES = {n: globals()[n] for n in _NAMES}

_MAP = f"""{RQ.VEC}, {TQ.DOCTRINES_SQL}, de AS (SELECT case_id, unnest(string_split(doctrine_ids, ',')) AS d FROM doctrines), pd AS (SELECT case_id, min(d) AS primary_doctrine FROM de GROUP BY case_id),
xy AS (SELECT case_id, round(avg(e[1]), 6) AS x, round(avg(e[2]), 6) AS y FROM vec WHERE case_id IS NOT NULL GROUP BY case_id),
mp AS (SELECT xy.case_id, x, y, coalesce(name, 'Unknown') AS name, {TQ._LABEL.format(c='court_id')} AS circuit, coalesce(year, 0) AS year, coalesce(primary_doctrine, 'No doctrine') AS primary_doctrine FROM xy LEFT JOIN nodes ON nodes.id = xy.case_id LEFT JOIN pd ON pd.case_id = xy.case_id)"""
ORACLES = {
    "merge_batches": "WITH r AS (SELECT strftime(fetched_at, '%Y') AS batch_year, row_number() OVER (PARTITION BY case_id ORDER BY strftime(fetched_at, '%Y'), row_id) = 1 AS first FROM cases_enriched WHERE case_id IS NOT NULL) SELECT batch_year, count(*) AS total, count_if(first) AS added, count_if(NOT first) AS duplicates FROM r GROUP BY batch_year",
    "embedding_upsert": "SELECT case_id, vec_id, chunk_index FROM embeddings_chunked WHERE case_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY case_id, chunk_index ORDER BY embedded_at DESC NULLS LAST, vec_id DESC) = 1",
    "resume_anti": f"WITH {V.CASES} SELECT case_id FROM cases WHERE case_id NOT IN (SELECT case_id FROM embeddings_chunked WHERE case_id IS NOT NULL)",
    "semi_align": f"WITH {V.CASES}, t AS (SELECT case_id, CAST(len({TQ._CORPUS.replace('text', 'plain_text')}) AS INTEGER) AS n_tokens FROM cases WHERE case_id IN (SELECT case_id FROM embeddings_chunked)) SELECT * FROM t WHERE n_tokens >= {K.MIN_TOKENS}",
    "stratified_sample": f"""WITH {V.CASES}, d AS (SELECT case_id, substr(coalesce(substr(date_filed, 1, 4), 'none'), 1, 3) AS stratum FROM cases WHERE length(plain_text) > {K.MIN_CHARS} AND coalesce(substr(date_filed, 1, 4), '') <> '2026'),
      n AS (SELECT stratum, count(*) AS n FROM d GROUP BY stratum), q AS (SELECT stratum, n, CAST(round_even(n / (SELECT sum(n) FROM n)::DOUBLE * 100, 0) AS BIGINT) AS q FROM n),
      qq AS (SELECT stratum, q + CASE WHEN row_number() OVER (ORDER BY n DESC, stratum) = 1 THEN 100 - (SELECT sum(q) FROM q) ELSE 0 END AS quota FROM q),
      r AS (SELECT case_id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY (case_id * 1103515245 + 42 * 12345) % 2147483647, case_id) AS r FROM d) SELECT case_id, stratum FROM r JOIN qq USING (stratum) WHERE r <= quota""",
    "fill_citations": f"WITH {V.CASES}, l AS (SELECT case_id, min(citation) AS v FROM benchmark_items WHERE case_id IS NOT NULL GROUP BY case_id) SELECT case_id, CASE WHEN citations IS NULL OR trim(citations) IN ('', '[]') THEN coalesce(v, citations) ELSE citations END AS citations FROM cases LEFT JOIN l USING (case_id)",
    "map_rows": f"WITH {V.NODES}, {_MAP} SELECT * FROM mp",
    "primary_doctrine": f"WITH {V.CASES}, {TQ.DOCTRINES_SQL}, de AS (SELECT case_id, unnest(string_split(doctrine_ids, ',')) AS d FROM doctrines) SELECT case_id, min(d) AS primary_doctrine, count(*) AS n FROM de GROUP BY case_id",
    "cite_sizes": f"WITH {V.CASES} SELECT case_id, round(15 + least(coalesce(cite_count, 0), 500) / 500.0::DOUBLE * 35, 6) AS size FROM cases",
    "landmark_presence": "SELECT case_id, case_id IN (SELECT dst FROM graph_edges WHERE dst IS NOT NULL) AS in_graph, case_id IN (SELECT case_id FROM embeddings_chunked WHERE case_id IS NOT NULL) AS in_vectors, case_id IN (SELECT case_id FROM documents WHERE case_id IS NOT NULL) AS in_documents FROM landmark_cases",
    "overlay_centroid": f"""WITH {V.NODES}, {_MAP}, {RQ._HITS.removeprefix(RQ.VEC + ", ")}, pool AS (SELECT q, case_id, greatest(max(cosine), 0.0) AS dense FROM ranked WHERE rank <= 25 AND case_id IS NOT NULL GROUP BY q, case_id),
      hp AS (SELECT q, case_id FROM pool QUALIFY row_number() OVER (PARTITION BY q ORDER BY dense DESC, case_id) <= 5), mid AS (SELECT q, avg(x) AS mx, avg(y) AS my FROM hp JOIN mp USING (case_id) GROUP BY q)
      SELECT v.id AS q, round(coalesce(mp.x, mx), 6) AS x, round(coalesce(mp.y, my), 6) AS y, CASE WHEN mp.x IS NOT NULL THEN 'own' WHEN mx IS NOT NULL THEN 'centroid' ELSE 'none' END AS placed_by
      FROM vec v LEFT JOIN mp ON mp.case_id = v.case_id LEFT JOIN mid ON mid.q = v.id WHERE v.id % 50 = 0""",
    "corpus_context": f"""WITH {V.NODES}, {RQ._HITS}, pool AS (SELECT q, case_id, greatest(max(cosine), 0.0) AS dense FROM ranked WHERE rank <= 25 AND case_id IS NOT NULL GROUP BY q, case_id), pr AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dense DESC, case_id) AS rank FROM pool QUALIFY rank <= 5)
      SELECT q, string_agg(rank || '. ' || coalesce(name, 'Unknown') || ' (' || coalesce(court_id, 'unknown') || ', ' || coalesce(CAST(year AS VARCHAR), 'n.d.') || ') — similarity score: ' || format('{{:.4f}}', round_even(round(dense, 6), 4)), chr(10) ORDER BY rank) AS context_lines FROM pr LEFT JOIN nodes ON nodes.id = pr.case_id GROUP BY q""",
    "expectations": """WITH c AS (SELECT count_if(case_id IS NULL) AS null_id, count_if(case_name IS NULL) AS null_name, count_if(TRY_CAST(substr(date_filed, 1, 4) AS INTEGER) IS NULL) AS no_year, count_if(coalesce(length(plain_text), 0) <= 100) AS short_text, count(*) - count(DISTINCT row_id) AS repeated_row_id FROM cases_enriched)
      UNPIVOT c ON COLUMNS(*) INTO NAME check_name VALUE failures""",
}
