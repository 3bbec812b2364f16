"""Graph queries: node and edge tables, connectivity, PageRank, paths, similarity of citing behaviour, upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom import constants as K
from citeloom.functions import text as X
from citeloom.operators import graph as G
from citeloom.operators import upsert as U
from citeloom.plans import text_queries as TQ
from citeloom.plans import views as V
from citeloom.session import cut, table

_EN = f"{V.NODES}, {V.EDGES}"


def graph_nodes(spark, sf):
    n = V.nodes(spark, sf)
    ends = V.edges(spark, sf).select(F.explode(F.array("src", "dst")).alias("id"))
    return U.insert_stubs(n, ends).select("id", "name", "year", F.col("court_id").alias("court"), "stub", F.coalesce("landmark", F.lit(False)).alias("landmark"))


_ALL = f"""{_EN}, ends AS (SELECT src AS id FROM edges UNION SELECT dst FROM edges),
all_nodes AS (SELECT * FROM nodes UNION ALL SELECT id, NULL, NULL, NULL, true, false FROM ends WHERE id NOT IN (SELECT id FROM nodes))"""


def graph_edges(spark, sf):
    return V.edges(spark, sf)


def graph_stats(spark, sf):
    n = graph_nodes(spark, sf)
    e = V.edges(spark, sf).select("src").distinct()
    j = n.join(e.withColumnRenamed("src", "id").withColumn("cites", F.lit(True)), "id", "left")
    return j.agg(
        F.count("*").alias("n_nodes"), F.count_if(~F.col("stub")).alias("n_full"), F.count_if("stub").alias("n_stub"), F.count_if("landmark").alias("n_landmark"),
        F.count_if(~F.col("stub") & F.col("year").isNull()).alias("n_no_year"), F.count_if(~F.col("stub") & F.col("cites").isNotNull()).alias("n_citing"),
    )


def stub_coverage(spark, sf):
    n = graph_nodes(spark, sf).select(F.col("id").alias("dst"), "stub")
    j = V.edges(spark, sf).join(n, "dst")
    return j.groupBy("stub").agg(F.count("*").alias("n_edges"), F.countDistinct("dst").alias("n_cited"))


def density(spark, sf):
    return G.density(V.edges(spark, sf), V.nodes(spark, sf))


def density_selfjoin(spark, sf):
    """The same result by the definition: a citation counts if another full node's citation of the same work is there. A semi-join asks only whether, so no pairs come out."""
    e, full = V.edges(spark, sf), V.nodes(spark, sf).filter("not stub").select("id")
    other = e.join(full.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("src").alias("by"), F.col("dst").alias("work"))
    hit = e.join(other, (F.col("dst") == F.col("work")) & (F.col("src") != F.col("by")), "left_semi").groupBy(F.col("src").alias("id")).agg(F.countDistinct("dst").alias("density"))
    return full.join(hit, "id", "left").select("id", F.coalesce("density", F.lit(0)).alias("density"))


_DENSITY = f"""SELECT n.id, count(DISTINCT e.dst) AS density FROM nodes n LEFT JOIN edges e ON e.src = n.id
 AND EXISTS (SELECT 1 FROM edges o JOIN nodes f ON f.id = o.src AND NOT f.stub WHERE o.dst = e.dst AND o.src <> n.id) GROUP BY n.id"""


def connected(spark, sf):
    n = V.nodes(spark, sf)
    d = G.density(V.edges(spark, sf), n).join(n.select("id", "landmark"), "id")
    return d.select("id", "density", G.connected(F.col("density"), F.col("landmark")).alias("is_connected"))


def degree_topk(spark, sf):
    return G.degrees(V.edges(spark, sf)).orderBy((F.col("out_degree") + F.col("in_degree")).desc(), "id").limit(10)


_ROUNDS = 3


def pagerank_fixed(spark, sf):
    r = G.pagerank(V.edges(spark, sf), graph_nodes(spark, sf), rounds=_ROUNDS, tolerance=None)
    return r.select("id", F.round("rank", 10).alias("rank"))


def pagerank(spark, sf):
    return G.pagerank(V.edges(spark, sf), graph_nodes(spark, sf)).select("id", F.round("rank", 10).alias("rank"))


#: Rounds that the converging oracle unrolls; the ranks of the first whose change is under the tolerance count.
_UNROLLED = 40


def _pagerank_sql(rounds: int) -> str:
    """all_nodes and r0 .. r{rounds}; every round is kept, so that later ones don't compute it again."""
    parts = ["pdeg AS (SELECT src, count(*) AS deg FROM edges GROUP BY src)", "n AS (SELECT count(*) AS n FROM all_nodes)", "r0 AS MATERIALIZED (SELECT id, deg, CAST(1 AS DOUBLE) / n AS rank, CAST(1 AS DOUBLE) AS change FROM all_nodes CROSS JOIN n LEFT JOIN pdeg ON src = id)"]
    for k in range(1, rounds + 1):
        parts.append(
            f"r{k} AS MATERIALIZED (SELECT id, deg, rank, abs(rank - old) AS change FROM (SELECT a.id, a.deg, a.rank AS old, {1 - K.DAMPING!r} / n + {K.DAMPING} * (coalesce(g.got, 0) + (SELECT coalesce(sum(rank), 0) FROM r{k - 1} WHERE deg IS NULL) / n) AS rank FROM r{k - 1} a CROSS JOIN n "
            f"LEFT JOIN (SELECT e.dst AS id, sum(CAST(r.rank AS DOUBLE) / r.deg) AS got FROM edges e JOIN r{k - 1} r ON r.id = e.src GROUP BY e.dst) g ON g.id = a.id))"
        )
    return ", ".join(parts)


_CONVERGED = (
    _pagerank_sql(_UNROLLED)
    + ", rounds AS ("
    + " UNION ALL ".join(f"SELECT {k} AS k, sum(change) AS c FROM r{k}" for k in range(1, _UNROLLED + 1))
    + f"), stop AS (SELECT min(k) AS k FROM rounds, n WHERE c < n * {K.TOLERANCE}::DOUBLE), ranks AS ("
    + " UNION ALL ".join(f"SELECT id, rank FROM r{k} WHERE (SELECT k FROM stop) = {k}" for k in range(1, _UNROLLED + 1))
    + ")"
)


def _cited_full(spark, sf):
    return V.edges(spark, sf).join(V.nodes(spark, sf).select(F.col("id").alias("dst")), "dst", "left_semi")


def _case_pairs(spark, sf):
    """(src, a, b), a < b: every pair of the full works that each case cites."""
    return G.list_pairs(_cited_full(spark, sf), "src", "dst")


def _pairs(spark, sf):
    """The distinct pairs of full works that some case cites together."""
    return _case_pairs(spark, sf).select("a", "b").distinct()


_PAIRS = f"""{_EN}, fe AS (SELECT src, dst FROM edges WHERE dst IN (SELECT id FROM nodes)),
cp AS (SELECT x.src, x.dst AS a, y.dst AS b FROM fe x JOIN fe y ON y.src = x.src AND y.dst > x.dst), pairs AS (SELECT DISTINCT a, b FROM cp)"""


def shortest_path(spark, sf):
    """Hops between the works that some case cites together, over all citations in either direction; null beyond five."""
    return G.shortest_paths(V.edges(spark, sf), cut(_pairs(spark, sf)))


_WALK = """und AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges),
walk(a, id, hop) AS (SELECT DISTINCT a, a, 0 FROM pairs UNION SELECT w.a, u.dst, w.hop + 1 FROM walk w JOIN und u ON u.src = w.id WHERE w.hop < 5),
far AS (SELECT a, id AS b, min(hop) AS hop FROM walk GROUP BY a, id),
short AS (SELECT p.a, p.b, CAST(f.hop AS INTEGER) AS hops FROM pairs p LEFT JOIN far f ON f.a = p.a AND f.b = p.b)"""


def _start(spark, sf) -> int:
    return G.degrees(V.edges(spark, sf)).orderBy(F.col("out_degree").desc(), "id").select("id").first()[0]


_START = "s AS (SELECT src FROM edges GROUP BY src ORDER BY count(*) DESC, src LIMIT 1)"
_PATHS = f"""{_EN}, {_START}, one AS (SELECT e.src AS n1, e.dst AS n2 FROM edges e JOIN s USING (src)),
paths AS (SELECT n1, n2, NULL::BIGINT AS n3 FROM one UNION ALL SELECT n1, n2, e.dst FROM one JOIN edges e ON e.src = n2), p AS (SELECT * FROM paths ORDER BY n1, n2, n3 NULLS FIRST LIMIT 100)"""


def khop_nodes(spark, sf):
    p = G.subgraph_paths(V.edges(spark, sf), _start(spark, sf), 2)
    ids = p.select(F.explode(F.array("n1", "n2", "n3")).alias("id")).filter("id is not null").distinct()
    n = graph_nodes(spark, sf).join(V.cases(spark, sf, "cite_count").select(F.col("case_id").alias("id"), "cite_count"), "id", "left")
    size = F.round(X.node_size(F.col("cite_count")), 6)
    return ids.join(n, "id", "left").select("id", X.label(F.coalesce("name", F.lit("Unknown")), 40).alias("label_text"), F.coalesce("year", F.lit(0)).alias("year"), F.coalesce("stub", F.lit(True)).alias("stub"), size.alias("size"))


def khop_edges(spark, sf):
    """Edges of the paths, one per path and step, so repeated ones are counted as often as paths use them."""
    p = G.subgraph_paths(V.edges(spark, sf), _start(spark, sf), 2)
    steps = p.select(F.explode(F.filter(F.array(F.struct(F.col("n1").alias("s"), F.col("n2").alias("d")), F.struct(F.col("n2").alias("s"), F.col("n3").alias("d"))), lambda x: x["d"].isNotNull())).alias("x"))
    return steps.groupBy(F.col("x.s").alias("src"), F.col("x.d").alias("dst")).agg(F.count("*").alias("times"))


def bidir_explorer(spark, sf):
    e, s = V.edges(spark, sf), _start(spark, sf)
    out = e.filter(F.col("src") == s).select(F.lit("out").alias("direction"), F.col("dst").alias("id"))
    back = e.filter(F.col("dst") == s).select(F.lit("in").alias("direction"), F.col("src").alias("id"))
    return out.unionByName(back)


def jaccard_pairs(spark, sf):
    return G.jaccard(V.edges(spark, sf), cut(_pairs(spark, sf))).select("a", "b", "common", F.round("jaccard", 9).alias("jaccard"))


def shared_doctrines(spark, sf):
    return G.shared_labels(TQ.doctrine_edges(spark, sf), cut(_pairs(spark, sf)))


_SHARED = f"""{TQ.DOCTRINES_SQL}, de AS (SELECT case_id, unnest(string_split(doctrine_ids, ',')) AS d FROM doctrines)"""


def cross_citation(spark, sf):
    """Signals of all pairs of full works that each case cites: mean overlap, least hops, mean shared doctrines and the pairs' number."""
    own = _cited_full(spark, sf).groupBy("src").agg(F.count("*").alias("n_cited"))
    cited = cut(_case_pairs(spark, sf))
    pairs = cut(cited.select("a", "b").distinct())
    sig = G.jaccard(V.edges(spark, sf), pairs).join(G.shared_labels(TQ.doctrine_edges(spark, sf), pairs), ["a", "b"])
    sig = sig.join(G.shortest_paths(V.edges(spark, sf), pairs), ["a", "b"])
    per = cited.join(sig, ["a", "b"]).groupBy("src").agg(F.avg("jaccard").alias("j"), F.min("hops").alias("min_hop"), F.avg("shared").alias("s"), F.count("*").alias("pairs"))
    zero = F.lit(0.0)
    return own.join(per, "src", "left").select(
        "src", "n_cited", F.round(F.coalesce("j", zero), 9).alias("avg_jaccard"), "min_hop", F.round(F.coalesce("s", zero), 9).alias("avg_shared"), F.coalesce("pairs", F.lit(0)).alias("pair_count")
    )


def cross_signals(spark, sf):
    """The signals of each work among the full works that a case cites with it, as a text's citations get them."""
    e = V.edges(spark, sf)
    x = G.cross_signals(_cited_full(spark, sf).select(F.col("src").alias("doc_id"), F.col("dst").alias("case_id")), e, e, TQ.doctrine_edges(spark, sf))
    return x.select("doc_id", "case_id", F.round("mean_jaccard", 9).alias("mean_jaccard"), "min_hop", "pair_count", "has_doctrines", F.round("mean_shared", 9).alias("mean_shared"))


def neighbour_sets(spark, sf):
    return V.edges(spark, sf).groupBy("src").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set(F.col("dst").cast("string"))), ",").alias("cited"))


def pagerank_stats(spark, sf):
    """Of the converged ranks."""
    return pagerank(spark, sf).agg(F.round(F.sum("rank"), 6).alias("total"), F.round(F.min("rank"), 9).alias("least"), F.round(F.max("rank"), 9).alias("most"), F.round(F.avg("rank"), 9).alias("mean"))


def pagerank_top(spark, sf):
    """The ten works of greatest rank."""
    return pagerank(spark, sf).orderBy(F.round("rank", 9).desc(), "id").limit(10).select("id", F.round("rank", 9).alias("rank"))


def graph_ratios(spark, sf):
    """Shares of full nodes without a year and with citations of their own, and whether they keep to the bounds of 5 and 50 percent."""
    s = graph_stats(spark, sf).withColumns({"no_year": F.col("n_no_year") / F.col("n_full"), "citing": F.col("n_citing") / F.col("n_full")})
    return s.select(F.round("no_year", 6).alias("no_year"), F.round("citing", 6).alias("citing"), (F.col("no_year") < 0.05).alias("years_ok"), (F.col("citing") >= 0.5).alias("citing_ok"))


def graph_checks(spark, sf):
    """What must hold of the merged graph, as counts of failures: no self loops, no repeated edges, ends that exist, totals that add up, landmarks that are full."""
    n, e = graph_nodes(spark, sf), edge_merge(spark, sf)
    edge = e.agg(F.count_if(F.col("src") == F.col("dst")).alias("self_loops"), (F.count("*") - F.countDistinct("src", "dst")).alias("repeated_edges"))
    ends = e.select(F.explode(F.array("src", "dst")).alias("id")).join(n.select("id"), "id", "left_anti").agg(F.count("*").alias("lost_ends"))
    node = n.agg((F.count("*") - F.count_if("stub") - F.count_if(~F.col("stub"))).alias("uncounted_nodes"), F.count_if(F.col("landmark") & F.col("stub")).alias("landmark_stubs"))
    one = edge.crossJoin(F.broadcast(ends)).crossJoin(F.broadcast(node))  # one row each
    return one.unpivot([], one.columns, "check_name", "failures")


#: Colours of nodes, by what they are first.
COLOURS = {"centre": "#e74c3c", "landmark": "#f1c40f", "stub": "#7f8c8d", "regular": "#3498db"}


def _styled(spark, sf):
    start = _start(spark, sf)
    p = G.subgraph_paths(V.edges(spark, sf), start, 2)
    ids = p.select(F.explode(F.array("n1", "n2", "n3")).alias("id")).filter("id is not null").distinct()
    cites = V.cases(spark, sf, "cite_count").select(F.col("case_id").alias("id"), "cite_count")
    n = ids.join(graph_nodes(spark, sf), "id", "left").join(cites, "id", "left")
    stub, mark = F.coalesce("stub", F.lit(True)), F.coalesce("landmark", F.lit(False))
    kind = F.when(F.col("id") == start, "centre").when(mark, "landmark").when(stub, "stub").otherwise("regular")
    return n.withColumns({"kind": kind, "stub": stub, "c": F.coalesce("cite_count", F.lit(0))})


def styled_nodes(spark, sf):
    """The neighbourhood of the node that cites most, as it is drawn: colour, size, label and tooltip."""
    n = _styled(spark, sf)
    name, year, court = F.coalesce("name", F.lit("Unknown")), F.coalesce(F.col("year").cast("string"), F.lit("0")), F.coalesce("court", F.lit("unknown"))
    colour = F.coalesce(*[F.when(F.col("kind") == k, v) for k, v in COLOURS.items()])
    tip = F.concat(name, F.lit("\nYear: "), year, F.lit("\nCourt: "), court, F.lit("\nCitations: "), F.col("c").cast("string"))
    return n.select("id", "kind", colour.alias("colour"), F.round(X.node_size(F.col("c")), 6).alias("size"), X.label(F.coalesce("name", F.concat(F.lit("Case "), F.col("id").cast("string"))), 40).alias("label_text"), tip.alias("tooltip"))


def styled_edges(spark, sf):
    """The drawn edges: those of the paths whose ends are both drawn."""
    drawn = _styled(spark, sf).select("id")
    e = khop_edges(spark, sf).select("src", "dst")
    return e.join(drawn.withColumnRenamed("id", "src"), "src", "left_semi").join(drawn.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


def stub_insert(spark, sf):
    n = V.nodes(spark, sf).select("id", "name", "stub")
    return U.insert_stubs(n, V.edges(spark, sf).select(F.col("dst").alias("id"))).select("id", "name", "stub")


def node_upsert(spark, sf):
    """Landmarks and stubs first, then the cases merged into them."""
    marks = table(spark, sf, "landmark_cases").select(F.col("case_id").alias("id"), F.col("case_name").alias("name"), F.lit(False).alias("stub"))
    old = U.insert_stubs(marks, V.edges(spark, sf).select(F.col("dst").alias("id")))
    new = V.cases(spark, sf, "case_name").select(F.col("case_id").alias("id"), F.col("case_name").alias("name"))
    return U.upsert_nodes(old, new)


def edge_merge(spark, sf):
    e = V.edges(spark, sf)
    return U.merge_edges(e.limit(0), table(spark, sf, "graph_edges").filter("src <> dst").select("src", "dst"), V.nodes(spark, sf))


def property_backfill(spark, sf):
    n = V.nodes(spark, sf).select("id", F.lit(None).cast("string").alias("court"))
    vals = V.cases(spark, sf, "court_id").filter("court_id is not null").select(F.col("case_id").alias("id"), F.col("court_id").alias("value"))
    return U.set_property(n, vals, "court")


_NAMES = (
    "graph_nodes graph_edges graph_stats stub_coverage density density_selfjoin connected degree_topk pagerank_fixed pagerank shortest_path khop_nodes khop_edges styled_nodes styled_edges bidir_explorer jaccard_pairs shared_doctrines cross_citation cross_signals neighbour_sets pagerank_stats pagerank_top graph_ratios graph_checks "
    "stub_insert node_upsert edge_merge property_backfill"
).split()
QUERIES = {n: globals()[n] for n in _NAMES}

_STYLED = f"""{_ALL.replace(_EN, _PATHS)}, ids AS (SELECT DISTINCT unnest([n1, n2, n3]) AS id FROM p),
sn AS (SELECT i.id, a.name, a.year, a.court_id, coalesce(c.cite_count, 0) AS c, CASE WHEN i.id = (SELECT src FROM s) THEN 'centre' WHEN coalesce(a.landmark, false) THEN 'landmark' WHEN coalesce(a.stub, true) THEN 'stub' ELSE 'regular' END AS kind
 FROM ids i LEFT JOIN all_nodes a ON a.id = i.id LEFT JOIN cases c ON c.case_id = i.id WHERE i.id IS NOT NULL)"""
_JACCARD = """common AS (SELECT a, b, count(*) AS common FROM pairs JOIN edges x ON x.src = a JOIN edges y ON y.src = b AND y.dst = x.dst GROUP BY a, b),
deg AS (SELECT src, count(*) AS deg FROM edges GROUP BY src),
jac AS (SELECT p.a, p.b, coalesce(c.common, 0) AS common, CASE WHEN da.deg IS NULL OR db.deg IS NULL THEN 0.0::DOUBLE ELSE coalesce(c.common, 0)::DOUBLE / (da.deg + db.deg - coalesce(c.common, 0)) END AS jaccard
 FROM pairs p LEFT JOIN common c USING (a, b) LEFT JOIN deg da ON da.src = p.a LEFT JOIN deg db ON db.src = p.b)"""
_SHARE = "sh AS (SELECT p.a, p.b, count(y.d) AS shared FROM pairs p LEFT JOIN de x ON x.case_id = p.a LEFT JOIN de y ON y.case_id = p.b AND y.d = x.d GROUP BY p.a, p.b)"

ORACLES = {
    "graph_nodes": f"WITH {_ALL} SELECT id, name, year, court_id AS court, stub, landmark FROM all_nodes",
    "graph_edges": f"WITH {V.EDGES} SELECT src, dst FROM edges",
    "graph_stats": f"WITH {_ALL} SELECT count(*) AS n_nodes, count_if(NOT stub) AS n_full, count_if(stub) AS n_stub, count_if(landmark) AS n_landmark, count_if(NOT stub AND year IS NULL) AS n_no_year, count_if(NOT stub AND id IN (SELECT src FROM edges)) AS n_citing FROM all_nodes",
    "stub_coverage": f"WITH {_ALL} SELECT stub, count(*) AS n_edges, count(DISTINCT dst) AS n_cited FROM edges JOIN all_nodes ON id = dst GROUP BY stub",
    "density": f"WITH {_EN} {_DENSITY}",
    "density_selfjoin": f"WITH {_EN} {_DENSITY}",
    "connected": f"WITH {_EN}, d AS ({_DENSITY}) SELECT id, density, landmark OR density >= 1 AS is_connected FROM d JOIN nodes USING (id)",
    "degree_topk": f"WITH {V.EDGES}, d AS (SELECT src AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) SELECT id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM d GROUP BY id ORDER BY sum(o) + sum(i) DESC, id LIMIT 10",
    "pagerank_fixed": f"WITH {_ALL}, {_pagerank_sql(_ROUNDS)} SELECT id, round(rank, 10) AS rank FROM r{_ROUNDS}",
    "pagerank": f"WITH {_ALL}, {_CONVERGED} SELECT id, round(rank, 10) AS rank FROM ranks",
    "pagerank_stats": f"WITH {_ALL}, {_CONVERGED} SELECT round(sum(rank), 6) AS total, round(min(rank), 9) AS least, round(max(rank), 9) AS most, round(avg(rank), 9) AS mean FROM ranks",
    "pagerank_top": f"WITH {_ALL}, {_CONVERGED} SELECT id, round(rank, 9) AS rank FROM ranks ORDER BY round(rank, 9) DESC, id LIMIT 10",
    "graph_ratios": f"WITH {_ALL}, s AS (SELECT count_if(year IS NULL) / count(*)::DOUBLE AS no_year, count_if(id IN (SELECT src FROM edges)) / count(*)::DOUBLE AS citing FROM all_nodes WHERE NOT stub) SELECT round(no_year, 6) AS no_year, round(citing, 6) AS citing, no_year < 0.05 AS years_ok, citing >= 0.5 AS citing_ok FROM s",
    "graph_checks": f"""WITH {_ALL}, m AS (SELECT src, dst FROM edges WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes))
      SELECT 'self_loops' AS check_name, count_if(src = dst) AS failures FROM m UNION ALL SELECT 'repeated_edges', count(*) - count(DISTINCT (src, dst)) FROM m UNION ALL SELECT 'lost_ends', count_if(src NOT IN (SELECT id FROM all_nodes)) + count_if(dst NOT IN (SELECT id FROM all_nodes)) FROM m
      UNION ALL SELECT 'uncounted_nodes', count(*) - count_if(stub) - count_if(NOT stub) FROM all_nodes UNION ALL SELECT 'landmark_stubs', count_if(landmark AND stub) FROM all_nodes""",
    "shortest_path": f"WITH RECURSIVE {_PAIRS}, {_WALK} SELECT a, b, hops FROM short",
    "styled_nodes": f"""WITH {_STYLED} SELECT id, kind, CASE kind {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in COLOURS.items())} END AS colour, round(15 + least(c, 500) / 500.0::DOUBLE * 35, 6) AS size,
      CASE WHEN length(coalesce(name, 'Case ' || id)) > 40 THEN substr(coalesce(name, 'Case ' || id), 1, 37) || '...' ELSE coalesce(name, 'Case ' || id) END AS label_text,
      coalesce(name, 'Unknown') || chr(10) || 'Year: ' || coalesce(CAST(year AS VARCHAR), '0') || chr(10) || 'Court: ' || coalesce(court_id, 'unknown') || chr(10) || 'Citations: ' || c AS tooltip FROM sn""",
    "styled_edges": f"WITH {_STYLED}, st AS (SELECT n1 AS src, n2 AS dst FROM p UNION SELECT n2, n3 FROM p WHERE n3 IS NOT NULL) SELECT src, dst FROM st WHERE src IN (SELECT id FROM sn) AND dst IN (SELECT id FROM sn)",
    "khop_nodes": f"""WITH {_PATHS}, ids AS (SELECT DISTINCT unnest([n1, n2, n3]) AS id FROM p), full_nodes AS (SELECT * FROM nodes)
      SELECT i.id, CASE WHEN length(coalesce(name, 'Unknown')) > 40 THEN substr(name, 1, 37) || '...' ELSE coalesce(name, 'Unknown') END AS label_text, coalesce(year, 0) AS year, coalesce(stub, true) AS stub, round(15 + least(coalesce(cite_count, 0), 500) / 500.0::DOUBLE * 35, 6) AS size
      FROM ids i LEFT JOIN full_nodes n ON n.id = i.id LEFT JOIN cases c ON c.case_id = i.id WHERE i.id IS NOT NULL""",
    "khop_edges": f"WITH {_PATHS}, st AS (SELECT n1 AS src, n2 AS dst FROM p UNION ALL SELECT n2, n3 FROM p WHERE n3 IS NOT NULL) SELECT src, dst, count(*) AS times FROM st GROUP BY src, dst",
    "bidir_explorer": f"WITH {V.EDGES}, {_START} SELECT 'out' AS direction, dst AS id FROM edges JOIN s USING (src) UNION ALL SELECT 'in', e.src FROM edges e JOIN s ON e.dst = s.src",
    "jaccard_pairs": f"WITH {_PAIRS}, {_JACCARD} SELECT a, b, common, round(jaccard, 9) AS jaccard FROM jac",
    "shared_doctrines": f"WITH {_PAIRS}, {_SHARED}, {_SHARE} SELECT a, b, shared FROM sh",
    "cross_citation": f"""WITH RECURSIVE {_PAIRS}, {_JACCARD}, {_SHARED}, {_SHARE}, {_WALK}, own AS (SELECT src, count(*) AS n_cited FROM fe GROUP BY src),
      per AS (SELECT src, avg(jaccard) AS j, min(hops) AS min_hop, avg(shared) AS s, count(*) AS pairs FROM cp JOIN jac USING (a, b) JOIN sh USING (a, b) JOIN short USING (a, b) GROUP BY src)
      SELECT src, n_cited, round(coalesce(j, 0), 9) AS avg_jaccard, min_hop, round(coalesce(s, 0), 9) AS avg_shared, coalesce(pairs, 0) AS pair_count FROM own LEFT JOIN per USING (src)""",
    "cross_signals": f"""WITH RECURSIVE {_PAIRS}, {_JACCARD}, {_SHARED}, {_SHARE}, {_WALK}, ends AS (SELECT src, unnest([a, b]) AS case_id, jaccard, hops, shared FROM cp JOIN jac USING (a, b) JOIN sh USING (a, b) JOIN short USING (a, b)),
      per AS (SELECT src, case_id, avg(jaccard) AS j, min(hops) AS min_hop, avg(shared) AS s, count(*) AS pairs FROM ends GROUP BY src, case_id)
      SELECT fe.src AS doc_id, fe.dst AS case_id, round(j, 9) AS mean_jaccard, min_hop, coalesce(pairs, 0) AS pair_count, fe.dst IN (SELECT case_id FROM de) AS has_doctrines, round(s, 9) AS mean_shared FROM fe LEFT JOIN per ON per.src = fe.src AND per.case_id = fe.dst""",
    "neighbour_sets": f"WITH {V.EDGES} SELECT src, count(*) AS n, array_to_string(list_sort(list(CAST(dst AS VARCHAR))), ',') AS cited FROM edges GROUP BY src",
    "stub_insert": f"WITH {_EN} SELECT id, name, stub FROM nodes UNION ALL SELECT DISTINCT dst, NULL, true FROM edges WHERE dst NOT IN (SELECT id FROM nodes)",
    "node_upsert": f"""WITH {_EN}, old AS (SELECT case_id AS id, case_name AS name, false AS stub FROM landmark_cases UNION ALL SELECT DISTINCT dst, NULL, true FROM edges WHERE dst NOT IN (SELECT case_id FROM landmark_cases))
      SELECT coalesce(o.id, c.case_id) AS id, coalesce(c.case_name, o.name) AS name, CASE WHEN c.case_id IS NOT NULL THEN false ELSE o.stub END AS stub FROM old o FULL JOIN cases c ON c.case_id = o.id""",
    "edge_merge": f"WITH {_EN} SELECT src, dst FROM edges WHERE src IN (SELECT id FROM nodes) AND dst IN (SELECT id FROM nodes)",
    "property_backfill": f"WITH {_EN} SELECT id, CASE WHEN landmark THEN NULL ELSE court_id END AS court FROM nodes",
}
