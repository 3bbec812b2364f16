"""Citation-graph operators over edge tables (src, dst) and node tables (id, ...)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citeloom import constants as K
from citeloom.session import cut


def density(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, density): how many distinct works each node cites that another full node cites too.

    One count per cited work instead of a self-join: a work with c full citers counts for a target if c less
    the target itself, where that is full, is at least one. Nodes without edges get 0; a hot work is one row.
    """
    full = nodes.filter("not stub").select(F.col("id").alias("src"), F.lit(1).alias("full"))
    e = edges.join(full, "src", "left").withColumn("full", F.coalesce("full", F.lit(0)))
    citers = e.groupBy("dst").agg(F.sum("full").alias("n"))
    shared = e.join(citers, "dst").filter(F.col("n") - F.col("full") >= 1).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("density"))
    return nodes.select("id").join(shared, "id", "left").select("id", F.coalesce("density", F.lit(0)).cast("bigint").alias("density"))


def connected(density_col: Column, landmark: Column, least: int = K.DENSITY_CUT) -> Column:
    return F.coalesce(landmark, F.lit(False)) | (F.coalesce(density_col, F.lit(0)) >= least)


def degrees(edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree) of every node with an edge."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    return ends.groupBy("x.id").agg(F.sum("x.o").cast("bigint").alias("out_degree"), F.sum("x.i").cast("bigint").alias("in_degree"))


#: Cited works that a row of PageRank holds at most; longer lists are split.
LINKS = 10_000


def pagerank(edges: DataFrame, nodes: DataFrame, alpha: float = K.DAMPING, rounds: int = K.MAX_ITERATIONS, tolerance: float | None = K.TOLERANCE) -> DataFrame:
    """(id, rank) by power iteration over all nodes, isolated ones too; the mass of dangling nodes is spread evenly.

    Stops when the L1 change falls under N * tolerance, judged after the new ranks are taken; tolerance None makes every
    round. A node is one row with the works it cites, and passes its own share on: a round explodes that row and sums what each work
    gets, per task before the exchange, so links never meet ranks in a join and a work that a third of all edges cite is one row per task.
    One aggregate a round gives both the change and the next round's dangling mass. A hub's list is split into rows of LINKS works.
    """
    deg = edges.groupBy("src").agg(F.count("*").alias("deg"), F.min("dst").alias("least"))
    # A node's first row, which stands for it, surely exists: its least work goes there.
    slot = F.when(F.col("dst") == F.col("least"), 0).otherwise(F.pmod(F.xxhash64("dst"), F.ceil(F.col("deg") / LINKS))).cast("int")
    lists = edges.join(deg, "src").groupBy("src", slot.alias("slot")).agg(F.collect_list("dst").alias("dst"), F.first("deg").alias("deg"))
    base = cut(nodes.select("id").distinct().join(lists.withColumnRenamed("src", "id"), "id", "left").withColumn("head", F.coalesce("slot", F.lit(0)) == 0).drop("slot"))
    n = base.filter("head").count()
    if n == 0:
        return base.select("id", F.lit(0.0).alias("rank"))
    dangling = base.filter("head and deg is null").count() / n
    ranks = base.withColumn("rank", F.lit(1.0 / n))
    for k in range(rounds):
        given = ranks.filter("deg is not null").select(F.explode("dst").alias("id"), (F.col("rank") / F.col("deg")).alias("share")).groupBy("id").agg(F.sum("share").alias("got"))
        new = ranks.withColumnRenamed("rank", "old").join(given, "id", "left")
        new = new.withColumn("rank", (1 - alpha) / n + alpha * (F.coalesce("got", F.lit(0.0)) + F.lit(dangling) / n)).drop("got")
        new = cut(new)
        s = new.filter("head").agg(F.sum(F.when(F.col("deg").isNull(), F.col("rank"))).alias("d"), F.sum(F.abs(F.col("rank") - F.col("old"))).alias("change")).first()
        dangling, ranks = s["d"] or 0.0, new.drop("old")
        if tolerance is not None and s["change"] < n * tolerance:
            break
    return ranks.filter("head").select("id", "rank")


def within_hops(edges: DataFrame, starts: DataFrame, hops: int, undirected: bool = False) -> DataFrame:
    """(start, id, hop): nodes within `hops` of each start, with their least hop; level by level, each node expanded once per start."""
    e = edges.select("src", "dst")
    if undirected:
        e = cut(e.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    reached = starts.select("start", F.col("start").alias("id"), F.lit(0).alias("hop")).distinct()
    frontier = reached
    for h in range(1, hops + 1):
        nxt = frontier.join(e, frontier["id"] == e["src"]).select("start", F.col("dst").alias("id")).distinct()
        frontier = cut(nxt.join(reached.select("start", "id"), ["start", "id"], "left_anti").withColumn("hop", F.lit(h)))
        reached = reached.unionByName(frontier)
    return reached


#: Most-cited nodes whose distances shortest_paths keeps as bits of one long; any number up to 62 gives the same hops.
HUBS = 62


def shortest_paths(edges: DataFrame, pairs: DataFrame, most: int = 5, hubs: int = HUBS) -> DataFrame:
    """(a, b, hops) of each pair, undirected, null beyond `most`: a level at a time, and only for pairs not met yet.

    A path through one of the `hubs` nodes of highest degree is found from bit masks: which hubs lie within h hops of a node.
    Each level is one row per node and one pre-aggregated join, whatever the hubs' degrees and the number of pairs. Paths
    that avoid all of them are found in the rest of the graph, where both ends of a pair search half the way and meet.
    """
    spark = edges.sparkSession
    e = cut(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    top = [r["src"] for r in e.groupBy("src").count().orderBy(F.col("count").desc(), "src").limit(hubs).collect()]
    rest = cut(e.filter(~F.col("src").isin(top) & ~F.col("dst").isin(top)))
    bits = spark.createDataFrame([(h, 1 << i) for i, h in enumerate(top)], f"id {edges.schema['src'].dataType.simpleString()}, bit bigint")
    marks = e.select(F.col("src").alias("id")).distinct().join(F.broadcast(bits), "id", "left").select("id", F.array(F.coalesce("bit", F.lit(0).cast("bigint"))).alias("m"))

    deg = rest.groupBy("src").agg(F.count("*").alias("deg"))
    ends = pairs.select("a", "b").distinct()
    sized = ends.filter("a <> b").join(deg.select(F.col("src").alias("a"), F.col("deg").alias("da")), "a", "left").join(deg.select(F.col("src").alias("b"), F.col("deg").alias("db")), "b", "left")
    turn = F.coalesce("da", F.lit(0)) > F.coalesce("db", F.lit(0))
    todo = cut(sized.select("a", "b", F.when(turn, F.col("b")).otherwise(F.col("a")).alias("x"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("y")))
    best = ends.filter("a = b").select("a", "b", F.lit(0).alias("hops"))
    near, far = ([todo.select(F.col(s).alias("start"), F.col(s).alias("id")).distinct()] for s in ("x", "y"))
    for h in range(1, most + 1):
        if todo.isEmpty():
            break
        last = marks.select(F.col("id").alias("src"), F.col("m")[h - 1].alias("bit"))
        given = e.join(last.filter("bit <> 0"), "src").groupBy(F.col("dst").alias("id")).agg(F.bit_or("bit").alias("bit"))
        marks = cut(marks.join(given, "id", "left").select("id", F.concat("m", F.array(F.col("m")[h - 1].bitwiseOR(F.coalesce("bit", F.lit(0))))).alias("m")))
        side, end = (near, "x") if h % 2 else (far, "y")
        open_ = side[-1].join(todo.select(F.col(end).alias("start")).distinct(), "start", "left_semi")
        nxt = open_.join(rest, open_["id"] == rest["src"]).select("start", F.col("dst").alias("id")).distinct()
        for level in side[-2:]:  # a neighbour of the last level lies in it, in the one before or in the next
            nxt = nxt.join(level, ["start", "id"], "left_anti")
        side.append(cut(nxt))
        met = todo.join(near[-1].withColumnRenamed("start", "x"), "x").join(far[-1].withColumnRenamed("start", "y"), ["y", "id"]).select("a", "b")
        mx, my = marks.select(F.col("id").alias("x"), F.col("m").alias("mx")), marks.select(F.col("id").alias("y"), F.col("m").alias("my"))
        through = reduce(Column.__or__, [F.col("mx")[i].bitwiseAND(F.col("my")[h - i]) != 0 for i in range(h + 1)])
        via = todo.join(mx, "x").join(my, "y").filter(through).select("a", "b")
        hit = cut(met.unionByName(via).distinct())
        best = best.unionByName(hit.withColumn("hops", F.lit(h)))
        todo = cut(todo.join(hit, ["a", "b"], "left_anti"))
    return pairs.join(best, ["a", "b"], "left").select("a", "b", "hops")


def jaccard(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, common, jaccard) of the cited works of each pair; 0 where either cites nothing."""
    out = edges.groupBy("src").agg(F.count("*").alias("deg"))
    one = pairs.join(edges.select(F.col("src").alias("a"), "dst"), "a")
    common = one.join(edges.select(F.col("src").alias("b"), "dst"), ["b", "dst"]).groupBy("a", "b").agg(F.count("*").alias("common"))
    j = pairs.join(common, ["a", "b"], "left").join(out.select(F.col("src").alias("a"), F.col("deg").alias("da")), "a", "left").join(out.select(F.col("src").alias("b"), F.col("deg").alias("db")), "b", "left")
    c = F.coalesce("common", F.lit(0))
    return j.select("a", "b", c.alias("common"), F.when(F.col("da").isNull() | F.col("db").isNull(), 0.0).otherwise(c / (F.col("da") + F.col("db") - c)).alias("jaccard"))


def shared_labels(labels: DataFrame, pairs: DataFrame, key: str = "case_id", label: str = "doctrine") -> DataFrame:
    """(a, b, shared): how many labels the two of each pair have in common."""
    one = pairs.join(labels.select(F.col(key).alias("a"), label), "a")
    n = one.join(labels.select(F.col(key).alias("b"), label), ["b", label]).groupBy("a", "b").agg(F.count("*").alias("shared"))
    return pairs.join(n, ["a", "b"], "left").select("a", "b", F.coalesce("shared", F.lit(0)).alias("shared"))


def cross_signals(cites: DataFrame, edges: DataFrame, known: DataFrame, labels: DataFrame, doc: str = "doc_id", most: int = 5) -> DataFrame:
    """(doc, case_id, mean_jaccard, min_hop, pair_count, has_doctrines, mean_shared) of every distinct case that a text cites (doc, case_id).

    A case's signals are means and least values over its pairs with the text's other cases: likeness of cited works (edges), hops
    (undirected, over `known` edges, null beyond `most`), shared labels (case_id, doctrine). A text's only case has no pairs, null means
    and has_doctrines. Pairs are formed in blocks and each different pair is judged once, however many texts cite both.
    """
    d = cut(cites.filter("case_id is not null").select(doc, "case_id").distinct())
    per_doc = cut(list_pairs(d, doc, "case_id"))
    pairs = cut(per_doc.select("a", "b").distinct())
    sig = jaccard(edges, pairs).join(shared_labels(labels, pairs), ["a", "b"]).join(shortest_paths(known, pairs, most), ["a", "b"])
    ends = per_doc.join(sig, ["a", "b"]).select(doc, F.explode(F.array("a", "b")).alias("case_id"), "jaccard", "hops", "shared")
    means = ends.groupBy(doc, "case_id").agg(F.avg("jaccard").alias("mean_jaccard"), F.min("hops").alias("min_hop"), F.count("*").alias("pair_count"), F.avg("shared").alias("mean_shared"))
    has = labels.select("case_id").distinct().withColumn("has_doctrines", F.lit(True))
    j = d.join(means, [doc, "case_id"], "left").join(has, "case_id", "left")
    return j.select(doc, "case_id", "mean_jaccard", "min_hop", F.coalesce("pair_count", F.lit(0)).alias("pair_count"), F.coalesce("has_doctrines", F.lit(False)).alias("has_doctrines"), "mean_shared")


def list_pairs(rows: DataFrame, key: str, item: str, block: int = 64) -> DataFrame:
    """(key, a, b), a < b: every pair of the distinct items of each key. Long lists are split by position into blocks, so no task gets all pairs of one."""
    w = Window.partitionBy(key)
    r = rows.select(key, item).distinct().withColumn("pos", F.row_number().over(w.orderBy(item)) - 1).withColumn("last", F.floor((F.count("*").over(w) - 1) / block).cast("int"))
    r = r.withColumn("at", F.floor(F.col("pos") / block).cast("int"))
    left = r.select(key, F.col("at").alias("i"), F.explode(F.sequence("at", "last")).alias("j"), F.col(item).alias("a"))
    right = r.select(key, F.explode(F.sequence(F.lit(0), F.col("at"))).alias("i"), F.col("at").alias("j"), F.col(item).alias("b"))
    return left.join(right, [key, "i", "j"]).filter("a < b").select(key, "a", "b")


def subgraph_paths(edges: DataFrame, start: int, hops: int, limit: int = 100) -> DataFrame:
    """(n1, n2, n3): outbound paths of up to `hops` (1 or 2) from one node, the first `limit` in order."""
    one = edges.filter(F.col("src") == start).select(F.col("src").alias("n1"), F.col("dst").alias("n2"), F.lit(None).cast("long").alias("n3"))
    if hops > 1:
        two = one.join(edges.select(F.col("src").alias("n2"), F.col("dst").alias("n4")), "n2").select("n1", "n2", F.col("n4").alias("n3"))
        one = one.unionByName(two)
    return one.orderBy("n1", "n2", F.col("n3").asc_nulls_first()).limit(limit)
