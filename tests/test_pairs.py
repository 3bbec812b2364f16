from itertools import combinations

from citeloom.operators import graph as G
from citeloom.plans import graph_queries as Q

from test_paths import hops, write


def test_long_lists_give_every_pair(spark):
    lists = {1: range(11), 2: [5], 3: [7, 3], 4: range(100, 104)}
    rows = spark.createDataFrame([(k, x) for k, v in lists.items() for x in v] + [(3, 7)], "src bigint, dst bigint")
    got = [tuple(r) for r in G.list_pairs(rows, "src", "dst", block=4).collect()]
    assert sorted(got) == sorted((k, *p) for k, v in lists.items() for p in combinations(sorted(v), 2))


def test_cross_citation_aggregates_all_pairs(spark, tmp_path):
    # only the middle works of 1 share what they cite, 5 and 6 don't
    edges = [(1, 2), (1, 3), (1, 4), (1, 5), (3, 10), (4, 10), (4, 11), (2, 3), (6, 5)]
    sf = write(spark, tmp_path, edges, [1, 2, 3, 4, 5, 6])
    out = {s: {d for a, d in edges if a == s} for s in range(1, 7)}
    pairs = list(combinations([2, 3, 4, 5], 2))
    jac = [len(out[a] & out[b]) / len(out[a] | out[b]) if out[a] and out[b] else 0 for a, b in pairs]
    got = {r["src"]: r.asDict() for r in Q.cross_citation(spark, sf).collect()}
    assert got[1]["pair_count"] == 6 and got[1]["min_hop"] == min(hops(edges, *p) for p in pairs) == 1
    assert got[1]["avg_jaccard"] == round(sum(jac) / 6, 9) > 0 and got[1]["avg_shared"] in (0, 1)
    assert (got[6]["n_cited"], got[6]["pair_count"], got[6]["min_hop"]) == (1, 0, None)
    assert {(r["a"], r["b"]) for r in Q.jaccard_pairs(spark, sf).collect()} == set(pairs)
    assert Q.shared_doctrines(spark, sf).count() == Q.shortest_path(spark, sf).count() == 6
