import pytest

from citeloom.operators import graph as G
from citeloom.operators import upsert as U


@pytest.fixture(scope="module")
def g(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (4, 2), (4, 5), (6, 7), (3, 5)], "src bigint, dst bigint")
    nodes = spark.createDataFrame([(i, False) for i in (1, 2, 3, 4, 5, 6, 8)] + [(7, True)], "id bigint, stub boolean")
    return edges, nodes


def test_density_counts_works_others_cite(g):
    d = {r["id"]: r["density"] for r in G.density(*g).collect()}
    assert d == {1: 1, 2: 0, 3: 1, 4: 2, 5: 0, 6: 0, 7: 0, 8: 0}


def test_density_of_stub_citers(spark):
    e = spark.createDataFrame([(1, 2), (9, 2)], "src bigint, dst bigint")
    n = spark.createDataFrame([(1, False), (9, True)], "id bigint, stub boolean")
    d = {r["id"]: r["density"] for r in G.density(e, n).collect()}
    assert d == {1: 0, 9: 1}


def test_pagerank_sums_to_one(g):
    r = {x["id"]: x["rank"] for x in G.pagerank(*g).collect()}
    assert len(r) == 8 and abs(sum(r.values()) - 1) < 1e-9 and r[5] > r[1] and abs(r[8] - r[6]) < 1e-12


def test_pagerank_of_nothing(spark):
    assert G.pagerank(spark.createDataFrame([], "src bigint, dst bigint"), spark.createDataFrame([], "id bigint")).count() == 0


def test_shortest_paths(spark, g):
    pairs = spark.createDataFrame([(1, 4), (1, 5), (1, 6), (2, 2)], "a bigint, b bigint")
    assert {(r["a"], r["b"]): r["hops"] for r in G.shortest_paths(g[0], pairs, 5).collect()} == {(1, 4): 2, (1, 5): 2, (1, 6): None, (2, 2): 0}
    chain = spark.createDataFrame([(i, i + 1) for i in range(10)], "src bigint, dst bigint")
    got = G.shortest_paths(chain, spark.createDataFrame([(0, 5), (0, 6)], "a bigint, b bigint"), 5).collect()
    assert {r["b"]: r["hops"] for r in got} == {5: 5, 6: None}


def test_jaccard_is_symmetric_and_zero_without_citations(spark, g):
    p = spark.createDataFrame([(1, 4), (4, 1), (1, 8)], "a bigint, b bigint")
    j = {(r["a"], r["b"]): r["jaccard"] for r in G.jaccard(g[0], p).collect()}
    assert j[1, 4] == j[4, 1] == pytest.approx(1 / 3) and j[1, 8] == 0


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a", False), (2, None, True)], "id bigint, name string, stub boolean")
    new = spark.createDataFrame([(2, "b"), (3, "c"), (1, None)], "id bigint, name string")
    got = sorted(map(tuple, U.upsert_nodes(old, new).select("id", "name", "stub").collect()))
    assert got == [(1, "a", False), (2, "b", False), (3, "c", False)]
    again = U.upsert_nodes(U.upsert_nodes(old, new), new).select("id", "name", "stub")
    assert sorted(map(tuple, again.collect())) == got
    ids = spark.createDataFrame([(1,), (9,), (9,), (None,)], "id bigint")
    assert sorted((r["id"], r["stub"]) for r in U.insert_stubs(old, ids).collect()) == [(1, False), (2, True), (9, True)]
    e = spark.createDataFrame([(1, 2), (1, 2), (1, 7)], "src bigint, dst bigint")
    assert [tuple(r) for r in U.merge_edges(e.limit(0), e, old).collect()] == [(1, 2)]
    k = U.keep_last(spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string"), spark.createDataFrame([(2, "z")], "k int, v string"), ["k"])
    assert sorted(map(tuple, k.collect())) == [(1, "x"), (2, "z")]
