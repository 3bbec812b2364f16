import random
from collections import defaultdict

import pytest

from citeloom.operators import graph as G
from citeloom.plans import graph_queries as Q


def hops(edges, a, b, most=5):
    """Undirected distance by breadth-first search, None beyond `most`."""
    adj = defaultdict(set)
    for x, y in edges:
        adj[x].add(y)
        adj[y].add(x)
    seen, front = {a}, {a}
    for h in range(most + 1):
        if b in seen:
            return h
        front = {y for x in front for y in adj[x]} - seen
        seen |= front
    return None


def write(spark, folder, edges, cases):
    """Tables of a small graph, as the graph queries read them."""
    spark.createDataFrame(edges, "src bigint, dst bigint").write.parquet(f"{folder}/graph_edges.parquet")
    rows = [(i, c, f"v. {c}", "2001-01-01", "scotus", "Res judicata.") for i, c in enumerate(cases)]
    cols = "row_id bigint, case_id bigint, case_name string, date_filed string, court_id string, plain_text string"
    spark.createDataFrame(rows, cols).write.parquet(f"{folder}/cases_enriched.parquet")
    spark.createDataFrame([], "case_id bigint, case_name string, date_filed string, court_id string").write.parquet(f"{folder}/landmark_cases.parquet")
    return str(folder)


def test_paths_through_the_test_data_hub(spark, tmp_path):
    # 84216 is the only link of 1 and 2
    edges = [(1, 84216), (2, 84216), (9, 1), (9, 2)]
    sf = write(spark, tmp_path, edges + [(8, 1), (8, 84216)], [1, 2, 84216])
    got = {(r["a"], r["b"]): r["hops"] for r in Q.shortest_path(spark, sf).collect()}
    assert got == {(1, 2): 2, (1, 84216): 1}


@pytest.mark.parametrize("hubs", [0, 3])
def test_any_number_of_hubs_gives_the_distances(spark, hubs):
    rnd = random.Random(hubs)
    edges = [(i, 1000) for i in range(0, 40, 5)] + [(i, i + 1) for i in range(60)] + [(rnd.randrange(90), rnd.randrange(90)) for _ in range(25)]
    pairs = sorted({(rnd.randrange(100), rnd.choice([1000, rnd.randrange(100)])) for _ in range(200)} | {(7, 7)})
    got = G.shortest_paths(spark.createDataFrame(edges, "src bigint, dst bigint"), spark.createDataFrame(pairs, "a bigint, b bigint"), hubs=hubs).collect()
    assert {(r["a"], r["b"]): r["hops"] for r in got} == {p: hops(edges, *p) for p in pairs}
