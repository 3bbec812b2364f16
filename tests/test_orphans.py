from datetime import datetime as D

from citeloom.operators.orphans import entity_state, orphan_references

T0, T1 = D(2020, 1, 1), D(2021, 1, 1)
REF = "ref_table string, ref_key bigint, owner bigint, ref bigint, at timestamp_ntz"


def state(spark):
    live = spark.createDataFrame([(1, T0), (2, T1), (2, T1), (None, T0), (5, T0), (6, None)], "id bigint, at timestamp_ntz")
    return entity_state(live, spark.createDataFrame([(3,)], "id bigint"), spark.createDataFrame([(4,), (1,)], "id bigint"))


def test_reasons(spark):
    refs = spark.createDataFrame([("t", 1, None, 1, T0), ("t", 2, None, 2, T0), ("t", 3, None, 2, T1), ("t", 4, None, 3, T0), ("t", 5, None, 4, T0), ("t", 6, None, 9, T0), ("t", 7, None, None, T0), ("t", 8, None, 9, None), ("t", 9, None, 6, T0)], REF)
    got = {r["ref_key"]: r["reason"] for r in orphan_references(refs, state(spark)).direct.collect()}
    assert got == {2: "late", 5: "deleted", 6: "missing", 8: "missing"}


def test_cascade_ends_on_cycles_and_keeps_first_level(spark):
    # 1 cites the missing 9; 5 cites 1; 1 cites 5 (a cycle); 2 cites 5; self reference of 5
    refs = spark.createDataFrame([("t", 1, 1, 9, T1), ("t", 2, 5, 1, T1), ("t", 3, 1, 5, T1), ("t", 4, 2, 5, T1), ("t", 5, 5, 5, T1), ("t", 5, 5, 5, T1)], REF)
    o = orphan_references(refs, state(spark))
    assert {(r["ref_key"], r["ref"], r["level"]) for r in o.inherited.collect()} == {(2, 1, 1), (3, 5, 2), (4, 5, 2), (5, 5, 2)}
    assert [r["ref_key"] for r in o.direct.collect()] == [1]


def test_empty(spark):
    o = orphan_references(spark.createDataFrame([], REF), state(spark))
    assert o.direct.count() == 0 and o.inherited.count() == 0
