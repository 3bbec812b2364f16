import ast
import json

import duckdb

from citeloom.plans import text_queries as Q

FORMS = [
    '["1 A. 2"]', '["1 \\"Red\\" 2", "b\\u00e9"]', "['1 A. 2', '3 B. 4']", '["it\'s", \'b\']', "['it\\'s']", '[\n "a",\n "b"\n]', "[]", "[ ]", "[1, null]", "['a', None]", "['a',]", " ['a']",
    "[broken", '["a"] and more', '{"a": 1}', "'a'", '"a","b"', '"[\\"a\\"]"', "1 A. 2\n3 B. 4", "", "  ", None,
]


def brute(text):
    """(items or nothing, items or the text) by the two parsers themselves."""
    for parse in (json.loads, ast.literal_eval):
        try:
            v = parse(text.strip())
        except Exception:
            continue
        if isinstance(v, (list, tuple)):
            v = [x if x is None else str(x) for x in v]
            return v, v
    return [], [] if text is None else [text]


def want(rows):
    return {i: (len(brute(t)[0]), (brute(t)[1] or [None])[0]) for i, t in rows}


def test_every_form_is_parsed_under_both_failure_rules(spark, tmp_path):
    rows = list(enumerate(FORMS))
    spark.createDataFrame(rows, "row_id bigint, citations string").write.parquet(f"{tmp_path}/cases_enriched.parquet")
    got = {r["row_id"]: (r["n_items"], r["first_item"]) for r in Q.parse_list(spark, str(tmp_path)).collect()}
    assert got == want(rows)
    assert got[2] == (2, "1 A. 2") and got[12] == (0, "[broken") and got[21] == (0, None)


def test_all_rows_of_the_smallest_tables(spark, sf):
    rows = duckdb.execute(f"select row_id, citations from '{sf}/cases_enriched.parquet'").fetchall()
    assert {r["row_id"]: (r["n_items"], r["first_item"]) for r in Q.parse_list(spark, sf).collect()} == want(rows)
