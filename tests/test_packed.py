import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from citeloom.functions.packed import split_packed
from citeloom.operators.unpack import unpack


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (None, []), ("", []), ("  ", []), ("[]", []), ("['']", []), (" ; ", []), ("{}", []),
        ('["1 A. 2", "3 B. 4"]', ["1 A. 2", "3 B. 4"]),
        ("['1 A. 2', \"365 D's Ch. 2\"]", ["1 A. 2", "365 D's Ch. 2"]),
        ('"[\\"1 Q. \\\\\\"Red\\\\\\" Rep. 5\\", \\"2 R. 3\\"]"', ['1 Q. "Red" Rep. 5', "2 R. 3"]),
        ('"1 A. 2";"2 Q. ""Red"" Rep. 3"', ["1 A. 2", '2 Q. "Red" Rep. 3']),
        ('{"1 A. 2","3 Q. \\"Red\\" Rep. 4"}', ["1 A. 2", '3 Q. "Red" Rep. 4']),
        ("118 Harl. & T., N.S. 352", ["118 Harl. & T., N.S. 352"]),
        ("587 Cal. Rec., Ser. B 72;79 V. 2d 261", ["587 Cal. Rec., Ser. B 72", "79 V. 2d 261"]),
        ("1 A. 2 | 3 B. 4, 5 C. 6;\t7 D. 8", ["1 A. 2", "3 B. 4", "5 C. 6", "7 D. 8"]),
        ("1 A. 2||1 A. 2", ["1 A. 2", "1 A. 2"]), ("1 A. 2 / 3 B. 4 /", ["1 A. 2", "3 B. 4"]),
        ("[498 Q. \"Red\" Rep. 1331, 27 App. 1351]", ['498 Q. "Red" Rep. 1331', "27 App. 1351"]),
        ("https://a.example/o/1/ /o/2/ 33", ["https://a.example/o/1/", "/o/2/", "33"]),
        ('"never closed; 2', ['"never closed', "2"]), ('["a \\u00a7 b"]', ["a § b"]), ('[["a"], ["b", "c"]]', ["a", "b", "c"]),
    ],
)
def test_forms(text, want):
    assert split_packed(text) == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="abc 12.&'\"\\,;|é", min_size=1).map(str.strip).filter(bool), min_size=2, max_size=6))
def test_json_round_trip(items):
    assert split_packed(json.dumps(items)) == items


def test_very_long_list():
    assert split_packed("; ".join(f"{i} A. {i}" for i in range(20_000)))[-1] == "19999 A. 19999"


def test_unpack_rows(spark):
    df = spark.createDataFrame([(1, "1 A. 2; 3 B. 4", None, 9), (1, "1 A. 2", "", 9), (2, None, "[7, 8]", 9), (3, "[]", " ", 9)], "id int, a string, b string, pos int")
    got = sorted(map(tuple, unpack(df, "id", ["a", "b"]).collect()))
    assert got == [(1, "a", 1, "1 A. 2"), (1, "a", 1, "1 A. 2"), (1, "a", 2, "3 B. 4"), (2, "b", 1, "7"), (2, "b", 2, "8")]
    assert unpack(df.limit(0), "id", ["a"]).count() == 0
