import random

from hypothesis import given, settings
from hypothesis import strategies as st

from citeloom.llm import pieces as P


@settings(max_examples=120, deadline=None)
@given(st.lists(st.sampled_from(["Word ", "a. ", "Some sentence here. ", "\n\n", "x" * 70, "No. 5 ", "é ", "; ", "\r\n\r\n", "What? "]), max_size=120), st.integers(0, 10))
def test_round_trip_and_limit(parts, overlap):
    text = "".join(parts)
    kind, got = P.cut_text(text, 50 + overlap, overlap)
    assert all(len(p) <= 50 + overlap for p in got) and kind in P.KINDS
    assert all(p in text for p in got)
    if text and not any(len(w) > 50 for w in text.split()):
        assert " ".join(P.cut_text(text, 50, 0)[1]).split() == text.split()
    plain = P.cut_text(text, 50, 0)[1]
    assert "".join("".join(plain).split()) == "".join(text.split())
    assert len(got) == len(plain) and all(p.endswith(q) for p, q in zip(got, plain))


def test_boundaries():
    para, sent = "A short sentence. " * 20, "w" * 30 + " "
    assert P.cut_text((para.strip() + "\n\n") * 20, 400 + 200)[0] == "paragraph"
    assert P.cut_text(para * 20, 600)[0] == "sentence"
    assert P.cut_text("see Doe v. Roe, 5 App. Ct. 3 (No. 5, App. Ct. 1932) (held); " * 40, 600)[0] == "word"
    assert P.cut_text("x" * 5000, 600)[0] == "char" and P.cut_text(sent * 40, 600)[0] == "word"
    assert [len(p) for p in P.cut_text("x" * 1000, 600, 200)[1]] == [400, 600, 400]


def test_cuts_fall_on_the_strongest_boundaries():
    rng = random.Random(1)
    text = "\n\n".join(" ".join(f"Sentence {i} has {rng.randint(1, 99)} words." for i in range(12)) for _ in range(20))
    _, got = P.cut_text(text, 1000, 0)
    assert all(p.endswith("\n\n") or p is got[-1] for p in got)


def test_abbreviations_end_no_sentence():
    t = 'Mr. J. Doe v. Roe Corp. et al. filed No. 5. See 12 Vell. Rep. 4 there; it was late. "Why?" he said. Then Q.M.L.R. closed.'
    assert [t[a:b].strip() for a, b in P.sentence_spans(t)] == ["Mr. J. Doe v. Roe Corp. et al. filed No. 5.", "See 12 Vell. Rep. 4 there; it was late.", '"Why?" he said.', "Then Q.M.L.R. closed."]


def test_rows(spark):
    df = spark.createDataFrame([(1, "A b. " * 1000, "x"), (1, "A b. " * 1000, "x"), (2, None, "x"), (3, "", "x"), (4, "short", "x"), (5, " " * 5000, "x")], "row_id int, plain_text string, pieces string")
    got = sorted((r["row_id"], r["boundary"]) for r in P.split_oversized(df).collect())
    assert got == [(1, "sentence"), (1, "sentence"), (5, "paragraph")]
    assert P.split_oversized(df.limit(0)).count() == 0
