import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from citeloom.llm import bpe

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.VOCABULARY), reason="no vocabulary")


@pytest.fixture(scope="module")
def plain():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.VOCABULARY), special_tokens={})


@settings(max_examples=200, deadline=None)
@given(t=st.text(max_size=80))
def test_equal_to_the_plain_encoder(plain, t):
    assert bpe.encode_texts([t], bpe.VOCABULARY, {}) == [plain.encode_ordinary(t)]


def test_round_trip_of_long_and_odd_texts(plain):
    texts = ["a" * 30_000, "<|endoftext|>", " \n\t ", "don't 'LL é😀 ١٢", "ab" * 5000, "\x00"]
    got = bpe.encode_texts(texts, bpe.VOCABULARY, {})
    assert got == [plain.encode_ordinary(t) for t in texts] and [plain.decode(g) for g in got] == texts


def test_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "", 5), (3, "hello hello", 5), (3, "hello hello", 5)], "doc_id bigint, text string, ids int")
    got = sorted((r["doc_id"], list(r["ids"])) for r in bpe.encode_corpus(df).collect())
    assert got == [(1, []), (2, []), (3, [31373, 23748]), (3, [31373, 23748])]
    assert bpe.encode_corpus(df.limit(0)).count() == 0
