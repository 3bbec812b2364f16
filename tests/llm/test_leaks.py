import random

from citeloom.llm import leaks as L

RNG = random.Random(4)
VOCAB = [f"w{i}" for i in range(400)]


def passage(n, rng=RNG):
    return [rng.choice(VOCAB) for _ in range(n)]


def brute(item, text):
    """Edit distance of every run of the item to any stretch of the text."""
    n, m = len(item), len(text)
    for s in range(n - 29):
        row = [0] * (m + 1)
        for k in range(1, n - s + 1):
            new = [k]
            for j in range(1, m + 1):
                new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (item[s + k - 1] != text[j - 1])))
            row = new
            if k >= 30 and min(row) <= k // 10:
                return True
            if k >= 60:
                break
    return False


def spoil(w, edits, rng):
    w = list(w)
    for _ in range(edits):
        i = rng.randrange(1, len(w) - 1)
        how = rng.randrange(3)
        if how == 0:
            w[i] = "changed"
        elif how == 1:
            del w[i]
        else:
            w.insert(i, "added")
    return w


def test_against_brute_force():
    rng = random.Random(9)
    items = [(i, passage(rng.randint(30, 90), rng)) for i in range(6)]
    index = L.Index(items)
    for trial in range(36):
        key, w = items[trial % 6]
        n = rng.choice([20, 26, 29, 30, 31, 35, 45, 60])
        s = rng.randrange(max(1, len(w) - n + 1))
        text = passage(rng.randint(0, 45), rng) + spoil(w[s : s + n], rng.choice([0, 1, 2, 3, 4, 6]), rng) + passage(rng.randint(0, 45), rng)
        want = [k for k, x in enumerate(items) if brute(x[1], text)]
        assert L.leaked(text, index) == want, (trial, key, n)


def test_wand_finds_all_above_threshold():
    rng = random.Random(2)
    common = passage(20, rng)
    items = [(i, common + passage(40, rng)) for i in range(100)]
    index = L.Index(items)
    query = set(L.grams(items[7][1]) + L.grams(items[41][1][15:]))
    scores = {i: sum(x for g in query if g in index.postings for j, x in zip(*index.postings[g][:2]) if j == i) for i in range(100)}
    assert sorted(index.retrieve(query)) == sorted(i for i, s in scores.items() if s >= index.threshold[i] and s > 0)


def test_words_disregard_case_punctuation_and_quotes():
    assert L.words_of("“The Warrant’s\n—scope”, IT­self") == ["the", "warrants", "scope", "itself"] and L.words_of(None) == []


def test_rows(spark):
    w = [f"u{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, " ".join(w), 0), (2, None, 0), (3, "", 0), (4, " ".join(w[:25]), 0), (5, "x " * 20_000 + " ".join(w).upper(), 0), (5, " ".join(w), 0)], "doc_id bigint, text string, t int")
    items = spark.createDataFrame([(10, " ".join(w), 1), (11, " ".join(w), 1), (12, None, 1), (13, "too short", 1)], "benchmark_id bigint, context string, d int")
    got = sorted(map(tuple, L.leaked_items(docs, items).collect()))
    assert got == [(1, 10), (1, 11), (5, 10), (5, 11)]
    assert L.leaked_items(docs, items.limit(0)).count() == 0 and L.leaked_items(docs.limit(0), items).count() == 0
