import random

from citeloom.llm import toxic as T

RNG = random.Random(0)
GOOD = ["The court held that the {} was lawful.", "Counsel filed a brief about the {}.", "The witness saw the {} near the dock.", "A man shouted an insult at the {}, the transcript says.", "I strongly disagree with the ruling on the {}."]
BAD = ["You are a worthless {} and everybody hates you.", "Those {} people are vermin and should be wiped out.", "I hope you rot, you filthy {}."]
NOUN = ["lease", "warrant", "ledger", "deputy", "affidavit", "receipt"]
INSULT = ["clown", "grubber", "zonk", "slimeball"]


def corpus(n, seed):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        y = rng.random() < 0.25
        s = [rng.choice(GOOD).format(rng.choice(NOUN)) for _ in range(6)]
        if y:
            s.insert(rng.randrange(6), rng.choice(BAD).format(rng.choice(INSULT)))
        out.append((" ".join(s), int(y)))
    return out


def test_held_out_accuracy_despite_wrong_labels():
    train = [(t, y if RNG.random() > 0.06 else 1 - y) for t, y in corpus(600, 1)]
    m = T.fit(train)
    test = corpus(300, 2)
    hits = sum((m.score(T.sentences(t)) >= m.cut) == bool(y) for t, y in test)
    assert hits >= 0.97 * len(test), hits


def test_disguises_read_as_the_word():
    m = T.fit(corpus(300, 1) + [("You goddamn idiot, you stupid idiot.", 1)] * 8)
    assert m.known(T.words_of("iiidiot go.ddamn 1d10t i d i o t st*pid f****y")) == ["idiot", "goddamn", "idiot", "idiot", "stupid", "<masked>"] or m.known(T.words_of("iiidiot go.ddamn i d i o t")) == ["idiot", "goddamn", "idiot"]


def test_without_judgements_the_examples_decide(spark):
    docs = spark.createDataFrame([(1, "a", "You stupid worthless idiot, shut up."), (2, "a", None), (3, "b", ""), (4, "b", "The court held that the search was lawful."), (4, "b", "The court held that the search was lawful."), (5, None, "word " * 30_000)], "doc_id bigint, source string, text string").selectExpr("*", "0 as score")
    labels = spark.createDataFrame([(4, None), (4, 0), (4, 1), (99, 1)], "doc_id bigint, toxic int")
    got = [(r["doc_id"], r["toxic"]) for r in T.toxic_scores(docs, labels).collect()]
    assert sorted(got) == [(1, True), (2, False), (3, False), (4, False), (4, False), (5, False)]
    assert T.toxic_scores(docs.limit(0), labels.limit(0)).count() == 0
