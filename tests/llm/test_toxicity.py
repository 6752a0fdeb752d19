import random

import pytest

from newsloom.llm import toxicity
from tests.llm.helpers import documents

LEXICON = toxicity.Lexicon({" idiot ": 5.0, " ioser ": 4.0, " vequ": 3.0}, (" viiiage idiot ",), (-6.0, 2.0, 1.0, 0.5))


def found(text):
    return [(s, e, t) for s, e, _, t in toxicity.matches(toxicity.fold(text), LEXICON)]


@pytest.mark.parametrize("text,terms", [
    ("You IDIOT!", ["idiot"]), ("1d10t", ["idiot"]), ("іdіоt", ["idiot"]), ("ｉｄｉｏｔ", ["idiot"]), ("l0$er", ["ioser"]), ("|oser", ["ioser"]),
    ("idiot idiot", ["idiot", "idiot"]), ("idiotic", []), ("unidiot", []), ("idiot$$$", ["idiot"]), ("@idiot", []),
    ("the village idiot", []), ("a village, idiot", ["idiot"]), ("veqution", ["vequ"]), ("xvequ", []), ("", []), ("idiot", ["idiot"]),
])
def test_matches(text, terms):
    hits = found(text)
    assert [t for _, _, t in hits] == terms
    for s, e, term in hits:
        assert toxicity.fold(text[s:e]).strip().startswith(term)


def test_fold_keeps_places():
    rng = random.Random(1)
    for _ in range(200):
        text = "".join(chr(rng.choice([rng.randrange(32, 600), rng.randrange(0x400, 0x460), rng.randrange(0xFF01, 0xFF5F), 0x1F600])) for _ in range(40))
        assert len(toxicity.fold(text)) == len(text) + 2


def corpus(n=900):
    rng = random.Random(3)
    words = [f"word{i}" for i in range(300)]
    rows, marks = [], []
    for i in range(n):
        body = rng.choices(words, k=rng.randint(5, 60))
        bad = i % 5 == 0
        if bad:
            body[rng.randrange(len(body))] = rng.choice(["gr0mble", "GROMBLE", "snurkish", "snurky", "Snurk"])
        rows.append((i, " ".join(body)))
        marks.append((i, int(bad)))
    return rows, marks


def test_held_out_accuracy(spark):
    rows, marks = corpus()
    docs = documents(spark, [*rows, (9000, None), (9001, ""), (9002, "GR0MBLE " + "long " * 50_000), (None, "gromble")])
    labels = spark.createDataFrame([m for m in marks if m[0] % 4 != 2] + [(None, 1), (5, None), (99999, 1)], "doc_id long, toxic int")
    lexicon = toxicity.learn(docs, labels)
    scored = {r["doc_id"]: r for r in toxicity.score(docs.selectExpr("*", "1 AS toxicity", "2 AS _found"), lexicon).collect()}
    held = [m for m in marks if m[0] % 4 == 2]
    assert sum((scored[i]["toxicity"] >= 0.3) == bool(t) for i, t in held) >= 0.97 * len(held)
    assert all(0 <= r["toxicity"] <= 1 for r in scored.values())
    assert scored[9000]["toxicity"] == scored[9001]["toxicity"] < 0.3
    assert scored[9002]["toxic_spans"] and scored[None]["toxicity"] >= 0.3


def test_exceptions_are_learned(spark):
    rows, marks = corpus()
    extra = [(2000 + i, f"such a gromble garden word{i}") for i in range(30)]
    labels = spark.createDataFrame(marks + [(i, 0) for i, _ in extra], "doc_id long, toxic int")
    lexicon = toxicity.learn(documents(spark, rows + extra), labels)
    assert " grombie garden " in lexicon.exceptions


def test_no_labels_and_empty_table(spark):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    lexicon = toxicity.learn(documents(spark, [(1, "x")]), labels)
    assert toxicity.score(documents(spark, [(1, "x")]), lexicon).first()["toxicity"] < 0.01
    assert toxicity.score(documents(spark, []), lexicon).collect() == []
