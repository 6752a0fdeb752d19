import math
import random

import numpy as np
import pytest

from newsloom.llm import gru
from tests.llm.helpers import documents

SOUNDS = {"aa": ["the", "ing", "er", "wh"], "bb": ["sch", "ung", "ß", "ei"], "cc": ["ción", "ñ", "que", "os"]}


def corpus(n=600, seed=2):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SOUNDS))
        rows.append((i, " ".join("".join(rng.choices(SOUNDS[lang], k=3)) for _ in range(rng.randint(3, 60))), lang))
    return rows


def test_gradients_are_slopes():
    rng = np.random.default_rng(0)
    net = gru.Network.drawn(["x", "y", "z"], units=3)
    for field in ("inputs", "states", "bias"):
        setattr(net, field, [v.astype(np.float64) for v in getattr(net, field)])
    net.out, net.shift = net.out.astype(np.float64), net.shift.astype(np.float64)
    windows = rng.integers(0, 256, (6, 4)).astype(np.uint8)
    live = np.ones((6, 4))
    live[4:, 1] = 0
    target = np.array([0, 1, 2, 1])
    slopes = gru.gradients(net, windows, live, target)[1]
    for value, slope in zip(net.parameters(), slopes):
        places = np.argwhere(slope != 0) if value.size > 60 else np.argwhere(np.ones(value.shape))
        for place in map(tuple, places[:12]):
            kept = value[place]
            loss = []
            for step in (1e-3, -1e-3):
                value[place] = kept + step
                loss.append(gru.gradients(net, windows, live, target)[0])
            value[place] = kept
            assert (loss[0] - loss[1]) / 2e-3 == pytest.approx(slope[place], abs=2e-4)


def test_windows_cover_whole_texts():
    for n in (0, 1, 63, 64, 65, 1000):
        text = bytes(range(1, 251)) * 4
        windows, live = gru.cut(text[:n])
        assert windows.T.tobytes()[:n] == text[:n] and live.sum() == n


def test_pooling_does_not_depend_on_the_batch(monkeypatch):
    net = gru.Network.drawn(["x", "y"])
    rng = random.Random(5)
    texts = [bytes(rng.choices(range(97, 122), k=rng.choice([0, 3, 64, 65, 700]))) for _ in range(40)]
    alone = np.array([gru.pooled(net, [t])[0] for t in texts])
    for together in (1, 7, 4096):
        monkeypatch.setattr(gru, "TOGETHER", together)
        assert np.allclose(gru.pooled(net, texts), alone, atol=1e-5)
    for text, shares in zip(texts, alone):
        if text:
            windows, live = gru.cut(text)
            positions = gru.position_probabilities(net, windows, live)
            assert positions.shape[::2] == windows.shape and np.allclose(positions.sum(axis=1), 1, atol=1e-5)
            assert shares.sum() == pytest.approx(1, abs=1e-4)


def test_held_out_accuracy_and_odd_texts(spark):
    rows = corpus()
    learning = documents(spark, [r for r in rows if r[0] % 3 != 1] + [(5000, None, "aa"), (5001, "", "bb"), (5002, "xyz", None)])
    net = gru.learn(learning)
    assert net.languages == ["aa", "bb", "cc"]
    odd = [(9000, None), (9001, ""), (9002, "12 34 !?"), (9003, "ción " * 40_000), (9004, "ñ")]
    docs = documents(spark, rows + odd).selectExpr("*", "'q' AS lang_pred", "1 AS _found", "2 AS score")
    found = {r["doc_id"]: r for r in gru.identify(docs, net).collect()}
    held = [r for r in rows if r[0] % 3 == 1]
    assert sum(found[i]["lang_pred"] == lang for i, _, lang in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert [found[i]["lang_pred"] for i in (9000, 9001, 9002, 9003)] == ["und", "und", "und", "cc"]
    assert [found[i]["score"] for i in (9000, 9001, 9002)] == [0, 0, 0]
    assert found[0]["_found"] == 1


def test_nothing_to_learn_and_empty_table(spark):
    assert gru.learn(documents(spark, [(1, "abc")])) is None
    assert gru.identify(documents(spark, [(1, "abc")]), None).first()["lang_pred"] == "und"
    assert gru.identify(documents(spark, []), None).collect() == []


def many_languages(n, each):
    """Languages that differ in one letter that all their words hold."""
    rng = random.Random(9)
    letters = [chr(0x4E00 + 37 * i) for i in range(n)]
    return [(i, " ".join(letters[i % n] * 2 + rng.choice("abcde") for _ in range(40)), f"l{i % n:03d}") for i in range(n * each)]


def test_a_hundred_languages_are_learned_and_rare_ones_too(spark):
    rows = many_languages(100, 3) + [(10_000 + i, f"the {i} of and", "zz") for i in range(2000)]
    net = gru.learn(documents(spark, rows), rows=400, least=3)
    assert len(net.languages) == 101


def test_the_sample_is_bounded_under_null_and_hot_ids(spark):
    rows = [(None, f"text number {i}", "aa") for i in range(4000)] + [(7, f"other {i}", "bb") for i in range(4000)]
    rows += [(9, "always the same", "cc")] * 3000 + [(i, f"plain {i}", "dd") for i in range(1000)]
    taken = gru.training_rows(documents(spark, rows).repartition(4), "text", "lang", "doc_id", 400, 30).dropDuplicates(["h", "l"])
    counts = {r["l"]: r["count"] for r in taken.groupBy("l").count().collect()}
    assert counts["cc"] == 1 and all(60 <= counts[c] <= 170 for c in ("aa", "bb", "dd"))


def plain_shares(net, text):
    """Mean probabilities of a text: window by window and byte by byte, in plain numbers."""
    units = net.states[0].shape[1]

    def sigmoid(x):
        return 1 / (1 + math.exp(-x))

    totals = [0.0] * len(net.languages)
    for at in range(0, len(text), gru.WINDOW):
        window = text[at: at + gru.WINDOW]
        states = [{}, {}]
        for way in (0, 1):
            state = [0.0] * units
            for t in range(len(window)) if way == 0 else reversed(range(len(window))):
                given = net.inputs[way][:, window[t]]
                led = [sum(float(net.states[way][k, j]) * state[j] for j in range(units)) for k in range(3 * units)]
                after = []
                for k in range(units):
                    reset, update = sigmoid(given[k] + led[k]), sigmoid(given[units + k] + led[units + k])
                    candidate = math.tanh(given[2 * units + k] + reset * (led[2 * units + k] + float(net.bias[way][k, 0])))
                    after.append(candidate + update * (state[k] - candidate))
                state = after
                states[way][t] = state
        for t in range(len(window)):
            both = states[0][t] + states[1][t]
            scores = [sum(float(w) * x for w, x in zip(row, both)) + float(net.shift[i, 0]) for i, row in enumerate(net.out)]
            top = [math.exp(x - max(scores)) for x in scores]
            totals = [a + x / sum(top) for a, x in zip(totals, top)]
    return [x / max(1, len(text)) for x in totals]


def test_pooling_equals_a_plain_forward_pass():
    net = gru.Network.drawn(["x", "y", "z"], seed=4)
    for drawn in net.bias:
        drawn += np.linspace(-0.5, 0.5, len(drawn), dtype=np.float32)[:, None]
    rng = random.Random(2)
    texts = [b"", b"a", bytes(rng.choices(range(256), k=64)), "zażółć gęślą".encode() * 9]
    for shares, text in zip(gru.pooled(net, texts), texts):
        assert np.allclose(shares, plain_shares(net, text), atol=1e-5)
