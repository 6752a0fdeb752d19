import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from newsloom.llm import ppm
from tests.llm.helpers import documents


def texts(n=60, seed=1):
    rng = random.Random(seed)
    parts = ["ba", "ti", "no", "É", "ru", "ss", "Q"]
    return [" ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def spelled(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split()
    return "\n" * ppm.ORDER + " ".join(words) + "\n"


def plain_trie(learned):
    trie = {}
    for text in learned:
        data = spelled(text).encode()
        for at in range(ppm.ORDER, len(data)):
            for depth in range(ppm.ORDER + 1):
                trie.setdefault(data[at - depth: at], Counter())[data[at]] += 1
    return trie


def plain_log10(trie, context, symbol):
    """Method C with exclusion, from the definition."""
    excluded, out = set(), 0.0
    for depth in range(ppm.ORDER, -1, -1):
        seen = trie.get(context[len(context) - depth:])
        if seen is None:
            continue
        left = {s: n for s, n in seen.items() if s not in excluded}
        total, kinds = sum(left.values()), len(left)
        if symbol in left:
            return out + math.log10(left[symbol] / (total + kinds))
        if kinds:
            out += math.log10(kinds / (total + kinds))
        excluded |= set(seen)
    return out - math.log10(max(1, 256 - len(excluded)))


def model(spark, learned, **how):
    return ppm.learn(documents(spark, list(enumerate(learned))), "text", **how)


def test_equals_the_definition(spark):
    learned = texts() + ["", None]
    trie, fitted = plain_trie(learned), model(spark, learned)
    for text in [*texts(20, 9), "", "zzz ünknown ÿ", "ba" * 50]:
        data = spelled(text).encode()
        want = sum(plain_log10(trie, data[at - ppm.ORDER: at], data[at]) for at in range(ppm.ORDER, len(data)))
        assert fitted.score([text.encode()])[0] == pytest.approx(want, abs=1e-3)


@pytest.mark.parametrize("nodes", [10**6, 300])
def test_probabilities_sum_to_one(spark, nodes):
    fitted = model(spark, texts(), nodes=nodes)
    assert sum(len(level.keys) for level in fitted.levels) <= nodes
    for context in (b"\n\n\n\n\n", b"tino ", b"zzzzz", "É ba".encode()):
        key = int.from_bytes(context[:5].rjust(5, b"\n"), "big") << 8
        p = 10 ** fitted.log10(np.array([key | s for s in range(256)]))
        assert p.sum() == pytest.approx(1, abs=1e-5) and (p > 0).all()


@pytest.mark.parametrize("common", [5, 100_000])
def test_scores(spark, common):
    rows = list(enumerate([*texts(80), None, "", "Never seen words", "ba ba ba " * 3000])) + [(3, "ba ti"), (3, "ba ti")]
    docs = documents(spark, rows).selectExpr("*", "1 AS word", "2 AS n", "3 AS rest")
    found = ppm.score(docs, "crc32(cast(doc_id AS string)) % 7 <> 2", common=common).collect()
    learns = lambda i: zlib.crc32(str(i).encode()) % 7 != 2
    tokens = lambda t: [*spelled(t).split(), ""]
    counts = Counter(w for i, t in rows if learns(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted(
        (i, not learns(i), len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), n,
         round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), 5)) for i, t in rows)
    assert sorted((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in found) == want
    held = [r for r in found if r["held_out"] and r["n_tokens"] > 5]
    assert held and sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 for r in found)


@pytest.mark.parametrize("nodes", [0, 200, 10**6])
def test_every_count_is_used(spark, nodes):
    """Scores are those of the whole trie, however few grams the tasks hold."""
    rows = list(enumerate([*texts(70, 3), "zzz ünknown ÿ", "", None, "ba" * 50]))
    learned = [t for i, t in rows if i % 3]
    trie = plain_trie(learned)
    assert sum(map(len, trie.values())) > 200
    for r in ppm.score(documents(spark, rows), "doc_id % 3 <> 0", nodes=nodes).collect():
        data = spelled(dict(rows)[r["doc_id"]]).encode()
        want = sum(plain_log10(trie, data[at - ppm.ORDER: at], data[at]) for at in range(ppm.ORDER, len(data)))
        assert r["score"] == pytest.approx(want, abs=1e-3)


def test_empty_tables(spark):
    assert ppm.score(documents(spark, []), "true").collect() == []
    row = ppm.score(documents(spark, [(1, "a b")]), "false").first()
    assert row["n_known"] == 0 and row["train_tokens"] == 0 and row["score"] == pytest.approx(-4 * math.log10(256))
    assert row["base_score"] == 0
