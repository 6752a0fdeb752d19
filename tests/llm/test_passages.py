import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.llm import passages
from tests.llm.helpers import documents

RNG = random.Random(8)


def words(n, rng=RNG):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def edited(body, every, rng=RNG):
    out = []
    for i, w in enumerate(body):
        if i % every == every - 1:
            out += rng.choice([["new"], [], [w, "more"]])
        else:
            out.append(w)
    return out


def hashes(body):
    return passages.word_hashes(" ".join(body).encode())


@given(st.integers(0, 300), st.integers(1, 3))
@settings(max_examples=60, deadline=None)
def test_shared_words_share_a_seed(n, kinds):
    rng = random.Random(n)
    shared = words(passages.K + passages.WINDOW - 1, rng)
    a, b = words(n, rng) + shared + words(kinds, rng), words(kinds, rng) + shared + words(n, rng)
    found = [set(passages.seeds(hashes(x))[0].tolist()) for x in (a, b)]
    assert found[0] & found[1]


def test_one_repeated_word_has_few_seeds():
    assert len(passages.seeds(hashes(["la"] * 5000))[0]) <= 5000 / passages.WINDOW + 2


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_anchors_over_batches(size):
    rng = random.Random(size)
    rows = sorted((rng.randrange(6), rng.randrange(5), rng.randrange(9)) for _ in range(150))
    batches = [
        pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[at: at + size]]) for i in range(3)], names=["seed", "doc_id", "pos"])
        for at in range(0, len(rows), size)]
    got = [tuple(r.values()) for b in passages._anchors(iter(batches)) for r in b.to_pylist()]
    want = []
    for seed in range(6):
        by_doc = {}
        for s, d, p in sorted(set(rows)):
            if s == seed:
                by_doc.setdefault(d, []).append(p)
        source = min(by_doc, default=None)
        for d, places in sorted(by_doc.items()):
            if d != source:
                want += [(d, p, source, by_doc[source][t % len(by_doc[source])]) for t, p in enumerate(places)]
    assert got == want


def test_chains_score_best(n=60):
    for seed in range(20):
        rng = np.random.default_rng(seed)
        p = np.sort(rng.choice(500, n, replace=False))
        r = np.where(rng.random(n) < 0.7, p + 40, rng.integers(0, 500, n))
        found = passages.chains(p, r)
        assert sorted(i for c in found for i in c) == list(range(n))
        assert all((np.diff(p[c]) > 0).all() and (np.diff(r[c]) > 0).all() for c in found)
        best = np.zeros(n)
        for i in range(n):
            gains = [best[j] - passages.GAP_COST * (p[i] - p[j] + r[i] - r[j]) for j in range(i) if p[j] < p[i] and r[j] < r[i]]
            best[i] = passages.K + max([0.0, *gains])
        first = found[0]
        score = passages.K * len(first) - passages.GAP_COST * (p[first[-1]] - p[first[0]] + r[first[-1]] - r[first[0]])
        assert score == pytest.approx(best.max())


@given(st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), max_size=30))
def test_common_words(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert passages.common_words(a, b) == table[-1][-1]


@given(st.lists(st.integers(0, 3), max_size=30), st.lists(st.integers(0, 3), max_size=30), st.sampled_from([1, 40, 1 << 26]))
def test_matches_are_a_longest_common_subsequence(a, b, held):
    found = passages.matches(a, b, held)[::-1]
    assert len(found) == passages.common_words(a, b) and all(a[i] == b[j] for i, j in found)
    assert all(i < k and j < m for (i, j), (k, m) in zip(found, found[1:]))


def test_planted_passages(spark):
    rng = random.Random(4)
    long_, short, fuzzy, hot = words(200, rng), words(40, rng), words(150, rng), words(60, rng)
    bodies = {i: words(rng.randint(0, 200), rng) for i in range(40)}
    bodies[3] += long_ + words(30, rng)
    bodies[11] = words(17, rng) + long_ + bodies[11]
    bodies[5] += short
    bodies[6] += short
    bodies[7] += fuzzy
    bodies[20] = edited(fuzzy, 20, rng) + bodies[20]
    bodies[30] = bodies[31] = words(90, rng)
    for i in range(60):
        bodies[100 + i] = words(20, rng) + hot + words(20, rng)
    rows = [(i, " \n".join(b)) for i, b in bodies.items()] + [(900, None), (901, ""), (None, " ".join(long_)), (902, "la " * 3000), (903, "LA " * 4000)]
    docs = documents(spark, rows + [rows[0]]).selectExpr("*", "1 AS seed", "2 AS _spans", "'x' AS block")
    found = passages.repeated_passages(docs)
    got = {}
    for r in found.collect():
        assert r["source_id"] < r["doc_id"] and r["end"] - r["start"] >= 50 and r["identity"] >= 0.8
        got.setdefault((r["doc_id"], r["source_id"]), []).append(r)
    want = {(11, 3), (20, 7), (31, 30), (903, 902), *((100 + i, 100) for i in range(1, 60))}
    assert want <= set(got)
    assert all(100 <= s < d < 160 for d, s in set(got) - want)  # a word beside the hot passage may agree too
    exact = got[11, 3][0]
    assert (exact["start"], exact["end"], exact["identity"]) == (17, 217, 1.0)
    assert exact["source_end"] - exact["source_start"] == 200
    assert sum(r["end"] - r["start"] for r in got[20, 7]) >= 130
    assert [(r["start"], r["end"]) for r in got[31, 30]] == [(0, 90)]
    assert all((r[0]["start"], r[0]["end"]) == (20, 80) for (d, s), r in got.items() if s == 100)
    cut = {r["doc_id"]: r for r in passages.remove_passages(docs, found).collect()}
    assert cut[11]["removed_words"] == 200 and cut[11]["text"].split() == rows[[r[0] for r in rows].index(11)][1].split()[:17] + bodies[11][217:]
    assert cut[31]["text"] == "" and cut[30]["text"] == " \n".join(bodies[30]) and cut[900]["text"] is None
    assert all(cut[i]["removed_words"] == 0 for i in (3, 5, 6, 7, 100, 901, 902))


@given(st.integers(0, 10**6))
@settings(max_examples=60, deadline=None)
def test_stretches_cover_all_there_are(seed):
    rng = random.Random(seed)
    a, b = [], []
    for _ in range(rng.randint(1, 8)):
        same = words(rng.randint(8, 40), rng)
        a += same + words(rng.randint(0, 9), rng)
        b += same + words(rng.randint(0, 9), rng)
    a, b = hashes(a), hashes(b)
    p, r = [], []
    for i in range(0, len(a) - passages.K + 1):
        for j in range(0, len(b) - passages.K + 1):
            if np.array_equal(a[i: i + passages.K], b[j: j + passages.K]) and (not p or i > p[-1] and j > r[-1]):
                p.append(i)
                r.append(j)
    found = passages.stretches(a, b, p, r, 50, 0.8)
    x, y = passages._matched(a, b, p, r, passages.K)
    assert (np.diff(x) > 0).all() and (np.diff(y) > 0).all() and (a[x] == b[y]).all()
    covered = np.zeros(len(a), dtype=bool)
    for s, e, t, u, same in found:
        covered[s:e] = True
        hits = ((x >= s) & (x < e)).sum()
        assert e - s >= 50 and same == pytest.approx(2 * hits / (e - s + u - t)) and same >= 0.8 - 1e-9
    for i in range(len(x)):
        for j in range(i, len(x)):
            size = x[j] + 1 - x[i]
            if size >= 50 and 2 * (j - i + 1) >= 0.8 * (size + y[j] + 1 - y[i]) + 1e-6:
                assert covered[x[i]: x[j] + 1].all()


def test_exact_words_before_a_loose_form(spark):
    """An exact start is found though what follows it, in the same chain, matches loosely."""
    rows = []
    for n in range(10):
        rng = random.Random(n)
        intro, form = words(60, rng), [words(12, rng) for _ in range(25)]
        for side in range(2):
            rows.append((2 * n + side, " ".join(intro + [w for part in form for w in words(4, rng) + part])))
    found = passages.repeated_passages(documents(spark, rows)).collect()
    assert all(r["identity"] >= 0.8 and r["end"] - r["start"] >= 50 for r in found)
    for n in range(10):
        own = [r for r in found if (r["doc_id"], r["source_id"]) == (2 * n + 1, 2 * n)]
        assert any(r["start"] == 0 and r["end"] >= 60 for r in own)


def test_empty_table(spark):
    docs = documents(spark, [])
    found = passages.repeated_passages(docs)
    assert found.collect() == [] and passages.remove_passages(docs, found).collect() == []


@pytest.mark.parametrize("spans,want", [([], b" a b\tc  d"), ([(0, 1)], b" b\tc  d"), ([(1, 3), (2, 4)], b" a "), ([(0, 9)], b" "), ([(2, 2)], b" a b\tc  d")])
def test_without(spans, want):
    assert passages.without(b" a b\tc  d", spans) == want


@pytest.mark.parametrize("size", [1, 2, 3, 7, 1000])
def test_linked_anchors_hold_the_places_of_the_first_document(size):
    rng = random.Random(size)
    rows = sorted({(rng.randrange(30), rng.randrange(5), rng.randrange(9)) for _ in range(150)})
    batches = [
        pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows[at: at + size]]) for i in range(3)], names=["seed", "doc_id", "pos"])
        for at in range(0, len(rows), size)]
    got = [tuple(r.values()) for b in passages._anchors(iter(batches), linked=True) for r in b.to_pylist()]
    docs_of = {s: {d for t, d, _ in rows if t == s} for s, _, _ in rows}
    assert sorted((s, d, p) for s, d, p, _, _ in got) == [r for r in rows if len(docs_of[r[0]]) > 1]
    assert all(o == min(docs_of[s]) and (d != o or p == q) for s, d, p, o, q in got)
    assert sorted(x[1:] for x in got if x[1] != x[3]) == sorted(tuple(r.values()) for b in passages._anchors(iter(batches)) for r in b.to_pylist())


def test_passages_whose_pieces_lie_in_earlier_documents(spark):
    """The first documents of the seeds hold a piece of under 50 words each; another holds the passage."""
    rows = []
    for n in range(60):
        rng = random.Random(n)
        one, two, hidden = words(45, rng), words(45, rng), words(52, rng)
        pieces = [one + words(30, rng), words(30, rng) + two, words(10, rng) + hidden[8:44] + words(20, rng)]
        whole = [words(20, rng) + one + two + words(20, rng), words(7, rng) + one + two + words(9, rng),
                 words(20, rng) + hidden + words(5, rng), words(3, rng) + hidden + words(30, rng)]
        rows += [(100 * n + i, " ".join(b)) for i, b in enumerate(pieces + whole)]
    docs = documents(spark, rows)
    found = passages.repeated_passages(docs).collect()
    by_id = {i: hashes(t.split()) for i, t in rows}
    for r in found:
        assert r["source_id"] < r["doc_id"] and r["end"] - r["start"] >= 50 and r["identity"] >= 0.8
    for n in range(60):
        for doc, source, start, size in ((4, 3, 7, 90), (6, 5, 3, 52)):
            assert any(r["doc_id"] == 100 * n + doc and r["source_id"] == 100 * n + source and r["start"] <= start and r["end"] >= start + size
                       for r in found), (n, doc)
    assert len({tuple(r)[:6] for r in found}) == len(found)
