import random

import pytest
from pyspark.sql import functions as F

from newsloom.llm import mixing
from tests.llm.helpers import documents


def level(sizes, weights, total):
    """Targets by resharing the excess until none is above twice its size."""
    target, open_sources = dict.fromkeys(sizes, 0.0), set(sizes)
    while open_sources:
        rest = total - sum(target[s] for s in sizes if s not in open_sources)
        shares = {s: rest * weights[s] / sum(weights[o] for o in open_sources) for s in open_sources}
        over = {s for s in open_sources if shares[s] > 2 * sizes[s]}
        if not over:
            return target | shares
        target |= {s: 2.0 * sizes[s] for s in over}
        open_sources -= over
    return target


def corpus(seed=2):
    rng = random.Random(seed)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), "en", rng.choice(["a", "a", "a", "b", "é", "Z", None, "hot"])) for i in range(400)]
    return rows + [(900, None, "en", "a"), (901, "", None, "only empty"), (902, "x " * 3000, "en", "b")]


def test_targets_and_budgets(spark):
    rows = corpus()
    docs = documents(spark, rows).selectExpr("*", "'x' AS size", "1 AS taken", "2 AS _w")
    found = mixing.mix(docs, spark.createDataFrame([(i, 3.0) for i in range(0, 400, 3)], "doc_id long, weight double")).collect()
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want = level(sizes, weights, 1.5 * sum(sizes.values()))
    taken = dict.fromkeys(sizes, 0)
    assert len(found) == len(rows)
    for r in found:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) < 1 for s in sizes)
    for source in sizes:
        whole = int(want[source] // sizes[source]) if sizes[source] else 0
        own = [r for r in found if r["source"] == source]
        assert all(r["taken"] >= whole * r["size"] for r in own)
        assert sum(whole * r["size"] < r["taken"] < (whole + 1) * r["size"] for r in own) <= 1


def test_keys_follow_the_weights(spark):
    docs = documents(spark, [(i, "one two three four", "en", "a") for i in range(2000)] + [(9000 + i, "w " * 80, "en", "b") for i in range(10)])
    heavy = spark.createDataFrame([(i, 8.0) for i in range(0, 2000, 2)], "doc_id long, weight double")
    taken = mixing.mix(docs, heavy, cycle=(1, 30), share=0.6).where("source = 'a'").groupBy(F.col("doc_id") % 2).agg(F.avg("taken")).collect()
    means = dict(map(tuple, taken))
    assert means[0] > 1.5 * means[1] > 0


def test_repeated_rows_share_and_reruns_agree(spark):
    docs = documents(spark, [(1, "a b c d", "en", "s")] * 5 + [(2, "q " * 50, "en", "t")])
    runs = [sorted(map(tuple, mixing.mix(docs.repartition(n)).select("doc_id", "taken").collect())) for n in (1, 3)]
    assert runs[0] == runs[1]
    assert len({t for d, t in runs[0] if d == 1}) == 1


def test_copies_cut_after_whole_words(spark):
    docs = documents(spark, [(1, "  aa\tbb  cc ", "en", "s"), (2, None, "en", "s")])
    rows = mixing.copies(docs.selectExpr("*", "3L AS size", "CASE doc_id WHEN 1 THEN 5L ELSE 0L END AS taken")).collect()
    assert sorted(r["text"] for r in rows) == ["  aa\tbb  cc ", "aa bb"]


def test_empty_table(spark):
    assert mixing.mix(documents(spark, [])).collect() == []
