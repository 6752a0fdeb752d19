"""Greedy selection against a sequential model, and the parts it is made of."""

import random

import pytest

from pyspark.sql import functions as F

from newsloom.operators.interleave import dense_index, round_robin
from newsloom.operators.numbering import leading_rows, number_rows
from newsloom.operators.selection import greedy_select, source_distribution

SCHEMA = "rank bigint, url string, title string, author string, source string"


def sequential(rows, source_limit, goal):
    used, per_source, taken = (set(), set(), set()), {}, []
    for rank, *keys, source in sorted(rows):
        if goal is not None and len(taken) >= goal:
            break
        if not keys[0] or any(k and k in seen for k, seen in zip(keys, used)):
            continue
        if source_limit is not None and per_source.get(source, 0) >= source_limit:
            continue
        for k, seen in zip(keys, used):
            seen.add(k)
        per_source[source] = per_source.get(source, 0) + 1
        taken.append(rank)
    return taken


def random_rows(rng, n, spread, gap=1, hot=0.0):
    def key(prefix, empty):
        if rng.random() < empty:
            return ""
        return prefix + ("hot" if rng.random() < hot else str(rng.randrange(spread)))

    return [
        (i * gap, key("u", 0.05), key("t", 0.2), key("a", 0.2), "s" + str(rng.randrange(max(2, spread // 4))))
        for i in range(n)
    ]


@pytest.mark.parametrize("seed,limit,goal,block,hot", [
    (1, None, None, 1 << 22, 0.0),
    (2, 1, None, 16, 0.0),
    (3, 3, 10, 16, 0.4),
    (4, 2, 25, 1 << 22, 0.4),
    (5, None, 12, 8, 0.4),
    (6, 1200, None, 32, 0.3),
])
@pytest.mark.parametrize("scan", [0, 20, 1 << 16])
def test_greedy_equals_sequential(spark, monkeypatch, seed, limit, goal, block, hot, scan):
    """By rounds alone, by rounds whose last rows are scanned, and by scans of whole blocks."""
    monkeypatch.setattr("newsloom.operators.selection.SCAN_ROWS", scan)
    rng = random.Random(seed)
    rows = random_rows(rng, 160, 40, gap=rng.choice([1, 3]), hot=hot)
    got = greedy_select(spark.createDataFrame(rows, SCHEMA), limit, goal, first_block=block)
    assert sorted(r["rank"] for r in got.collect()) == sequential(rows, limit, goal)


def test_greedy_beyond_the_broadcast_limit(spark, monkeypatch):
    monkeypatch.setattr("newsloom.operators.joins.BROADCAST_ROWS", 0)
    monkeypatch.setattr("newsloom.operators.selection.SCAN_ROWS", 10)
    rows = random_rows(random.Random(7), 120, 30, hot=0.5)
    got = greedy_select(spark.createDataFrame(rows, SCHEMA), 2, None, first_block=32, key_rows=5)
    assert sorted(r["rank"] for r in got.collect()) == sequential(rows, 2, None)


@pytest.mark.parametrize("scan", [0, 1 << 16])
def test_dependency_chain_and_turned_away_row(spark, monkeypatch, scan):
    monkeypatch.setattr("newsloom.operators.selection.SCAN_ROWS", scan)
    # Row 1 loses by title and must not reserve its URL, which row 2 takes.
    rows = [(0, "u0", "t0", "", "s"), (1, "u1", "t0", "", "s"), (2, "u1", "t2", "", "s")]
    rows += [(10 + i, f"c{i}", f"x{i // 2}", f"y{(i + 1) // 2}", "z") for i in range(20)]
    got = greedy_select(spark.createDataFrame(rows, SCHEMA))
    assert sorted(r["rank"] for r in got.collect()) == sequential(rows, None, None)


def test_empty_input(spark):
    assert greedy_select(spark.createDataFrame([], SCHEMA), 1, 5).count() == 0


def test_source_distribution_order(spark):
    rows = [(0, "a", "", "", "x"), (1, "b", "", "", "y"), (2, "c", "", "", "y"), (3, "d", "", "", "z")]
    got = source_distribution(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r["source"], r["n_articles"]) for r in got] == [("y", 2), ("x", 1), ("z", 1)]


def test_numbering_in_ranges(spark):
    rng = random.Random(3)
    ids = rng.sample(range(1000), 200)
    rows = [(i, "hot" if i % 3 else rng.choice(["g1", "g2", None])) for i in ids]
    df = spark.createDataFrame(rows, "id bigint, grp string")
    got = {r["id"]: r["at"] for r in number_rows(df, "at", ["id"], ["grp"]).collect()}
    for group in {g for _, g in rows}:
        members = sorted(i for i, g in rows if g == group)
        assert [got[i] for i in members] == list(range(len(members)))
    overall = {r["id"]: r["index"] for r in dense_index(df, "id").collect()}
    assert [overall[i] for i in sorted(ids)] == list(range(len(ids)))
    down = {r["id"]: r["at"] for r in number_rows(df, "at", [F.desc_nulls_last("grp"), F.desc("id")]).collect()}
    assert sorted(ids, key=down.get) == [i for i, _ in sorted(rows, key=lambda r: (r[1] or "", r[0]), reverse=True)]


def test_ranges_are_even_whatever_the_gaps(spark):
    """Ranks of one file of 100,000 articles and 100,000 files of one: after the first round they are sparse."""
    long = spark.range(100_000).select((F.col("id") * 100_001).alias("rank"))
    rows = long.unionAll(spark.range(1, 100_001).select(F.col("id").alias("rank"))).repartition(8)
    numbered = dense_index(rows)
    checked = numbered.agg(F.count("*").alias("n"), F.countDistinct("index").alias("d"), F.min("index").alias("a"), F.max("index").alias("b")).first()
    assert tuple(checked) == (200_000, 200_000, 0, 199_999)
    wrong = numbered.where(F.col("index") != F.when(F.col("rank") <= 100_000, F.col("rank")).otherwise(F.floor(F.col("rank") / 100_001) + 100_000))
    assert wrong.count() == 0
    keys = rows.repartitionByRange("rank").groupBy(F.spark_partition_id().alias("p")).count()
    sizes = sorted(r["count"] for r in keys.collect())
    assert sizes[-1] <= 2 * sizes[len(sizes) // 2]


def test_leading_rows_beyond_task_memory(spark, monkeypatch):
    monkeypatch.setattr("newsloom.operators.numbering.TOP_ROWS", 3)
    df = spark.range(0, 300, 3).withColumnRenamed("id", "rank")
    assert sorted(r["rank"] for r in leading_rows(df, 7, "rank").collect()) == list(range(0, 21, 3))
    assert sorted(r["rank"] for r in leading_rows(df, 2, "rank").collect()) == [0, 3]
    assert leading_rows(df.where("rank < 0"), 2, "rank").count() == 0


def test_round_robin_newest_file_first(spark):
    files = [("old", "2024-01-01 10:00:00"), ("new", "2024-01-02 10:00:00"), ("mid", "2024-01-01 12:00:00")]
    rows = [(path, ts, pos) for path, ts in files for pos in range(3 if path != "new" else 1)]
    df = spark.createDataFrame(rows, "path string, fetch_ts string, pos bigint")
    df = df.withColumn("fetch_ts", df["fetch_ts"].cast("timestamp"))
    ranked = sorted(round_robin(df, df).collect(), key=lambda r: r["rank"])
    assert [(r["path"], r["pos"]) for r in ranked] == [
        ("new", 0), ("mid", 0), ("old", 0), ("mid", 1), ("old", 1), ("mid", 2), ("old", 2),
    ]
