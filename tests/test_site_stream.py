"""The merging query with key state: several sources, restarts, late rows, other writers."""

import random

from pyspark.sql import functions as F

from newsloom.schemas import SITE_FIELDS
from newsloom.sources.store import Store
from newsloom.streaming.site import drain, judged_rows, merge_sources

SCHEMA = ", ".join(f"{f} string" for f in SITE_FIELDS) + ", run string, pos bigint"


def row(run, pos, url, title, **fields):
    return tuple({**dict.fromkeys(SITE_FIELDS, ""), "url": url, "title": title, **fields}.values()) + (run, pos)


class Place:
    def __init__(self, spark, folder):
        self.spark, self.folder, self.n = spark, folder, 0
        self.store = Store(spark, str(folder / "store"))

    def drop(self, source, rows):
        self.n += 1
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(self.folder / f"{source}/drop={self.n:04d}"))

    def merge(self, *sources, limit=None):
        streams = []
        for s in sources:
            reader = self.spark.readStream.schema(SCHEMA)
            reader = reader.option("maxFilesPerTrigger", limit) if limit else reader
            streams.append(reader.parquet(str(self.folder / f"{s}/*")))
        drain(merge_sources(self.store, streams, str(self.folder / "state")))

    def site(self):
        return sorted((r["run_seq"], r["pos"], r["url"], r["title"]) for r in self.store.read_site().collect())


def merged(runs):
    """The rule, run by run: a row is added unless an earlier run's added row has its URL or its title."""
    urls, titles, out = set(), set(), []
    for rows in runs:
        new = [r for r in rows if r["url"].strip().lower() not in urls and (not r["title"].strip() or r["title"].strip().lower() not in titles)]
        out.append(new)
        urls |= {r["url"].strip().lower() for r in new}
        titles |= {r["title"].strip().lower() for r in new if r["title"].strip()}
    return out


def test_two_sources_with_one_new_url_add_it_once(spark, tmp_path):
    place = Place(spark, tmp_path)
    place.drop("a", [row("a1", 0, "u1", "T1"), row("a1", 1, "u2", "T2"), row("a1", 2, "u3", "")])
    place.drop("b", [row("b1", 0, " U1 ", "other"), row("b1", 1, "u4", "t2"), row("b1", 2, "u5", ""), row("b1", 3, "u6", "T6")])
    place.merge("a", "b")
    assert place.site() == [(0, 0, "u1", "T1"), (0, 1, "u2", "T2"), (0, 2, "u3", ""), (1, 2, "u5", ""), (1, 3, "u6", "T6")]
    # A restart without new rows adds nothing; a row that was turned away reserved nothing, so its title is free.
    place.merge("a", "b")
    place.drop("b", [row("b2", 0, "u7", "other"), row("b2", 1, "u6", "new title"), row("b2", 2, "u8", "t1 ")])
    place.merge("a", "b")
    assert place.site()[5:] == [(2, 0, "u7", "other")]


def test_rows_of_another_writer_and_late_rows(spark, tmp_path):
    place = Place(spark, tmp_path)
    shaped = spark.createDataFrame([row("x", 0, "u1", "T1")], SCHEMA).drop("run")
    place.store.append_site(shaped, 4)
    place.drop("a", [row("a1", 0, "u1", "new"), row("a1", 1, "u2", "T2", processed_at="2024-05-01")])
    place.merge("a")
    place.store.append_site(spark.createDataFrame([row("x", 0, "u3", "T3")], SCHEMA).drop("run"), 9)
    place.drop("a", [row("a2", 0, "u3", "x"), row("a2", 1, "u4", "t3"), row("a2", 2, "u2", "late", processed_at="1999-01-01"),
                     row("a2", 3, "u5", "late", processed_at="1999-01-01")])
    place.merge("a")
    assert place.site() == [(4, 0, "u1", "T1"), (5, 1, "u2", "T2"), (9, 0, "u3", "T3"), (10, 3, "u5", "late")]


def test_many_micro_batches_equal_the_rule(spark, tmp_path):
    rng = random.Random(6)
    place, runs = Place(spark, tmp_path), []
    for n in range(5):
        rows = [dict(url=f"u{rng.randrange(60)}", title=rng.choice(["", f"T{rng.randrange(50)}"])) for _ in range(15)]
        runs.append(rows)
        place.drop("a", [row(f"r{n}", i, r["url"], r["title"]) for i, r in enumerate(rows)])
    place.merge("a", limit=1)
    got = {}
    for run_seq, pos, url, title in place.site():
        got.setdefault(run_seq, []).append({"url": url, "title": title})
    want = [new for new in merged(runs) if new]
    assert [got[s] for s in sorted(got)] == want and len(want) > 2


def test_a_repeated_micro_batch_replaces_its_rows(spark, tmp_path):
    place = Place(spark, tmp_path)
    place.drop("a", [row("a1", 0, "u1", "T1")])
    place.merge("a")
    place.drop("a", [row("a2", 0, "u1", "x"), row("a2", 1, "u2", "T2")])
    place.merge("a")
    before = place.site()
    commits = sorted((tmp_path / "state/commits").glob("[0-9]*"), key=lambda f: int(f.name))
    # As if the query had broken off before it committed its last micro-batches.
    for commit in commits[-2:]:
        commit.unlink()
        (commit.parent / f".{commit.name}.crc").unlink(missing_ok=True)
    for log in sorted((tmp_path / "state/offsets").glob("[0-9]*"), key=lambda f: int(f.name))[len(commits) - 1:]:
        log.unlink()
        (log.parent / f".{log.name}.crc").unlink(missing_ok=True)
    place.merge("a")
    assert place.site() == before == [(0, 0, "u1", "T1"), (1, 1, "u2", "T2")]
    assert place.store.read_site().where(F.col("run_seq") > 1).count() == 0


def test_keys_are_judged_without_python_and_without_texts(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    store.start_site()
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "a"))
    plan = judged_rows(store, [spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "a"))])._jdf.queryExecution().analyzed().toString()
    state = [line for line in plan.splitlines() if "Aggregate" in line or "TransformWithState" in line]
    assert len(state) == 1 and "Python" not in plan and "PySpark" not in plan and "summary" not in state[0]
