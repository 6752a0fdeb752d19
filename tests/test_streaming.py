"""Streaming jobs equal their batch results and add nothing on a restart."""

import json

import pytest
from pyspark.sql import functions as F

from newsloom.sources.articles import site_rows
from newsloom.sources.store import Store
from newsloom.streaming import jobs
from registry import QUERIES


def drop(folder, name, articles):
    path = folder / "landing"
    path.mkdir(exist_ok=True)
    (path / name).write_text(json.dumps({"status": "ok", "totalResults": 0, "articles": articles}))


def raw(n, url=None, at="2026-08-21T01:00:00Z"):
    return {"source": {"id": None, "name": "s"}, "author": "a", "title": f"T{n}", "url": url or f"u{n}", "publishedAt": at}


def run(stream):
    stream.awaitTermination()
    assert stream.exception() is None


def test_ingest_goes_on_from_its_checkpoint(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for step, names in enumerate([[1, 2], [3]]):
        drop(tmp_path, f"news_A_2026-08-22_13-36-2{step}.json", [raw(n) for n in names])
        (tmp_path / "landing" / f"news_Bad_2026-08-22_13-36-2{step}.json").write_text('{"articles": [')
        rows = jobs.landing_stream(spark, str(tmp_path / "landing")).select("topic", "pos", "title", "url")
        run(jobs.append_rows(store, "ingested", rows, str(tmp_path / "state")))
    got = spark.read.parquet(store.path("ingested"))
    assert sorted(r["title"] for r in got.collect()) == ["T1", "T2", "T3"]


def test_windows_and_first_urls(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    drop(tmp_path, "news_A_2026-08-22_13-36-20.json", [
        raw(1), raw(2, url=" U1 "), raw(3, at="2026-08-21T12:00:00Z"), raw(4, at="2026-08-21T23:59:59Z"),
    ])
    rows = jobs.landing_stream(spark, str(tmp_path / "landing")).withColumn("time", F.col("published_at").cast("timestamp"))
    counts = jobs.window_counts(rows, "time")
    run(jobs.append_rows(store, "windows", counts, str(tmp_path / "s1")))
    assert spark.read.schema("span struct<start: timestamp, end: timestamp>, n long").parquet(store.path("windows")).count() == 0
    # The newest row closes the windows that end 25 hours before it; one row is too late, one is not.
    drop(tmp_path, "news_B_2026-08-23_13-36-20.json", [raw(5, at="2026-08-23T01:00:00Z")])
    run(jobs.append_rows(store, "windows", counts, str(tmp_path / "s1")))
    drop(tmp_path, "news_C_2026-08-23_14-36-20.json", [raw(6, at="2026-08-21T02:00:00Z"), raw(7, at="2026-08-22T02:00:00Z"), raw(8, at="2026-08-30T00:00:00Z")])
    run(jobs.append_rows(store, "windows", counts, str(tmp_path / "s1")))
    windows = spark.read.parquet(store.path("windows")).orderBy("span.start").collect()
    assert [(str(r["span"]["start"])[:16], r["n"]) for r in windows] == [
        ("2026-08-21 00:00", 2), ("2026-08-21 12:00", 2), ("2026-08-22 00:00", 1), ("2026-08-23 00:00", 1)]
    run(jobs.append_rows(store, "first", jobs.first_urls(rows, "time").select("url_key"), str(tmp_path / "s2")))
    assert sorted(r["url_key"] for r in spark.read.parquet(store.path("first")).collect()) == ["u1", "u3", "u4", "u5", "u6", "u7", "u8"]


def test_merge_is_idempotent_over_restarts(spark, tmp_path, small_dir):
    store = Store(spark, str(tmp_path))
    site = site_rows(spark, small_dir)
    for step in range(3):
        part = site.where(F.col("pos") % 2 == step) if step < 2 else site
        part.write.parquet(str(tmp_path / f"drops/step={step}"))
        stream = spark.readStream.schema(part.schema).parquet(str(tmp_path / "drops/*"))
        run(jobs.merge_into(store, stream, str(tmp_path / "state")))
        # A restart without new files processes nothing.
        stream = spark.readStream.schema(part.schema).parquet(str(tmp_path / "drops/*"))
        run(jobs.merge_into(store, stream, str(tmp_path / "state")))
    rows = store.read_site()
    assert rows.groupBy("run_seq").count().count() == 2
    assert rows.where("run_seq = 2").count() == 0


def test_totals_equal_batch(spark, small_dir):
    got = {r["category"]: r["n"] for r in QUERIES["stream_category_totals"](spark, small_dir).collect()}
    want = {r["category"]: r["count"] for r in site_rows(spark, small_dir).groupBy("category").count().collect()}
    assert got == want


def test_totals_keep_two_versions(spark, tmp_path):
    """Many micro-batches, of which each changes some totals; null is a category, too."""
    store, want = Store(spark, str(tmp_path)), {}
    for step in range(12):
        rows = [(c,) for c in ["a", "b", None, "d"][: 1 + step % 4] * (step + 1)]
        for (c,) in rows:
            want[c] = want.get(c, 0) + 1
        spark.createDataFrame(rows, "category string").coalesce(1).write.parquet(str(tmp_path / f"drops/step={step:02d}"))
        stream = spark.readStream.schema("category string").parquet(str(tmp_path / "drops/*"))
        run(jobs.replace_totals(store, "totals", jobs.category_totals(stream), str(tmp_path / "state")))
        assert {r["category"]: r["n"] for r in jobs.newest(store, "totals").collect()} == want
        assert len(jobs.versions(store, "totals")) <= 2
    # A version that was not finished is not read.
    (tmp_path / "totals/version=99").mkdir()
    assert {r["category"]: r["n"] for r in jobs.newest(store, "totals").collect()} == want


def streamed(spark, store, tmp_path, job, rows):
    """Merge the rows as the next drop of a job."""
    place = tmp_path / job
    rows.write.parquet(str(place / f"drops/step={len(list(place.glob('drops/*')))}"))
    stream = spark.readStream.schema(rows.schema).parquet(str(place / "drops/*"))
    run(jobs.merge_into(store, stream, str(place / "state")))


def test_writers_share_a_site(spark, tmp_path, small_dir):
    store = Store(spark, str(tmp_path / "store"))
    site = site_rows(spark, small_dir).dropDuplicates(["url"]).dropDuplicates(["title"])
    part = [site.where(F.col("pos") % 6 == i) for i in range(6)]
    for i in range(3):
        store.append_site(part[i], i)
    streamed(spark, store, tmp_path, "one", part[3].unionAll(part[0]))
    streamed(spark, store, tmp_path, "two", part[4].unionAll(part[3]))
    streamed(spark, store, tmp_path, "one", part[5].unionAll(part[4]))
    rows = store.read_site()
    assert sorted(r["url"] for r in rows.collect()) == sorted(r["url"] for r in site.collect())
    assert {r["run_seq"] for r in rows.select("run_seq").distinct().collect()} == set(range(6))
    with pytest.raises(ValueError, match="belongs to"):
        store.append_site(part[0], 4)


def test_a_crash_between_write_and_commit(spark, tmp_path, small_dir):
    store = Store(spark, str(tmp_path / "store"))
    site = site_rows(spark, small_dir)
    store.append_site(site.where("pos < 50"), 0)
    batch = site.where("pos >= 50")
    first = store.claim_run("job", 0)
    store.append_site(batch.limit(3), first, "job")
    assert store.claim_run("job", 0) == first == 1
    store.append_site(batch, first, "job")
    assert store.read_site().groupBy("run_seq").count().count() == 2
    assert store.read_site().where("run_seq = 1").count() == batch.count()
    assert store.claim_run("job", 1) == 2 and store.claim_run("other", 0) == 3


def test_merge_keeps_no_texts_in_between(spark, tmp_path, small_dir, monkeypatch):
    """Between the files of a micro-batch and the site only keys are stored."""
    stored = []
    kind = type(spark.range(1))
    checkpoint = kind.checkpoint
    monkeypatch.setattr(kind, "checkpoint", lambda self, eager=True: stored.append(self.columns) or checkpoint(self, eager))
    store = Store(spark, str(tmp_path))
    site = site_rows(spark, small_dir)
    for step in range(2):
        site.where(F.col("pos") % 2 == step).write.parquet(str(tmp_path / f"drops/step={step}"))
        stream = spark.readStream.schema(site.schema).parquet(str(tmp_path / "drops/*"))
        run(jobs.merge_into(store, stream, str(tmp_path / "state")))
    assert stored and not any("summary" in columns for columns in stored)
