"""Incremental jobs: ingest, event-time windows, de-duplication, merge and running totals.

Each job is given its checkpoint folder, from which a restarted query goes on. A run processes
what has arrived and stops.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsloom.functions.text import url_key
from newsloom.functions.times import is_recent
from newsloom.plans.batch import new_site_rows
from newsloom.session import delete_path, settle
from newsloom.sources.landing import flatten, json_documents
from newsloom.sources.store import Store

# Run cadence and the lateness that the fetch window allows.
CADENCE = "12 hours"
LATENESS = "25 hours"


def landing_stream(spark: SparkSession, path: str) -> DataFrame:
    """Flat articles of the landing documents as they arrive. Broken documents give no rows."""
    documents = json_documents(spark.readStream, path)
    return flatten(documents.where(F.col("_corrupt_record").isNull()))


def window_counts(rows: DataFrame, time: str, by: Sequence[str] = ()) -> DataFrame:
    """Rows in tumbling windows of the run cadence, with late rows up to the fetch lateness.

    To be written with `append_rows`: a window is written once, when the newest row is LATENESS
    past its end; its state goes, and rows that come later than that are dropped.
    """
    return (
        rows.withWatermark(time, LATENESS).groupBy(F.window(time, CADENCE).alias("span"), *by)
        .agg(F.count("*").alias("n"))
    )


def first_urls(rows: DataFrame, time: str) -> DataFrame:
    """Drop rows whose URL key was seen inside the watermark.

    The state is bounded by the lateness, so a URL that returns later passes; `merge_into` holds
    the rule for all time.
    """
    keyed = rows.withColumn("url_key", url_key(F.col("url"))).withWatermark(time, LATENESS)
    return keyed.dropDuplicatesWithinWatermark(["url_key"])


def category_totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("category").agg(F.count("*").alias("n"))


def recent_view(store: Store, as_of: str) -> DataFrame:
    """The rolling news set over the site table."""
    return store.read_site().where(is_recent(F.col("processed_at"), as_of))


def _start(rows: DataFrame, checkpoint: str, mode: str, handle: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return (
        rows.writeStream.foreachBatch(handle).outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def merge_into(store: Store, rows: DataFrame, checkpoint: str) -> StreamingQuery:
    """Merge each micro-batch of site-shaped rows with unique `pos` into the site table.

    A micro-batch claims a run number of its own, after those of all earlier runs and writers. A
    repeated batch finds its number and replaces its own rows, so a restart after a crash adds
    nothing twice. The checkpoint names the writer, so jobs with other checkpoints may share a site.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        run_seq = store.claim_run(checkpoint, batch_id)
        # The files are read twice, for the keys and for the rows that are new; only keys are kept in between.
        store.append_site(new_site_rows(store, batch, run_seq), run_seq, checkpoint)

    return _start(rows, checkpoint, "append", merge)


def append_rows(store: Store, name: str, rows: DataFrame, checkpoint: str) -> StreamingQuery:
    """Append finished rows to a table; the folder of a repeated batch is replaced."""
    def append(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(store.path(f"{name}/batch={batch_id}"))

    return _start(rows, checkpoint, "append", append)


def replace_totals(store: Store, name: str, totals: DataFrame, checkpoint: str, keys: Sequence[str] = ("category",)) -> StreamingQuery:
    """Keep a table of the newest totals, which `newest` reads.

    A micro-batch brings the totals that changed; they replace those of the last version with the same
    keys, and the result is a version of its own. A repeated micro-batch starts from the version before
    it, too. Once a version is complete all but the one before it go, which readers may still have open.
    """
    def upsert(batch: DataFrame, batch_id: int) -> None:
        changed = settle(batch)
        done = [v for v in versions(store, name) if v < batch_id]
        rows = changed
        if done:
            last, new = _version(store, name, done[-1]).alias("last"), changed.select(*keys).alias("new")
            same = reduce(and_, [F.col(f"last.{k}").eqNullSafe(F.col(f"new.{k}")) for k in keys])
            rows = last.join(new, same, "left_anti").unionByName(changed)
        rows.write.mode("overwrite").parquet(store.path(f"{name}/version={batch_id}"))
        for old in done[:-1]:
            delete_path(store.spark, store.path(f"{name}/version={old}"))

    return _start(totals, checkpoint, "update", upsert)


def versions(store: Store, name: str) -> list[int]:
    """The complete versions of a table of totals, oldest first."""
    spark = store.spark
    place = spark._jvm.org.apache.hadoop.fs.Path(store.path(name))
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        return []
    found = [status.getPath() for status in files.listStatus(place)]
    done = [p for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().removeprefix("version=")) for p in done)


def _version(store: Store, name: str, version: int) -> DataFrame:
    return store.spark.read.parquet(store.path(f"{name}/version={version}"))


def newest(store: Store, name: str) -> DataFrame:
    """The newest complete version of the totals that `replace_totals` keeps."""
    return _version(store, name, versions(store, name)[-1])
