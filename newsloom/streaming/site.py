"""One merging query for several sources: URL and title keys of all time are state, so no micro-batch reads the site.

The rows of each source and the rows that the site table gains are streams of one query. Both are taken
apart into keys; the state of a key, an aggregate, is whether a site row has it. A micro-batch gets its rows and
what the state says of their keys, decides, and appends to the site; the next micro-batch reads what was appended, by
this query or by a batch run, before it judges its own rows. A repeated micro-batch has the offsets and the
state it had, finds its run numbers again and replaces its own rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsloom import schemas
from newsloom.operators import merging
from newsloom.session import settle
from newsloom.sources.store import Store

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Runs of one micro-batch.
STEP_RUNS = 1 << 20

_ROW = ("run", "pos", *schemas.SITE_FIELDS)


def _keys(rows: DataFrame, added: bool) -> DataFrame:
    """The URL key and the title key, if there is one, of each row: whether the site gains it, and whose it is."""
    def key(kind: str, value: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.col(value).alias("value"))

    title = F.when(F.col("title_key") != "", key("title", "title_key"))
    keys = F.array_compact(F.array(key("url", "url_key"), title))
    return merging.with_keys(rows).select(F.inline(keys)).withColumn("added", F.lit(added))


def judged_rows(store: Store, sources: Sequence[DataFrame]) -> DataFrame:
    """The rows of the sources as they are, and for each key that a micro-batch touches a row that says whether
    the site has it. Texts pass beside the state, which holds a key and a flag."""
    site = store.spark.readStream.schema(schemas.SITE_TABLE).parquet(store.path("site"))
    asked = [merging.slim(rows, "run", "pos") for rows in sources]
    events = reduce(DataFrame.unionByName, [_keys(rows, False) for rows in asked], _keys(site, True))
    known = events.groupBy("kind", "value").agg(F.max("added").alias("known"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), asked, known)


def new_rows(judged: DataFrame) -> DataFrame:
    """Rows of the micro-batch whose URL and title are unknown to the state."""
    rows, known = judged.where("kind IS NULL"), judged.where("known")
    keyed = merging.with_keys(rows.select("run", "pos", "url", "title"))
    gone = []
    for kind in ("url", "title"):
        keys = known.where(F.col("kind") == kind).select(F.col("value").alias(f"{kind}_key"))
        gone.append(keyed.join(keys, f"{kind}_key").select("run", "pos"))
    return rows.select(*_ROW).join(gone[0].unionByName(gone[1]), ["run", "pos"], "left_anti")


def merge_sources(store: Store, sources: Sequence[DataFrame], checkpoint: str, every: str = "0 seconds") -> StreamingQuery:
    """Start the merge of streams of site-shaped rows with `run` and `pos`, which name a row, into the site.

    Rows of one run are not compared with each other, as in a batch run. Runs that come in one micro-batch
    are taken in the order of their names: each is compared with what the earlier ones added, too, so a URL
    that two sources bring at one time is added once. Each run that adds rows claims a run number of the
    site. The state has no time limit; rows that come late are judged like all others. Use `drain` to
    process what has arrived and stop. A batch run that appends at the same moment is seen by the next
    micro-batch only: writers that may bring the same URLs at one time must be sources of this query.
    """
    spark = store.spark
    store.start_site()

    def append(judged: DataFrame, batch_id: int) -> None:
        fresh = settle(new_rows(settle(judged)))
        earlier = spark.createDataFrame([], schemas.SITE_TABLE)
        names = sorted(r["run"] for r in fresh.select("run").distinct().collect())
        for at, name in enumerate(names):
            mine = fresh.where(F.col("run") == name).select(*schemas.SITE_FIELDS, "pos")
            added = mine if at == 0 else settle(merging.rows_to_add(earlier, mine, "pos"))
            run_seq = store.claim_run(checkpoint, batch_id * STEP_RUNS + at)
            store.append_site(added, run_seq, checkpoint)
            earlier = earlier.unionByName(added.withColumn("run_seq", F.lit(run_seq).cast("bigint")))

    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        return (
            judged_rows(store, sources).writeStream.foreachBatch(append).outputMode("update")
            .option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
        )
    finally:
        spark.conf.set(PROVIDER, before)


def drain(query: StreamingQuery) -> None:
    """Process all that has arrived, then stop."""
    try:
        query.processAllAvailable()
    finally:
        query.stop()
        query.awaitTermination()
