"""Streaming jobs over the articles, staged as files of the tables; each returns its final table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.schemas import SITE_FIELDS
from newsloom.session import scratch_path
from newsloom.sources.articles import AS_OF, article_rows, site_rows
from newsloom.sources.store import Store
from newsloom.streaming import jobs
from newsloom.streaming.site import drain, merge_sources
from registry.base import ARTICLES, NOW, SITE, query, sql_time, sql_title_key
from registry.merge_history import FLAGGED, split_site

STEPS = ("drop=0", "drop=1")


def finish(stream) -> None:
    stream.awaitTermination()


def staged_articles(spark: SparkSession, folder: str, root: str) -> DataFrame:
    """The articles written to files, read back as a stream with their event time."""
    rows = article_rows(spark, folder).select(
        "doc_id", "url", "topic", "category", F.col("published_at").cast("timestamp").alias("time")
    )
    rows.write.parquet(f"{root}/articles")
    return spark.readStream.schema(rows.schema).parquet(f"{root}/articles")


@query(ARTICLES + """, spans AS (
  SELECT time_bucket(INTERVAL 12 HOUR, CAST(published_at AS TIMESTAMP), TIMESTAMP '1970-01-01') AS span, topic,
    max(CAST(published_at AS TIMESTAMP)) OVER () AS newest FROM articles
) SELECT strftime(span, '%Y-%m-%dT%H:%M:%S') AS span_start, topic, count(*) AS n
FROM spans WHERE span + INTERVAL 12 HOUR <= newest - INTERVAL 25 HOUR GROUP BY 1, 2""")
def stream_window_counts(spark, folder):
    """Closed windows. A second drop brings all articles again with times far behind the watermark: they are dropped."""
    root = scratch_path(spark, "windows")
    store = Store(spark, root)
    rows = article_rows(spark, folder).select("topic", F.col("published_at").cast("timestamp").alias("time"))
    for step, back in zip(STEPS, (0, 400)):
        rows.withColumn("time", F.col("time") - F.make_dt_interval(days=F.lit(back))).write.parquet(f"{root}/drops/{step}")
        stream = spark.readStream.schema(rows.schema).parquet(f"{root}/drops/*")
        finish(jobs.append_rows(store, "counts", jobs.window_counts(stream, "time", ["topic"]), f"{root}/state"))
    stored = spark.read.parquet(f"{root}/counts")
    return stored.select(F.date_format("span.start", "yyyy-MM-dd'T'HH:mm:ss").alias("span_start"), "topic", "n")


@query(ARTICLES + " SELECT DISTINCT lower(trim(url)) AS url_key FROM articles")
def stream_first_urls(spark, folder):
    root = scratch_path(spark, "urls")
    first = jobs.first_urls(staged_articles(spark, folder, root), "time")
    finish(jobs.append_rows(Store(spark, root), "first", first, f"{root}/state"))
    return spark.read.parquet(f"{root}/first").select("url_key")


@query(ARTICLES + " SELECT category, count(*) AS n FROM articles GROUP BY category")
def stream_category_totals(spark, folder):
    root = scratch_path(spark, "totals")
    totals = jobs.category_totals(staged_articles(spark, folder, root))
    store = Store(spark, root)
    finish(jobs.replace_totals(store, "totals", totals, f"{root}/state"))
    return jobs.newest(store, "totals")


def merged_by_stream(spark: SparkSession, folder: str) -> Store:
    """Site table after two drops of files, each merged by a restarted query."""
    root = scratch_path(spark, "merge")
    store = Store(spark, root)
    existing, batch = split_site(spark, folder)
    for step, rows in zip(STEPS, (existing.drop("run_seq"), batch)):
        rows.write.parquet(f"{root}/drops/{step}")
        stream = spark.readStream.schema(rows.schema).parquet(f"{root}/drops/*")
        finish(jobs.merge_into(store, stream, f"{root}/state"))
    return store


@query(FLAGGED + f" SELECT run_seq, pos, {', '.join(SITE_FIELDS)} FROM merged")
def stream_site_merge(spark, folder):
    return merged_by_stream(spark, folder).read_site().select("run_seq", "pos", *SITE_FIELDS)


@query(FLAGGED + f" SELECT pos, title, processed_at FROM merged WHERE {sql_time('processed_at')} >= {NOW} - INTERVAL 2 DAY")
def stream_recent_view(spark, folder):
    return jobs.recent_view(merged_by_stream(spark, folder), AS_OF).select("pos", "title", "processed_at")


@query(FLAGGED + f" SELECT run_seq + 7 AS run_seq, pos, {', '.join(SITE_FIELDS)} FROM merged")
def stream_merge_onto_site(spark, folder):
    """A stream that merges onto a site with an earlier run, number 7: its micro-batch gets the next number."""
    root = scratch_path(spark, "onto")
    store = Store(spark, root)
    existing, batch = split_site(spark, folder)
    store.append_site(existing.drop("run_seq"), 7)
    batch.write.parquet(f"{root}/drops/drop=0")
    stream = spark.readStream.schema(batch.schema).parquet(f"{root}/drops/*")
    finish(jobs.merge_into(store, stream, f"{root}/state"))
    return store.read_site().select("run_seq", "pos", *SITE_FIELDS)


CLASH = "lower(trim(o.url)) = lower(trim(n.url)) OR (n.title_key <> '' AND o.title_key = n.title_key)"


@query(SITE + f""", keyed AS (
  SELECT *, {sql_title_key('title')} AS title_key, CASE WHEN pos % 10 IN (1, 4) THEN 1 WHEN pos % 10 IN (7, 9) THEN 2 ELSE 0 END::BIGINT AS run_seq
  FROM site
), early AS (
  SELECT * FROM keyed WHERE run_seq = 0
  UNION ALL SELECT * FROM keyed n WHERE run_seq = 1 AND NOT EXISTS (SELECT 1 FROM keyed o WHERE o.run_seq = 0 AND ({CLASH}))
) SELECT run_seq, pos, {', '.join(SITE_FIELDS)} FROM early
UNION ALL SELECT run_seq, pos, {', '.join(SITE_FIELDS)} FROM keyed n WHERE run_seq = 2 AND NOT EXISTS (SELECT 1 FROM early o WHERE {CLASH})""")
def stream_merge_sources(spark, folder):
    """Two sources of one merging query: the first run stands alone, the next two come in one micro-batch."""
    root = scratch_path(spark, "sources")
    store = Store(spark, root)
    digit = F.col("pos") % 10
    rows = site_rows(spark, folder).withColumn("run", F.when(digit.isin(1, 4), "1").when(digit.isin(7, 9), "2").otherwise("0"))
    for runs in (("0", ""), ("1", "2")):
        streams = []
        for source, run in zip("ab", runs):
            rows.where(F.col("run") == run).write.mode("append").parquet(f"{root}/{source}")
            streams.append(spark.readStream.schema(rows.schema).parquet(f"{root}/{source}"))
        drain(merge_sources(store, streams, f"{root}/state"))
    return store.read_site().select("run_seq", "pos", *SITE_FIELDS)
