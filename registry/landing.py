"""Landing files under their own names, progress documents and lists that are taken over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.schemas import SITE_FIELDS
from newsloom.session import scratch_path, settle
from newsloom.sources.articles import queued_articles, site_rows
from newsloom.sources.landing import envelope, read_landing
from newsloom.sources.named import write_named
from newsloom.sources.store import Store
from newsloom.streaming import jobs
from registry.base import QUEUED, SITE, query
from registry.curation import PAGE
from registry.enrichment import RESULTS, results

NEWEST = "2024-01-03 12:00:00"
# Documents besides those of the articles: broken, without a list, with a null and an empty one, with unknown keys and a null source.
ODD = (
    ("news_Broken_doc_2024-01-04_00-00-00.json", '{"status": "ok", "articles": [{"url": "https://x'),
    ("news_No_list_2024-01-04_00-00-01.json", '{"status": "error", "message": "over the limit"}'),
    ("news_Null_list_2024-01-04_00-00-02.json", '{"status": "ok", "totalResults": 0, "articles": null}'),
    ("news_Empty_list_2024-01-04_00-00-03.json", '{"status": "ok", "totalResults": 0, "articles": []}'),
    ("news_Odd_keys_2024-01-04_00-00-04.json",
     '{\n "status": "ok", "more": {"a": 1},\n "articles": [{"source": null, "author": " ", "title": " T ", "url": "https://x.org/odd", "rank": 3}]\n}'),
    ("other_2024-01-04_00-00-05.json", '{"status": "ok", "articles": [{"url": "https://x.org/other"}]}'),
)


def landing_store(spark: SparkSession, folder: str, label: str) -> tuple[Store, DataFrame]:
    """A store, and the articles as landing documents of at most PAGE articles: each page of a topic was fetched a second before the last."""
    pages = envelope(queued_articles(spark, folder), ("topic",), PAGE)
    fetched = F.to_timestamp(F.lit(NEWEST)) - F.make_dt_interval(secs=F.col("page").cast("int"))
    return Store(spark, scratch_path(spark, label)), pages.withColumn("fetch_ts", fetched)


def odd_documents(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(ODD), "name string, body string")


COLUMNS = ("topic", "fetched", "pos", "url", "title", "author", "source", "published_at")
FLAT = QUEUED + f""", flat AS (
  SELECT replace(topic, '_', ' ') AS topic, strftime(TIMESTAMP '{NEWEST}' - to_seconds(pos // {PAGE}), '%Y-%m-%d %H:%M:%S') AS fetched,
    pos % {PAGE} AS pos, trim(url) AS url, trim(coalesce(title, '')) AS title, coalesce(author, '') AS author,
    coalesce(nullif(source_name, ''), 'Unknown') AS source, published_at FROM queued
  UNION ALL SELECT 'Odd keys', '2024-01-04 00:00:04', 0, 'https://x.org/odd', 'T', '', 'Unknown', NULL
)"""


def flat_columns(rows: DataFrame) -> DataFrame:
    return rows.withColumn("fetched", F.date_format("fetch_ts", "yyyy-MM-dd HH:mm:ss")).select(*COLUMNS)


@query(FLAT + f" SELECT {', '.join(COLUMNS)} FROM flat")
def landing_files_read(spark, folder):
    """Articles of landing files that were written under their own names, with odd documents among them."""
    store, pages = landing_store(spark, folder, "files")
    store.write_landing_files(pages)
    write_named(odd_documents(spark), store.path("landing_files"))
    return flat_columns(read_landing(spark, store.path("landing_files")).articles)


@query("""SELECT 'Broken doc' AS topic, '2024-01-04 00:00:00' AS fetched, '{"status": "ok", "articles": [{"url": "https://x' AS text,
  (SELECT count(*) FROM documents) AS n_read""")
def landing_files_rejected(spark, folder):
    """Documents that could not be read, with their text; the others lose no article by them."""
    store, pages = landing_store(spark, folder, "rejects")
    store.write_landing_files(pages)
    write_named(odd_documents(spark), store.path("landing_files"))
    read = read_landing(spark, store.path("landing_files"))
    n_read = read.articles.where("topic <> 'Odd keys'").agg(F.count("*")).scalar()
    return settle(read.rejects.withColumn("n_read", n_read)).select(
        "topic", F.date_format("fetch_ts", "yyyy-MM-dd HH:mm:ss").alias("fetched"), F.col("_corrupt_record").alias("text"), "n_read")


@query(FLAT + f" SELECT {', '.join(COLUMNS)} FROM flat")
def stream_landing_ingest(spark, folder):
    """The files come in two drops, each taken in by a restarted query; broken ones give no rows."""
    store, pages = landing_store(spark, folder, "ingest")
    pages = settle(pages)
    for even in (0, 1):
        store.write_landing_files(pages.where(F.col("page") % 2 == even))
        if even:
            write_named(odd_documents(spark), store.path("landing_files"))
        rows = flat_columns(jobs.landing_stream(spark, store.path("landing_files")))
        jobs.append_rows(store, "ingested", rows, store.path("state")).awaitTermination()
    return spark.read.parquet(store.path("ingested")).select(*COLUMNS)


PROGRESS_ROWS = 50
PROGRESS_COLUMNS = ("index", "url", "title", "success", "category", "summary", "scrape_error", "summary_error", "classify_error")


@query(RESULTS + f""" SELECT idx AS "index", {', '.join(PROGRESS_COLUMNS[1:])} FROM results""")
def progress_documents_read(spark, folder):
    """Results kept as progress documents of PROGRESS_ROWS rows, read back beside a broken document."""
    root = scratch_path(spark, "progress")
    rows = results(spark, folder)
    part = F.call_function("div", F.col("index"), F.lit(PROGRESS_ROWS)).alias("part")
    listed = rows.groupBy(part).agg(F.sort_array(F.collect_list(F.struct("index", *[c for c in rows.columns if c != "index"]))).alias("results"))
    body = F.to_json(F.struct(F.size("results").alias("total_processed"), "results"))
    write_named(listed.select(F.format_string("progress_%06d.json", "part").alias("name"), body.alias("body")), root)
    write_named(spark.createDataFrame([("progress_broken.json", '{"results": [{"index": 1')], "name string, body string"), root)
    return Store(spark, root).read_progress(root).select(*PROGRESS_COLUMNS)


LIST_ROWS = 1000


@query(SITE + f""" SELECT 0::BIGINT AS run_seq, row_number() OVER (ORDER BY pos) - 1 AS pos, {', '.join(SITE_FIELDS)}, true AS claimed FROM site""")
def site_list_taken_over(spark, folder):
    """A site list kept as JSON arrays becomes the site's first run, which has its claim."""
    store = Store(spark, scratch_path(spark, "takeover"))
    part = F.call_function("div", F.col("pos"), F.lit(LIST_ROWS)).alias("part")
    listed = site_rows(spark, folder).groupBy(part).agg(F.sort_array(F.collect_list(F.struct("pos", *SITE_FIELDS))).alias("rows"))
    write_named(listed.select(F.format_string("articles_%06d.json", "part").alias("name"), F.to_json("rows").alias("body")), store.path("old"))
    store.take_over(store.path("old"))
    claimed = store.claims().select("run_seq", F.lit(True).alias("claimed"))
    return store.read_site().join(claimed, "run_seq", "left").select("run_seq", "pos", *SITE_FIELDS, "claimed")
