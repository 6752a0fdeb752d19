"""Tables and documents written by the store and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.text import topic_file_name
from newsloom.operators import history, progress
from newsloom.plans.enrichment import enrich, enrich_until
from newsloom.schemas import SITE_FIELDS
from newsloom.session import scratch_path, settle
from newsloom.sources.articles import article_rows, queued_articles, read_table
from newsloom.sources.landing import envelope, flatten
from newsloom.sources.store import Store
from registry.base import QUEUED, SITE, query
from registry.curation import PAGE, SELECTED, greedy_sql, selected
from registry.enrichment import GOAL, RESULTS, STAGED, label_by_length, results, stage_candidates, whole_body
from registry.merge_history import RUNS, run_history
from registry.texts import CATEGORIES


def new_store(spark: SparkSession, label: str) -> Store:
    return Store(spark, scratch_path(spark, label))


@query(QUEUED + f"""
SELECT topic, pos % {PAGE} AS pos, url, trim(coalesce(title, '')) AS title, coalesce(author, '') AS author,
  coalesce(nullif(source_name, ''), 'Unknown') AS source, published_at FROM queued""")
def landing_written_and_read(spark, folder):
    """Landing pages stored by topic and fetch time; a page is one JSON line with up to PAGE articles."""
    pages = envelope(queued_articles(spark, folder), ("topic",), PAGE)
    store = new_store(spark, "landing")
    store.write_landing(pages.withColumn("fetch_ts", F.lit("2024-01-03 12:00:00")).drop("page"))
    flat = flatten(store.read_landing_pages())
    return flat.select("topic", "pos", "url", "title", "author", "source", "published_at")


def stored_master(spark: SparkSession, folder: str) -> Store:
    store = new_store(spark, "master")
    chosen = selected(spark, folder, 5, 50)
    raw = F.struct(
        F.struct(F.lit(None).cast("string").alias("id"), F.col("source").alias("name")).alias("source"),
        "author", "title", F.lit(None).cast("string").alias("description"), "url",
        F.lit(None).cast("string").alias("urlToImage"), F.lit(None).cast("string").alias("publishedAt"),
        F.lit(None).cast("string").alias("content"),
    )
    store.write_master(chosen.select(F.col("index").alias("rank"), raw.alias("article")), "2024-01-03", 5, 50)
    return store


@query(greedy_sql(5, 50, SELECTED).replace(SELECTED, 'SELECT master_index AS "index", url, title, author, source FROM selected'))
def master_written_and_read(spark, folder):
    return stored_master(spark, folder).read_master().select(
        "index", "article.url", "article.title", "article.author", F.col("article.source.name").alias("source")
    )


@query(greedy_sql(5, 50, SELECTED).replace(SELECTED, """SELECT 'ok' AS status, count(*) AS "totalResults",
  '2024-01-03' AS created_at, 5::BIGINT AS source_limit, 50::BIGINT AS candidate_goal, min(url) AS least_url FROM selected"""))
def master_envelope(spark, folder):
    """The exported envelope: its count of candidates and its metadata."""
    envelope_row = stored_master(spark, folder).read_master_envelope()
    return envelope_row.select(
        "status", "totalResults", "metadata.created_at", "metadata.source_limit", "metadata.candidate_goal",
        F.array_min(F.transform("articles", lambda a: a["url"])).alias("least_url"))


@query("""SELECT 0::BIGINT AS results, 0::BIGINT AS blocks, 0::BIGINT AS processed, 0::BIGINT AS candidates, count(*) AS site_rows
FROM documents""")
def cleared_run(spark, folder):
    """A new run empties the tables of the last one; the site stays."""
    store = new_store(spark, "cleared")
    rows = settle(results(spark, folder))
    store.write_results(rows)
    store.write_block(rows, 0)
    store.write_processed(rows, GOAL, "2024-01-03")
    store.append_site(rows.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in SITE_FIELDS], F.col("index").alias("pos")), 1)
    store.clear_run()
    counts = [
        frame.agg(F.count("*").alias(name)) for name, frame in (
            ("results", store.read_results()), ("blocks", store.read_blocks()), ("processed", store.read_processed()),
            ("candidates", store.read_master()), ("site_rows", store.read_site()))
    ]
    return spark.range(1).select(*[c.scalar().alias(c.columns[0]) for c in counts])


@query(RESULTS + """ SELECT idx AS "index", url, title, success, category, content, summary, scrape_error, summary_error,
  classify_error, processed_at FROM results""")
def results_written_and_read(spark, folder):
    """All results of a run, written as two blocks and read back as one table."""
    store = new_store(spark, "results")
    rows = settle(results(spark, folder))
    store.write_block(rows.where("index % 2 = 0"), 0)
    store.write_block(rows.where("index % 2 = 1"), 1)
    store.write_results(store.read_blocks())
    return store.read_results().select(
        "index", "url", "title", "success", "category", "content", "summary", "scrape_error", "summary_error", "classify_error", "processed_at")


@query(STAGED + """ SELECT idx AS "index", r.* EXCLUDE (idx) FROM results r, goal
WHERE r.idx <= coalesce(goal.last, 9223372036854775807)""")
def enrichment_with_store(spark, folder):
    """A run that broke off after its first candidates and is taken up: nothing recorded is asked again."""
    store = new_store(spark, "enrichment")
    candidates = settle(stage_candidates(spark, folder))
    store.write_block(enrich(candidates.where("index < 7"), whole_body, label_by_length, CATEGORIES), 0)
    return enrich_until(candidates, whole_body, label_by_length, CATEGORIES, GOAL, store=store)


@query("""SELECT event_type AS topic,
  'news_' || replace(event_type, ' ', '_') || '_' || strftime(max(ts), '%Y-%m-%d_%H-%M-%S') || '.json' AS file_name
FROM events GROUP BY event_type""")
def topic_file_names(spark, folder):
    fetched = read_table(spark, folder, "events").groupBy(F.col("event_type").alias("topic")).agg(F.max("ts").alias("at"))
    return fetched.select("topic", topic_file_name(F.col("topic"), F.col("at")).alias("file_name"))


@query(RESULTS + """ SELECT idx AS "index", url, title, author, category, processed_at FROM cut WHERE success""")
def processed_written_and_read(spark, folder):
    store = new_store(spark, "processed")
    cut = progress.cut_at_goal(settle(results(spark, folder)), GOAL)
    store.write_results(cut)
    store.write_processed(store.read_results(), GOAL, "2024-01-03")
    return store.read_processed().select("index", "url", "title", "author", "category", "processed_at")


@query(RUNS + " SELECT run_seq, run_at, ord, category, n FROM counts")
def history_written_and_read(spark, folder):
    store = new_store(spark, "history")
    store.append_history(run_history(spark, folder))
    return history.run_counts(store.read_history())


@query(SITE + f" SELECT {', '.join(SITE_FIELDS)} FROM site")
def site_exported(spark, folder):
    """The JSON lines of the site for readers outside Spark."""
    store = new_store(spark, "export")
    rows = article_rows(spark, folder).withColumnRenamed("source_name", "source")
    shaped = rows.select(
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in SITE_FIELDS], F.col("doc_id").alias("pos")
    )
    store.append_site(shaped, 1)
    store.export_site_json(store.read_site())
    schema = ", ".join(f"{c} string" for c in SITE_FIELDS)
    return spark.read.schema(schema).json(store.path("publish/articles"))

