"""Gates, failure attribution, goal cut, counters and resume."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators import gates, progress
from newsloom.operators.numbering import number_rows
from newsloom.plans.enrichment import enrich, enrich_until
from newsloom.session import scratch_path, settle
from newsloom.sources.articles import article_rows, document_rows, queued_facts, read_table
from newsloom.sources.store import Store, summary_reports
from registry.base import ARTICLES, QUEUED, query
from registry.texts import CATEGORIES, CUT, GATE

GOAL = 20
VALID = "(" + ", ".join(f"'{c}'" for c in CATEGORIES) + ")"


@query(ARTICLES + """ SELECT doc_id, coalesce(nullif(author, ''), 'Unknown') AS author,
  coalesce(nullif(author, ''), 'Unknown') <> 'Unknown' AS passes FROM articles""")
def author_gate(spark, folder):
    return article_rows(spark, folder).select(
        "doc_id", gates.or_default(F.col("author"), "Unknown").alias("author"),
        gates.has_known_author(F.col("author")).alias("passes"),
    )


@query(ARTICLES + f"""
SELECT doc_id, category, 'valid' AS verdict FROM articles a WHERE category IN {VALID}
UNION ALL SELECT doc_id, category, 'rejected' FROM articles a WHERE category NOT IN {VALID}""")
def label_gate(spark, folder):
    categories = spark.createDataFrame([(c,) for c in CATEGORIES], "category string")
    rows = article_rows(spark, folder).select("doc_id", "category")
    valid = gates.keep_labelled(rows, categories, "left_semi").withColumn("verdict", F.lit("valid"))
    rejected = gates.keep_labelled(rows, categories, "left_anti").withColumn("verdict", F.lit("rejected"))
    return valid.unionByName(rejected).select("doc_id", "category", "verdict")


def results(spark: SparkSession, folder: str) -> DataFrame:
    """All articles through the gates; the given summary and category stand for the model answers.

    The index follows `(pos, topic)`.
    """
    facts = number_rows(queued_facts(spark, folder), "index", ["pos", F.asc_nulls_last("topic")])
    indexed = article_rows(spark, folder, facts)
    answer = F.struct(F.col("summary").alias("value"), F.lit(None).cast("string").alias("error"))
    label = F.struct(F.col("category").alias("value"), F.lit(None).cast("string").alias("error"))
    staged = indexed.withColumn("source", F.col("source_name")).withColumn(
        "content_stage", gates.content_outcome(F.col("url"), F.col("content"))
    ).withColumn("summary_stage", gates.summary_outcome(F.col("content_stage.value"), answer)).withColumn(
        "label_stage", gates.label_outcome(F.col("summary_stage.value"), label)
    )
    return gates.attribute(staged, CATEGORIES)


LABELS = ", ".join(CATEGORIES)
SUMMARY = "trim(summary, ' ' || chr(10))"
SHORT = f"""CASE WHEN length({SUMMARY}) < 50
    THEN 'ValueError: Summary suspiciously short (' || length({SUMMARY}) || ' chars) — possible API issue' END"""

RESULTS = QUEUED + f""", gated AS (
  SELECT *, row_number() OVER (ORDER BY pos, topic) - 1 AS idx, coalesce(author, 'Unknown') <> 'Unknown' AS known,
    {GATE} AS content_error, {CUT} AS kept, {SHORT} AS short FROM queued
), staged AS (
  SELECT *, known AND content_error IS NULL AS scraped,
    CASE WHEN length(kept) < 100 THEN 'Input text too short to summarise (' || length(kept) || ' chars)' ELSE short END AS sum_error
  FROM gated
), results AS (
  SELECT idx, url, coalesce(nullif(title, ''), 'Unknown') AS title, source_name AS source, coalesce(author, 'Unknown') AS author,
    scraped AND sum_error IS NULL AND category IN {VALID} AS success,
    CASE WHEN scraped AND sum_error IS NULL AND category IN {VALID} THEN category END AS category,
    CASE WHEN scraped THEN kept END AS content,
    CASE WHEN scraped AND sum_error IS NULL THEN {SUMMARY} END AS summary,
    CASE WHEN NOT known THEN 'No author' ELSE content_error END AS scrape_error,
    CASE WHEN scraped THEN sum_error END AS summary_error,
    CASE WHEN scraped AND sum_error IS NULL AND category NOT IN {VALID}
      THEN 'Classified as ''' || category || ''' — not a valid category (must be one of: {LABELS})' END AS classify_error,
    processed_at
  FROM staged
), goal AS (
  SELECT CASE WHEN count(*) >= {GOAL} THEN max(idx) END AS last
  FROM (SELECT idx FROM results WHERE success ORDER BY idx LIMIT {GOAL})
), cut AS (
  SELECT r.* FROM results r, goal WHERE r.idx <= coalesce(goal.last, 9223372036854775807)
)"""


@query(RESULTS + ' SELECT idx AS "index", * EXCLUDE (idx) FROM results')
def failure_attribution(spark, folder):
    return results(spark, folder)


@query(RESULTS + ' SELECT idx AS "index", url, title, success, category, scrape_error, summary_error, classify_error FROM cut')
def success_goal_cut(spark, folder):
    cut = progress.cut_at_goal(settle(results(spark, folder).drop("content", "summary")), GOAL)
    return cut.select(
        "index", "url", "title", "success", "category", "scrape_error", "summary_error", "classify_error"
    )


@query(RESULTS + f""" SELECT count(*) AS total_processed, count_if(success)::BIGINT AS total_successful,
  {GOAL}::BIGINT AS success_goal, count_if(success) >= {GOAL} AS goal_reached FROM cut""")
def run_counters(spark, folder):
    narrow = settle(results(spark, folder).select("index", "success"))
    return progress.run_counters(progress.cut_at_goal(narrow, GOAL), GOAL)


REPORTS = RESULTS + """, hits AS (SELECT *, row_number() OVER (ORDER BY idx) AS n FROM cut WHERE success)
SELECT printf('summary_%02d.txt', n) AS file_name,
  title || chr(10) || repeat('=', 60) || chr(10) || chr(10) || summary || chr(10) || chr(10) || repeat('=', 60) || chr(10)
  || 'Author:   ' || author || chr(10) || 'Source:   ' || source || chr(10) || 'URL:      ' || url || chr(10)
  || 'Category: ' || category AS body FROM hits"""


@query(REPORTS)
def summary_report_files(spark, folder):
    cut = progress.cut_at_goal(settle(results(spark, folder).drop("content")), GOAL)
    return summary_reports(progress.numbered_successes(cut))


@query(REPORTS.replace("AS body", "|| chr(10) AS body"))
def summary_reports_packed(spark, folder):
    """The reports of a run written and read back."""
    store = Store(spark, scratch_path(spark, "reports"))
    cut = progress.cut_at_goal(settle(results(spark, folder).drop("content")), GOAL)
    store.write_summaries(progress.numbered_successes(cut))
    return store.read_summaries().select(F.col("path").alias("file_name"), "body")


def whole_body():
    """Summary stand-in: the article part of the prompt; some articles get no answer."""
    def run(texts):
        bodies = [text.split("Article:\n", 1)[1][:-1] for text in texts]
        return [ValueError("no answer") if len(body) % 7 == 0 else body for body in bodies]

    return run


def label_by_length():
    """Label stand-in: a category by the length of the summary part of the prompt."""
    def run(texts):
        return [f" cat{len(text.split('Summary:' + chr(10), 1)[1]) % 5}" for text in texts]

    return run


def stage_candidates(spark: SparkSession, folder: str) -> DataFrame:
    return article_rows(spark, folder).select(
        F.col("doc_id").alias("index"), "url", "title", F.col("source_name").alias("source"), "author",
        F.col("content").alias("text"), "processed_at",
    )


STAGED = ARTICLES + f""", gated AS (
  SELECT *, coalesce(author, 'Unknown') <> 'Unknown' AS known, {GATE} AS content_error, {CUT} AS kept FROM articles
), asked AS (
  SELECT *, known AND content_error IS NULL AS scraped,
    CASE WHEN length(kept) < 100 THEN 'Input text too short to summarise (' || length(kept) || ' chars)'
      WHEN length(kept) % 7 = 0 THEN 'ValueError: no answer'
      WHEN length(trim(kept, ' ' || chr(10))) < 50
        THEN 'ValueError: Summary suspiciously short (' || length(trim(kept, ' ' || chr(10))) || ' chars) — possible API issue'
    END AS sum_error, trim(kept, ' ' || chr(10)) AS sum_text
  FROM gated
), labelled AS (
  SELECT *, 'cat' || CAST(length(sum_text) % 5 AS VARCHAR) AS label, scraped AND sum_error IS NULL AS summed FROM asked
), results AS (
  SELECT doc_id AS idx, url, coalesce(nullif(title, ''), 'Unknown') AS title, source_name AS source,
    coalesce(author, 'Unknown') AS author, summed AND label IN {VALID} AS success,
    CASE WHEN summed AND label IN {VALID} THEN label END AS category,
    CASE WHEN scraped THEN kept END AS content, CASE WHEN summed THEN sum_text END AS summary,
    CASE WHEN NOT known THEN 'No author' ELSE content_error END AS scrape_error,
    CASE WHEN scraped THEN sum_error END AS summary_error,
    CASE WHEN summed AND label NOT IN {VALID}
      THEN 'Classified as ' || chr(39) || label || chr(39) || ' — not a valid category (must be one of: {LABELS})' END AS classify_error,
    processed_at
  FROM labelled
), goal AS (
  SELECT CASE WHEN count(*) >= {GOAL} THEN max(idx) END AS last
  FROM (SELECT idx FROM results WHERE success ORDER BY idx LIMIT {GOAL})
)"""


@query(STAGED + ' SELECT idx AS "index", * EXCLUDE (idx) FROM results')
def staged_enrichment(spark, folder):
    return enrich(stage_candidates(spark, folder), whole_body, label_by_length, CATEGORIES)


@query(STAGED + """ SELECT idx AS "index", r.* EXCLUDE (idx) FROM results r, goal
WHERE r.idx <= coalesce(goal.last, 9223372036854775807)""")
def enrichment_until_goal(spark, folder):
    return enrich_until(stage_candidates(spark, folder), whole_body, label_by_length, CATEGORIES, GOAL)


@query(STAGED + """ SELECT idx AS "index", scrape_error, CASE WHEN scrape_error IS NULL THEN
  CASE WHEN length(content) < 100 THEN summary_error ELSE 'Summary stage not available' END END AS summary_error FROM results""")
def unavailable_stage(spark, folder):
    rows = enrich(stage_candidates(spark, folder), None, None, CATEGORIES)
    return rows.select("index", "scrape_error", "summary_error")


@query(ARTICLES + """, latest AS (
  SELECT *, row_number() OVER (PARTITION BY url ORDER BY doc_id DESC) AS r FROM articles
) SELECT url, doc_id, title, category FROM latest WHERE r = 1""")
def latest_result_per_index(spark, folder):
    rows = article_rows(spark, folder).select("url", "doc_id", "title", "category")
    return progress.latest_per_index(rows, "url", "doc_id").select("url", "doc_id", "title", "category")


@query(ARTICLES + " SELECT doc_id, url, title FROM articles WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def resume_remaining(spark, folder):
    done = read_table(spark, folder, "labels").select("doc_id")
    return progress.remaining(document_rows(spark, folder), done, "doc_id").select("doc_id", "url", "title")
