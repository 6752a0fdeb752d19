"""Merge into the site table and the run history."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.times import day_key, instant
from newsloom.operators import history, merging
from newsloom.operators.numbering import number_rows
from newsloom.schemas import SITE_FIELDS
from newsloom.sources.articles import article_rows, site_rows
from registry.base import ARTICLES, SITE, query, sql_day, sql_time, sql_title_key
from registry.texts import CATEGORIES

NEW_PART = (1, 4, 7, 9)


def split_site(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Existing site rows (run 0) and a new batch (run 1), so that repeated URLs are on both sides."""
    site = site_rows(spark, folder)
    is_new = (F.col("pos") % 10).isin(*NEW_PART)
    return site.where(~is_new).withColumn("run_seq", F.lit(0).cast("bigint")), site.where(is_new)


FLAGGED = SITE + f""", keyed AS (
  SELECT *, lower(trim(url)) AS url_key, {sql_title_key('title')} AS title_key, pos % 10 IN {NEW_PART} AS is_new FROM site
), flagged AS (
  SELECT n.*,
    EXISTS (SELECT 1 FROM keyed o WHERE NOT o.is_new AND o.url_key = n.url_key) AS known_url,
    n.title_key <> '' AND EXISTS (SELECT 1 FROM keyed o WHERE NOT o.is_new AND o.title_key = n.title_key) AS known_title
  FROM keyed n WHERE n.is_new
), merged AS (
  SELECT 1::BIGINT AS run_seq, pos, {', '.join(SITE_FIELDS)} FROM flagged WHERE NOT known_url AND NOT known_title
  UNION ALL SELECT 0::BIGINT, pos, {', '.join(SITE_FIELDS)} FROM keyed WHERE NOT is_new
)"""


@query(FLAGGED + """ SELECT row_number() OVER (ORDER BY run_seq DESC, pos) - 1 AS position, * FROM merged""")
def site_merge(spark, folder):
    existing, batch = split_site(spark, folder)
    added = merging.rows_to_add(existing, batch, "pos").withColumn("run_seq", F.lit(1).cast("bigint"))
    # The runs are parts of one site, so `pos` names a row in both.
    merged = merging.list_position(merging.merged_site(existing, added), ["pos"])
    return merged.select("position", "run_seq", "pos", *SITE_FIELDS)


@query(FLAGGED + """ SELECT count_if(NOT known_url AND NOT known_title)::BIGINT AS added, count_if(known_url)::BIGINT AS skipped_by_url,
  count_if(NOT known_url AND known_title)::BIGINT AS skipped_by_title, count(*) AS batch_rows FROM flagged""")
def merge_stats(spark, folder):
    existing, batch = split_site(spark, folder)
    return merging.merge_statistics(merging.flag_known(existing, batch.select("pos", "url", "title"), "pos"))


@query(ARTICLES + """ SELECT coalesce(title, '') AS title, coalesce(summary, '') AS summary, coalesce(author, '') AS author,
  coalesce(source_name, '') AS source, url, category, processed_at, doc_id FROM articles""")
def slim_projection(spark, folder):
    return merging.slim(article_rows(spark, folder).withColumnRenamed("source_name", "source"), "doc_id")


def day_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Successes of the runs: one run for each calendar day of a valid processing time."""
    rows = article_rows(spark, folder).where(instant(F.col("processed_at")).isNotNull())
    day = day_key(F.col("processed_at"))
    seq = F.datediff(F.to_date(day), F.to_date(F.lit("1970-01-01"))).cast("bigint")
    return rows.select(day.alias("run_at"), seq.alias("run_seq"), "category")


def run_history(spark: SparkSession, folder: str) -> DataFrame:
    return history.run_entries(day_runs(spark, folder), CATEGORIES)


RUNS = ARTICLES + f""", names AS (
  SELECT unnest({list(CATEGORIES)}) AS category, unnest(range({len(CATEGORIES)})) AS ord
), successes AS (
  SELECT {sql_day('processed_at')} AS run_at, date_diff('day', DATE '1970-01-01', CAST({sql_time('processed_at')} AS DATE)) AS run_seq, category
  FROM articles WHERE {sql_time('processed_at')} IS NOT NULL
), runs AS (
  SELECT run_at, run_seq, count(*) AS total_successes FROM successes GROUP BY ALL
), counts AS (
  SELECT r.run_seq, r.run_at, r.total_successes, n.ord, n.category,
    (SELECT count(*) FROM successes s WHERE s.run_seq = r.run_seq AND s.category = n.category) AS n
  FROM runs r, names n
)"""


@query(RUNS + " SELECT run_seq, run_at, ord, category, n FROM counts")
def category_counts_run(spark, folder):
    return history.run_counts(run_history(spark, folder))


@query(RUNS + """ SELECT run_at, any_value(total_successes) AS total_successes, string_agg(category, ', ' ORDER BY ord) AS categories,
  string_agg(category || '=' || n, ', ' ORDER BY ord) AS category_counts FROM counts GROUP BY run_at""")
def run_history_entries(spark, folder):
    entries = run_history(spark, folder)
    pairs = F.transform("categories", lambda c: F.concat_ws("=", c, F.col("category_counts")[c].cast("string")))
    return entries.select(
        "run_at", "total_successes", F.array_join("categories", ", ").alias("categories"),
        F.array_join(pairs, ", ").alias("category_counts"),
    )


@query(RUNS + " SELECT category, sum(n)::BIGINT AS n FROM counts GROUP BY category")
def category_counts_cumulative(spark, folder):
    return history.cumulative_counts(run_history(spark, folder)).select("category", "n")


@query(RUNS + " SELECT category, sum(n)::BIGINT AS n FROM counts GROUP BY ROLLUP (category)")
def category_totals(spark, folder):
    return history.category_totals(run_history(spark, folder))


@query(RUNS + """ SELECT category, min(run_seq) AS run_seq, any_value(ord) AS ord FROM counts GROUP BY category""")
def categories_first_seen(spark, folder):
    return history.all_categories(run_history(spark, folder))


@query(RUNS + """, totals AS (SELECT ord, category, sum(n)::BIGINT AS n FROM counts GROUP BY ALL), report AS (
  SELECT -4611686018427387904 AS section, p AS part, 0 AS a, line FROM (VALUES (0, repeat('═', 62)),
    (1, '  CUMULATIVE CATEGORY TOTALS  (all runs)'), (2, repeat('═', 62)), (4, repeat('─', 62)), (6, repeat('═', 62)), (7, '')) v(p, line)
  UNION ALL SELECT -4611686018427387904, 3, ord, printf('  %-32s  %4d', category, n) FROM totals
  UNION ALL SELECT -4611686018427387904, 5, 0, printf('  %-32s  %4d', 'TOTAL (valid categories)', sum(n)::BIGINT) FROM totals
  UNION ALL SELECT -run_seq, 0, 0, 'Run  ' || run_at || '   (' || total_successes || ' successes)' FROM runs
  UNION ALL SELECT -run_seq, 1, 0, repeat('─', 62) FROM runs
  UNION ALL SELECT -run_seq, 2, ord, printf('  %-32s  %4d', category, n) FROM counts
  UNION ALL SELECT -run_seq, 3, 0, '' FROM runs
) SELECT row_number() OVER (ORDER BY section, part, a) - 1 AS line_no, line FROM report""")
def category_report_lines(spark, folder):
    lines = history.report_lines(run_history(spark, folder))
    return number_rows(lines, "line_no", ["section", "ord"]).select("line_no", "line")
