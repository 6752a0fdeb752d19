"""Article rows out of a document table and an event table.

Queries on text alone read `document_rows`, which is a scan. Those that need a topic, an author, a
category or a time read `article_rows`, where derived text columns are projected before the join
and places are numbered on the narrow event side, so the wide document rows are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.operators.numbering import number_rows
from newsloom.schemas import SITE_FIELDS

AS_OF = "2024-01-03 12:00:00"

# Columns of the given tables; a known schema saves the pass over the file footers.
TABLES = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "pages": "page_id bigint, url string, html string",
    "labels": "doc_id bigint, quality int, toxic int",
}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}.parquet")


def event_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Topic, user, category and publication time of each document."""
    return read_table(spark, folder, "events").select(
        F.col("event_id").alias("doc_id"),
        F.col("event_type").alias("topic"),
        F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("user"),
        F.concat(F.lit("cat"), (F.col("user_id") % 5).cast("string")).alias("category"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("published_at"),
    )


def queued_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Event facts of each document with `pos`, its 0-based place in its topic queue. Those without an event are a queue too."""
    ids = read_table(spark, folder, "documents").select("doc_id")
    facts = ids.join(event_facts(spark, folder), "doc_id", "left")
    return number_rows(facts, "pos", ["doc_id"], ["topic"])


def document_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The text side of an article, from its document alone: one scan, without a shuffle.

    The title is the whole first line; the summary lists all further lines.
    """
    lines = F.split("text", "\n", -1)
    title = F.substring_index("text", "\n", 1)
    points = F.transform(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda line: F.concat(F.lit("- "), line))
    repeated = F.when(F.col("doc_id") % 10 == 9, F.col("doc_id") - 1).otherwise(F.col("doc_id"))
    return read_table(spark, folder, "documents").select(
        "doc_id",
        F.concat(F.lit("https://www.example.org/"), repeated.cast("string")).alias("url"),
        title.alias("title"),
        F.col("source").alias("source_name"),
        "lang",
        F.col("text").alias("content"),
        F.concat(
            F.lit("**"), title, F.lit("**\n\n### Key Points\n"), F.array_join(points, "\n"),
            F.lit("\n\n### Why it Matters\n- "), title,
        ).alias("summary"),
    )


def article_rows(spark: SparkSession, folder: str, facts: DataFrame | None = None) -> DataFrame:
    """One article for each document, with the facts of its event where it has one."""
    facts = event_facts(spark, folder) if facts is None else facts
    joined = document_rows(spark, folder).join(facts, "doc_id", "left")
    return joined.withColumns({
        "author": F.when(F.col("doc_id") % 11 != 0, F.col("user")),
        "processed_at": F.when(F.col("doc_id") % 97 == 0, F.lit(""))
        .when(F.col("doc_id") % 89 == 0, F.lit("not a date"))
        .otherwise(F.col("published_at")),
    }).drop("user")


def queued_articles(spark: SparkSession, folder: str) -> DataFrame:
    """Articles with their place `pos` in the topic queue."""
    return article_rows(spark, folder, queued_facts(spark, folder))


def site_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The articles as a site table; the list order `pos` is the document order."""
    articles = article_rows(spark, folder).withColumnRenamed("source_name", "source")
    return articles.select(
        F.col("doc_id").alias("pos"),
        *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in SITE_FIELDS],
    )
