"""Landing documents: one JSON document for each topic and fetch time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.functions.text import clean, source_name
from newsloom.schemas import LANDING

# Fixed formats: file names and their time stamp.
FILE_GLOB = "news_*.json"
FILE_NAME = r"^news_(.*)_(\d{4}-\d{2}-\d{2}_\d{2}-\d{2}-\d{2})\.json$"
FILE_STAMP = "yyyy-MM-dd_HH-mm-ss"


@dataclass(frozen=True)
class Landing:
    """Articles in file order, and the documents that could not be read."""

    articles: DataFrame
    rejects: DataFrame


def with_file_facts(documents: DataFrame) -> DataFrame:
    """Add `path`, `topic` and `fetch_ts` from the file name; without a stamp the file time counts."""
    # The path is percent-encoded; a plus sign stands for itself in it.
    name = F.url_decode(F.replace(F.element_at(F.split(F.col("path"), "/"), -1), F.lit("+"), F.lit("%2B")))
    stamp = F.try_to_timestamp(F.regexp_extract(name, FILE_NAME, 2), F.lit(FILE_STAMP))
    return documents.withColumn(
        "topic", F.replace(F.regexp_extract(name, FILE_NAME, 1), F.lit("_"), F.lit(" "))
    ).withColumn("fetch_ts", F.coalesce(stamp, F.col("file_time")))


def json_documents(reader, path: str) -> DataFrame:
    """Documents of a batch or stream reader, broken ones with their text in `_corrupt_record`."""
    read = (
        reader.schema(LANDING).option("multiLine", True).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record").option("pathGlobFilter", FILE_GLOB)
        .json(path)
    )
    return with_file_facts(read.select(
        "*", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("file_time")
    ))


def article_columns(item: str) -> list[Column]:
    """Flat, cleaned columns of a nested raw article."""
    return [
        clean(F.col(f"{item}.url")).alias("url"),
        clean(F.col(f"{item}.title")).alias("title"),
        clean(F.col(f"{item}.author")).alias("author"),
        source_name(F.col(f"{item}.source")).alias("source"),
        F.col(f"{item}.publishedAt").alias("published_at"),
    ]


def candidate_columns(item: str) -> list[Column]:
    """Columns of a candidate. Title and author stay as they are, so white space alone is a value."""
    return [
        clean(F.col(f"{item}.url")).alias("url"),
        F.col(f"{item}.title").alias("title"),
        F.col(f"{item}.author").alias("author"),
        source_name(F.col(f"{item}.source")).alias("source"),
    ]


def flatten(documents: DataFrame, keep: tuple[str, ...] = ("path", "topic", "fetch_ts")) -> DataFrame:
    """One row for each article with its place in the document; empty or missing lists give none."""
    items = documents.select(*keep, F.posexplode("articles").alias("pos", "article"))
    return items.select(
        *keep, F.col("pos").cast("bigint").alias("pos"), *article_columns("article"), "article"
    )


def read_landing(spark: SparkSession, path: str) -> Landing:
    """Read all landing documents below a folder. A folder without any file is an error."""
    documents = json_documents(spark.read, path)
    broken = F.col("_corrupt_record").isNotNull()
    return Landing(
        articles=flatten(documents.where(~broken)),
        # Spark wants a parsed column next to the text of a broken document.
        rejects=documents.where(broken).select("path", "topic", "fetch_ts", "status", "_corrupt_record"),
    )


def require_articles(articles: DataFrame) -> DataFrame:
    """Fail early when every landing document is empty."""
    if articles.isEmpty():
        raise ValueError("the landing documents hold no article")
    return articles


def envelope(rows: DataFrame, group: tuple[str, ...], page_size: int) -> DataFrame:
    """Landing documents from article rows: pages of at most `page_size` articles.

    `pos` is unique in its group, so a page nests at most `page_size` rows.
    """
    page = F.call_function("div", F.col("pos"), F.lit(page_size))
    raw = F.struct(
        "pos",
        F.struct(
            F.struct(F.lit(None).cast("string").alias("id"), F.col("source_name").alias("name")).alias("source"),
            "author", "title", F.lit(None).cast("string").alias("description"), "url",
            F.lit(None).cast("string").alias("urlToImage"), F.col("published_at").alias("publishedAt"),
            F.lit(None).cast("string").alias("content"),
        ).alias("article"),
    )
    grouped = rows.groupBy(*group, page.alias("page")).agg(F.array_sort(F.collect_list(raw)).alias("items"))
    return grouped.select(
        *group, "page", F.lit("ok").alias("status"), F.size("items").cast("bigint").alias("totalResults"),
        F.transform("items", lambda item: item["article"]).alias("articles"),
    )
