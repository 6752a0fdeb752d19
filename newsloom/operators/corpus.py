"""Topic search over an article corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.matching import met_searches
from newsloom.functions.text import search_text
from newsloom.functions.times import in_fetch_window
from newsloom.operators.numbering import leading_per_group

# Page size and language.
PAGE_SIZE = 100
LANGUAGE = "en"


def in_domains(url: Column, domains: str) -> Column:
    """Whether the host is in a comma-separated list; an empty list allows every host."""
    listed = [d.strip() for d in domains.split(",") if d.strip()]
    return F.try_parse_url(url, F.lit("HOST")).isin(*listed) if listed else F.lit(True)


def topic_hits(corpus: DataFrame, topics: Sequence[str], as_of: str, domains: str = "") -> DataFrame:
    """Articles with `topic`, one row for each topic they match, in the language and time window.

    An article matches when every word of the topic occurs in its title, description or content,
    in any case. The topics are a parameter, so one scan lowers each text once and tests it against all
    of them, a few or thousands; there is no join.
    """
    eligible = corpus.where(
        (F.col("lang") == LANGUAGE)
        & in_fetch_window(F.col("published_at"), as_of)
        & in_domains(F.col("url"), domains)
    )
    searched = eligible.withColumn("_text", search_text(F.col("title"), F.col("description"), F.col("content")))
    matched = met_searches(F.col("_text"), [(t, t.lower().split()) for t in topics])
    return searched.withColumn("topic", F.explode(matched)).drop("_text")


def topic_pages(hits: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """Newest articles of each topic, up to the page size, with their 0-based place `pos`."""
    order = [F.desc("published_at"), "url", "doc_id"]
    paged = leading_per_group(hits, page_size, ["topic"], order)
    return paged.withColumn("pos", F.col("place") - 1).drop("place")


def topic_counts(pages: DataFrame, topics: Sequence[str]) -> DataFrame:
    """Articles saved for each requested topic, zero when it has none."""
    found = pages.groupBy("topic").agg(F.count("*").alias("n"))
    asked = pages.sparkSession.createDataFrame([(t,) for t in topics], "topic string")
    return asked.join(found, "topic", "left").select("topic", F.coalesce("n", F.lit(0)).alias("n_articles"))
