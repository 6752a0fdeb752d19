"""Gates of the enrichment stages and the attribution of each failure to the first gate that fails.

The error texts are fixed formats.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import clean, cut_repeated_block, or_default
from newsloom.schemas import STAGE_OUTCOME

MIN_CONTENT = 1_000
REPEAT_CHUNK = 150
MIN_SUMMARY_INPUT = 100
MIN_SUMMARY = 50

NO_AUTHOR = "No author"
NO_URL = "Article has no URL"
NO_CONTENT = "ValueError: No content returned — possible network issue or bot block"
NO_TEXT = "ValueError: No text extracted — article is likely paywalled or empty"
EMPTY_SUMMARY = "Empty summary passed to classifier"


def outcome(value: Column, *failures: tuple[Column, Column | str]) -> Column:
    """`(ok, value, error)`: the first failure that applies, else the value."""
    error = F.lit(None).cast("string")
    for failed, text in reversed(failures):
        text = text if isinstance(text, Column) else F.lit(text)
        error = F.when(failed, text).otherwise(error)
    return F.struct(
        error.isNull().alias("ok"), F.when(error.isNull(), value).alias("value"), error.alias("error")
    ).cast(STAGE_OUTCOME)


def has_known_author(author: Column) -> Column:
    """A missing author, or one called `Unknown`, fails; white space alone passes."""
    return or_default(author, "Unknown") != "Unknown"


def content_outcome(url: Column, text: Column, min_length: int = MIN_CONTENT, chunk: int = REPEAT_CHUNK) -> Column:
    """Body text gate; a null text stands for a page that could not be had.

    The length is tested before the repeated block is cut.
    """
    return outcome(
        cut_repeated_block(text, chunk),
        (clean(url) == "", NO_URL),
        (text.isNull(), NO_CONTENT),
        (text == "", NO_TEXT),
        (
            F.length(text) < min_length,
            F.format_string(f"ValueError: Content too short (%d chars, minimum is {min_length})", F.length(text)),
        ),
    )


def summary_input_error(content: Column) -> Column:
    """Why a body cannot be summarised, else null."""
    n = F.length(F.coalesce(content, F.lit("")))
    return F.when(n < MIN_SUMMARY_INPUT, F.format_string("Input text too short to summarise (%d chars)", n))


def summary_outcome(content: Column, stage: Column) -> Column:
    """Judge the answer of the summary stage, a `(value, error)` struct."""
    summary = clean(stage["value"])
    n = F.length(summary)
    too_short_input = summary_input_error(content)
    return outcome(
        summary,
        (too_short_input.isNotNull(), too_short_input),
        (stage["error"].isNotNull(), stage["error"]),
        (
            n < MIN_SUMMARY,
            F.format_string("ValueError: Summary suspiciously short (%d chars) — possible API issue", n),
        ),
    )


def label_outcome(summary: Column, stage: Column) -> Column:
    """Judge the answer of the label stage; whether the label is a category is tested later."""
    return outcome(
        clean(stage["value"]),
        (F.coalesce(summary, F.lit("")) == "", EMPTY_SUMMARY),
        (stage["error"].isNotNull(), stage["error"]),
    )


def label_error(label: Column, categories: Sequence[str]) -> Column:
    """Why a label is rejected, else null. Labels compare exactly."""
    listed = ", ".join(categories)
    reason = F.concat(
        F.lit("Classified as '"), label, F.lit(f"' — not a valid category (must be one of: {listed})")
    )
    return F.when(~label.isin(*categories), reason)


def keep_labelled(rows: DataFrame, categories: DataFrame, how: str = "left_semi") -> DataFrame:
    """Rows whose label is (`left_semi`) or is not (`left_anti`) in a category table.

    The category table is configuration. Its size is left to Spark to judge.
    """
    return rows.join(categories.select(F.col("category")).distinct(), "category", how)


def attribute(rows: DataFrame, categories: Sequence[str]) -> DataFrame:
    """Result record of each candidate from its stage outcomes.

    Needs `index, url, title, source, author, processed_at` and the outcome structs
    `content_stage`, `summary_stage`, `label_stage`. Each row is a success or has exactly one
    error; the outputs of the stages before the failure are kept.
    """
    known = has_known_author(F.col("author"))
    body, summed, label = F.col("content_stage"), F.col("summary_stage"), F.col("label_stage")
    scraped = known & body["ok"]
    summarised = scraped & summed["ok"]
    labelled = summarised & label["ok"]
    rejected = label_error(label["value"], categories)
    success = labelled & rejected.isNull()
    return rows.select(
        F.col("index").cast("bigint").alias("index"),
        clean(F.col("url")).alias("url"),
        or_default(F.col("title"), "Unknown").alias("title"),
        or_default(F.col("source"), "Unknown").alias("source"),
        or_default(F.col("author"), "Unknown").alias("author"),
        success.alias("success"),
        F.when(success, label["value"]).alias("category"),
        F.when(scraped, body["value"]).alias("content"),
        F.when(summarised, summed["value"]).alias("summary"),
        F.when(~known, F.lit(NO_AUTHOR)).when(~body["ok"], body["error"]).alias("scrape_error"),
        F.when(scraped & ~summed["ok"], summed["error"]).alias("summary_error"),
        F.when(summarised, F.when(~label["ok"], label["error"]).otherwise(rejected)).alias("classify_error"),
        "processed_at",
    )

