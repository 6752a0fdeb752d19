"""Round-robin order over topic queues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.joins import measure, sized_join
from newsloom.operators.numbering import number_rows
from newsloom.session import settle


def file_order(files: DataFrame, rows: int | None = None) -> DataFrame:
    """Rank landing files newest first, ties by path: `(path, fetch_ts) -> file_rank`. Files without a time come last."""
    return number_rows(files, "file_rank", [F.desc("fetch_ts"), "path"], rows=rows)


def round_robin(articles: DataFrame, files: DataFrame) -> DataFrame:
    """Add `rank`: the i-th article of every file comes before the (i+1)-th of any file.

    `rank = pos * number of files + file_rank` is unique and follows that order with no sort.
    It has gaps where a file is shorter than the longest one; `dense_index` closes them.
    """
    names = files.select("path", "fetch_ts").distinct()
    size = measure(names)
    ranked = file_order(names, size.rows).select("path", "file_rank")
    if not size.fits_broadcast():
        ranked = settle(ranked)
    placed = sized_join(articles, ranked, "path", "inner", ["path", "pos"], size=size)
    return placed.withColumn("rank", F.col("pos") * F.lit(size.rows) + F.col("file_rank"))


def dense_index(df: DataFrame, key: str = "rank", name: str = "index", rows: int | None = None) -> DataFrame:
    """0-based index in the order of a unique integer key."""
    return number_rows(df, name, [key], rows=rows)
