"""Dense row numbers and leading rows without a global or a hot window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.session import settle

# Up to this many leading keys may go through one task.
TOP_ROWS = 100_000
# Up to so many leading rows of a group Spark keeps in each map task (`spark.sql.optimizer.windowGroupLimitThreshold`).
MAP_SIDE_ROWS = 1_000
# The place of a row in its partition, in the low bits of Spark's increasing id.
PLACE_BITS = 33


def number_rows(
    df: DataFrame, name: str, order: Sequence[str | Column], group: Sequence[str] = (), rows: int | None = None
) -> DataFrame:
    """Add the 0-based position of each row in its group, in the given order, which must be unique in it.

    Rows are dealt to ranges of (group, order) whose borders Spark draws from a sample, so ranges hold
    about equally many rows, whatever gaps the order has and however hot a group is. Inside a range the
    sorted rows are counted; a small table with one row for each range and group that meet says how many
    rows of the group lie in earlier ranges. The rows pass through here whole: give the columns that
    identify them, and join the rest. A null in a group column is a group of its own. Where the caller
    knows that there are at most `rows` rows, and these are few, a plain window numbers them.
    """
    if rows is not None and rows <= TOP_ROWS:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("bigint") - 1)
    keys = [*group, *order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    placed = settle(ranged).withColumn("_range", F.shiftright("_id", PLACE_BITS))
    met = placed.groupBy(*group, "_range").agg(F.count("*").alias("_rows"), F.min("_id").alias("_first"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = met.select(
        *(F.col(g).alias(f"_of_{g}") for g in group), F.col("_range").alias("_at"),
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    same = F.col("_range") == F.col("_at")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_of_{g}"))
    # Without groups there is one row for each range: as many as shuffle partitions, whatever the data.
    joined = placed.join(starts if group else F.broadcast(starts), same)
    return joined.select(*df.columns, (F.col("_id") + F.col("_shift")).cast("bigint").alias(name))


def leading_rows(df: DataFrame, n: int, key: str) -> DataFrame:
    """The `n` rows with the smallest integer `key`, which must be unique.

    Only keys are compared; the rows are then filtered by the greatest of the leading keys.
    """
    if n <= TOP_ROWS:
        last = df.select(key).orderBy(key).limit(n)
    else:
        last = number_rows(df.select(key), "_place", [key]).where(F.col("_place") < n)
    return df.where(F.col(key) <= last.agg(F.max(key)).scalar())


def leading_per_group(df: DataFrame, n: int, group: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first `n` rows of each group with their 1-based place.

    The rank filter lets Spark keep only `n` rows of a group in each map task before the
    shuffle, so a hot group does not reach one task as a whole. That holds for `n` up to MAP_SIDE_ROWS;
    beyond, the rows are numbered by ranges, for which the order must be unique in a group.
    """
    if n > MAP_SIDE_ROWS:
        numbered = number_rows(df, "place", order, group).withColumn("place", F.col("place") + 1)
        return numbered.where(F.col("place") <= n)
    place = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return df.withColumn("place", place.cast("bigint")).where(F.col("place") <= n)
