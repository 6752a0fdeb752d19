"""Joins that stay even under hot keys and broadcast only what was measured."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.session import settle

# Rows of one key that a join task may take; a hotter key is spread over several tasks.
KEY_ROWS = 1_000_000

# A side is broadcast only after its size was measured below both limits.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20


@dataclass(frozen=True)
class Size:
    """Measured rows and stored bytes of a table."""

    rows: int = 0
    bytes: int = 0

    def __add__(self, other: Size) -> Size:
        return Size(self.rows + other.rows, self.bytes + other.bytes)

    def fits_broadcast(self) -> bool:
        return self.rows <= BROADCAST_ROWS and self.bytes <= BROADCAST_BYTES


def measure(df: DataFrame) -> Size:
    """Measure a settled table; the bytes are those of its values as text, plus 16 for a row."""
    width = F.lit(16)
    for name, kind in df.dtypes:
        value = F.col(name) if kind == "string" else F.to_json(F.struct(name))
        width = width + F.coalesce(F.octet_length(value), F.lit(0))
    size = df.agg(F.count("*").alias("rows"), F.sum(width.cast("bigint")).alias("bytes")).first()
    return Size(size["rows"], size["bytes"] or 0)


def spread_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str,
    spread: Sequence[str],
    key_rows: int = KEY_ROWS,
) -> DataFrame:
    """Equi-join on a key that is unique in `right` and may be hot or null in `left`.

    A key with more than `key_rows` left rows gets one part for each `key_rows`. Its left rows
    are dealt to the parts by a hash of the `spread` columns and its right row is repeated in
    each part. There are at most (left rows / key_rows) such keys, so the table of hot keys that
    is broadcast stays that small, and no key is dropped. Left rows without a key match nothing
    and are dealt to all tasks.
    """
    hot = (
        left.groupBy(key)
        .agg(F.count("*").alias("_n"))
        .where(F.col("_n") > key_rows)
        .select(F.col(key).alias("_hot"), F.ceil(F.col("_n") / key_rows).cast("int").alias("_parts"))
    )
    parts = F.coalesce(F.col("_parts"), F.lit(1))
    own_parts = F.when(F.col(key).isNull(), F.lit(1 << 16)).otherwise(parts)
    dealt = (
        left.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
        .withColumn("_part", F.pmod(F.xxhash64(*spread), own_parts).cast("int"))
        .drop("_hot", "_parts")
    )
    repeated = (
        right.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left")
        .withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
        .drop("_hot", "_parts")
    )
    return dealt.join(repeated, [key, "_part"], how).drop("_part")


def measured_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str,
    spread: Sequence[str],
    key_rows: int = KEY_ROWS,
) -> DataFrame:
    """Join with a summary table that is usually small: broadcast if measured small, else spread.

    `right` is settled first, so measuring it costs no second run of its plan.
    """
    return sized_join(left, settle(right), key, how, spread, key_rows)


def sized_join(
    left: DataFrame,
    right: DataFrame,
    key: str,
    how: str,
    spread: Sequence[str],
    key_rows: int = KEY_ROWS,
    size: Size | None = None,
) -> DataFrame:
    """Join with a settled table whose size may be known already."""
    if (size or measure(right)).fits_broadcast():
        return left.join(F.broadcast(right), key, how)
    return spread_join(left, right, key, how, spread, key_rows)


def hinted(right: DataFrame, size: Size | None = None) -> DataFrame:
    """A settled table, with a broadcast hint if it was measured small.

    For keys that are unique on both sides, where a shuffle is even and needs no spreading.
    """
    return F.broadcast(right) if (size or measure(right)).fits_broadcast() else right


def keep_last(rows: DataFrame, key: str, order: str, key_rows: int = KEY_ROWS) -> DataFrame:
    """Of the rows with one key only the one with the greatest `order`, which is unique per key.

    Two narrow columns are aggregated to find the keys that occur more than once. Only these are
    joined to the rows, so rows with a lone key are not shuffled when there are few repeats.
    """
    repeated = (
        rows.groupBy(key).agg(F.max(order).alias("_last"), F.count("*").alias("_n"))
        .where(F.col("_n") > 1).select(key, "_last")
    )
    joined = measured_join(rows, repeated, key, "left", [order], key_rows)
    return joined.where(F.col("_last").isNull() | (F.col(order) == F.col("_last"))).select(*rows.columns)
