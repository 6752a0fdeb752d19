"""Shared helpers of the subpackage: tables, hold-out folds, byte views of Arrow texts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space of the text contracts: space, and tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold_of(key: str, folds: int) -> Column:
    """CRC-32 of the key as text, modulo `folds`; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % folds


def shielded(docs: DataFrame, replaced: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """`docs` without the columns that are to be replaced and with its other columns under names that no
    operator uses; and the columns that give them back their names. The columns an operator reads keep theirs."""
    kept = [c for c in docs.columns if c not in replaced]
    hidden = {c: f"kept:{c}" for c in kept if c.startswith("_")}
    back = [F.col(f"`{hidden[c]}`").alias(c) if c in hidden else F.col(f"`{c}`") for c in kept]
    return docs.select(*(F.col(f"`{c}`").alias(hidden.get(c, c)) for c in kept)), back


def sampled(rows: DataFrame, key: Column, size: int) -> DataFrame:
    """About `size` rows, the same at every run: those with a small hash of `key`. All rows if there are no more.

    A filter in the map tasks, so that no task gathers candidates of all others.
    """
    n = rows.count()
    if n <= size:
        return rows
    return rows.where(F.pmod(F.xxhash64(key), F.lit(1 << 40)) < F.lit(int(size / n * (1 << 40))))


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 texts of an Arrow string column, null as the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def lower_words(text: bytes) -> list[bytes]:
    """Words between white space, A-Z in lower case. `bytes` methods know ASCII only, as wanted."""
    return text.lower().split()


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """Arrow lists from one numpy array for each row."""
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))
