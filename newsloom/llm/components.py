"""Connected components of a link table by contraction, without a driver-side or one-task union."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.session import settle

LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its tree) that join the same nodes as the links given."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = flat[: len(a)], flat[len(a):]
    parent = np.arange(len(nodes))
    while True:
        low = np.minimum(parent[left], parent[right])
        before = parent.copy()
        np.minimum.at(parent, parent[left], low)
        np.minimum.at(parent, parent[right], low)
        while not np.array_equal(parent, parent[parent]):
            parent = parent[parent]
        if np.array_equal(parent, before):
            break
    moved = parent != np.arange(len(nodes))
    return nodes[moved], nodes[parent[moved]]


def thinned(batches: Iterator[pa.RecordBatch], limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """A spanning forest of every `limit` links of a task, so a dense group leaves few links."""
    kept = [np.empty((2, 0), dtype=np.int64)]
    held = 0
    for batch in batches:
        kept.append(np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()]))
        held += batch.num_rows
        if held > limit:
            kept = [np.stack(forest(*np.concatenate(kept, axis=1)))]
            if kept[0].shape[1] > limit // 2:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in kept[0]], schema=LINK)
                kept = [np.empty((2, 0), dtype=np.int64)]
            held = kept[0].shape[1]
    a, b = forest(*np.concatenate(kept, axis=1))
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=LINK)


def components(links: DataFrame) -> DataFrame:
    """Rows (node, component) for every node of `links` (a, b): component is the smallest node reachable.

    Each round gives a node the smallest of itself and its neighbours and contracts the links to
    these labels, so at least half of the nodes that still have links go. The rounds grow with the
    logarithm of the nodes. Minima are combined in the map tasks; the joins bring a unique side, so
    a hot node is split by Spark's skew join. Rounds are cut by a reliable checkpoint. Links with a
    null end and links of a node with itself are left out. Only the number of links left is sent to
    the driver.
    """
    left = settle(_open(links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b")))
    ends = left.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    labels = ends.select("node", F.col("node").alias("component"))
    while not left.isEmpty():
        both = left.select("a", "b").unionAll(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = settle(
            both.groupBy("a").agg(F.min("b").alias("_low"))
            .select(F.col("a").alias("_at"), F.least("a", "_low").alias("_low")).where("_low < _at")
        )
        labels = (
            labels.join(least, F.col("component") == F.col("_at"), "left")
            .select("node", F.coalesce("_low", "component").alias("component"))
        )
        for end in ("a", "b"):
            left = (
                left.join(least, F.col(end) == F.col("_at"), "left")
                .withColumn(end, F.coalesce("_low", end)).select("a", "b")
            )
        left = settle(_open(left.where("a <> b")))
    return labels


def _open(links: DataFrame) -> DataFrame:
    return links.mapInArrow(thinned, "a long, b long").distinct()
