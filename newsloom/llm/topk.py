"""Exact top-k search: tiled products of queries and shards, partial selection, tree of merges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.session import settle

SHARD_ROWS = 8192
QUERY_ROWS = 4096
TILE_QUERIES = 256
FAN = 32
FOUND = "query_id long, shard int, vec_id long, score long"


def integers(embedding: str, scale: float) -> Column:
    """floor(scale * x) of each component in double precision; null where a component is null or not finite."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(finite, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def _matrix(column) -> np.ndarray:
    rows = column.combine_chunks()
    return rows.flatten().to_numpy().reshape(len(rows), -1)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T of integers: by floating point while every sum is exact there, else by whole numbers, cut to the range of a long."""
    most = [float(np.abs(x.astype(np.float64)).max(initial=0)) for x in (a, b)]
    if most[0] * most[1] * a.shape[1] < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, 1 - 2**63, 2**63 - 1).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> list[np.ndarray]:
    """Places of the k best of each row, by score and then the smaller id. A masked score is the least long."""
    found = []
    k = min(k, scores.shape[1])
    edge = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
    for row, least in zip(scores, edge):
        at = np.flatnonzero((row >= least) & (row > np.iinfo(np.int64).min))
        found.append(at[np.lexsort((ids[at], -row[at]))][:k])
    return found


def _tile(k: int):
    def run(key: tuple, queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = [np.empty((0, 3), dtype=np.int64)]
        if queries.num_rows and rows.num_rows:
            asked, ids = queries.column("_query").to_numpy(), rows.column("_id").to_numpy()
            a, b = _matrix(queries.column("_q")), _matrix(rows.column("_v"))
            for at in range(0, len(asked), TILE_QUERIES):
                some = asked[at: at + TILE_QUERIES]
                scores = product(a[at: at + TILE_QUERIES], b)
                scores[some[:, None] == ids[None, :]] = np.iinfo(np.int64).min
                for q, row, places in zip(some, scores, best(scores, ids, k)):
                    out.append(np.column_stack([np.full(len(places), q), ids[places], row[places]]))
        found = np.concatenate(out)
        return pa.table({
            "query_id": found[:, 0], "shard": np.full(len(found), key[1].as_py(), dtype=np.int32),
            "vec_id": found[:, 1], "score": found[:, 2],
        })

    return run


def top_k(
    vectors: DataFrame, queries: Column, k: int = 10, scale: float = 1024.0, vec_id: str = "vec_id",
    embedding: str = "embedding", shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """Rows (query_id, rank from 1, vec_id, score): the k rows of largest inner product of each query.

    Queries are the rows for which `queries` holds; candidates are all rows with another id and as
    many components. Components become floor(scale * x); ties go to the smaller id. Rows whose id or
    vector is null, or with a component that is null or not finite, take no part. Rows that repeat an
    id are candidates each; as a query an id is taken once. Other columns are ignored.

    Rows are dealt by a hash to shards of about `shard_rows`, queries to groups of about
    `query_rows`. Each pair of a shard and a group is one task, which holds both and works in tiles.
    The lists of a query are merged in a tree, so a merge sees at most FAN lists.
    """
    usable = vectors.withColumn("_v", integers(embedding, scale)).where(F.col(vec_id).isNotNull() & F.col("_v").isNotNull())
    rows = settle(usable.select(F.col(vec_id).cast("long").alias("_id"), "_v", F.size("_v").alias("_dim"), queries.alias("_asked")))
    sizes = rows.agg(F.count("*").alias("n"), F.count_if("_asked").alias("q")).first()
    shards, groups = max(1, -(-sizes["n"] // shard_rows)), max(1, -(-sizes["q"] // query_rows))
    deal = F.xxhash64("_id")
    shard, group = F.pmod(deal, F.lit(shards)).cast("int"), F.pmod(deal, F.lit(groups)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    candidates = rows.select("_dim", shard.alias("_shard"), every(groups).alias("_group"), "_id", "_v")
    asked = rows.where("_asked").dropDuplicates(["_id"]).select("_dim", every(shards).alias("_shard"), group.alias("_group"), F.col("_id").alias("_query"), F.col("_v").alias("_q"))
    keys = ["_dim", "_shard", "_group"]
    found = asked.groupBy(*keys).cogroup(candidates.groupBy(*keys)).applyInArrow(_tile(k), FOUND)
    while shards > 1:
        shards = -(-shards // FAN)
        found = _merged(found.withColumn("shard", (F.col("shard") / FAN).cast("int")), k)
    return _merged(found, k).select("query_id", "rank", "vec_id", "score")


def _merged(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id", "shard").orderBy(F.col("score").desc(), "vec_id")
    return found.select("query_id", "shard", "vec_id", "score").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
