"""Near-duplicate vectors by iterative quantisation, multi-index Hamming tables and reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.components import components, forest
from newsloom.llm.frames import list_array, sampled
from newsloom.session import settle

# Bits of one table's part of a code, and of one rotation at most.
WIDTH = 16
BITS = 64
# Tables at most, and those of vectors of a length that the sample lacks.
MOST_TABLES, DRAWN_TABLES = 64, 24
# Share of the pairs at the least cosine itself that the tables are to find, and pairs that are drawn to measure it.
RECALL, TRIALS = 0.97, 2000
# Largest group of one table entry whose pairs are listed; larger ones are compared in blocks.
LISTED = 64
BLOCK = 512


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest component first, so squares neither vanish nor overflow."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]


def rotation(rows: np.ndarray, steps: int = 50, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection) for balanced codes: principal directions, then the rotation that brings
    them closest to the corners of a cube, by alternating codes and an orthogonal fit. Each seed starts
    from another rotation and ends in another one."""
    rng = np.random.default_rng(seed)
    mean = rows.mean(axis=0)
    centred = rows - mean
    values, vectors = np.linalg.eigh(centred.T @ centred)
    directions = vectors[:, np.argsort(-values, kind="stable")][:, :BITS]
    reduced = centred @ directions
    turn = np.linalg.qr(rng.standard_normal((reduced.shape[1],) * 2))[0]
    for _ in range(steps):
        codes = np.where(reduced @ turn > 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(codes.T @ reduced)
        turn = (left @ right).T
    return mean, directions @ turn


@dataclass(frozen=True)
class Model:
    """Directions whose signs, taken from the mean, are the bits: WIDTH for each table; and the most bits in
    which the codes of a pair differ."""

    mean: np.ndarray
    projection: np.ndarray
    reach: int

    @property
    def tables(self) -> int:
        return self.projection.shape[1] // WIDTH


def parts(rows: np.ndarray, model: Model) -> np.ndarray:
    """(n, tables) parts of the codes."""
    bits = (unit(rows) - model.mean) @ model.projection > 0
    return np.packbits(bits, axis=1, bitorder="little").view("<u2")


def turned_aside(rows: np.ndarray, least: float, seed: int = 5) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of unit rows whose cosine is `least`: sample rows turned in any direction, in directions in which
    the sample differs, and towards and away from other rows."""
    rng = np.random.default_rng(seed)
    u, other, third = (rows[rng.integers(len(rows), size=TRIALS)] for _ in range(3))
    aside = [rng.standard_normal(u.shape), other - third, other - u, u - other]
    found = []
    for w in aside:
        w = w - np.einsum("ij,ij->i", u, w)[:, None] * u
        length = np.sqrt(np.einsum("ij,ij->i", w, w))
        some = length > 1e-9
        if some.any():
            found.append((u[some], least * u[some] + np.sqrt(1 - least**2) * w[some] / length[some, None]))
    return found


def planned(rows: np.ndarray, least: float, recall: float = RECALL) -> Model:
    """A model with as many tables as the angle of `least` needs in these unit rows.

    Codes are taken from the mean, so what counts is the angle there, which is wider the more direction
    the rows have in common. The pairs of `turned_aside` measure it: rotations are added until the share
    of pairs that have a part with at most one differing bit is `recall`, or there are MOST_TABLES.
    """
    pairs = turned_aside(rows, least)
    mean, projection = rotation(rows)
    while True:
        tables = projection.shape[1] // WIDTH
        model = Model(mean, projection[:, : tables * WIDTH], tables * WIDTH)
        if tables:
            differing = [np.bitwise_count(parts(u, model) ^ parts(v, model)) for u, v in pairs]
            found = np.min([[(d[:, :t].min(axis=1) <= 1).mean() for t in range(1, tables + 1)] for d in differing], axis=0) if differing else np.ones(tables)
            enough = np.flatnonzero(found >= recall)
            if len(enough) or tables >= MOST_TABLES:
                used = int(enough[0]) + 1 if len(enough) else MOST_TABLES
                reach = max([int(np.quantile(d[:, :used].sum(axis=1), 0.999)) for d in differing], default=0) + 2
                return Model(mean, projection[:, : used * WIDTH], reach)
        more = rotation(rows, steps=20, seed=projection.shape[1] + 7)[1]
        projection = np.concatenate([projection, more], axis=1)


def drawn(size: int) -> Model:
    """A model without a sample."""
    bits = DRAWN_TABLES * WIDTH
    turns = [rotation(np.eye(size), steps=0, seed=i)[1] for i in range(-(-bits // min(size, BITS)))]
    return Model(np.zeros(size), np.concatenate(turns, axis=1)[:, :bits], bits)


def learn(vectors: DataFrame, least: float, rows: int = 20_000) -> dict[int, Model]:
    """A model for each length in a sample of about `rows` of the distinct vectors `v`, dealt by a hash of the vector."""
    sample = sorted(sampled(vectors.select("v"), F.xxhash64("v"), rows).toPandas()["v"], key=tuple)
    by_size: dict[int, list] = {}
    for v in sample:
        by_size.setdefault(len(v), []).append(v)
    return {size: planned(unit(np.array(some, dtype=np.float64)), least) for size, some in by_size.items()}


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def words(codes: np.ndarray, count: int) -> np.ndarray:
    """(n, count) longs that hold the parts, four in each, the rest zero."""
    out = np.zeros((len(codes), 4 * count), dtype="<u2")
    out[:, : codes.shape[1]] = codes
    return out.view("<i8")


def _code_column(models: dict[int, Model], count: int) -> Column:
    """Struct (code, keys) of the column `v`: `count` longs, and the table entries of the vector."""
    @F.arrow_udf("code array<long>, keys array<long>")
    def coded(v: pa.Array) -> pa.Array:
        sizes = np.asarray(v.value_lengths())
        code, keys = np.empty((len(v), count), dtype=np.int64), [np.empty(0, dtype=np.int64)] * len(v)
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            mine = parts(_rows(v.take(pa.array(at))), models.get(int(size)) or drawn(int(size)))
            code[at] = words(mine, count)
            for i, row in zip(at, table_keys(mine)):
                keys[i] = row
        return pa.StructArray.from_arrays([list_array(list(code), pa.int64()), list_array(keys, pa.int64())], names=["code", "keys"])

    return coded(F.col("v"))


def table_keys(codes: np.ndarray) -> np.ndarray:
    """Entries of each code: each part with each of its bits taken out in turn."""
    part = codes.astype(np.int64)[:, :, None]
    bit = np.arange(WIDTH, dtype=np.int64)
    rest = part >> (bit + 1) << bit | part & ((1 << bit) - 1)
    place = np.arange(codes.shape[1], dtype=np.int64)[:, None] * WIDTH + bit
    return (place << WIDTH | rest).reshape(len(codes), -1)


def meets_here(x: np.ndarray, key: np.ndarray | int, reach: int) -> np.ndarray:
    """Whether a pair whose codes differ by `x` (..., longs) belongs to this entry: it has at most `reach` bits, and
    the entry is the first table that holds it, at the differing bit or, where the parts agree, at bit 0."""
    counts = np.bitwise_count(np.ascontiguousarray(x).view("<u2"))
    table, bit = np.divmod(np.broadcast_to(np.asarray(key) >> WIDTH, x.shape[:-1]), WIDTH)
    own = np.take_along_axis(x.view("<u2"), table[..., None], axis=-1)[..., 0].astype(np.int64)
    at = np.where(own == 0, bit == 0, own == (1 << bit))
    return (counts.sum(axis=-1, dtype=np.int64) <= reach) & ((counts <= 1).argmax(axis=-1) == table) & at


def _entries(reach: int, listed: int, block: int):
    """Task over (label, key, node, words of the code) sorted by label and key: pairs of small groups, rows of large ones."""
    schema = pa.schema([(n, pa.int64()) for n in ("a", "b", "label", "key", "part", "node")])

    def pairs(found: list[np.ndarray]) -> pa.RecordBatch:
        both = np.concatenate(found, axis=1)
        none = pa.nulls(both.shape[1], pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1]), none, none, none, none], schema=schema)

    def large(group: np.ndarray, before: int) -> pa.RecordBatch:
        none = pa.nulls(len(group), pa.int64())
        part = (before + np.arange(len(group))) // block
        return pa.RecordBatch.from_arrays([none, none, pa.array(group[:, 0]), pa.array(group[:, 1]), pa.array(part), pa.array(group[:, 2])], schema=schema)

    def closed(done: np.ndarray, before: int) -> Iterator[pa.RecordBatch]:
        """Whole groups; `before` rows of the first one have gone out."""
        starts = np.concatenate([[0], np.flatnonzero((done[1:, :2] != done[:-1, :2]).any(axis=1)) + 1])
        sizes = np.diff(np.append(starts, len(done)))
        big = sizes > listed
        big[0] |= before > 0
        for g in np.flatnonzero(big):
            yield large(done[starts[g]: starts[g] + sizes[g]], before if g == 0 else 0)
        group = np.repeat(np.arange(len(starts)), sizes)
        keep = ~big[group] & (sizes[group] > 1)
        done, group = done[keep], group[keep]
        found, same, shift = [np.empty((2, 0), dtype=np.int64)], np.arange(len(done)), 1
        while len(same):
            same = same[: np.searchsorted(same, len(done) - shift)]
            same = same[group[same] == group[same + shift]]
            here = same[meets_here(done[same, 3:] ^ done[same + shift, 3:], done[same, 1], reach)]
            found.append(np.stack([done[here, 2], done[here + shift, 2]]))
            shift += 1
        yield pairs(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, before = None, 0
        for batch in batches:
            rows = np.stack([c.to_numpy() for c in batch.columns], axis=1)
            rest = rows if rest is None else np.concatenate([rest, rows])
            cuts = np.flatnonzero((rest[1:, :2] != rest[:-1, :2]).any(axis=1)) + 1
            if len(cuts):
                yield from closed(rest[: cuts[-1]], before)
                rest, before = rest[cuts[-1]:], 0
            if len(rest) > 8 * block:
                yield large(rest, before)
                before, rest = before + len(rest), rest[:0]
        if rest is not None and len(rest):
            yield from closed(rest, before)

    return run


def _tile(least: float, reach: int):
    """Task over pairs of blocks of one entry: links (a, b), and counts of the links of a node (a, n)."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, same, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                for size in {len(m["v"]) for m in x}:
                    left, right = ([m for m in side if len(m["v"]) == size] for side in (x, y))
                    if not right:
                        continue
                    nodes, code, copies = ([np.array([m[f] for m in side], dtype=np.int64) for side in (left, right)] for f in ("node", "code", "copies"))
                    near = unit(np.array([m["v"] for m in left])) @ unit(np.array([m["v"] for m in right])).T >= least
                    i, j = np.nonzero(near)
                    near[i, j] = meets_here(code[0][i] ^ code[1][j], key, reach)
                    if same:
                        near = np.triu(near, 1)
                    i, j = np.nonzero(near)
                    a, b = forest(nodes[0][i], nodes[1][j])
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], schema=schema)
                    counts = [(nodes[0], near @ copies[1]), (nodes[1], near.T @ copies[0])]
                    for node, n in counts:
                        node, n = node[n > 0], n[n > 0]
                        yield pa.RecordBatch.from_arrays([pa.array(node), pa.nulls(len(node), pa.int64()), pa.array(n)], schema=schema)

    return run


def cosine(a: str, b: str) -> Column:
    """Cosine of two columns of vectors without zero vectors; -1 where their lengths differ."""
    @F.arrow_udf("double")
    def between(x: pa.Array, y: pa.Array) -> pa.Array:
        out = np.full(len(x), -1.0)
        sizes = np.asarray(x.value_lengths()), np.asarray(y.value_lengths())
        for size in np.unique(sizes[0]):
            at = np.flatnonzero((sizes[0] == size) & (sizes[1] == size))
            if len(at):
                out[at] = np.einsum("ij,ij->i", unit(_rows(x.take(pa.array(at)))), unit(_rows(y.take(pa.array(at)))))
        return pa.array(out)

    return between(F.col(a), F.col(b))


def near_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
    least: float = 0.93, sample: int = 20_000, listed: int = LISTED, block: int = BLOCK,
) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of `vectors`.

    Vectors of one label and length link when their cosine in double precision is `least` or more.
    n_links counts the other rows linked directly, component_id is the smallest id reachable, and
    the row of that id is kept. Vectors that are null, zero or hold null or non-finite components,
    and rows with a null label, link with nothing; a row without an id has no component and is not
    kept. Ids should be unique; equal rows are copies of each other. Other columns are ignored.

    Every vector gets a code from rotations learned on about `sample` vectors, as many as find RECALL of
    the pairs at `least` (`planned`). A pair is found when one of its 16-bit parts differs in at most one
    bit; it is then checked on the vectors. Each pair is met in one table entry only, so nothing is
    counted twice. Entries of more than `listed` vectors do not list their pairs: their members are
    compared in blocks, which return counts and a spanning forest.
    """
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & finite & F.exists(embedding, lambda x: x != 0)
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.when(usable, F.col(label).cast("long")).alias("label"),
        F.when(usable, F.transform(embedding, lambda x: x.cast("double"))).alias("v"),
    )
    usable_rows = rows.where("v is not null")
    grouped = usable_rows.groupBy("label", "v").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"))
    distinct = settle(grouped)
    models = learn(distinct, least, sample)
    count = -(-max([m.tables for m in models.values()] + [DRAWN_TABLES] * (not models)) // 4)
    sizes = {r[0] for r in distinct.select(F.size("v")).distinct().collect()} if models else set()
    if sizes - set(models):
        count = max(count, -(-DRAWN_TABLES // 4))
    reach = max([m.reach for m in models.values()] + [DRAWN_TABLES * WIDTH] * bool(sizes - set(models)), default=0)
    nodes = settle(distinct.withColumn("_coded", _code_column(models, count)).select("label", "v", "node", "copies", "_coded.code", "_coded.keys"))
    keyed = nodes.select("label", F.explode("keys").alias("key"), "node", *(F.col("code")[i].alias(f"c{i}") for i in range(count)))
    nodes = nodes.drop("keys")
    met = settle(
        keyed.repartition("label", "key").sortWithinPartitions("label", "key", "node")
        .mapInArrow(_entries(reach, listed, block), "a long, b long, label long, key long, part long, node long")
    )
    left, right = (nodes.select(F.col("node").alias(n), F.col("v").alias(f"v{n}"), F.col("copies").alias(f"n{n}")) for n in "ab")
    pairs = settle(
        met.where("a is not null").select("a", "b").join(left, "a").join(right, "b")
        .where(cosine("va", "vb") >= least).select("a", "b", "na", "nb")
    )
    members = met.where("node is not null").select("label", "key", "part", "node").join(nodes.drop("label"), "node")
    blocks = settle(members.groupBy("label", "key", "part").agg(F.collect_list(F.struct("node", "code", "copies", "v")).alias("pack")))
    x, y = blocks.alias("x"), blocks.alias("y")
    same = (F.col("x.label") == F.col("y.label")) & (F.col("x.key") == F.col("y.key"))
    tiles = settle(
        x.join(y, same & (F.col("x.part") <= F.col("y.part")))
        .select(F.col("x.key").alias("key"), (F.col("x.part") == F.col("y.part")).alias("same"), F.col("x.pack").alias("x"), F.col("y.pack").alias("y"))
        .mapInArrow(_tile(least, reach), "a long, b long, n long")
    )
    counts = (
        pairs.select(F.col("a").alias("node"), F.col("nb").alias("n"))
        .unionAll(pairs.select(F.col("b").alias("node"), F.col("na").alias("n")))
        .unionAll(tiles.where("n is not null").select(F.col("a").alias("node"), "n"))
        .groupBy("node").agg(F.sum("n").alias("n"))
    )
    labels = components(pairs.select("a", "b").unionAll(tiles.where("b is not null").select("a", "b")))
    found = settle(
        nodes.join(counts, "node", "left").join(labels, "node", "left").select(
            F.col("label").alias("_label"), F.col("v").alias("_v"),
            (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("_n"), F.coalesce("component", "node").alias("_class"))
    )
    own = rows.join(found, (F.col("label") == F.col("_label")) & (F.col("v") == F.col("_v")), "left")
    component = F.coalesce("_class", "vec_id")
    return own.select(
        "vec_id", F.coalesce("_n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
