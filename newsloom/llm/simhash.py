"""SimHash near-duplicates: deletion variants of fingerprint segments, equality join, verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.components import LINK, components, forest
from newsloom.llm.frames import list_array, lower_words, texts_of
from newsloom.session import settle

# Members of one variant that are compared in one step; a larger group is cut into blocks of so many.
BLOCK = 2048


def fingerprint(words: list[bytes], width: int, seeds: tuple[int, ...]) -> np.ndarray:
    """One 64-bit fingerprint for each seed: the bits set in over half of the shingle hashes."""
    if not words:
        return np.zeros(len(seeds), dtype=np.uint64)
    if len(words) <= width:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(width)))))
    out = np.empty(len(seeds), dtype=np.uint64)
    for at, seed in enumerate(seeds):
        digest = xxhash.xxh64_intdigest
        h = np.fromiter((digest(s, seed) for s in shingles), dtype="<u8", count=len(shingles))
        ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[at] = np.packbits(ones * 2 > len(shingles), bitorder="little").view("<u8")[0]
    return out


def fingerprints(text: str, width: int = 3, seeds: tuple[int, ...] = (42,)) -> Column:
    """Column of type array<long> with one fingerprint for each seed, of the whole text.

    A text without words, or null, has fingerprint zero. A text of fewer than `width` words has one
    shingle, the whole sequence. Repeated shingles count as often as they occur.
    """
    @F.arrow_udf("array<long>")
    def prints(texts: pa.Array) -> pa.Array:
        return list_array(
            [fingerprint(lower_words(t), width, seeds).view(np.int64) for t in texts_of(texts)], pa.int64()
        )

    return prints(F.col(text))


def segments(bits: int, radius: int, size: int | None = None) -> list[tuple[int, int, int]]:
    """(first bit, width, flips) of each segment.

    Two fingerprints of at most `radius` differing bits agree in at least one segment up to its
    flips (0 or 1), since the flips plus one add up to more than the radius. `size` asks for
    segments of that many bits, each with one flip, where a wider search is wanted.
    """
    if size:
        return [(at, min(size, bits - at), 1) for at in range(0, bits, size)]
    count = radius // 2 + 1
    edges = [bits * i // count for i in range(count + 1)]
    spare = 2 * count - (radius + 1)  # flips that no segment needs
    return [(a, b - a, 0 if i < spare else 1) for i, (a, b) in enumerate(zip(edges, edges[1:]))]


def variants(nodes: DataFrame, parts: list[tuple[int, int, int]]) -> DataFrame:
    """`nodes` (node, prints) with a row for each `key`: each segment whole, or with each of its bits taken out in turn."""
    cuts = [(first, width, wild) for first, width, flips in parts for wild in (range(width) if flips else [-1])]
    kinds = "array<struct<number: int, word: int, first: int, mask: bigint, wild: int>>"
    listed = F.array(*(
        F.struct(*(F.lit(x).alias(n) for n, x in (
            ("number", number), ("word", first // 64), ("first", first % 64), ("mask", (1 << min(width, 63)) - 1 if width < 64 else -1), ("wild", wild))))
        for number, (first, width, wild) in enumerate(cuts))).cast(kinds)
    part = "(shiftrightunsigned(prints[v.word], v.first) & v.mask)"
    rest = f"CASE WHEN v.wild < 0 THEN {part} ELSE shiftleft(shiftrightunsigned({part}, v.wild + 1), v.wild) | ({part} & (shiftleft(1L, v.wild) - 1)) END"
    # A segment of over 48 bits leaves no room for the number of the cut, so both are hashed; links are verified in any case.
    key = f"shiftleft(cast(v.number AS bigint), 48) | ({rest})" if max(w for _, w, _ in parts) <= 48 else f"xxhash64(v.number, {rest})"
    return nodes.withColumn("v", F.explode(listed)).withColumn("key", F.expr(key)).drop("v")


def _near(x: np.ndarray, y: np.ndarray, radius: int) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(axis=-1, dtype=np.int64) <= radius


def _within(node: np.ndarray, prints: np.ndarray, starts: np.ndarray, radius: int) -> list[np.ndarray]:
    """Links inside runs of rows with one key; `starts` has the number of the run of each row."""
    found = []
    same = np.arange(len(node))
    shift = 1
    while True:
        same = same[: np.searchsorted(same, len(node) - shift)]
        same = same[starts[same + shift] == starts[same]]
        if not len(same):
            return found
        near = same[_near(prints[same], prints[same + shift], radius)]
        found.append(np.stack([node[near], node[near + shift]]))
        shift += 1


def _runs(radius: int, words: int, block: int):
    """Task over rows sorted by key: links of small groups, packed blocks of the large ones."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("part", pa.int64()), ("pack", pa.binary())])

        def links(pairs):
            a, b = forest(*np.concatenate(pairs, axis=1)) if pairs else (np.empty(0, np.int64),) * 2
            none = pa.nulls(len(a), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none, none, pa.nulls(len(a), pa.binary())], schema=schema)

        def packed(key, part, rows):
            return pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([key]), pa.array([part], pa.int64()), pa.array([rows.tobytes()], pa.binary())],
                schema=schema,
            )

        rest = np.empty((0, 2 + words), dtype=np.int64)
        part = 0  # blocks of the open group that have gone out
        for rows in _gathered(batches):
            rest = np.concatenate([rest, rows])
            ends = np.flatnonzero(rest[1:, 0] != rest[:-1, 0]) + 1
            done, rest = (rest[: ends[-1]], rest[ends[-1]:]) if len(ends) else (rest[:0], rest)
            if len(done):
                yield from _groups(done, part, radius, block, links, packed)
                part = 0
            while len(rest) >= 2 * block:
                yield packed(rest[0, 0], part, rest[:block, 1:])
                part, rest = part + 1, rest[block:]
        if len(rest):
            yield from _groups(rest, part, radius, block, links, packed)

    return run


def _gathered(batches: Iterator[pa.RecordBatch], rows: int = 1 << 17) -> Iterator[np.ndarray]:
    held, n = [], 0
    for batch in batches:
        held.append(np.stack([c.to_numpy() for c in batch.columns], axis=1))
        n += batch.num_rows
        if n >= rows:
            yield np.concatenate(held)
            held, n = [], 0
    if held:
        yield np.concatenate(held)


def _groups(rows, part, radius, block, links, packed):
    """Whole groups, of which the first may have `part` blocks that have gone out."""
    cuts = np.flatnonzero(rows[1:, 0] != rows[:-1, 0]) + 1
    starts = np.concatenate([[0], cuts])
    sizes = np.diff(np.append(starts, len(rows)))
    large = sizes > block
    if part:
        large[0] = True
    for group in np.flatnonzero(large):
        mine = rows[starts[group]: starts[group] + sizes[group]]
        first = part if group == 0 else 0
        for at in range(0, len(mine), block):
            yield packed(mine[0, 0], first, mine[at: at + block, 1:])
            first += 1
    run = np.repeat(np.arange(len(starts)), sizes)
    small = ~large[run] & (sizes[run] > 1)
    rows, run = rows[small], run[small]
    prints = rows[:, 2:].view(np.uint64)
    pairs = _within(rows[:, 1], prints, run, radius)
    yield links(pairs)


def _tiles(radius: int, words: int):
    """Task over pairs of packed blocks of one group."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1)):
                left, right = (np.frombuffer(p.as_py(), dtype=np.int64).reshape(-1, 1 + words) for p in (x, y))
                found = [np.empty((2, 0), dtype=np.int64)]
                for at in range(0, len(left), 256):
                    some = left[at: at + 256]
                    i, j = np.nonzero(_near(some[:, None, 1:].view(np.uint64), right[None, :, 1:].view(np.uint64), radius))
                    found.append(np.stack([some[i, 0], right[j, 0]]))
                a, b = forest(*np.concatenate(found, axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=LINK)

    return run


def near_links(nodes: DataFrame, parts: list[tuple[int, int, int]], radius: int, words: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) that join the same nodes as all pairs of `nodes` (node, prints) within the radius
    that share a variant.

    Rows of one variant are sorted together and compared as they stream by. A group larger than two
    blocks is never held: it leaves in packed blocks, whose pairs are compared in tasks of their own.
    What a group yields is a spanning forest, so the links do not grow with the square of a group.
    """
    keyed = variants(nodes.select("node", "prints"), parts).select("key", "node", *(F.col("prints")[i].alias(f"p{i}") for i in range(words)))
    schema = "a long, b long, key long, part long, pack binary"
    found = settle(
        keyed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_runs(radius, words, block), schema)
    )
    blocks = found.where("pack is not null").select("key", "part", "pack")
    left, right = blocks.alias("l"), blocks.alias("r")
    tiles = left.join(right, (F.col("l.key") == F.col("r.key")) & (F.col("l.part") <= F.col("r.part")))
    tiled = tiles.select(F.col("l.pack").alias("x"), F.col("r.pack").alias("y")).mapInArrow(_tiles(radius, words), "a long, b long")
    return found.where("pack is null").select("a", "b").unionAll(tiled)


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, seeds: tuple[int, ...] = (42,),
    radius: int = 2, size: int | None = None, block: int = BLOCK,
) -> DataFrame:
    """Rows (doc_id, prints, component_id), one for each row of `docs`.

    Documents link when their fingerprints, of 64 bits for each seed, differ in at most `radius`
    bits; component_id is the smallest doc_id reachable, itself included. Equal fingerprints are
    collapsed before the search, so groups of exact copies cost one row. With `size`, segments have
    that many bits and pairs within the radius that differ by two bits in every segment are missed;
    without it every pair is found. A null doc_id links with nothing and has a null component. Rows
    that share a doc_id are one document. Other columns of `docs` are ignored.
    """
    rows = settle(docs.select(F.col(doc_id).cast("long").alias("doc_id"), fingerprints(text, width, seeds).alias("prints")))
    groups = settle(rows.where("doc_id is not null").groupBy("prints").agg(F.min("doc_id").alias("node")))
    links = near_links(groups, segments(64 * len(seeds), radius, size), radius, len(seeds), block)
    shared = rows.where("doc_id is not null").join(groups, "prints").where("doc_id <> node").select(
        F.col("doc_id").alias("a"), F.col("node").alias("b"))
    return _labelled(rows, groups, links, shared)


def _labelled(rows: DataFrame, groups: DataFrame, links: DataFrame, shared: DataFrame) -> DataFrame:
    repeated = rows.groupBy("doc_id").agg(F.min("prints").alias("x"), F.max("prints").alias("y")).where("x <> y").select("doc_id")
    # A doc_id with several texts joins their groups; other copies hang on their group's node as they are.
    ties = shared.join(repeated.withColumnRenamed("doc_id", "a"), "a", "left_semi")
    labels = components(links.unionAll(ties))
    classes = settle(
        groups.join(labels, "node", "left").select("prints", F.coalesce("component", "node").alias("_class"))
    )
    return rows.join(classes, "prints", "left").select(
        "doc_id", "prints", F.when(F.col("doc_id").isNotNull(), F.col("_class")).alias("component_id")
    )
