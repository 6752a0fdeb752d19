"""Byte-level BPE: long texts are pre-tokenised in overlapping chunks that are stitched where their boundaries meet."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.llm.frames import list_array, shielded, texts_of
from newsloom.session import settle

# Characters of a chunk and of the overlap with the next one. A text of up to two chunks is encoded as it is.
CHUNK, OVERLAP = 1 << 15, 1 << 10
# Characters that the pattern may look at behind the end of a piece, but for runs of one kind.
LOOK = 4
# Bytes of text that are encoded between two batches of results.
GROUP_BYTES = 1 << 20


def read_ranks(path: str) -> bytes:
    """The rank file; it is as large as a vocabulary."""
    with open(path, "rb") as file:
        return file.read()


def ranks_of(lines: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines.splitlines())}


class Coder:
    """Encoding of whole texts and decoding by a table of the bytes of each id."""

    def __init__(self, lines: bytes, pattern: str):
        ranks = ranks_of(lines)
        self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces: list[bytes | None] = [None] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.pieces[rank] = token

    def encode(self, text: bytes) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text.decode("utf-8", "replace")), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


def _rows_for(texts: pa.Array, at: int) -> int:
    sizes = pc.fill_null(pc.binary_length(texts.slice(at, 4096)), 0).to_numpy()
    return max(1, int(np.searchsorted(np.cumsum(sizes, dtype=np.int64), GROUP_BYTES, side="right")))


def _encoded(rows: DataFrame, text: str, lines, pattern: str, decode: bool) -> DataFrame:
    """`rows` with `ids` and, if asked for, `decoded`, of whole texts or of stretches between true boundaries."""
    added = [T.StructField("ids", T.ArrayType(T.IntegerType()))] + [T.StructField("decoded", T.BinaryType())] * decode
    place, names = rows.columns.index(text), [*rows.columns, *(f.name for f in added)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder(lines.value, pattern)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                some = batch.slice(at, _rows_for(batch.column(place), at))
                ids = [coder.encode(t) for t in texts_of(some.column(place))]
                new = [list_array(ids, pa.int32())] + [pa.array(map(coder.decode, ids), pa.binary())] * decode
                yield pa.RecordBatch.from_arrays([*some.columns, *new], names=names)
                at += some.num_rows

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *added]))


def decoded(ids: Column, lines, pattern: str) -> Column:
    """The bytes of the ids, one after the other."""
    @F.arrow_udf("binary")
    def joined(lists: pa.Array) -> pa.Array:
        coder = Coder(lines.value, pattern)
        return pa.array([coder.decode(np.asarray(x.values.to_numpy(zero_copy_only=False))) for x in lists], pa.binary())

    return joined(ids)


# A chunk: its text with the overlap, the characters that are its own, and how many first chunks it is made of.
_CHUNK = "digest string, part int, pieces int, size int, last boolean, text string"


def _cut(chunk: int, overlap: int):
    """Task over (digest, text): overlapping chunks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = raw.as_py()
                for part, at in enumerate(range(0, len(text), chunk)):
                    own = min(chunk, len(text) - at)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([digest]), pa.array([part], pa.int32()), pa.array([1], pa.int32()), pa.array([own], pa.int32()),
                         pa.array([at + chunk >= len(text)]), pa.array([text[at: at + own + overlap]])],
                        names=["digest", "part", "pieces", "size", "last", "text"])

    return run


def boundaries(text: str, size: int, overlap: int, last: bool, pattern: regex.Pattern) -> tuple[list[int], list[int]]:
    """Ends of the pieces of a chunk, where the next character was seen: those in its first `overlap` characters,
    and those behind its own `size` characters, counted from there.

    Only places behind a character that is no white space are listed: a text that is cut there reads
    the same without what follows.
    """
    whole = last or len(text) < size + overlap  # nothing follows the text of the chunk
    limit = len(text) if whole else len(text) - LOOK
    ends = [m.end() for m in pattern.finditer(text)]
    ends = [e for e in ends if e <= limit and not text[e - 1].isspace()]
    return [0, *(e for e in ends if e <= overlap)], [e - size for e in ends if e >= size]


def _scanned(chunks: DataFrame, overlap: int, pattern: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = regex.compile(pattern)
        for batch in batches:
            size, last, texts = (batch.column(n) for n in ("size", "last", "text"))
            for at in range(batch.num_rows):
                head, tail = boundaries(texts[at].as_py(), size[at].as_py(), overlap, last[at].as_py(), pieces)
                yield pa.RecordBatch.from_arrays(
                    [*batch.slice(at, 1).columns, pa.array([head], pa.list_(pa.int32())), pa.array([tail], pa.list_(pa.int32()))],
                    names=[*batch.schema.names, "head", "tail"])

    return settle(chunks.mapInArrow(run, f"{_CHUNK}, head array<int>, tail array<int>"))


def _seams(chunks: DataFrame) -> DataFrame:
    """Rows (digest, part, next, meets) for each chunk but the last of a text: the first place, counted in
    the next chunk, where both have a boundary; null if they do not meet in the overlap."""
    left = chunks.where("NOT last").select("digest", "part", (F.col("part") + F.col("pieces")).alias("next"), "tail")
    right = chunks.where("part > 0").select("digest", F.col("part").alias("next"), "head")
    return settle(left.join(right, ["digest", "next"]).select("digest", "part", "next", F.array_min(F.array_intersect("tail", "head")).alias("meets")))


def _merged(chunks: DataFrame, seams: DataFrame) -> DataFrame:
    """The chunks, where those that do not meet are one."""
    opened = seams.where("meets IS NULL").select("digest", F.col("next").alias("part"), F.lit(True).alias("joins"))
    numbered = chunks.select("digest", "part").join(opened, ["digest", "part"], "left").withColumn(
        "unit", F.max(F.when(F.col("joins").isNull(), F.col("part"))).over(Window.partitionBy("digest").orderBy("part")))
    grouped = chunks.drop("head", "tail").join(numbered.select("digest", "part", "unit"), ["digest", "part"]).groupBy("digest", "unit").agg(
        F.sort_array(F.collect_list(F.struct("part", "pieces", "size", "last", "text"))).alias("c"))
    # A chunk's own characters, and behind those of the last one its overlap.
    inner = F.transform(F.slice("c", F.lit(1), F.size("c") - 1), lambda x: F.substring(x["text"], F.lit(1), x["size"]))
    final = F.element_at("c", -1)
    return grouped.select(
        "digest", F.col("unit").alias("part"), F.expr("aggregate(c, 0, (n, x) -> n + x.pieces)").alias("pieces"),
        F.expr("aggregate(c, 0, (n, x) -> n + x.size)").alias("size"), final["last"].alias("last"),
        F.concat(F.array_join(inner, ""), final["text"]).alias("text"))


def stretches(texts: DataFrame, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Rows (digest, part, text): the texts of `texts` (digest, text) cut at true boundaries of their pieces.

    Chunks with an overlap are dealt over all tasks and pre-tokenised there, each from its own first
    character. What follows a boundary does not depend on what precedes it, so where two neighbours have
    a boundary in common, the later one is right from there on if the earlier one was right there; by
    induction from the first chunk all are. Chunks that have no common boundary in the overlap, as in a
    run of letters, become one and are pre-tokenised anew, until all meet. Equal texts are cut once.
    """
    cut = texts.select("digest", "text").mapInArrow(_cut(chunk, overlap), _CHUNK).dropDuplicates(["digest", "part"])
    chunks = _scanned(cut, overlap, pattern)
    seams = _seams(chunks)
    while not seams.where("meets IS NULL").isEmpty():
        chunks = _scanned(_merged(chunks, seams), overlap, pattern)
        seams = _seams(chunks)
    starts = seams.select("digest", F.col("next").alias("part"), F.col("meets").alias("start"))
    ends = seams.select("digest", "part", F.col("meets").alias("end"))
    edges = starts.join(ends, ["digest", "part"], "full")
    bounded = chunks.join(edges, ["digest", "part"], "left")
    start = F.coalesce("start", F.lit(0))
    stop = F.when(F.col("last"), F.length("text")).otherwise(F.col("size") + F.col("end"))
    return bounded.select("digest", "part", F.substring("text", start + 1, stop - start).alias("text"))


def encode(
    docs: DataFrame, ranks: str, pattern: str, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """`docs` with `ids` (array of int) and `decoded` (binary), as the rank file at the path `ranks` and
    the pattern of pieces give them for the whole text, without special tokens.

    The pattern must give every character to some piece, read nothing before a piece, and stop looking
    `LOOK` characters behind its end, but for runs of one kind; that of the public rank files does.
    A null or empty text has no ids and an empty decoding. Columns named `ids` or `decoded` are replaced.
    Texts of up to two chunks are encoded where they are read. Longer ones are cut into stretches that
    all tasks share; equal ones are encoded once, by a hash of the text.
    """
    lines = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks))
    rows, columns = shielded(docs, ("ids", "decoded"))
    is_long = F.coalesce(F.length(text) > 2 * chunk, F.lit(False))
    short = _encoded(rows.where(~is_long), text, lines, pattern, decode=True).select(*columns, "ids", "decoded")

    long = rows.where(is_long).withColumn("_digest", F.sha2(F.col(text).cast("binary"), 256))
    parts = _encoded(stretches(long.select(F.col("_digest").alias("digest"), F.col(text).alias("text")), pattern, chunk, overlap), "text", lines, pattern, decode=False)
    whole = parts.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("part", "ids"))).alias("p")).select(
        F.col("digest").alias("_digest"), F.flatten(F.col("p.ids")).alias("ids"))
    joined = long.join(whole.withColumn("decoded", decoded(F.col("ids"), lines, pattern)), "_digest")
    return short.unionAll(joined.select(*columns, "ids", "decoded"))
