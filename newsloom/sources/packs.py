"""Packed documents: many small texts in a bounded number of files, with an index of their places.

    root/packs/<name>.pack      bytes of the documents of a task, one after the other
    root/index/<name>.parquet   (path, version, part, file, offset, length) of each stretch of that pack, sorted by path
    root/commits/<version>.json the files of a version; what no commit names does not exist for readers

A document is the ordered lines of one path, each ended by a line feed. Rows are dealt to tasks by ranges
of path and order, so a long document fills stretches of several packs, in the order of `part`. Writes go through
Spark's data source interface: tasks write files with fresh names, and the driver commits the names of
those that Spark accepted, so a repeated or lost task leaves nothing that readers see. A version that is
written again replaces itself; of several versions that hold a path the greatest wins; `overwrite` makes
a version the only one. Files are reached by `pyarrow.fs`, which knows local, HDFS and object storage paths.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.resource import ResourceProfile, ResourceProfileBuilder, TaskResourceRequests
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

INDEX = "path string, version bigint, part bigint, file string, offset bigint, length bigint"
_INDEX = pa.schema([("path", pa.string()), ("version", pa.int64()), ("part", pa.int64()), ("file", pa.string()),
                    ("offset", pa.int64()), ("length", pa.int64())])
# Packs of a write, unless the caller names another number.
FILES = 64
# Index rows that a task holds before it writes them.
INDEX_ROWS = 1 << 16
# Bytes of a read, of the small documents that one reading task takes, about, and from which a document has a task of its own.
PIECE, WINDOW, LARGE = 1 << 20, 32 << 20, 16 << 20
# Bytes of a text.
MOST = (1 << 31) - 1


def located(root: str) -> tuple[fs.FileSystem, str]:
    if root.startswith("file:/") and not root.startswith("file://"):
        root = "file://" + root.removeprefix("file:")
    files, path = fs.FileSystem.from_uri(root)
    return files, path.rstrip("/")


@dataclass
class PackWritten(WriterCommitMessage):
    """What a task wrote: the name of its pack and index, if it had rows."""

    name: str | None
    documents: int = 0
    size: int = 0


class PackSource(DataSource):
    """`df.write.format("newsloom_pack")` for rows (path, line), in ranges of paths and sorted."""

    @classmethod
    def name(cls) -> str:
        return "newsloom_pack"

    def schema(self) -> str:
        return "path string, line string"

    def writer(self, schema, overwrite: bool) -> PackWriter:
        return PackWriter(self.options["path"], int(self.options.get("version", "0")), overwrite)


class PackWriter(DataSourceArrowWriter):
    def __init__(self, root: str, version: int, overwrite: bool) -> None:
        self.root, self.version, self.overwrite = root, version, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> PackWritten:
        files, root = located(self.root)
        name = f"{self.version:012d}-{uuid.uuid4().hex}"
        part = TaskContext.get().partitionId()
        documents, at, held, pack, index = 0, 0, [], None, None
        opened: tuple[str, int] | None = None  # path and offset of the stretch that is being written

        def close_stretch() -> None:
            if opened is not None:
                held.append((opened[0], self.version, part, f"{name}.pack", opened[1], at - opened[1]))

        def flush() -> None:
            index.write_table(pa.Table.from_pylist([dict(zip(_INDEX.names, row)) for row in held], schema=_INDEX))
            held.clear()

        try:
            for batch in iterator:
                if pack is None and batch.num_rows:
                    for folder in ("packs", "index"):
                        files.create_dir(f"{root}/{folder}", recursive=True)
                    pack = files.open_output_stream(f"{root}/packs/{name}.pack")
                    index = pq.ParquetWriter(files.open_output_stream(f"{root}/index/{name}.parquet"), _INDEX)
                for path, line in zip(batch.column("path").to_pylist(), batch.column("line").cast(pa.binary()).to_pylist()):
                    if opened is None or path != opened[0]:
                        close_stretch()
                        opened, documents = (path, at), documents + 1
                        if len(held) >= INDEX_ROWS:
                            flush()
                    data = (line or b"") + b"\n"
                    pack.write(data)
                    at += len(data)
            close_stretch()
            if held:
                flush()
        finally:
            for stream in (pack, index):
                if stream is not None:
                    stream.close()
        return PackWritten(name if pack is not None else None, documents, at)

    def commit(self, messages: Sequence[PackWritten | None]) -> None:
        files, root = located(self.root)
        done = [m for m in messages if m is not None and m.name]
        before = _commits(files, root)
        files.create_dir(f"{root}/commits", recursive=True)
        body = {"version": self.version, "names": [m.name for m in done], "size": sum(m.size for m in done)}
        # A new name first, then the move: a reader sees the old or the new list.
        draft = f"{root}/commits/.{self.version:012d}-{uuid.uuid4().hex}"
        with files.open_output_stream(draft) as out:
            out.write(json.dumps(body).encode())
        files.move(draft, f"{root}/commits/{self.version:012d}.json")
        for old in before:
            replaced = old["version"] == self.version
            if replaced or self.overwrite:
                if not replaced:
                    files.delete_file(f"{root}/commits/{old['version']:012d}.json")
                _delete(files, root, old["names"])

    def abort(self, messages: Sequence[PackWritten | None]) -> None:
        files, root = located(self.root)
        _delete(files, root, [m.name for m in messages if m is not None and m.name])


def _delete(files: fs.FileSystem, root: str, names: Sequence[str]) -> None:
    for name in names:
        for path in (f"{root}/packs/{name}.pack", f"{root}/index/{name}.parquet"):
            if files.get_file_info(path).type != fs.FileType.NotFound:
                files.delete_file(path)


def _commits(files: fs.FileSystem, root: str) -> list[dict]:
    found = files.get_file_info(fs.FileSelector(f"{root}/commits", allow_not_found=True))
    out = []
    for info in sorted(found, key=lambda i: i.base_name):
        if info.base_name.endswith(".json") and not info.base_name.startswith("."):
            with files.open_input_stream(info.path) as stream:
                out.append(json.loads(stream.read()))
    return out


def write_packed(
    lines: DataFrame, root: str, order: Sequence[str] = ("ord",), version: int = 0, overwrite: bool = False, files: int = FILES,
) -> None:
    """Write the documents of the rows (path, line), in `order`, as one version in at most `files` packs.

    A null line is empty; rows without a path belong to the document of the empty path.
    """
    lines.sparkSession.dataSource.register(PackSource)
    rows = lines.withColumn("path", F.coalesce(F.col("path"), F.lit("")))
    ordered = rows.repartitionByRange(files, "path", *order).sortWithinPartitions("path", *order)
    ordered.select("path", F.col("line").cast("string")).write.format(PackSource.name()).option("version", str(version)).mode("overwrite" if overwrite else "append").save(root)


def versions(root: str) -> list[int]:
    return [c["version"] for c in _commits(*located(root))]


def packed_index(spark: SparkSession, root: str, paths: Sequence[str] | None = None) -> DataFrame:
    """The stretches of the newest version of each path, of all or of the given paths.

    The index files are sorted by path, so a look-up of few paths reads few row groups.
    """
    commits = _commits(*located(root))
    names = [f"{root.rstrip('/')}/index/{n}.parquet" for c in commits for n in c["names"]]
    if not names:
        return spark.createDataFrame([], INDEX)
    index = spark.read.schema(INDEX).parquet(*names)
    if paths is not None:
        index = index.where(F.col("path").isin(list(paths)))
    if len(commits) == 1:
        return index
    return index.join(index.groupBy("path").agg(F.max("version").alias("version")), ["path", "version"]).select(*index.columns)


def _read(root: str):
    """Task over stretches: their bytes. Those of one pack come together, so each pack is opened once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = located(root)
        name, stream = None, None
        for batch in batches:
            bodies, first, size = [], 0, 0
            for i, (file, offset, length) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")))):
                if file != name:
                    name, stream = file, files.open_input_file(f"{base}/packs/{file}")
                bodies.append(stream.read_at(length, offset))
                size += length
                if size >= 8 << 20 or i == batch.num_rows - 1:
                    some = batch.slice(first, len(bodies))
                    yield pa.RecordBatch.from_arrays([some.column("path"), some.column("part"), pa.array(bodies, pa.binary()).cast(pa.string())],
                                                     names=["path", "part", "body"])
                    bodies, first, size = [], i + 1, 0

    return run


def read_stretches(spark: SparkSession, root: str, paths: Sequence[str] | None = None) -> DataFrame:
    """Rows (path, part, body): the text of each stretch of a document, in the order of `part`."""
    index = packed_index(spark, root, paths).select("path", "part", "file", "offset", "length")
    dealt = index.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(_read(root), "path string, part bigint, body string")


def _documents(root: str, counted: bool):
    """Task over documents and the places of their stretches: their bytes, each document put together in the place it is sent from."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = located(root)
        opened: list = [None, None]

        def together(some: list[tuple[str, list[dict]]]) -> pa.RecordBatch:
            ends = [0]
            for _, places in some:
                ends.append(ends[-1] + sum(p["length"] for p in places))
            if ends[-1] > MOST:
                raise ValueError(f"document {some[0][0]!r} has {ends[-1]} bytes; a text holds {MOST}")
            # The system's pool gives a large buffer back at once.
            data = pa.allocate_buffer(ends[-1], memory_pool=pa.system_memory_pool())
            view, at, lines = memoryview(data), 0, []
            for _, places in some:
                lines.append(0)
                for place in places:
                    if place["file"] != opened[0]:
                        opened[:] = place["file"], files.open_input_file(f"{base}/packs/{place['file']}")
                    opened[1].seek(place["offset"])
                    end = at + place["length"]
                    while at < end:
                        got = opened[1].readinto(view[at : min(end, at + PIECE)])
                        if not got:
                            raise EOFError(f"{place['file']} ends before {place['offset'] + place['length']}")
                        if counted:
                            lines[-1] += view[at : at + got].tobytes().count(b"\n")
                        at += got
            columns = [pa.array([path for path, _ in some], pa.string()),
                       pa.Array.from_buffers(pa.string(), len(some), [None, pa.array(ends, pa.int32()).buffers()[1], data])]
            return pa.RecordBatch.from_arrays(columns + [pa.array(lines, pa.int64())] * counted, names=["path", "body", "n_lines"][: 2 + counted])

        some, size = [], 0
        for batch in batches:
            for path, places in zip(batch.column("path").to_pylist(), batch.column("places").to_pylist()):
                length = sum(p["length"] for p in places)
                if some and size + length > 8 * PIECE:
                    yield together(some)
                    some, size = [], 0
                some.append((path, places))
                size += length
        if some:
            yield together(some)

    return run


def _one_a_machine(spark: SparkSession) -> ResourceProfile | None:
    """Tasks that take all cores of an executor, where that is known and can be asked for."""
    master = spark.sparkContext.master
    local = re.fullmatch(r"local-cluster\[\s*\d+\s*,\s*(\d+)\s*,.*", master)
    if master.startswith("local") and not local:
        return None
    cores = int(local[1] if local else spark.sparkContext.getConf().get("spark.executor.cores", "1"))
    return ResourceProfileBuilder().require(TaskResourceRequests().cpus(cores)).build if cores > 1 else None


def read_packed(spark: SparkSession, root: str, paths: Sequence[str] | None = None, counted: bool = False) -> DataFrame:
    """Rows (path, body) of the newest version of each path, of all or of the given paths; `counted` adds `n_lines`, their line feeds.

    The index says where the stretches of a document are, so tasks are dealt by bytes and a document is put together
    where it is read. A document of LARGE bytes or more has a task of its own, and where Spark can be told so, one at a time
    in an executor; there are at most (bytes / LARGE) of them. It passes a shuffle, behind which its row is as
    long as its text: a row that comes from Python has twice that. A writer holds several copies of a row besides, see the README.
    """
    stretch = F.struct("part", "offset", "file", "length")
    documents = packed_index(spark, root, paths).groupBy("path").agg(
        F.sort_array(F.collect_list(stretch)).alias("places"), F.sum("length").alias("size"))
    small_one = F.col("size") < LARGE
    large, total = documents.agg(F.array_sort(F.collect_list(F.when(~small_one, F.col("path")))), F.sum(F.when(small_one, F.col("size")))).first()
    profile = _one_a_machine(spark) if large else None
    schema = "path string, body string" + ", n_lines bigint" * counted

    def read(rows: DataFrame) -> DataFrame:
        return rows.select("path", "places").mapInArrow(_documents(root, counted), schema, profile=profile)

    first = F.col("places")[0]
    window = first["file"], F.floor(first["offset"] / WINDOW)
    small = documents.where(small_one).repartition(1 + (total or 0) // WINDOW, *window).sortWithinPartitions(first["file"], first["offset"])
    if not large:
        return read(small)
    own = F.array_position(F.lit(large), F.col("path")).cast("int") - 1
    alone = read(documents.where(~small_one).repartitionById(len(large), own))
    return read(small).unionByName(alone.repartitionById(len(large), own))


def read_lines(spark: SparkSession, root: str, paths: Sequence[str] | None = None) -> DataFrame:
    """Rows (path, part, place, line): lines in the order of (path, part, place), for documents of any length."""
    lines = F.split(F.col("body"), "\n", -1)
    ended = F.slice(lines, F.lit(1), F.size(lines) - 1)
    return read_stretches(spark, root, paths).select("path", "part", F.posexplode(ended).alias("place", "line"))


def export_folders(spark: SparkSession, root: str, paths: Sequence[str], target: str) -> None:
    """The given documents as a folder of text files each, for readers outside Spark."""
    # The writer ends the text with a line feed itself.
    body = F.substr(F.col("body"), F.lit(1), F.length("body") - 1)
    read_packed(spark, root, paths).select("path", body.alias("value")).write.mode("overwrite").partitionBy("path").text(target)
