"""Files under given names, one for each row, written by the tasks through Spark's data source interface."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from newsloom.sources.packs import located


class NamedFileSource(DataSource):
    """`df.write.format("newsloom_named")` for rows (name, body)."""

    @classmethod
    def name(cls) -> str:
        return "newsloom_named"

    def schema(self) -> str:
        return "name string, body string"

    def writer(self, schema, overwrite: bool) -> NamedFileWriter:
        return NamedFileWriter(self.options["path"])


class NamedFileWriter(DataSourceArrowWriter):
    """A file is written under a passing name and then moved, so a reader sees it whole, and a repeated task replaces it."""

    def __init__(self, root: str) -> None:
        self.root = root

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, root = located(self.root)
        files.create_dir(root, recursive=True)
        for batch in iterator:
            for name, body in zip(batch.column("name").to_pylist(), batch.column("body").cast(pa.binary()).to_pylist()):
                draft = f"{root}/.{uuid.uuid4().hex}"
                with files.open_output_stream(draft) as out:
                    out.write(body or b"")
                files.move(draft, f"{root}/{name}")
        return WriterCommitMessage()

    def commit(self, messages: Sequence[WriterCommitMessage | None]) -> None:
        pass

    def abort(self, messages: Sequence[WriterCommitMessage | None]) -> None:
        pass


def write_named(rows: DataFrame, root: str) -> None:
    """Write the rows (name, body) as files below `root`. Names must be unique; other files stay."""
    rows.sparkSession.dataSource.register(NamedFileSource)
    rows.select(F.col("name").cast("string"), F.col("body").cast("string")).write.format(NamedFileSource.name()).mode("append").save(root)
