"""The engine's tables below one root folder, and the documents it publishes.

Tables are Parquet; the exchange formats (JSON envelopes, text reports, XML) are written as
documents. A document is a set of text part files whose names are in line order, so that their
concatenation is the document, whatever its size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom import schemas
from newsloom.functions.text import or_default, summary_file_name, topic_file_name
from newsloom.operators.numbering import leading_rows, number_rows
from newsloom.sources import packs
from newsloom.sources.named import write_named


def _or_empty(spark: SparkSession, schema: T.StructType, read) -> DataFrame:
    """A table that may not exist yet."""
    try:
        return read()
    except AnalysisException as problem:
        if problem.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema)


class Store:
    """Paths, readers and writers. Run tables are overwritten by each run; the site and history grow."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def stage(self, name: str, rows: DataFrame) -> DataFrame:
        """Write a table and read it back."""
        rows.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(rows.schema).parquet(self.path(name))

    # --- landing ---

    def write_landing(self, documents: DataFrame) -> None:
        """One folder for each topic and fetch time, as JSON lines."""
        documents.write.mode("overwrite").partitionBy("topic", "fetch_ts").json(self.path("landing"))

    def write_landing_files(self, documents: DataFrame) -> None:
        """One file for each topic and fetch time, under its fixed name, as the landing readers expect them."""
        body = F.to_json(F.struct("status", "totalResults", "articles"), {"ignoreNullFields": "false"})
        write_named(documents.select(topic_file_name(F.col("topic"), F.col("fetch_ts")).alias("name"), body.alias("body")), self.path("landing_files"))

    def read_landing_pages(self) -> DataFrame:
        """The landing folders written by this store; `path` names the folder."""
        read = self.spark.read.schema(
            T.StructType([*schemas.LANDING.fields, T.StructField("topic", T.StringType()),
                          T.StructField("fetch_ts", T.TimestampType())])
        ).json(self.path("landing"))
        folder = F.concat_ws("/", F.col("topic"), F.col("fetch_ts").cast("string"))
        return read.withColumn("path", folder)

    # --- run tables ---

    def clear_run(self) -> None:
        """Empty the tables of the previous run. Site and history are kept."""
        empty = self.spark.createDataFrame
        empty([], schemas.MASTER).write.mode("overwrite").json(self.path("master"))
        article = schemas.MASTER["articles"].dataType.elementType
        candidates = T.StructType().add("article", article).add("index", T.LongType())
        empty([], candidates).write.mode("overwrite").parquet(self.path("candidates"))
        for name in ("progress", "results"):
            empty([], schemas.RESULT).write.mode("overwrite").parquet(self.path(name))
        empty([], schemas.PROCESSED).write.mode("overwrite").json(self.path("processed"))
        packs.write_packed(empty([], "path string, line string"), self.path("summaries"), order=(), overwrite=True, files=1)

    def write_master(self, selected: DataFrame, created_at: str, source_limit: int | None, goal: int) -> None:
        """The candidates in rank order, at most `goal` of them, as a table by `index`, which the run
        reads, and as an envelope with metadata, which is an export: one row that nests the list."""
        chosen = leading_rows(selected, goal, "rank").select("rank", "article")
        numbered = number_rows(chosen.select("rank"), "index", ["rank"])
        chosen.join(numbered, "rank").drop("rank").write.mode("overwrite").parquet(self.path("candidates"))
        ordered = F.array_sort(F.collect_list(F.struct("rank", "article")))
        master = leading_rows(selected, goal, "rank").agg(ordered.alias("items")).select(
            F.lit("ok").alias("status"),
            F.size("items").cast("bigint").alias("totalResults"),
            F.transform("items", lambda item: item["article"]).alias("articles"),
            F.struct(
                F.lit(created_at).alias("created_at"),
                F.lit(source_limit).cast("bigint").alias("source_limit"),
                F.lit(goal).cast("bigint").alias("candidate_goal"),
            ).alias("metadata"),
        )
        master.write.mode("overwrite").json(self.path("master"))

    def read_master(self) -> DataFrame:
        """Candidates of the run with their 0-based `index`. A missing table is an error."""
        return self.spark.read.parquet(self.path("candidates")).select("index", "article")

    def read_master_envelope(self) -> DataFrame:
        """The master envelope: one row with status, count, articles and metadata."""
        return self.spark.read.schema(schemas.MASTER).json(self.path("master"))

    def write_block(self, results: DataFrame, start: int) -> None:
        """Record the results of one block of candidates. Repeating a block replaces its rows."""
        results.write.mode("overwrite").parquet(self.path(f"progress/block={start}"))

    def read_blocks(self) -> DataFrame:
        """Results recorded so far in this run, also of candidates behind the goal."""
        return self._results("progress")

    def write_results(self, results: DataFrame) -> None:
        results.write.mode("overwrite").parquet(self.path("results"))

    def read_results(self) -> DataFrame:
        """Results of the last run; empty if there is none."""
        return self._results("results")

    def _results(self, name: str) -> DataFrame:
        read = _or_empty(
            self.spark, schemas.RESULT, lambda: self.spark.read.schema(schemas.RESULT).parquet(self.path(name))
        )
        return read.select(*schemas.RESULT.names)

    def read_progress(self, path: str) -> DataFrame:
        """Results of a saved progress document; missing or broken documents count as empty."""
        def read():
            return self.spark.read.schema(schemas.PROGRESS).option("multiLine", True).json(path)

        return _or_empty(self.spark, schemas.PROGRESS, read).select(F.inline("results"))

    def write_processed(self, results: DataFrame, goal: int, completed_at: str) -> None:
        """Processed envelope: counters, and the successes in order, at most `goal` of them."""
        record = F.struct(*[F.col(f.name) for f in schemas.RESULT.fields])
        counted = results.agg(
            F.count("*").alias("total_processed"),
            F.count_if("success").alias("total_successful"),
        )
        hits = leading_rows(results.where("success"), goal, "index")
        listed = hits.agg(F.array_sort(F.collect_list(record)).alias("articles"))
        processed = counted.select(
            F.lit("ok").alias("status"), "total_processed", "total_successful",
            F.lit(goal).cast("bigint").alias("success_goal"), F.lit(completed_at).alias("completed_at"),
            listed.scalar().alias("articles"),
        )
        processed.write.mode("overwrite").json(self.path("processed"))

    def read_processed(self) -> DataFrame:
        """Successes of the last run. A missing document is an error, a missing list is empty."""
        processed = self.spark.read.schema(schemas.PROCESSED).json(self.path("processed"))
        return processed.select(F.inline("articles"))

    def write_summaries(self, numbered: DataFrame) -> None:
        """One text report for each success, packed."""
        reports = summary_reports(numbered).select(F.col("file_name").alias("path"), F.col("body").alias("line"))
        packs.write_packed(reports, self.path("summaries"), order=(), overwrite=True)

    def read_summaries(self) -> DataFrame:
        """`(path, body)` of the reports of the last run."""
        return packs.read_packed(self.spark, self.path("summaries"))

    # --- site table ---

    def claims(self) -> DataFrame:
        """`(run_seq, writer, step)`: which step of which writer holds a run number of the site."""
        return _or_empty(self.spark, schemas.CLAIM, lambda: self.spark.read.schema(schemas.CLAIM).parquet(self.path("claims")))

    def claim_run(self, writer: str, step: int) -> int:
        """The run number of a step of a writer: that of an earlier try, else the next free one.

        The claim is written before the rows, so a step that broke off finds its number again. A
        number that another writer claims at the same moment is refused, and the step is to be tried again.
        """
        held = self.claims().where((F.col("writer") == writer) & (F.col("step") == step)).agg(F.max("run_seq")).first()[0]
        if held is not None:
            return held
        used = self.claims().select("run_seq").unionAll(self.read_site().select("run_seq"))
        run_seq = used.agg(F.coalesce(F.max("run_seq") + 1, F.lit(0).cast("bigint"))).first()[0]
        self._claim(run_seq, writer, step)
        return run_seq

    def _claim(self, run_seq: int, writer: str, step: int) -> None:
        row = self.spark.createDataFrame([(writer, step)], "writer string, step bigint")
        row.write.mode("errorifexists").parquet(self.path(f"claims/run_seq={run_seq}"))

    def start_site(self) -> None:
        """Make the site table where there is none, so that a stream can follow it."""
        empty = self.spark.createDataFrame([], schemas.SITE_TABLE)
        empty.write.mode("ignore").partitionBy("run_seq").parquet(self.path("site"))

    def append_site(self, added: DataFrame, run_seq: int, writer: str = "batch") -> None:
        """Store the rows a run adds. Repeating a run replaces its own rows only.

        A run number that another writer has claimed is refused.
        """
        holder = self.claims().where(F.col("run_seq") == run_seq).first()
        if holder is None:
            self._claim(run_seq, writer, run_seq)
        elif holder["writer"] != writer:
            raise ValueError(f"run {run_seq} of the site belongs to {holder['writer']}")
        added.drop("run_seq").write.mode("overwrite").parquet(self.path(f"site/run_seq={run_seq}"))

    def read_site(self) -> DataFrame:
        """All site rows with their order key; empty before the first run."""
        return _or_empty(
            self.spark, schemas.SITE_TABLE,
            lambda: self.spark.read.schema(schemas.SITE_TABLE).parquet(self.path("site")),
        )

    def read_site_json(self, path: str) -> DataFrame:
        """A site list kept as JSON arrays, as run 0 with the place in the list; empty if it is missing.

        Of several documents the list goes on in the order of their names. A JSON array is read by one task, so
        the site itself is kept as the Parquet table of `append_site`; `take_over` moves a list there.
        """
        numbered = "array<struct<" + ",".join(f"{f}:string" for f in schemas.SITE_FIELDS) + ">>"

        def read():
            whole = self.spark.read.text(path, wholetext=True)
            rows = whole.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.from_json("value", numbered)).alias("at", "row"))
            placed = number_rows(rows, "pos", ["file", "at"])
            return placed.select("row.*", F.lit(0).cast("bigint").alias("run_seq"), "pos")

        return _or_empty(self.spark, schemas.SITE_TABLE, read)

    def take_over(self, path: str, writer: str = "import") -> None:
        """Store a site list kept as JSON, once: it claims its run number like any other writer."""
        rows = self.read_site_json(path)
        self.append_site(rows, self.claim_run(writer, 0), writer)

    def export_site_json(self, site: DataFrame) -> None:
        """The list as JSON lines in list order, for readers outside Spark."""
        ordered = site.orderBy(F.desc("run_seq"), "pos").select(*schemas.SITE_FIELDS)
        ordered.write.mode("overwrite").option("ignoreNullFields", False).json(self.path("publish/articles"))

    # --- history ---

    def append_history(self, entries: DataFrame) -> None:
        """Store run entries by `run_seq`. Repeating a run replaces its own entry only."""
        entries.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_seq").parquet(
            self.path("history")
        )

    def read_history(self) -> DataFrame:
        schema = T.StructType([*schemas.HISTORY.fields, T.StructField("run_seq", T.LongType())])
        return _or_empty(
            self.spark, schema, lambda: self.spark.read.schema(schema).parquet(self.path("history"))
        )

    # --- documents ---

    def write_document(self, name: str, body: DataFrame, line: Column, order: Sequence[str | Column],
                       head: str = "", foot: str = "") -> None:
        """Write head, the ordered body lines and foot as one document."""
        document_lines(body, line, order, head, foot).write.mode("overwrite").text(self.path(f"publish/{name}"))

    def write_pages(self, lines: DataFrame, name: str, version: int | None = None, files: int = packs.FILES) -> None:
        """The pages of `(path, ord, line)` rows, packed into at most `files` files.

        Without a version they are all pages there are; with one they replace the pages of their paths,
        and a step that is repeated with its version replaces its own.
        """
        packs.write_packed(lines, self.path(f"publish/{name}"), ("ord",), version or 0, version is None, files)

    def read_pages(self, name: str, paths: Sequence[str] | None = None, counted: bool = False) -> DataFrame:
        """`(path, body)` of all pages, or of those of the given paths; `counted` adds `n_lines`."""
        return packs.read_packed(self.spark, self.path(f"publish/{name}"), paths, counted)

    def export_pages(self, name: str, paths: Sequence[str]) -> None:
        """Chosen pages as folders of text files, for readers outside Spark."""
        packs.export_folders(self.spark, self.path(f"publish/{name}"), paths, self.path(f"publish/{name}-export"))


def document_lines(body: DataFrame, line: Column, order: Sequence[str | Column], head: str = "", foot: str = "") -> DataFrame:
    """Lines of a document in order. The sort is by ranges, so no task sees the whole document."""
    spark = body.sparkSession
    part = F.struct(*order).alias("_ord")
    rows = body.select(F.lit(1).alias("_part"), part, line.alias("value"))
    for text, place in ((head, 0), (foot, 2)):
        if text:
            edge = spark.createDataFrame([(place, text)], "_part int, value string")
            rows = rows.unionByName(edge, allowMissingColumns=True)
    return rows.orderBy("_part", "_ord").select("value")


def summary_reports(numbered: DataFrame) -> DataFrame:
    """`(file_name, body)` of each numbered success. The layout is a fixed format."""
    rule = F.lit("=" * 60)
    lines = [
        F.coalesce("title", F.lit("")), rule, F.lit(""), F.coalesce("summary", F.lit("")), F.lit(""), rule,
        F.concat(F.lit("Author:   "), F.col("author")),
        F.concat(F.lit("Source:   "), F.col("source")),
        F.concat(F.lit("URL:      "), F.col("url")),
        F.concat(F.lit("Category: "), or_default(F.col("category"), "Unknown")),
    ]
    return numbered.select(summary_file_name(F.col("number")).alias("file_name"), F.concat_ws("\n", *lines).alias("body"))
