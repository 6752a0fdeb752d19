"""A training-data pipeline: toxic documents go, near copies go, repeated passages go, sources are mixed, texts are encoded.

`run(spark, sf_dir)` applies the stages to the table `documents`. Each stage reads all that its
predecessor kept, from Parquet.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsloom.llm import bpe, mixing, passages, simhash, toxicity
from newsloom.llm.frames import shielded, table
from newsloom.llm.queries import quality_weights
from newsloom.operators.joins import hinted
from newsloom.session import scratch_path, settle

# Score from which a document is rejected.
TOXIC = 0.3
# Near copies: words of a shingle, and the most bits in which the fingerprints of two linked documents differ.
SHINGLE, RADIUS = 3, 2
TOKENIZER = "word_bpe_49k.json"


def _measured(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of `like`, with `n_chars` of the text as it is now."""
    if "n_chars" in docs.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast("long"))
    return docs.select(*like.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the limit. The lexicon is learned from the labelled ones; null and empty texts stay."""
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, lexicon).where(F.col("toxicity") < TOXIC).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of documents whose fingerprints link: that of the smallest id. Texts without a
    word share a fingerprint and so a group. Rows without an id stay. Each row of an id is judged by its own
    text: of its texts the one of the smallest hash goes by the id, the others by a number drawn from 2^62 up.
    Of rows of one id and text that of the smallest hash stays, and of equal rows any."""
    rows, columns = shielded(docs, ())
    texts = rows.withColumn("_text", F.xxhash64("text"))
    several = settle(
        texts.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.min("_text").alias("_first"), F.max("_text").alias("_last"))
        .where("_first <> _last").select("_id", "_first"))
    drawn = F.xxhash64("doc_id", "_text").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    keyed = texts.join(hinted(several), F.col("doc_id") == F.col("_id"), "left").withColumn(
        "_key", F.when(F.col("_first") != F.col("_text"), drawn).otherwise(F.col("doc_id").cast("long"))).drop("_id", "_first", "_text")
    groups = simhash.near_duplicates(keyed.select("_key", "text"), "_key", width=SHINGLE, radius=RADIUS)
    marks = settle(
        groups.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_key"))
        .agg(F.max(F.col("component_id") != F.col("doc_id")).alias("goes"), F.count("*").alias("n")))
    stays = keyed.join(marks.where("goes OR n > 1").select("_key"), "_key", "left_anti").select(*columns)
    repeated = settle(marks.where("NOT goes AND n > 1").select("_key"))
    whole = F.struct(*(F.col(f"`{c}`") for c in rows.columns))
    once = keyed.join(hinted(repeated), "_key", "left_semi").groupBy("_key").agg(F.min_by(whole, F.xxhash64(whole)).alias("_row"))
    return stays.unionAll(once.select("_row.*").select(*columns))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that one of smaller id has. A document of which no word is left goes."""
    found = passages.remove_passages(docs, passages.repeated_passages(docs))
    return _measured(found.where((F.col("removed_words") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the one on the border of a source's target with its first words."""
    return _measured(mixing.copies(mixing.mix(docs, quality_weights(spark, sf_dir))), docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and decoding of each text."""
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), public_tokenizers.path(TOKENIZER))
    return coded.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("repeated_passages", cut_repeated_passages),
    ("source_mixing", mix_sources),
    ("bpe", encode_texts),
]

# The stages are not expressible in SQL; tests compare them with plain versions.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. A stage's table in the shared folder is deleted when the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            _delete(spark, before)
        before = path
    return docs
