"""Explicit schemas of every table the engine reads or writes."""

from __future__ import annotations

from pyspark.sql import types as T

_string = T.StringType()

# Raw article as a landing document holds it.
RAW_ARTICLE = T.StructType([
    T.StructField("source", T.StructType([
        T.StructField("id", _string),
        T.StructField("name", _string),
    ])),
    T.StructField("author", _string),
    T.StructField("title", _string),
    T.StructField("description", _string),
    T.StructField("url", _string),
    T.StructField("urlToImage", _string),
    T.StructField("publishedAt", _string),
    T.StructField("content", _string),
])

LANDING = T.StructType([
    T.StructField("status", _string),
    T.StructField("totalResults", T.LongType()),
    T.StructField("articles", T.ArrayType(RAW_ARTICLE)),
    T.StructField("_corrupt_record", _string),
])

# Curated master document.
MASTER = T.StructType([
    T.StructField("status", _string),
    T.StructField("totalResults", T.LongType()),
    T.StructField("articles", T.ArrayType(RAW_ARTICLE)),
    T.StructField("metadata", T.StructType([
        T.StructField("created_at", _string),
        T.StructField("source_limit", T.LongType()),
        T.StructField("candidate_goal", T.LongType()),
    ])),
])

# Outcome of one candidate.
RESULT = T.StructType([
    T.StructField("index", T.LongType()),
    T.StructField("url", _string),
    T.StructField("title", _string),
    T.StructField("source", _string),
    T.StructField("author", _string),
    T.StructField("success", T.BooleanType()),
    T.StructField("category", _string),
    T.StructField("content", _string),
    T.StructField("summary", _string),
    T.StructField("scrape_error", _string),
    T.StructField("summary_error", _string),
    T.StructField("classify_error", _string),
    T.StructField("processed_at", _string),
])

PROCESSED = T.StructType([
    T.StructField("status", _string),
    T.StructField("total_processed", T.LongType()),
    T.StructField("total_successful", T.LongType()),
    T.StructField("success_goal", T.LongType()),
    T.StructField("completed_at", _string),
    T.StructField("articles", T.ArrayType(RESULT)),
])

PROGRESS = T.StructType([
    T.StructField("success_count", T.LongType()),
    T.StructField("total_processed", T.LongType()),
    T.StructField("last_updated", _string),
    T.StructField("results", T.ArrayType(RESULT)),
])

# The seven published fields, in their stored order.
SITE_FIELDS = ("title", "summary", "author", "source", "url", "category", "processed_at")

SITE = T.StructType([T.StructField(name, _string) for name in SITE_FIELDS])

# A site row with its order key: newer runs first, then the order inside the run.
SITE_TABLE = T.StructType([
    *SITE.fields,
    T.StructField("run_seq", T.LongType()),
    T.StructField("pos", T.LongType()),
])

HISTORY = T.StructType([
    T.StructField("run_at", _string),
    T.StructField("total_successes", T.LongType()),
    T.StructField("categories", T.ArrayType(_string)),
    T.StructField("category_counts", T.MapType(_string, T.LongType())),
])

# Outcome of a replaceable row stage.
STAGE_OUTCOME = "struct<ok:boolean,value:string,error:string>"

CLAIM = T.StructType().add("writer", T.StringType()).add("step", T.LongType()).add("run_seq", T.LongType())
