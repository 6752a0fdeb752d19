"""Result records: newest per index, resume, goal cut and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.operators.joins import hinted, keep_last
from newsloom.operators.numbering import TOP_ROWS, number_rows
from newsloom.session import settle


def latest_per_index(results: DataFrame, index: str = "index", seq: str = "seq") -> DataFrame:
    """The last recorded row of each index; `seq` is unique within an index."""
    return keep_last(results, index, seq)


def remaining(candidates: DataFrame, results: DataFrame, index: str = "index") -> DataFrame:
    """Candidates that have no result yet."""
    return candidates.join(results.select(index).distinct(), index, "left_anti")


def goal_index(results: DataFrame, goal: int) -> DataFrame:
    """One row with the index at which the goal is met; null if it is not met."""
    hits = results.where("success").select("index")
    if goal <= TOP_ROWS:
        first = hits.orderBy("index").limit(goal)
        return first.agg(F.when(F.count("*") >= goal, F.max("index")).alias("last"))
    numbered = number_rows(hits, "place", ["index"])
    return numbered.where(F.col("place") == goal - 1).agg(F.max("index").alias("last"))


def cut_at_goal(results: DataFrame, goal: int) -> DataFrame:
    """Rows up to and with the success that meets the goal; later rows have no result at all."""
    last = goal_index(results, goal).select(F.coalesce("last", F.lit((1 << 63) - 1))).scalar()
    return results.where(F.col("index") <= last)


def run_counters(results: DataFrame, goal: int) -> DataFrame:
    """Processed rows, successes and whether the goal was reached, of one run."""
    return results.agg(
        F.count("*").alias("total_processed"),
        F.count_if("success").alias("total_successful"),
    ).withColumn("success_goal", F.lit(goal).cast("bigint")).withColumn(
        "goal_reached", F.col("total_successful") >= goal
    )


def numbered_successes(results: DataFrame) -> DataFrame:
    """Successes with their 1-based number in processing order; only their indexes are numbered."""
    hits = results.where("success")
    places = settle(number_rows(hits.select("index"), "number", ["index"]))
    return hits.join(hinted(places.withColumn("number", F.col("number") + 1)), "index").select(*results.columns, "number")
