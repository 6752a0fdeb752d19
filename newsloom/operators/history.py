"""Run history: category counts of each run, totals over all runs, and the text report.

A history row is `(run_seq, run_at, total_successes, categories, category_counts)`; its
categories are configuration, so the arrays and maps are small whatever the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.functions.text import report_cell

# Fixed formats of the text report.
THICK, THIN = "═" * 62, "─" * 62
TOTALS_HEADING = "  CUMULATIVE CATEGORY TOTALS  (all runs)"
TOTAL_LABEL = "TOTAL (valid categories)"


def _category_counts(categories: Sequence[str]) -> list[Column]:
    return [F.count_if(F.col("category") == name).alias(f"n{i}") for i, name in enumerate(categories)]


def _entry_columns(categories: Sequence[str]) -> list[Column]:
    names = F.array(*[F.lit(name) for name in categories])
    counted = F.array(*[f"n{i}" for i in range(len(categories))])
    return [names.alias("categories"), F.map_from_arrays(names, counted).alias("category_counts")]


def run_entries(successes: DataFrame, categories: Sequence[str], run: Sequence[str] = ("run_seq", "run_at")) -> DataFrame:
    """History row of each run that has successes.

    Categories without a success count zero; other labels are ignored.
    """
    counted = successes.groupBy(*run).agg(F.count("*").alias("total_successes"), *_category_counts(categories))
    return counted.select(*run, "total_successes", *_entry_columns(categories))


def run_entry(successes: DataFrame, categories: Sequence[str], run_at: str) -> DataFrame:
    """History row of one run, also of one without any success."""
    counted = successes.agg(F.count("*").alias("total_successes"), *_category_counts(categories))
    return counted.select(F.lit(run_at).alias("run_at"), "total_successes", *_entry_columns(categories))


def declared_categories(history: DataFrame) -> Column:
    """Category list of a run; the counted names where it has none."""
    return F.coalesce("categories", F.map_keys("category_counts"), F.array().cast("array<string>"))


def run_counts(history: DataFrame) -> DataFrame:
    """Long form `(run_seq, run_at, ord, category, n)`, with zero for a name that was not counted."""
    listed = history.select("run_seq", "run_at", "category_counts", F.posexplode(declared_categories(history)))
    n = F.coalesce(F.try_element_at("category_counts", F.col("col")), F.lit(0)).cast("bigint")
    return listed.select("run_seq", "run_at", F.col("pos").cast("bigint").alias("ord"), F.col("col").alias("category"), n.alias("n"))


def all_categories(history: DataFrame) -> DataFrame:
    """Names over all runs in first-seen order: `(category, run_seq, ord)` of the first sight."""
    listed = history.select("run_seq", F.posexplode(declared_categories(history)))
    first = listed.groupBy(F.col("col").alias("category")).agg(
        F.min(F.struct("run_seq", F.col("pos").cast("bigint").alias("ord"))).alias("seen")
    )
    return first.select("category", "seen.run_seq", "seen.ord")


def cumulative_counts(history: DataFrame) -> DataFrame:
    """Count of each declared category over all runs, zero-filled: `(category, run_seq, ord, n)`."""
    counted = (
        history.select(F.explode("category_counts").alias("category", "n"))
        .groupBy("category").agg(F.sum("n").cast("bigint").alias("n"))
    )
    return all_categories(history).join(counted, "category", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def category_totals(history: DataFrame) -> DataFrame:
    """Cumulative counts and, with a null category, their grand total, in one pass."""
    return cumulative_counts(history).rollup("category").agg(F.sum("n").cast("bigint").alias("n"))


def report_lines(history: DataFrame) -> DataFrame:
    """Text report as rows `(section, ord, line)`: totals first, then the runs, newest first."""
    totals = cumulative_counts(history)
    newest = history.select((-F.col("run_seq")).alias("section"), "run_at", "total_successes")
    runs = newest.select(
        "section",
        F.posexplode(F.array(
            F.concat(
                F.lit("Run  "), F.coalesce("run_at", F.lit("unknown")),
                F.format_string("   (%d successes)", F.coalesce("total_successes", F.lit(0))),
            ),
            F.lit(THIN),
        )).alias("part", "line"),
    ).select("section", _at(0, F.lit(0), F.col("part")), "line")
    cells = run_counts(history).select(
        (-F.col("run_seq")).alias("section"), _at(2, F.lit(0), F.col("ord")), report_cell(F.col("category"), F.col("n")).alias("line")
    )
    blanks = newest.select("section", _at(3, F.lit(0), F.lit(0)), F.lit("").alias("line"))
    top = totals.select(_at(1, F.col("run_seq"), F.col("ord")), report_cell(F.col("category"), F.col("n")).alias("line"))
    heading = _constant_lines(history, 0, [THICK, TOTALS_HEADING, THICK])
    total = totals.agg(report_cell(F.lit(TOTAL_LABEL), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint")).alias("line"))
    footer = _constant_lines(history, 2, [THIN]).unionByName(
        total.select(_at(3, F.lit(0), F.lit(0)), "line")
    ).unionByName(_constant_lines(history, 4, [THICK, ""]))
    summary = heading.unionByName(top).unionByName(footer).withColumn("section", _first_section())
    return summary.unionByName(runs).unionByName(cells).unionByName(blanks).select("section", "ord", "line")


def _first_section() -> Column:
    return F.lit(-(1 << 62)).cast("bigint")


def _at(part: int, run: Column, at: Column) -> Column:
    return F.struct(
        F.lit(part).cast("bigint").alias("part"), run.cast("bigint").alias("run"), at.cast("bigint").alias("at")
    ).alias("ord")


def _constant_lines(history: DataFrame, part: int, lines: list[str]) -> DataFrame:
    rows = history.sparkSession.createDataFrame([(i, line) for i, line in enumerate(lines)], "at bigint, line string")
    return rows.select(_at(part, F.lit(0), F.col("at")), "line")
