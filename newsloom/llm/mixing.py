"""Mixing sources to target weights by Efraimidis-Spirakis sampling without replacement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.frames import WORD, shielded
from newsloom.session import settle

# Key ranges that a source is cut into for the prefix sum.
RANGES = 8192


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def exponential_key(doc_id: str, weight: Column) -> Column:
    """-ln(u) / weight, where u in (0, 1] comes from the id: smaller keys are taken first.

    52 bits of the MD5 of the id as text, so that a rerun agrees. A null id counts as the empty text.
    """
    digest = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 1) / F.lit(float(1 << 52))
    return -F.log(u) / weight


def source_targets(sizes: DataFrame, cycle: Sequence[int], share: float, most: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sources by code point, null last, weigh `cycle`, repeating, and share `share` of all sizes. A
    target stops at `most` times the size of its source; the excess goes to the others by weight
    until none is above. That is the level at which the first source, by size for its weight, is not
    filled up. The windows without a partition see one row for each source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*(F.lit(float(w)) for w in cycle))
    weighed = sizes.withColumn("_w", F.get(weights, (F.row_number().over(order) - 1) % len(cycle))).withColumn(
        "_cap", F.lit(most) * F.col("source_size"))
    fill = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = F.lit(share) * F.sum("source_size").over(everything)
    level = weighed.withColumn("_at", F.row_number().over(fill)).withColumn(
        "_level", (total - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after))
    first = F.min_by(F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.col("_level")),
                     F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.col("_at"))).over(everything)
    return level.withColumn("_first", first).select(
        "source", "source_size",
        F.least(F.col("_cap"), F.coalesce(F.col("_w") * F.col("_first"), F.col("_cap"))).alias("target"))


def takes(
    docs: DataFrame, quality: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text",
    source: str = "source", cycle: Sequence[int] = (5, 2, 1), share: float = 1.5, most: float = 2.0,
) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, taken), one for each row of `docs`.

    `size` counts the words of the text, `taken` the words that the mix takes of the row, repeats
    included. `quality` (doc_id, weight > 0) raises the chance of a document; one without a row
    weighs 1. A source takes each of its documents as often as whole epochs fit its target. The rest
    of the target goes to the documents in the order of their exponential keys, and the document on
    the border gives as many words as are missing. Rows with the same id and size tie and share what
    is left to them evenly, rounded down. A null text has size 0 and gives nothing; null is a source.

    Texts are read once and not shuffled. The sums that a source needs are taken over ranges of its
    keys, then over the rows of the one range on the border, so no task sees a whole source.
    """
    sized = docs.select(
        F.col(doc_id).cast("string").alias("_tie"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(text).alias("size"))
    weight = F.lit(1.0)
    if quality is not None:
        sized = sized.join(quality.select(F.col(doc_id).alias("_id"), F.col("weight").alias("_weight")), F.col("doc_id") == F.col("_id"), "left")
        weight = F.coalesce("_weight", F.lit(1.0))
    keyed = sized.withColumn("_key", exponential_key("doc_id", weight)).withColumn(
        "_range", F.least(F.lit(RANGES - 1), ((1 - F.exp(-F.col("_key"))) * RANGES).cast("int")))
    narrow = settle(keyed.select("doc_id", "source", "size", "_key", "_range", "_tie"))
    ranges = settle(narrow.groupBy("source", "_range").agg(F.sum("size").alias("_words")))
    sizes = ranges.groupBy("source").agg(F.sum("_words").alias("source_size"))
    plan = source_targets(sizes, cycle, share, most).withColumn(
        "_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    ).withColumn("_rest", F.floor(F.col("target") - F.col("_epochs") * F.col("source_size")).cast("long"))
    plan = settle(plan)
    earlier = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    borders = (
        ranges.withColumn("_before", F.coalesce(F.sum("_words").over(earlier), F.lit(0)))
        .join(plan.select(F.col("source").alias("_s"), "_rest"), F.col("source").eqNullSafe(F.col("_s")))
        .where("_before <= _rest and _rest < _before + _words")
        .select("_s", F.col("_range").alias("_border"), "_before", "_rest")
    )
    inside = (
        narrow.join(settle(borders), F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_border")))
        .groupBy("_s", "_border", "_before", "_rest", "_key", "_tie", "size").agg(F.count("*").alias("_n"))
    )
    upto = Window.partitionBy("_s").orderBy("_key", F.col("_tie").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        inside.withColumn("_left", F.col("_rest") - F.col("_before") - F.coalesce(F.sum(F.col("size") * F.col("_n")).over(upto), F.lit(0)))
        .where("_left >= 0 and _left < size * _n")
        .select("_s", F.col("_key").alias("_cut"), F.col("_tie").alias("_cut_tie"), F.col("size").alias("_cut_size"),
                F.floor(F.col("_left") / F.col("_n")).cast("long").alias("_part"))
    )
    decided = settle(
        plan.join(cuts, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumnRenamed("source", "_s")
    )
    here = F.struct("_key", F.col("_tie").isNull(), F.col("_tie"), F.col("size"))
    cut = F.struct("_cut", F.col("_cut_tie").isNull(), F.col("_cut_tie"), F.col("_cut_size"))
    rest = F.when(F.col("_cut").isNull() | (here > cut), F.lit(0)).when(here < cut, F.col("size")).otherwise(F.col("_part"))
    return narrow.join(decided, F.col("source").eqNullSafe(F.col("_s")), "left").select(
        "doc_id", "source", "size", "source_size", "target", (F.col("_epochs") * F.col("size") + rest).cast("long").alias("taken"))


def mix(docs: DataFrame, quality: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source", **how) -> DataFrame:
    """`docs` with the columns `size`, `source_size`, `target` and `taken` of `takes`.

    Columns of `docs` with these names are replaced. The decisions are joined by id, source and
    size, which is one shuffle of the texts.
    """
    rows, columns = shielded(docs, ("size", "source_size", "target", "taken"))
    decided = takes(docs, quality, doc_id, text, source, **how).select(
        F.col("doc_id").alias("_id"), F.col("source").alias("_source"), F.col("size").alias("_size"), "source_size", "target", "taken").distinct()
    same = F.col(doc_id).eqNullSafe(F.col("_id")) & F.col(source).eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))
    return rows.withColumn("size", word_count(text)).join(decided, same, "left").select(*columns, "size", "source_size", "target", "taken")


def copies(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The documents of a mix: one row for each whole take and one with the first words of a part.

    The column `taken` of a row is the words it holds. The words of a part are joined by single spaces.
    """
    whole = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    part = F.when(F.col("size") > 0, F.col("taken") % F.col("size")).otherwise(0)
    takes = F.concat(
        F.when(whole > 0, F.array_repeat(F.col("size"), whole)).otherwise(F.array().cast("array<bigint>")),
        F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")),
    )
    rows = mixed.withColumn("taken", F.explode(takes))
    head = F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)), 1, F.col("taken").cast("int")), " ")
    return rows.withColumn(text, F.when(F.col("taken") < F.col("size"), head).otherwise(F.col(text)))
