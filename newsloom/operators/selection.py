"""Greedy selection under several exclusive keys and a cap for each source, exact and parallel.

The sequential rule: scan rows by rank and accept a row if its URL, its non-empty title and its
non-empty author are unused by the rows accepted so far, and its source has fewer than
`source_limit` accepted rows. A row that is turned away reserves nothing, so independent
de-duplications give other results.

The parallel form repeats two sound decisions until no row is open (Blelloch, Fineman, Shun,
"Greedy sequential maximal independent set and matching are parallel on average", SPAA 2012,
with a capacity added for the source):

* a row is accepted when no earlier open row shares one of its keys, and when its place among the
  open rows of its source is within the places its source has left;
* an open row is rejected when it shares a key with an accepted row or its source is full.

The first open row by rank is always decided, so the rounds end. Both decisions are read from
aggregates: a key votes for its first open row, and a row with a vote from each of its keys
wins. Votes are keyed by rank, which is unique, so counting them meets no hot key.

The rounds follow the longest chain of rows that wait for each other. Once few rows are open, or when
a block has few from the start, one task scans them by rank: SCAN_ROWS bounds what it holds, whatever
the size of the tables, and a chain of any length ends there.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.operators.joins import KEY_ROWS, Size, spread_join
from newsloom.operators.numbering import leading_per_group, leading_rows
from newsloom.session import settle, staged

# Ranks that the first block spans, and the factor by which the following blocks grow. With a
# goal the first block is smaller: GOAL_RANKS ranks for each wanted row, but at least MIN_BLOCK.
FIRST_BLOCK = 1 << 22
MIN_BLOCK = 1 << 16
GOAL_RANKS = 64
BLOCK_GROWTH = 8

# Rounds after which the accepted rows are written together, to keep plans short.
MAX_PARTS = 16

# Open rows, and bytes of their keys, that one task scans.
SCAN_ROWS = 1 << 16
SCAN_BYTES = 32 << 20

_COLUMNS = ("rank", "url", "title", "author", "source")


@dataclass(frozen=True)
class _Accepted:
    """Accepted rows so far: a union of settled parts, with its measured size."""

    rows: DataFrame
    size: Size = field(default_factory=Size)
    parts: int = 0

    def plus(self, rows: DataFrame, size: Size) -> _Accepted:
        union = self.rows.unionByName(rows) if self.parts else rows
        if self.parts < MAX_PARTS:
            return _Accepted(union, self.size + size, self.parts + 1)
        return _Accepted(settle(union), self.size + size, 1)

    def meets(self, goal: int | None, before: int | None = None) -> bool:
        """Whether `goal` rows are accepted, counting those ahead of rank `before` only."""
        if goal is None or self.size.rows < goal:
            return False
        return before is None or self.rows.where(F.col("rank") < before).count() >= goal


def greedy_select(
    rows: DataFrame,
    source_limit: int | None = None,
    goal: int | None = None,
    first_block: int | None = None,
    key_rows: int = KEY_ROWS,
) -> DataFrame:
    """Rows `(rank, url, title, author, source)` accepted by the sequential rule, up to `goal`.

    `rows` carries a unique non-negative integer `rank`, stripped `url`, `title` and `author`
    (empty means missing; a row without URL is out) and `source`. Pass a stored or settled table: it is
    read once for each block; of one that `in_blocks` stored, only the files of the block are read.

    Acceptance depends on earlier rows only. Rows are therefore taken in blocks of consecutive
    ranks; a block of `n` ranks holds at most `n` rows. Later blocks lose all rows that clash
    with accepted ones before their first round, and none is read once the goal is met.
    """
    empty = rows.sparkSession.createDataFrame([], rows.select(*_COLUMNS).schema)
    accepted = _Accepted(empty)
    for level, (start, end) in enumerate(block_bounds(goal, first_block)):
        if start and (accepted.meets(goal) or rows.where(F.col("rank") >= start).isEmpty()):
            break
        block = rows.where((F.col("rank") >= start) & (F.col("rank") < end))
        if "block" in rows.columns:
            block = block.where(F.col("block") == level)
        block = block.select(*_COLUMNS).where(F.col("url") != "")
        if start:
            block = _without_clashes(block, accepted.rows, accepted.size, accepted, source_limit, key_rows)
        accepted = _decide_block(block, accepted, source_limit, goal, key_rows)
    return accepted.rows if goal is None else leading_rows(accepted.rows, goal, "rank")


def block_bounds(goal: int | None, first_block: int | None = None) -> list[tuple[int, int]]:
    """Ranges of ranks that are read one after the other, up to the greatest integer."""
    if first_block is None:
        first_block = FIRST_BLOCK if goal is None else min(max(GOAL_RANKS * goal, MIN_BLOCK), FIRST_BLOCK)
    bounds, width = [(0, first_block)], first_block
    while bounds[-1][1] < (1 << 63) - 1:
        width *= BLOCK_GROWTH
        bounds.append((bounds[-1][1], min(bounds[-1][1] + width, (1 << 63) - 1)))
    return bounds


def in_blocks(rows: DataFrame, goal: int | None = None, first_block: int | None = None) -> DataFrame:
    """Ranked rows stored by the blocks that `greedy_select` reads with the same parameters."""
    starts = [start for start, _ in block_bounds(goal, first_block)]
    block = reduce(lambda a, b: a + b, [F.when(F.col("rank") >= s, 1).otherwise(0) for s in starts[1:]], F.lit(0))
    return staged(rows.withColumn("block", block), "ranked", "block")


def _first_copies(rows: DataFrame) -> DataFrame:
    """Keep the first of rows that agree in all keys; the others can never be accepted."""
    return rows.groupBy("url", "title", "author", "source").agg(F.min("rank").alias("rank")).select(*_COLUMNS)


def _decide_block(
    open_rows: DataFrame, accepted: _Accepted, source_limit: int | None, goal: int | None, key_rows: int
) -> _Accepted:
    """Run rounds until few rows of the block are open, which are scanned, or the goal lies ahead of the first open row.

    A round stores the open rows with a mark on the winners, and reads all it has to know from that
    table in one pass. The rows that clash with winners are left out as the next round reads it.
    """
    left, _ = _measured(open_rows.withColumn("won", F.lit(False)), False)
    if left.rows > SCAN_ROWS or left.bytes > SCAN_BYTES:
        open_rows = settle(_first_copies(open_rows))
    while not (left.rows <= SCAN_ROWS and left.bytes <= SCAN_BYTES):
        marked = settle(_marked(open_rows, accepted, source_limit))
        won, _ = _measured(marked, True)
        left, first = _measured(marked, False)
        winners = marked.where("won").select(*_COLUMNS)
        if won.rows:
            accepted = accepted.plus(winners, won)
        if first is None or accepted.meets(goal, before=first):
            return accepted
        still = marked.where(~F.col("won")).select(*_COLUMNS)
        open_rows = _without_clashes(still, winners, won, accepted, source_limit, key_rows)
    if left.rows:
        winners = settle(_scanned(open_rows, accepted, source_limit))
        size, _ = _measured(winners.withColumn("won", F.lit(True)), True)
        if size.rows:
            accepted = accepted.plus(winners, size)
    return accepted


def _measured(rows: DataFrame, won: bool) -> tuple[Size, int | None]:
    """Size and least rank of the rows that won, or of those that did not."""
    width = sum((F.octet_length(c) for c in _COLUMNS[1:]), F.lit(16))
    found = rows.where(F.col("won") == won).agg(F.count("*").alias("rows"), F.sum(width).alias("bytes"), F.min("rank").alias("first")).first()
    return Size(found["rows"], found["bytes"] or 0), found["first"]


def _scanned(open_rows: DataFrame, accepted: _Accepted, source_limit: int | None) -> DataFrame:
    """The winners among few open rows that clash with no accepted row, by the sequential rule in one task."""
    rows = open_rows.select(*_COLUMNS).withColumn("used", F.lit(0).cast("bigint"))
    if source_limit is not None and accepted.size.rows:
        counts = accepted.rows.groupBy("source").agg(F.count("*").alias("n"))
        rows = rows.drop("used").join(counts, "source", "left").select(*_COLUMNS, F.coalesce("n", F.lit(0)).alias("used"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, set[str]] = {"url": set(), "title": set(), "author": set()}
        taken: Counter[str] = Counter()
        for batch in batches:
            kept = []
            columns = (batch.column(c).to_pylist() for c in ("url", "title", "author", "source", "used"))
            for place, (url, title, author, source, used) in enumerate(zip(*columns)):
                if url in seen["url"] or title in seen["title"] or author in seen["author"]:
                    continue
                if source_limit is not None and used + taken[source] >= source_limit:
                    continue
                taken[source] += 1
                seen["url"].add(url)
                for kind, value in (("title", title), ("author", author)):
                    if value:
                        seen[kind].add(value)
                kept.append(place)
            yield batch.select(list(_COLUMNS)).take(pa.array(kept, pa.int32()))

    return rows.coalesce(1).sortWithinPartitions("rank").mapInArrow(scan, open_rows.select(*_COLUMNS).schema)


def _exclusive_keys(source_limit: int | None) -> list[tuple[str, Column]]:
    """Keys that at most one accepted row may hold; with a cap of one the source is such a key."""
    names = ["url", "title", "author"] + (["source"] if source_limit == 1 else [])
    return [(name, (F.col(name) != "") if name in ("title", "author") else F.lit(True)) for name in names]


def _marked(open_rows: DataFrame, accepted: _Accepted, source_limit: int | None) -> DataFrame:
    """Open rows; `won` are those that are the first open row of each of their keys and have a free source place."""
    keys = _exclusive_keys(source_limit)
    pairs = F.array_compact(
        F.array(*[
            F.when(present, F.struct(F.lit(name).alias("kind"), F.col(name).alias("value")))
            for name, present in keys
        ])
    )
    votes = (
        open_rows.select("rank", F.explode(pairs).alias("key"))
        .groupBy("key.kind", "key.value")
        .agg(F.min("rank").alias("rank"))
        .select("rank")
    )
    needed = reduce(lambda a, b: a + b, [F.when(present, 1).otherwise(0) for _, present in keys])
    if source_limit is not None and source_limit > 1:
        votes = votes.unionByName(_free_places(open_rows, accepted, source_limit))
        needed = needed + 1
    counted = votes.groupBy("rank").agg(F.count("*").alias("votes"))
    return open_rows.join(counted, "rank", "left").withColumn("won", F.coalesce(F.col("votes") == needed, F.lit(False))).drop("votes")


def _free_places(open_rows: DataFrame, accepted: _Accepted, source_limit: int) -> DataFrame:
    """Ranks of open rows whose place in their source is within the places left."""
    slim = open_rows.select("source", "rank")
    placed = leading_per_group(slim, source_limit, ["source"], ["rank"])
    if accepted.size.rows == 0:
        return placed.select("rank")
    used = accepted.rows.groupBy("source").agg(F.count("*").alias("used"))
    return (
        placed.join(used, "source", "left")
        .where(F.col("place") <= source_limit - F.coalesce("used", F.lit(0)))
        .select("rank")
    )


def _without_clashes(
    rows: DataFrame, winners: DataFrame, size: Size, accepted: _Accepted, source_limit: int | None, key_rows: int
) -> DataFrame:
    """Rows that share no key with `winners` and whose source is not full."""
    for name, _ in _exclusive_keys(source_limit):
        taken = winners.select(name) if name == "source" else winners.select(name).where(F.col(name) != "")
        rows = _drop_keys(rows, taken, name, size, key_rows)
    if source_limit is not None and 1 < source_limit <= accepted.size.rows:
        used = accepted.rows.groupBy("source").agg(F.count("*").alias("n"))
        full = used.where(F.col("n") >= source_limit).select("source")
        # The full sources are part of the accepted rows, so their size bounds them.
        rows = _drop_keys(rows, full, "source", accepted.size, key_rows)
    return rows


def _drop_keys(rows: DataFrame, taken: DataFrame, key: str, size: Size, key_rows: int) -> DataFrame:
    if size.fits_broadcast():
        return rows.join(F.broadcast(taken), key, "left_anti")
    return spread_join(rows, taken, key, "left_anti", ["rank"], key_rows)


def source_distribution(accepted: DataFrame) -> DataFrame:
    """Accepted rows for each source, most first, ties by the first accepted row."""
    return (
        accepted.groupBy("source")
        .agg(F.count("*").alias("n_articles"), F.min("rank").alias("first_rank"))
        .orderBy(F.desc("n_articles"), "first_rank")
    )
