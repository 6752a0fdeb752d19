"""Curation: landing articles to the master list."""

from __future__ import annotations

from pyspark.sql import DataFrame

from newsloom.operators.interleave import dense_index, round_robin
from newsloom.operators.joins import hinted
from newsloom.operators.selection import greedy_select, in_blocks

# Defaults of the master list.
CANDIDATES = 50
SOURCE_LIMIT = 1


def ranked_articles(articles: DataFrame) -> DataFrame:
    """Round-robin rank and the selection keys of flat landing articles."""
    files = articles.select("path", "fetch_ts").distinct()
    return round_robin(articles, files).select("rank", "path", "pos", "url", "title", "author", "source")


def curate(
    articles: DataFrame, source_limit: int | None = SOURCE_LIMIT, goal: int | None = CANDIDATES
) -> DataFrame:
    """Selected articles with their 0-based `index` in the master list, `path` and `pos`."""
    ranked = in_blocks(ranked_articles(articles), goal)
    chosen = dense_index(greedy_select(ranked, source_limit, goal), rows=goal)
    return ranked.select("rank", "path", "pos").join(hinted(chosen), "rank")
