"""Enrichment of ordered candidates through the stage chain until a success goal is met."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.functions.prompts import label_prompt, summary_prompt
from newsloom.operators import gates
from newsloom.operators.progress import cut_at_goal, remaining
from newsloom.operators.stages import NO_CLASSIFIER, NO_SUMMARIZER, StageMaker, stage_answer
from newsloom.schemas import RESULT
from newsloom.session import settle
from newsloom.sources.store import Store

# Candidates of the first block for each success still wanted; blocks then grow.
BLOCK_FACTOR = 4


def enrich(
    candidates: DataFrame,
    summarize: StageMaker | None,
    classify: StageMaker | None,
    categories: Sequence[str],
    min_content: int = gates.MIN_CONTENT,
    chunk: int = gates.REPEAT_CHUNK,
) -> DataFrame:
    """Result record of each candidate `(index, url, title, source, author, text, processed_at)`.

    The cheap gates come first. A row that fails a gate is not sent to the stages behind it.
    """
    gated = candidates.withColumn(
        "content_stage", gates.content_outcome(F.col("url"), F.col("text"), min_content, chunk)
    )
    content = F.col("content_stage.value")
    ready = (
        gates.has_known_author(F.col("author")) & F.col("content_stage.ok")
        & gates.summary_input_error(content).isNull()
    )
    asked = gated.withColumn(
        "answer", stage_answer(summarize, F.when(ready, summary_prompt(content)), NO_SUMMARIZER)
    ).withColumn("summary_stage", gates.summary_outcome(content, F.col("answer")))
    summary = F.col("summary_stage.value")
    prompt = F.when(
        ready & F.col("summary_stage.ok"),
        label_prompt(gates.or_default(F.col("title"), "Unknown"), summary, categories),
    )
    labelled = asked.withColumn("answer", stage_answer(classify, prompt, NO_CLASSIFIER)).withColumn(
        "label_stage", gates.label_outcome(summary, F.col("answer"))
    )
    return gates.attribute(labelled, categories)


def enrich_until(
    candidates: DataFrame,
    summarize: StageMaker | None,
    classify: StageMaker | None,
    categories: Sequence[str],
    goal: int,
    first_block: int | None = None,
    store: Store | None = None,
    tasks: int | None = None,
    **limits: int,
) -> DataFrame:
    """Results up to the success that meets the goal, with the stages run on few rows beyond it.

    Candidates carry a dense 0-based `index`. They are processed in blocks of consecutive indexes;
    a block is kept before the next one starts, so nothing is sent to a model twice. The outcome
    equals the goal cut over the results of all candidates. The candidates of a block are dealt by index
    to `tasks` tasks, else to as many as the cluster has cores; a task calls a stage once at a time, so
    that is also the number of calls in flight.

    With a store the blocks are recorded there, and candidates it has results of are skipped, so
    a run that broke off can be resumed.
    """
    done = store.read_blocks() if store else candidates.sparkSession.createDataFrame([], RESULT)
    if store:
        candidates = remaining(candidates, done)
    span = candidates.agg(F.min("index").alias("first"), F.max("index").alias("last")).first()
    start, width = span["first"], first_block or max(BLOCK_FACTOR * goal, 1)
    while start is not None and start <= span["last"] and done.where("success").count() < goal:
        block = candidates.where((F.col("index") >= start) & (F.col("index") < start + width))
        dealt = block.repartition(tasks or block.sparkSession.sparkContext.defaultParallelism, "index")
        results = enrich(dealt, summarize, classify, categories, **limits)
        if store:
            store.write_block(results, start)
            done = store.read_blocks()
        else:
            done = done.unionByName(settle(results))
        start, width = start + width, 2 * width
    return cut_at_goal(done, goal)
