"""Replaceable row stages that call a user's batch function in Arrow batches.

A stage is given as a maker, a function without arguments that runs once in each task and
returns the batch function, so that a model is loaded once for a task. The batch function takes a
list of prompts or texts and returns as many answers; an answer may be an exception.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BatchFunction = Callable[[Sequence[str]], Sequence[object]]
StageMaker = Callable[[], BatchFunction]

# The error of every row when a stage is not available.
NO_SUMMARIZER = "Summary stage not available"
NO_CLASSIFIER = "Label stage not available"

# Prompts of one call.
BATCH_SIZE = 256

ANSWER = "struct<value:string,error:string>"
ANSWERED = pa.struct([("value", pa.string()), ("error", pa.string())])


def stage_answer(make: StageMaker | None, text: Column, unavailable: str, batch_size: int = BATCH_SIZE) -> Column:
    """`(value, error)` of a stage for each row; rows whose text is null are not sent to it.

    Prompts are sent in lists of at most `batch_size`. An answer that is an exception becomes
    `Type: message` of its row, which is how a batch function should report a failing row: then
    nothing is sent twice. If the call itself raises, its list is halved until the failing rows stand
    alone, so a row is sent again at most log2(batch_size) times.
    """
    if make is None:
        return F.struct(F.lit(None).cast("string").alias("value"), F.lit(unavailable).alias("error"))

    @F.arrow_udf(ANSWER)
    def answer(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        run = make()

        def attempt(texts):
            try:
                return list(run(texts))
            except Exception as failure:  # the row keeps the error, the job goes on
                half = len(texts) // 2
                return [failure] if not half else attempt(texts[:half]) + attempt(texts[half:])

        for batch in batches:
            # Of the texts of a batch only those of one call, and their answers, are held as Python text.
            valid = batch.is_valid()
            sent, answers = pc.indices_nonzero(valid), [pa.array([], ANSWERED)]
            for at in range(0, len(sent), batch_size):
                texts = batch.take(sent.slice(at, batch_size)).to_pylist()
                given = attempt(texts)
                if len(given) != len(texts):
                    raise ValueError(f"{len(given)} answers to {len(texts)} texts")
                answers.append(pa.array([
                    {"value": None, "error": f"{type(a).__name__}: {a}"} if isinstance(a, Exception) else {"value": a, "error": None}
                    for a in given], ANSWERED))
            place = np.cumsum(valid.to_numpy(zero_copy_only=False)) - 1
            at = pa.array(place, mask=~valid.to_numpy(zero_copy_only=False))
            both = pa.concat_arrays(answers)
            yield pa.StructArray.from_arrays([both.field(i).take(at) for i in range(2)], names=["value", "error"])

    # A model may answer otherwise when asked again, so Spark must not repeat the call in a plan.
    return answer.asNondeterministic()(text)
