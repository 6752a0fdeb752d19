"""Gates, stages, goal cut and result records."""

import os
import re
import uuid

from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from newsloom.operators import gates, progress
from newsloom.operators.stages import NO_CLASSIFIER, NO_SUMMARIZER, stage_answer
from newsloom.plans.enrichment import enrich, enrich_until
from tests.standins import keyword_label, lead_summary

CATEGORIES = ["Cybersecurity"]
COLUMNS = "index bigint, url string, title string, source string, author string, text string, processed_at string"
BODY = "data breach " * 20


def candidates(spark, *cases):
    rows = [(i, f"u{i}", f"t{i}", "s", "a", BODY, "now") for i in range(len(cases))]
    rows = [tuple(dict(zip(COLUMNS_LIST, r), **c).values()) for r, c in zip(rows, cases)]
    return spark.createDataFrame(rows, COLUMNS)


COLUMNS_LIST = [c.split()[0] for c in COLUMNS.split(", ")]
LIMITS = {"min_content": 150, "chunk": 1000}


def test_each_row_ends_in_one_place(spark):
    rows = candidates(
        spark, {}, {"author": None}, {"author": "Unknown"}, {"url": " "}, {"text": None}, {"text": "x" * 149},
        {"text": "boom " * 40}, {"text": "tiny " * 40}, {"text": "odd breac " * 30}, {"text": "plain " * 40},
        {"title": None, "source": ""}, {"author": " "}, {"text": ""},
    )
    got = {r["index"]: r for r in enrich(rows, lead_summary, keyword_label, CATEGORIES, **LIMITS).collect()}
    error = {i: r["scrape_error"] or r["summary_error"] or r["classify_error"] for i, r in got.items()}
    assert [i for i, r in got.items() if r["success"]] == [0, 10, 11]
    assert got[0]["category"] == "Cybersecurity" and got[0]["summary"].startswith("**Lead** data breach")
    assert error[1] == error[2] == "No author" and got[1]["author"] == "Unknown" and got[1]["content"] is None
    assert error[3] == gates.NO_URL and error[4] == gates.NO_CONTENT and error[12] == gates.NO_TEXT
    assert error[5] == "ValueError: Content too short (149 chars, minimum is 150)"
    assert error[6] == "RuntimeError: no answer" and got[6]["content"] and got[6]["summary"] is None
    assert error[7] == "ValueError: Summary suspiciously short (5 chars) — possible API issue"
    assert error[8] == "KeyError: 'k'" and got[8]["summary"]
    assert error[9] == "Classified as 'Other' — not a valid category (must be one of: Cybersecurity)"
    assert got[10]["title"] == "Unknown" and got[10]["source"] == "Unknown"
    assert all(
        sum(r[c] is not None for c in ("scrape_error", "summary_error", "classify_error")) == (not r["success"])
        for r in got.values()
    )


def test_short_input_and_missing_stages(spark):
    rows = candidates(spark, {"text": "x" * 60}, {})
    got = enrich(rows, lead_summary, None, CATEGORIES, min_content=10, chunk=1000).orderBy("index").collect()
    assert got[0]["summary_error"] == "Input text too short to summarise (60 chars)"
    assert got[1]["classify_error"] == NO_CLASSIFIER and got[1]["summary"]
    got = enrich(rows, None, None, CATEGORIES, min_content=10, chunk=1000).orderBy("index").collect()
    assert got[1]["summary_error"] == NO_SUMMARIZER and got[1]["content"]


def test_blocks_equal_goal_cut_over_all(spark):
    cases = [{} if i % 3 == 0 else {"author": None} for i in range(40)]
    rows = candidates(spark, *cases)
    everything = enrich(rows, lead_summary, keyword_label, CATEGORIES, **LIMITS)
    want = sorted(r["index"] for r in progress.cut_at_goal(everything, 5).collect())
    for block in (1, 4, 100):
        got = enrich_until(rows, lead_summary, keyword_label, CATEGORIES, 5, first_block=block, **LIMITS)
        assert sorted(r["index"] for r in got.collect()) == want == list(range(13))
    short = enrich_until(rows, lead_summary, keyword_label, CATEGORIES, 99, first_block=8, **LIMITS)
    assert short.count() == 40


def test_goal_beyond_task_memory(spark, monkeypatch):
    rows = spark.range(50).select(F.col("id").alias("index"), (F.col("id") % 2 == 0).alias("success"))
    monkeypatch.setattr("newsloom.operators.progress.TOP_ROWS", 2)
    assert progress.cut_at_goal(rows, 10).count() == 19
    assert progress.cut_at_goal(rows, 26).count() == 50
    counters = progress.run_counters(progress.cut_at_goal(rows, 10), 10).first()
    assert (counters["total_processed"], counters["total_successful"], counters["goal_reached"]) == (19, 10, True)


def test_latest_record_of_a_hot_index(spark):
    rows = spark.createDataFrame([(1, i, f"v{i}") for i in range(30)] + [(2, 5, "x")], "index int, seq int, v string")
    assert {r["index"]: r["v"] for r in progress.latest_per_index(rows).collect()} == {1: "v29", 2: "x"}


def test_resume_and_labels(spark):
    rows = spark.createDataFrame([(i, "A" if i % 2 else "Other") for i in range(6)], "index int, category string")
    done = spark.createDataFrame([(1,), (1,), (4,)], "index int")
    assert sorted(r["index"] for r in progress.remaining(rows, done).collect()) == [0, 2, 3, 5]
    valid = spark.createDataFrame([("A",)], "category string")
    assert gates.keep_labelled(rows, valid).count() == gates.keep_labelled(rows, valid, "left_anti").count() == 3


def test_a_block_is_dealt_to_tasks_that_ask_once(spark, tmp_path):
    """Each task of a block loads its model once, and no prompt is sent twice."""
    folder = str(tmp_path)

    def counting(name, maker):
        def make():
            run = maker()
            open(f"{folder}/{name}-made-{uuid.uuid4().hex}", "w").close()

            def answers(texts):
                for _ in texts:
                    open(f"{folder}/{name}-asked-{uuid.uuid4().hex}", "w").close()
                return run(texts)

            return answers

        return make

    rows = candidates(spark, *[{}] * 30)
    done = enrich_until(rows, counting("sum", lead_summary), counting("label", keyword_label), CATEGORIES, 30, first_block=30, tasks=3, **LIMITS)
    assert done.where("success").count() == 30
    names = [name.rsplit("-", 1)[0] for name in os.listdir(folder)]
    assert 1 < names.count("sum-made") <= 3 and 1 < names.count("label-made") <= 3
    assert names.count("sum-asked") == names.count("label-asked") == 30


def test_a_stage_holds_the_texts_of_one_call(spark):
    """The stage is an Arrow function, so a batch is not turned into Python text as a whole; answers keep their rows."""
    def make():
        def run(texts):
            if len(texts) > 4:
                raise AssertionError("too many texts")
            return [ValueError("odd") if t == "5" else None if t == "7" else "r" + t for t in texts]
        return run

    rows = spark.range(0, 50, 1, 2).selectExpr("id", "if(id % 3 = 0, null, cast(id as string)) AS t")
    out = rows.select("id", stage_answer(make, F.col("t"), "none", 4).alias("a"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"ArrowEvalPython .*, {PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF}\b", plan)
    for row in out.collect():
        i = row["id"]
        want = (None, None) if i % 3 == 0 or i == 7 else (None, "ValueError: odd") if i == 5 else (f"r{i}", None)
        assert tuple(row["a"]) == want
