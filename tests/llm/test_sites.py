import random

import pytest
from pyspark.sql import functions as F

from newsloom.llm import sites
from tests.llm.helpers import documents


def corpus(n=900, seed=6):
    """Junk on the site `bad`, on the path `fr` of `mixed`, and now and then elsewhere."""
    rng = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        host, lang = rng.choice(["good", "good", "mixed", "bad"]), rng.choice(["en", "fr"])
        junk = rng.random() < {"good": 0.02, "bad": 0.9}.get(host, 0.8 if lang == "fr" else 0.02)
        body = " ".join(f"w{rng.randrange(400)}" + ("%%%" if junk else "") for _ in range(rng.randint(20, 90)))
        rows.append((i, body, lang, host))
        marks.append((i, int(not junk)))
    return rows, marks


def quality(spark, rows, labels, coefficients="learn"):
    docs = documents(spark, rows)
    frame = spark.createDataFrame(labels, "doc_id long, quality int")
    model = sites.learn(docs, frame) if coefficients == "learn" else coefficients
    wide = docs.selectExpr("*", "1 AS host", "2 AS path", "3 AS _mark", "4 AS evidence")
    return {r["doc_id"]: r for r in sites.site_quality(wide, frame, F.col("source"), F.col("lang"), model).collect()}


def test_held_out_accuracy(spark):
    rows, marks = corpus()
    found = quality(spark, rows, [m for m in marks if m[0] % 5 != 1] + [(None, 1), (7, None)])
    held = [m for m in marks if m[0] % 5 == 1]
    assert sum(found[i]["kept"] == bool(q) for i, q in held) >= 0.97 * len(held)
    rates = {(r["host"], r["path"]): r["path_quality"] for r in found.values()}
    assert rates["good", "en"] > 0.9 > 0.3 > rates["bad", "fr"]
    assert rates["mixed", "en"] > 0.8 and rates["mixed", "fr"] < 0.4


def test_sparse_sites_shrink_toward_the_rate_of_all(spark):
    rows, marks = corpus()
    rows += [(5000, "w1 w2 w3", "en", "once"), (5001, "w1 w2 w3", "en", None), (5002, None, None, None), (5003, "", "en", "good")]
    found = quality(spark, rows, marks + [(5000, 0)], coefficients=None)
    overall = sum(q for _, q in marks) / len(marks)
    one = [r for r in found.values() if r["host"] == "once"][0]
    assert 0 < one["path_quality"] < overall and one["host_quality"] > one["path_quality"] * 0.5
    assert abs(found[5001]["path_quality"] - overall) < 0.25
    assert len(found) == len(rows) and all(0 < r["score"] < 1 for r in found.values())


def test_evidence_reads_whole_texts():
    clean = b" ".join(b"w%d" % i for i in range(5000))
    assert sites.features(clean) != sites.features(clean + b" " + b"%%% " * 4000)
    assert sites.features(b"")[0] == 1.0 and len(sites.features(b"")) == len(sites.features(clean))


@pytest.mark.parametrize("url,host,path", [
    ("https://User@Blog.Example.org:80/a/b?x=/c#d", "blog.example.org", "/a"), ("http://x.net", "x.net", ""), ("http://x.net/?q", "x.net", "/"), (None, "", ""), ("no url", "", ""),
])
def test_urls(spark, url, host, path):
    row = spark.createDataFrame([(url,)], "url string").select(sites.host_of("url").alias("h"), sites.path_of("url").alias("p")).first()
    assert (row["h"], row["p"]) == (host, path)


def test_one_label_and_empty_table(spark):
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    docs = documents(spark, [(1, "a b")])
    assert sites.learn(docs, labels) is None
    assert sites.site_quality(documents(spark, []), labels, F.col("source"), F.col("lang"), None).collect() == []
