"""Quality from document evidence and host and path posteriors, by hierarchical empirical Bayes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.frames import sampled, texts_of
from newsloom.session import settle

# Classes of bytes: upper case, lower case, digits, other printable signs.
CLASSES = np.zeros(256, dtype=np.int64)
CLASSES[0x21:0x7F] = 4
CLASSES[0x41:0x5B] = 1
CLASSES[0x61:0x7B] = 2
CLASSES[0x80:] = 2
CLASSES[0x30:0x3A] = 3
# Evidence beyond these odds says no more about a document.
BOUND = 12.0


def features(text: bytes) -> list[float]:
    """Shares that tell prose from junk, of the whole text."""
    words, lines = text.split(), text.split(b"\n")
    counts = np.bincount(CLASSES[np.frombuffer(text, dtype=np.uint8)], minlength=5)
    signs = max(1, counts[1:].sum())
    n, kinds = max(1, len(words)), max(1, len(set(words)))
    alone = sum(1 for w in words if len(w) == 1 and not w.isalnum())
    return [
        1.0, np.log1p(len(words)), np.log(kinds) / np.log(n) if n > 1 else 1.0, kinds / n, min(30.0, signs / n), counts[1] / signs,
        counts[3] / signs, counts[4] / signs, min(1.0, 10 * counts[4] / signs), alone / n, len(set(lines)) / len(lines), text.count(b"!!") / n,
    ]


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Coefficients of a logistic regression on columns as they are, by Newton steps on scaled ones."""
    mean, spread = x.mean(axis=0), x.std(axis=0)
    mean[0], spread[spread == 0], spread[0] = 0.0, 1.0, 1.0
    z = (x - mean) / spread
    beta = np.zeros(z.shape[1])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        pull = ridge * beta * (np.arange(len(beta)) > 0)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(beta)), z.T @ (y - p) - pull)
        beta += step
    raw = beta / spread
    raw[0] -= float(raw[1:] @ mean[1:])
    return raw


def _featured(column: str) -> Column:
    @F.arrow_udf("array<double>")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([features(t) for t in texts_of(texts)], pa.list_(pa.float64()))

    return of(F.col(column))


def learn(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = 20_000) -> np.ndarray | None:
    """Coefficients of the document classifier from about `rows` labelled documents, those with a
    small hash of the id; None without documents of both labels. Null ids, labels and texts are left out."""
    marks = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).select(
        F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label"))
    # The picked rows are about `rows` ids and labels, so they may be broadcast.
    picked = sampled(marks, F.col("_id"), rows).distinct()
    sample = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).where("_text is not null").join(F.broadcast(picked), "_id")
    data = np.array([[*r["x"], r["_label"]] for r in sample.select(_featured("_text").alias("x"), "_label").collect()])
    if not len(data) or len(set(data[:, -1])) < 2:
        return None
    data = data[np.lexsort(data.T)]
    return fit(data[:, :-1], (data[:, -1] > 0).astype(float))


def host_of(url: str) -> Column:
    """Host of a URL in lower case, without user and port; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path_of(url: str, depth: int = 1) -> Column:
    """First `depth` parts of the path of a URL."""
    path = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?", 1)
    return F.array_join(F.slice(F.split(path, "/"), 1, depth + 1), "/")


def _evidence(column: str, coefficients: np.ndarray) -> Column:
    @F.arrow_udf("double")
    def of(texts: pa.Array) -> pa.Array:
        found = np.array([features(t) for t in texts_of(texts)]).reshape(len(texts), len(coefficients))
        return pa.array(np.clip(found @ coefficients, -BOUND, BOUND))

    return of(F.col(column))


def _concentration(groups: DataFrame, mean: Column) -> Column:
    """Prior strength by moments: the spread of group rates beyond what their sizes explain."""
    mass, n = F.col("_good"), F.col("_n")
    expected = F.sum(mean * (1 - mean))
    between = F.sum((mass / n - mean) * (mass / n - mean) * n) - expected
    total = F.sum(n) - F.sum(n * n) / F.sum(n)
    variance = F.greatest(between / F.greatest(total, F.lit(1e-9)), F.lit(1e-6))
    return F.least(F.lit(1e4), F.greatest(F.lit(1.0), F.avg(mean * (1 - mean)) / variance - 1))


def site_quality(
    docs: DataFrame, labels: DataFrame, host: Column, path: Column, coefficients: np.ndarray | None,
    doc_id: str = "doc_id", text: str = "text", label: str = "quality", trust: float = 0.25,
) -> DataFrame:
    """Rows (doc_id, host, path, evidence, host_quality, path_quality, score, kept), one for each row of `docs`.

    `evidence` is the log odds of the document classifier on the whole text. A group's rate is the
    mean over its documents of the label, or, where there is none, of the classifier's probability,
    which counts `trust` of a document. Hosts shrink toward the rate of all documents and paths toward
    their host, each by a strength estimated from the spread of the groups, so a sparse site says
    little. `score` joins the evidence with the path's posterior as its prior odds; `kept` is a score
    of one half or more. Null hosts and paths are groups. A null or empty text has the evidence of an
    empty one. Without coefficients the evidence is the rate of the labels, or even odds. Several
    labels of one id count as their mean.

    Texts are read once. Groups are sums made in the map tasks; the rows are joined back as narrow
    rows, which Spark splits where a host is hot.
    """
    marks = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.avg((F.col(label) > 0).cast("double")).alias("_mark"))
    if coefficients is None:
        evidence = F.lit(0.0)
    else:
        evidence = _evidence(text, coefficients)
    read = docs.select(F.col(doc_id).alias("doc_id"), host.alias("host"), path.alias("path"), evidence.alias("evidence"))
    rows = settle(read.join(marks, F.col("doc_id") == F.col("_id"), "left").drop("_id"))
    chance = 1 / (1 + F.exp(-F.col("evidence")))
    weight = F.when(F.col("_mark").isNotNull(), F.lit(1.0)).otherwise(F.lit(trust))
    paths = settle(rows.groupBy("host", "path").agg(
        F.sum(weight).alias("_n"), F.sum(weight * F.coalesce("_mark", chance)).alias("_good"), F.count("*").alias("_rows")))
    hosts = paths.groupBy("host").agg(F.sum("_n").alias("_n"), F.sum("_good").alias("_good"))
    overall = paths.agg(((F.sum("_good") + 0.5) / (F.sum("_n") + 1)).alias("m")).first()["m"]
    base = F.lit(float(overall) if overall is not None else 0.5)
    strength = hosts.agg(_concentration(hosts, base).alias("s")).first()["s"] or 1.0
    hosts = hosts.select(F.col("host").alias("_h"), ((base * strength + F.col("_good")) / (strength + F.col("_n"))).alias("host_quality"))
    nested = settle(paths.join(settle(hosts), F.col("host").eqNullSafe(F.col("_h"))).drop("_h"))
    inner = nested.agg(_concentration(nested, F.col("host_quality")).alias("s")).first()["s"] or 1.0
    sites = settle(nested.select(
        F.col("host").alias("_h"), F.col("path").alias("_p"), "host_quality",
        ((F.col("host_quality") * inner + F.col("_good")) / (inner + F.col("_n"))).alias("path_quality")))
    same = F.col("host").eqNullSafe(F.col("_h")) & F.col("path").eqNullSafe(F.col("_p"))
    odds = F.col("evidence") + F.log(F.col("path_quality") / (1 - F.col("path_quality"))) - F.log(base / (1 - base))
    score = 1 / (1 + F.exp(-odds))
    return rows.join(sites, same, "left").select(
        "doc_id", "host", "path", "evidence", "host_quality", "path_quality", score.alias("score"), (score >= 0.5).alias("kept"))
