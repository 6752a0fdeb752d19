import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsloom.llm import itq, topk
from tests.llm.helpers import classes

VECTORS = "vec_id long, embedding array<float>, label int"


def clusters(seed=0, dim=32):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((30, dim))
    rows = []
    for i in range(400):
        base = centres[rng.integers(30)] if i % 3 else rng.standard_normal(dim)
        rows.append((i, [float(x) for x in np.float32(base + 0.12 * rng.standard_normal(dim))], int(rng.integers(3))))
    hot = [float(x) for x in np.float32(centres[0])]
    rows += [(500 + i, [float(np.float32(x + 0.01 * rng.standard_normal())) for x in hot], 1) for i in range(150)]
    return rows + [(700 + i, hot, 1) for i in range(60)]


ODD = [
    (900, None, 1), (901, [0.0] * 32, 1), (902, [None] + [1.0] * 31, 1), (903, [math.inf] + [1.0] * 31, 1), (904, [math.nan] + [1.0] * 31, 1),
    (905, [1.0] * 32, None), (906, [], 1), (907, [1.0, 2.0], 1), (908, [2.0, 4.0], 1), (909, [1e-30, 2e-30], 1), (None, [1.0, 2.0], 1),
]


def plain_links(rows, least):
    kept = [(i, np.array(v, dtype=float), t) for i, v, t in rows
            if i is not None and t is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = []
    for a in range(len(kept)):
        for b in range(a):
            (i, x, s), (j, y, t) = kept[a], kept[b]
            if s == t and len(x) == len(y) and (x / abs(x).max()) @ (y / abs(y).max()) / np.linalg.norm(x / abs(x).max()) / np.linalg.norm(y / abs(y).max()) >= least:
                links.append((i, j))
    return links


@pytest.mark.parametrize("listed,block", [(64, 512), (4, 16)])
def test_near_vectors(spark, listed, block):
    rows = clusters() + ODD
    frame = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS node", "2 AS code", "3 AS v")
    found = itq.near_vectors(frame, listed=listed, block=block).collect()
    links = plain_links(rows, 0.93)
    degree = {i: 0 for i, _, _ in rows}
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    got = {r["vec_id"]: r for r in found}
    assert len(found) == len(rows)
    assert all(got[i]["n_links"] <= degree[i] for i in got)
    assert sum(r["n_links"] for r in found) >= 0.97 * 2 * len(links)
    whole = classes([i for i in degree if i is not None], links)
    assert sum(got[i]["component_id"] == whole[i] for i in whole) >= 0.98 * len(whole)
    assert all(r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"]) for r in found)
    assert got[909]["component_id"] == 907 and got[907]["n_links"] == 2 and got[None]["component_id"] is None


def test_near_vectors_of_nothing(spark):
    assert itq.near_vectors(spark.createDataFrame([], VECTORS)).collect() == []


def test_rotation_is_orthogonal():
    rows = itq.unit(np.random.default_rng(1).standard_normal((500, 24)))
    projection = itq.rotation(rows)[1]
    assert np.allclose(projection.T @ projection, np.eye(24))


def plain_top(rows, k, asked):
    kept = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, _ in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    out = []
    for q, a in kept:
        if asked(q):
            scores = sorted((-sum(x * y for x, y in zip(a, b)), j) for j, b in kept if j != q and len(a) == len(b))
            out += [(q, rank, j, -s) for rank, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows,query_rows", [(8192, 4096), (10, 7)])
def test_top_k(spark, shard_rows, query_rows):
    rows = clusters()[:300] + ODD + [(1000 + i, [1.0] * 32, 0) for i in range(40)] + [(2000, [1e18] * 32, 0), (2100, [3.0] * 32, 0)]
    frame = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS _id", "2 AS rank", "'x' AS shard").repartition(4)
    rows = [r for r in rows if r[0] != 2000]
    frame = frame.where("vec_id IS NULL OR vec_id <> 2000")
    found = topk.top_k(frame, F.col("vec_id") % 20 == 0, k=10, shard_rows=shard_rows, query_rows=query_rows)
    assert sorted(map(tuple, found.collect())) == plain_top(rows, 10, lambda q: q % 20 == 0)


def test_large_components_are_exact():
    a = np.array([[2**40 + 1, 3], [-(2**41), 5]])
    assert topk.product(a, a).tolist() == [[max(1 - 2**63, min(sum(x * y for x, y in zip(r, s)), 2**63 - 1)) for s in a.tolist()] for r in a.tolist()]


def test_top_k_of_nothing(spark):
    assert topk.top_k(spark.createDataFrame([], VECTORS), F.col("vec_id") % 100 == 0).collect() == []


def sharing(n, dim, common, seed):
    """Unit vectors of which two have the mean cosine `common`."""
    rng = np.random.default_rng(seed)
    direction = itq.unit(rng.standard_normal((1, dim)))
    return itq.unit(np.sqrt(common) * direction + np.sqrt(1 - common) * itq.unit(rng.standard_normal((n, dim))))


def partners_of(rows, towards, seed):
    """Partners at cosines from 0.93 to 0.99, turned in any direction or towards other rows."""
    rng = np.random.default_rng(seed)
    aside = np.roll(rows, 1, axis=0) - rows if towards else rng.standard_normal(rows.shape)
    aside = itq.unit(aside - np.einsum("ij,ij->i", rows, aside)[:, None] * rows)
    cosines = rng.uniform(0.93, 0.99, len(rows))
    return cosines[:, None] * rows + np.sqrt(1 - cosines**2)[:, None] * aside, cosines


@pytest.mark.parametrize("dim", [64, 256])
@pytest.mark.parametrize("common", [0, 0.3, 0.5, 0.7])
def test_recall_by_band_whatever_direction_is_shared(dim, common):
    rows = sharing(2000, dim, common, 1)
    model = itq.planned(rows, 0.93)
    for towards in (False, True):
        partners, cosines = partners_of(rows, towards, 2)
        differing = np.bitwise_count(itq.parts(rows, model) ^ itq.parts(partners, model))
        found = (differing.min(axis=1) <= 1) & (differing.sum(axis=1) <= model.reach)
        for low, high in ((0.93, 0.95), (0.95, 0.97), (0.97, 0.99)):
            band = (cosines >= low) & (cosines < high)
            assert found[band].mean() >= 0.95, (towards, low, model.tables)


def test_links_of_vectors_that_share_a_direction(spark):
    rows = sharing(400, 64, 0.6, 3)
    partners, _ = partners_of(rows, True, 4)
    pairs = [(i, [float(x) for x in v], 0) for i, v in enumerate(np.concatenate([rows, partners]))]
    found = itq.near_vectors(spark.createDataFrame(pairs, "vec_id long, embedding array<double>, label int")).collect()
    links = plain_links(pairs, 0.93)
    assert sum(r["n_links"] for r in found) >= 0.95 * 2 * len(links) and len(links) >= 390
