import random

import pytest
import xxhash

from newsloom.llm import simhash
from newsloom.llm.components import components
from tests.llm.helpers import classes, documents


def plain_print(text, width=3, seed=42):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    shingles = [" ".join(words[i: i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed) for s in shingles]
    return sum(1 << bit for bit in range(64) if sum(h >> bit & 1 for h in hashes) * 2 > len(hashes))


def family(rows=250, seed=5):
    rng = random.Random(seed)
    words = [f"w{i}é" for i in range(60)]
    texts = [" ".join(rng.choices(words, k=rng.randint(0, 90))) for _ in range(rows // 4)]
    while len(texts) < rows:
        base = rng.choice(texts[: rows // 4]).split()
        for _ in range(rng.randint(0, 2)):
            if base:
                base[rng.randrange(len(base))] = rng.choice(words)
        texts.append(" ".join(base))
    return texts


@pytest.mark.parametrize("radius,block", [(2, 2048), (2, 4), (3, 8), (7, 16)])
def test_equals_brute_force(spark, radius, block):
    texts = [*family(), None, "", " \t\n", "One", "one", "a b", "A  b", "Ünï cödé"]
    prints = [plain_print(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= radius]
    want = classes(range(len(texts)), links)
    found = simhash.near_duplicates(documents(spark, list(enumerate(texts))), radius=radius, block=block).collect()
    assert {r["doc_id"]: r["component_id"] for r in found} == want
    assert {r["doc_id"]: r["prints"][0] % 2**64 for r in found} == dict(enumerate(prints))


def test_null_ids_repeats_and_clashing_columns(spark):
    rows = [(None, "a b c d"), (4, "a b c d"), (3, "a b c d"), (9, "x y z"), (9, "a b c d"), (2, "x y z"), (9, "x y z")]
    docs = documents(spark, rows).selectExpr("*", "1 AS prints", "2 AS node", "3 AS component_id", "4 AS key")
    found = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert found == sorted([(None, None), (4, 2), (3, 2), (9, 2), (9, 2), (2, 2), (9, 2)], key=str)


def test_empty_table(spark):
    assert simhash.near_duplicates(documents(spark, [])).collect() == []


def test_large_group_leaves_few_links(spark):
    rng = random.Random(1)
    base = rng.getrandbits(64)
    prints = list({base ^ (1 << rng.randrange(64)) for _ in range(500)} | {rng.getrandbits(64) for _ in range(200)})
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    nodes = spark.createDataFrame([(i, [p]) for i, p in enumerate(signed)], "node long, prints array<long>")
    links = [tuple(r) for r in simhash.near_links(nodes, simhash.segments(64, 2), 2, 1, block=8).collect()]
    true = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    assert all((prints[a] ^ prints[b]).bit_count() <= 64 for a, b in links)
    assert classes(range(len(prints)), links) == classes(range(len(prints)), true)


@pytest.mark.parametrize("radius", range(8))
def test_segments_cover_the_radius(radius):
    parts = simhash.segments(64, radius)
    assert sum(flips + 1 for _, _, flips in parts) >= radius + 1
    assert sum(width for _, width, _ in parts) == 64


def test_components(spark):
    rng = random.Random(3)
    links = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5)]
    frame = spark.createDataFrame([*links, (None, 1)], "a long, b long").repartition(5)
    found = {r["node"]: r["component"] for r in components(frame).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert found == classes(nodes, [(a, b) for a, b in links if a != b])
