import hashlib
import math
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.helpers import classes, documents
from tests.llm.test_simhash import plain_print


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Toxic documents, copies, a shared passage, a hot source, odd rows."""
    rng = random.Random(12)
    vocabulary = [f"wörd{i}" for i in range(3000)]
    body = lambda n: " ".join(rng.choices(vocabulary, k=n))
    rows = [(i, body(rng.randint(30, 160)), "en", rng.choice(["a", "a", "a", "b", "c", None])) for i in range(240)]
    marks = [(i, int(i % 6 == 0), rng.randint(0, 1)) for i in range(200)]
    rows = [(i, t + (" Gr0mble SNURK" if i % 6 == 0 else ""), la, s) for i, t, la, s in rows]
    passage = body(70)
    rows += [(300 + i, f"{body(40)} {passage}\n{body(40)}", "fr", "b") for i in range(8)]
    rows += [(400 + i, rows[1][1], "en", "a") for i in range(5)]
    rows += [(410, rows[2][1] + " tail", "en", "c"), (500, None, "en", "a"), (501, "", "en", "a"), (502, "", "en", "a"), (None, "no id here", None, "c")]
    path = tmp_path_factory.mktemp("tables")
    documents(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, toxic int, quality int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def settled(spark, docs, path):
    docs.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def steps(spark, folder, tmp_path_factory):
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), []
    where = tmp_path_factory.mktemp("steps")
    for name, stage in corpus_pipeline.STAGES:
        after = settled(spark, stage(spark, docs, folder), f"{where}/{name}")
        out.append((docs, after))
        docs = after
    return out


def rows_of(frame):
    return [tuple(r) for r in frame.collect()]


def test_toxic_documents_go(steps):
    before, after = (rows_of(x) for x in steps[0])
    assert {r[0] for r in after} == {r[0] for r in before if "SNURK" not in (r[1] or "")}
    assert set(after) <= set(before)


def linked(texts):
    """Smallest index of the group of each text whose fingerprints are chained by at most two bits."""
    prints = [plain_print(t or "", 3, 42) for t in texts]
    return classes(range(len(texts)), [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2])


def test_one_of_each_group_of_copies_stays(steps):
    before, after = (rows_of(x) for x in steps[1])
    ided = sorted((r for r in before if r[0] is not None), key=lambda r: r[0])
    group = linked([r[1] for r in ided])
    want = [r for i, r in enumerate(ided) if group[i] == i] + [r for r in before if r[0] is None]
    assert sorted(map(str, after)) == sorted(map(str, want))
    assert {401, 402, 403, 404}.isdisjoint(r[0] for r in after) and 501 not in {r[0] for r in after}


def kept(spark, rows):
    docs = documents(spark, rows).selectExpr("*", "1 AS _key", "'x' AS goes")
    return sorted(map(str, (r[:2] for r in rows_of(corpus_pipeline.drop_near_copies(spark, docs, "")))))


def test_near_copies_are_those_of_fingerprints(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts = []
    for base in [rng.choices(vocabulary, k=150) for _ in range(25)]:
        for _ in range(6):
            copy = list(base)
            for at in rng.sample(range(150), rng.randint(0, 2)):
                copy[at] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    group = linked(texts)
    assert 26 < len(set(group.values())) < len(texts) - 10
    assert kept(spark, list(enumerate(texts))) == sorted(str(r) for r in enumerate(texts) if group[r[0]] == r[0])


def test_rows_that_repeat_an_id(spark):
    """Of equal rows one stays, and a row of an id does not go for another text of the same id."""
    one, two, three = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, one), (5, one), (5, one), (6, one), (7, two), (7, one), (8, three), (8, three), (None, one), (None, one), (9, ""), (9, "")]
    want = [(5, one), (7, two), (8, three), (None, one), (None, one), (9, "")]
    assert kept(spark, rows) == sorted(map(str, want))


def test_passages_are_cut_but_for_the_first(steps):
    before, after = ({r[0]: r for r in rows_of(x)} for x in steps[2])
    for i in range(301, 308):
        whole, left = before[i][1].split(), after[i][1].split()
        assert any(left == whole[:s] + whole[e:] for s in range(35, 41) for e in range(110, 116))
        assert after[i][4] == len(after[i][1])
    assert all(after[i][:4] == before[i][:4] for i in before if i is None or not 301 <= i < 308)


def test_mix_equals_a_plain_one(spark, folder, steps):
    before, after = (rows_of(x) for x in steps[3])
    weights = {r["doc_id"]: 2.0 if r["quality"] else 0.5 for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    sizes = {s: sum(len((r[1] or "").split()) for r in before if r[3] == s) for s in ("a", "b", "c", None)}
    share = dict(zip(("a", "b", "c", None), (5, 2, 1, 5)))
    target, rest = {}, 1.5 * sum(sizes.values())
    for s in sorted(sizes, key=lambda s: sizes[s] / share[s]):
        level = rest / sum(share[o] for o in sizes if o not in target)
        target[s] = min(2 * sizes[s], share[s] * level)
        rest -= target[s]

    def key(r):
        u = (int(hashlib.md5(str("" if r[0] is None else r[0]).encode()).hexdigest()[:13], 16) + 1) / 2**52
        return -math.log(u) / weights.get(r[0], 1.0)

    want = []
    for s in sizes:
        own = sorted((r for r in before if r[3] == s), key=key)
        epochs, left = int(target[s] // sizes[s]), math.floor(target[s] - target[s] // sizes[s] * sizes[s])
        for r in own:
            words = (r[1] or "").split()
            want += [(r[0], r[1])] * (epochs if words else 0)
            part = min(left, len(words))
            left -= part
            if part:
                want.append((r[0], r[1] if part == len(words) else " ".join(words[:part])))
    assert sorted(map(str, want)) == sorted(str(r[:2]) for r in after)
    assert all(r[4] == len(r[1]) for r in after)


def test_texts_are_encoded(steps):
    before, after = steps[4]
    tok = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    want = sorted((str(r["doc_id"]), tok.encode(r["text"], add_special_tokens=False).ids) for r in before.collect())
    assert sorted((str(r["doc_id"]), list(r["ids"])) for r in after.collect()) == want
    assert all(r["n_tokens"] == len(r["ids"]) and r["decoded"] == tok.decode(r["ids"], skip_special_tokens=False) for r in after.collect())


def test_stages_keep_the_columns(steps):
    for before, after in steps[:-1]:
        assert after.dtypes == before.dtypes


def test_run_applies_all_stages(spark, folder, steps):
    found = corpus_pipeline.run(spark, folder)
    assert sorted(map(str, rows_of(found))) == sorted(map(str, rows_of(steps[-1][1])))


def test_empty_documents(spark, folder, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
