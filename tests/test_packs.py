"""Packed documents: written in a set number of files, read back by path, replaced by later versions."""

import glob
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from newsloom.sources import packs


def table(spark, rows):
    return spark.createDataFrame(rows, "path string, ord int, line string").repartition(5)


def bodies(spark, root, paths=None):
    return {r["path"]: r["body"] for r in packs.read_packed(spark, root, paths).collect()}


def files(root):
    return sorted(os.path.basename(f) for f in glob.glob(f"{root}/packs/*") + glob.glob(f"{root}/index/*"))


def test_documents_come_back_whole(spark, tmp_path):
    rng = random.Random(4)
    rows = [(f"/p{i}", n, rng.choice(["é", "", "two\nlines", "x" * rng.randrange(60), None])) for i in range(300) for n in range(rng.randrange(1, 9))]
    rows += [("/long", n, f"line {n} " + "y" * 50) for n in range(20_000)] + [(None, 1, "none"), ("", 0, "empty")]
    packs.write_packed(table(spark, rows), str(tmp_path), files=6)
    want = {}
    for path, _, line in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        want[path or ""] = want.get(path or "", "") + (line or "") + "\n"
    assert bodies(spark, str(tmp_path)) == want
    assert bodies(spark, f"file://{tmp_path}", ["/p7", "/long", "/none"]) == {p: want[p] for p in ("/p7", "/long") if p in want}
    assert len(glob.glob(f"{tmp_path}/packs/*.pack")) <= 6
    assert packs.packed_index(spark, str(tmp_path), ["/long"]).count() > 1  # in several packs
    lines = packs.read_lines(spark, str(tmp_path), ["/long"]).orderBy("part", "place").collect()
    assert [r["line"] for r in lines] == [line for _, _, line in rows if line and line.startswith("line ")]


def test_later_versions_win_and_repeated_ones_replace_themselves(spark, tmp_path):
    root = str(tmp_path)
    packs.write_packed(table(spark, [("/a", 0, "a1"), ("/b", 0, "b1"), ("/c", 0, "c1")]), root, version=1, files=2)
    packs.write_packed(table(spark, [("/b", 0, "b3")]), root, version=3, files=2)
    packs.write_packed(table(spark, [("/b", 0, "b2"), ("/c", 0, "c2")]), root, version=2, files=2)
    assert bodies(spark, root) == {"/a": "a1\n", "/b": "b3\n", "/c": "c2\n"}
    before = files(root)
    packs.write_packed(table(spark, [("/c", 0, "c2 again")]), root, version=2, files=2)
    assert bodies(spark, root) == {"/a": "a1\n", "/b": "b3\n", "/c": "c2 again\n"}
    assert len(files(root)) <= len(before) and packs.versions(root) == [1, 2, 3]
    packs.write_packed(table(spark, [("/z", 0, "z")]), root, version=0, overwrite=True, files=2)
    assert bodies(spark, root) == {"/z": "z\n"} and packs.versions(root) == [0] and len(files(root)) == 2
    packs.write_packed(table(spark, []), root, overwrite=True)
    assert bodies(spark, root) == {} and files(root) == []


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    root = str(tmp_path)
    packs.write_packed(table(spark, [("/a", 0, "a")]), root, files=2)
    rows = table(spark, [(f"/{i}", 0, str(i)) for i in range(50)])
    broken = rows.withColumn("line", F.when(F.col("path") == "/33", F.raise_error(F.lit("broken"))).otherwise(F.col("line")))
    with pytest.raises(Exception, match="broken"):
        packs.write_packed(broken, root, version=1, files=4)
    assert bodies(spark, root) == {"/a": "a\n"}


def test_many_documents_in_few_files(spark, tmp_path):
    n = 200_000
    rows = spark.range(n).select(F.format_string("/page/%07d", "id").alias("path"), F.lit(0).alias("ord"), F.concat(F.lit("<p>"), "id", F.lit("</p>")).alias("line"))
    packs.write_packed(rows, str(tmp_path), files=4)
    assert len(glob.glob(f"{tmp_path}/packs/*")) == 4 and len(glob.glob(f"{tmp_path}/index/*")) == 4
    assert bodies(spark, str(tmp_path), ["/page/0000000", "/page/0199999"]) == {"/page/0000000": "<p>0</p>\n", "/page/0199999": "<p>199999</p>\n"}
    assert packs.read_packed(spark, str(tmp_path)).agg(F.count("*"), F.sum(F.regexp_extract("body", r"(\d+)", 1).cast("long"))).first()[:] == (n, n * (n - 1) // 2)
    plan = packs.packed_index(spark, str(tmp_path), ["/page/0000007"])._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(path" in plan or "PushedFilters: [IsNotNull(path), EqualTo(path" in plan or "EqualTo(path" in plan


def test_a_large_document_has_a_task_of_its_own(spark, tmp_path, monkeypatch):
    """Tasks are dealt by the bytes that the index names, not by its own few rows: large documents never meet in one."""
    monkeypatch.setattr(packs, "LARGE", 1 << 16, raising=False)
    rows = [(f"/large{d}", n, f"line {n} é " + "y" * 50) for d in range(5) for n in range(3_000 + d)]
    rows += [(f"/small{i}", 0, "x\ny" if i == 7 else "x") for i in range(40)] + [("/none", 0, None)]
    packs.write_packed(table(spark, rows), str(tmp_path), files=3)
    read = packs.read_packed(spark, str(tmp_path)).select("path", F.md5("body").alias("body"), F.spark_partition_id().alias("task"))
    tasks, want = {}, {}
    for path, _, line in rows:
        want[path] = want.get(path, "") + (line or "") + "\n"
    for row in read.collect():
        tasks.setdefault(row["task"], []).append(row["path"])
        assert row["body"] == hashlib.md5(want.pop(row["path"]).encode()).hexdigest()
    assert not want
    assert all(len(paths) == 1 for paths in tasks.values() if any(p.startswith("/large") for p in paths))


def test_line_feeds_are_counted_where_documents_are_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(packs, "LARGE", 1 << 16, raising=False)
    rows = [("/long", n, "z" * 90) for n in range(3_000)] + [("/a", 0, "two\nlines"), ("/b", 0, None)]
    packs.write_packed(table(spark, rows), str(tmp_path), files=2)
    packs.write_packed(table(spark, [("/b", 0, "new"), ("/b", 1, "")]), str(tmp_path), version=1, files=2)
    found = packs.read_packed(spark, str(tmp_path), counted=True)
    assert found.columns == ["path", "body", "n_lines"]
    assert {r["path"]: r["n_lines"] for r in found.collect()} == {"/long": 3_000, "/a": 2, "/b": 2}
    assert all(r["n_lines"] == r["body"].count("\n") for r in found.collect())


def test_chosen_pages_as_folders(spark, tmp_path):
    packs.write_packed(table(spark, [("a", 0, "x"), ("a", 1, "y"), ("b", 0, "z")]), f"{tmp_path}/in", files=2)
    packs.export_folders(spark, f"{tmp_path}/in", ["a"], f"{tmp_path}/out")
    found = glob.glob(f"{tmp_path}/out/path=*/part-*")
    assert len(found) == 1 and open(found[0]).read() == "x\ny\n"
