import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.llm import fim
from tests.llm.helpers import documents

ENDS = {"line": "\n", "sentence": "\n.!?", "word": "\n \t\x0b\x0c\r"}


def units(text, unit):
    marks = re.escape(ENDS[unit])
    return re.findall(f"[^{marks}]*[{marks}]|[^{marks}]+", text)


def plain(doc_id, text, unit="line", seed=7, rate=100, suffix_first=50):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i: 8 * i + 8], 16) for i in range(4)]
    found = units(text, unit)
    n = len(found)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (found[:low], found[low:high], found[high:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < suffix_first:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 7), max_size=700))
def test_rank_and_select(symbols):
    codes = np.array(symbols, dtype=np.uint8)
    matrix = fim.WaveletMatrix(codes)
    places = np.arange(len(codes) + 1)
    for symbol in range(8):
        assert matrix.rank(symbol, places).tolist() == [symbols[:i].count(symbol) for i in places]
        at = np.flatnonzero(codes == symbol)
        assert matrix.select(symbol, np.arange(len(at))).tolist() == at.tolist()


@settings(max_examples=150, deadline=None)
@given(
    st.lists(st.one_of(st.none(), st.text(alphabet="ab.!\n\r \t\x0b9é漢😀Z", max_size=40)), max_size=12),
    st.sampled_from(sorted(ENDS)), st.sampled_from([3, 16, 1 << 20]), st.sampled_from([1, 20, 1 << 20]), st.integers(0, 2**32 - 1))
def test_places_equal_split(texts, unit, block, group, draw):
    first = np.array([draw * (i + 1) % 2**32 for i in range(len(texts))], dtype=np.int64)
    second = first[::-1].copy()
    found = fim.located(pa.array(texts, pa.string()), first, second, fim.UNITS[unit], block, group)
    for i, text in enumerate(texts):
        parts = units(text or "", unit)
        low, high = sorted((first[i] % (len(parts) + 1), second[i] % (len(parts) + 1)))
        assert found[:, i].tolist() == [len(parts), len("".join(parts[:low])), len("".join(parts[:high]))]


TEXTS = [
    None, "", "\n", "one", "one\n", "one\ntwo", "é\n\n漢字\r\n😀 x\n" * 7, "has <P> inside\nand more", "<S", "<<M>x\n", "x<\ny<S\nz<P\n>\n" * 5,
    "long line " * 30_000 + "\n" + "line\n" * 50_000, "w" * 3_000_000, "  \n\t\n", "one\ntwo",
]


@pytest.mark.parametrize("unit,rate,suffix_first", [("line", 100, 50), ("word", 70, 30), ("sentence", 100, 100)])
def test_table_equals_plain_version(spark, unit, rate, suffix_first):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(i, t) for i in range(100, 160) for t in ("a\nb\nc. d e\nf",)] + [(None, "a\nb"), (5, "other\n\n"), (5, "other\n\n")]
    docs = documents(spark, rows).selectExpr("*", "7 AS _cut", "'x' AS output", "1 AS n")
    cut = fim.fill_in_middle(docs, unit=unit, rate=rate, suffix_first=suffix_first).withColumn("back", fim.restored())
    assert {"_cut", "lang", "source", "n_chars"} < set(cut.columns)
    got = sorted((repr((r["doc_id"], r["text"])), repr((r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]))) for r in cut.collect())
    assert got == sorted((repr((d, t)), repr(plain(d, t, unit, 7, rate, suffix_first))) for d, t in rows)
    assert cut.where("back <> coalesce(text, '') OR _cut <> 7").count() == 0


def test_empty_table(spark):
    assert fim.fill_in_middle(documents(spark, [])).collect() == []
