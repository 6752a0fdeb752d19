import random

import public_tokenizers
import pytest
import regex
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.llm import byte_bpe
from tests.llm.helpers import documents

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
RANKS = byte_bpe.ranks_of(byte_bpe.read_ranks(PATH))
WHOLE = tiktoken.Encoding("whole", pat_str=PATTERN, mergeable_ranks=RANKS, special_tokens={})
PIECES = regex.compile(PATTERN)


def plainly(text):
    """Ids by the merge of the lowest rank, piece by piece."""
    ids = []
    for piece in PIECES.findall(text):
        parts = [bytes([b]) for b in piece.encode()]
        while len(parts) > 1:
            rank, at = min((RANKS.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 30:
                break
            parts[at: at + 2] = [parts[at] + parts[at + 1]]
        ids += [RANKS[p] for p in parts]
    return ids


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("aevr'srlm 1٣!?.\n\t\r\x0b\x1c  　é漢😀"), max_size=80), st.integers(3, 12), st.integers(6, 16))
def test_chunks_meet_at_true_boundaries(text, chunk, overlap):
    """Ends that two scans share are ends of the whole text's pieces, and a cut there changes no piece."""
    true = [m.end() for m in PIECES.finditer(text)]
    cuts, right = [], True
    for at in range(0, max(0, len(text) - chunk), chunk):
        own = min(chunk, len(text) - at)
        after = text[at + chunk: at + 2 * chunk + overlap]
        tail = byte_bpe.boundaries(text[at: at + own + overlap], own, overlap, False, PIECES)[1]
        head = byte_bpe.boundaries(after, min(chunk, len(after)), overlap, at + 2 * chunk >= len(text), PIECES)[0]
        common = set(tail) & set(head)
        right = right and bool(common)  # without a common end the chunks would be merged, and the next scan made anew
        if right:
            cuts.append(at + chunk + min(common))
    assert set(cuts) <= set(true)
    edges = [0, *cuts, len(text)]
    assert [p for a, b in zip(edges, edges[1:]) for p in PIECES.findall(text[a:b])] == PIECES.findall(text)


def texts():
    rng = random.Random(8)
    bits = ["the ", "Hello", "x'll", "'re", "'", "'s ", "!!", "...", "\n", "\n\n", "  ", " \t ", "123", " 45", "é", "漢字", "، ", "😀", "<|endoftext|>", " ", "　", "\x1c"]
    mixed = ["".join(rng.choice(bits) for _ in range(rng.randrange(900))) for _ in range(60)]
    runs = ["a" * 3000, " " * 3000 + "x", "x" + "\n" * 3000, "!" * 2000 + "a" * 2000 + "7" * 2000 + " " * 2000, "漢" * 2500, "word " * 200 + "y" * 1500 + " word" * 300]
    return mixed + runs + [None, "", " ", "'", "a'", "\x00"]


@pytest.mark.parametrize("chunk,overlap", [(16, 8), (100, 20), (700, 64), (byte_bpe.CHUNK, byte_bpe.OVERLAP)])
def test_table_equals_library(spark, chunk, overlap):
    rows = list(enumerate(texts()))
    rows += [(200, rows[3][1]), (3, rows[3][1]), (3, rows[3][1]), (None, rows[5][1])]
    docs = documents(spark, rows).selectExpr("*", "1 AS ids", "'x' AS _digest", "2 AS part")
    coded = byte_bpe.encode(docs, PATH, PATTERN, chunk=chunk, overlap=overlap)
    assert set(coded.columns) == {*docs.columns, "decoded"}
    got = sorted((repr((r["doc_id"], r["text"])), r["ids"], bytes(r["decoded"])) for r in coded.collect())
    want = sorted((repr((d, t)), WHOLE.encode_ordinary(t or ""), (t or "").encode()) for d, t in rows)
    assert got == want


def test_library_equals_plain_merges():
    for text in texts():
        if text and len(text) < 1500:
            assert WHOLE.encode_ordinary(text) == plainly(text)


def test_very_long_text(spark):
    rng = random.Random(2)
    long = "".join(rng.choice(["one ", "two, ", "três\n", "  four", "5", "'s"]) for _ in range(4_000_000))
    row = byte_bpe.encode(documents(spark, [(1, long), (2, "short")]), PATH, PATTERN).where("doc_id = 1").select("ids", "decoded").first()
    assert bytes(row["decoded"]) == long.encode() and row["ids"] == WHOLE.encode_ordinary(long)


def test_empty_table(spark):
    assert byte_bpe.encode(documents(spark, []), PATH, PATTERN).collect() == []
