import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from newsloom.llm import bpe
from tests.llm.helpers import documents

PATH = public_tokenizers.path("word_bpe_49k.json")
TOK = Tokenizer.from_file(PATH)


def whole(text):
    return TOK.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aeiounrstlhd'sve!?.,-09éßİǺあ漢😀<|>"), max_size=120), st.sampled_from([1, 2, 5, 16]))
def test_tree_equals_whole(text, leaf):
    assert bpe.encode_long(TOK, text, leaf) == whole(text)


@pytest.mark.parametrize("text", ["a" * 5000, "theandofin" * 700, "ab1!" * 900, "é" * 1200, "don't've're" * 300])
def test_long_unsplit_text(text):
    assert bpe.encode_long(TOK, text, 64) == whole(text)


def test_words_equal_whole_texts(spark):
    rng = random.Random(4)
    bits = ["the", "Hello", "İstanbul", "x y", "　", "\x1c!", "<|endoftext|>", "a<|startoftext|>b", "'s", "é", "é", "'", "12", "́"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", "\n", "\t", "\x0b", "\x0c", "\r"]) for _ in range(30)) for _ in range(80)]
    texts += ["", None, "   ", "the " * 40000, "wordwithoutend" * 3000]
    docs = documents(spark, list(enumerate(texts))).selectExpr("*", "1 AS ids", "'x' AS decoded")
    for r in bpe.encode(docs, PATH).collect():
        ids = whole(texts[r["doc_id"]] or "")
        assert r["ids"] == ids
        assert r["decoded"] == TOK.decode(ids, skip_special_tokens=False)


def test_empty_table(spark):
    assert bpe.encode(documents(spark, []), PATH).collect() == []


def test_other_kinds_are_refused():
    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file, pytest.raises((ValueError, AttributeError, KeyError)):
        bpe.check_spec(file.read())
