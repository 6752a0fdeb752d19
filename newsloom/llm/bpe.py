"""BPE encoding and decoding, with long unsplit text joined from encoded halves."""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from newsloom.llm.frames import shielded, texts_of

# Characters of unsplit text that are encoded in one piece.
LEAF = 512
# Words of a generation whose encoding a task keeps.
KEPT_WORDS = 100_000
# Bytes of text whose new words are encoded together.
GROUP_BYTES = 1 << 19

Span = tuple[int, int, int]


def _spans(encoding, shift: int) -> list[Span]:
    return [(i, s + shift, e + shift) for i, (s, e) in zip(encoding.ids, encoding.offsets)]


def _clean(tokens: list[Span], at: int) -> bool:
    """Whether the text can be cut before token `at`: the bytes of one character may fill several tokens."""
    return at in (0, len(tokens)) or tokens[at][1] >= tokens[at - 1][2]


def join_halves(tok: Tokenizer, text: str, left: list[Span], right: list[Span], start: int, end: int) -> list[Span]:
    """Tokens of text[start:end] from those of its two halves.

    A window around the join is encoded anew. Where it gives a token of the left half and, further
    on, a token of the right half at their places, the halves are spliced there: every pair of
    neighbouring tokens has then been made by one encoding, and a sequence whose neighbouring pairs
    are such is the encoding of the whole. Else the window doubles, up to the whole text.
    """
    reach = 8
    while True:
        low, high = max(0, len(left) - reach), min(len(right), reach)
        while not _clean(left, low):
            low -= 1
        while not _clean(right, high):
            high += 1
        first = left[low][1] if low else start
        last = right[high - 1][2] if high < len(right) else end
        window = _spans(tok.encode(text[first:last], add_special_tokens=False), first)
        if low == 0 and high == len(right):
            return window
        head = 0 if low == 0 else None
        if low and window and window[0] == left[low]:
            head = 0
        tail = None
        if high == len(right):
            tail = (len(window), len(right))
        else:
            places = {t: i for i, t in enumerate(right[:high])}
            for j in range(len(window) - 2, -1, -1):
                if window[j] in places and _clean(window, j + 1) and _clean(right, places[window[j]] + 1):
                    tail = (j + 1, places[window[j]] + 1)
                    break
        if head is not None and tail is not None and tail[0] > 0:
            return left[:low] + window[: tail[0]] + right[tail[1]:]
        reach *= 2


def encode_long(tok: Tokenizer, text: str, leaf: int = LEAF) -> list[int]:
    """Ids of a text without white space, from halves of halves; the leaves are encoded as one batch."""
    bounds = [0, len(text)]
    while max(b - a for a, b in zip(bounds, bounds[1:])) > leaf:
        halves = [(a + b) // 2 for a, b in zip(bounds, bounds[1:])]
        bounds = sorted({*bounds, *halves})
    edges = list(zip(bounds, bounds[1:]))
    before = os.environ.get("TOKENIZERS_PARALLELISM", "true")
    os.environ["TOKENIZERS_PARALLELISM"] = "true"
    leaves = tok.encode_batch([text[a:b] for a, b in edges], add_special_tokens=False)
    os.environ["TOKENIZERS_PARALLELISM"] = before
    level = [(_spans(e, a), a, b) for e, (a, b) in zip(leaves, edges)]
    while len(level) > 1:
        joined = [
            (join_halves(tok, text, x, y, a, b), a, b)
            for (x, a, _), (y, _, b) in zip(level[::2], level[1::2])
        ]
        level = joined + level[len(joined) * 2:]
    return [t[0] for t in level[0][0]]


class Coder:
    """Encodes texts word by word: the pre-tokenizer drops white space, so words are independent."""

    def __init__(self, spec: str, leaf: int = LEAF):
        # A task has one core; threads of the library would only hold memory. The leaves of long text use them.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_str(spec)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.leaf = leaf
        self.pieces = {i: t for t, i in self.tok.get_vocab(with_added_tokens=True).items()}
        # Ids and decoding of words, in an older and a newer generation: a word that is not met again goes.
        self.old: dict[bytes, tuple[bytes, str]] = {}
        self.new: dict[bytes, tuple[bytes, str]] = {}

    def _pair(self, ids: list[int]) -> tuple[bytes, str]:
        return array("i", ids).tobytes(), " ".join(map(self.pieces.__getitem__, ids))

    def _known(self, words: set[bytes]) -> dict[bytes, tuple[bytes, str]]:
        """The newer generation, made to hold `words`."""
        if len(self.new) > KEPT_WORDS:
            self.old, self.new = self.new, {}
        missing = []
        for w in words:
            if w not in self.new:
                if w in self.old:
                    self.new[w] = self.old[w]
                else:
                    missing.append(w)
        short = [w for w in missing if len(w) <= self.leaf]
        for w, e in zip(short, self.tok.encode_batch_fast([w.decode() for w in short], add_special_tokens=False)):
            self.new[w] = self._pair(e.ids)
        for w in missing:
            if len(w) > self.leaf:
                self.new[w] = self._pair(encode_long(self.tok, w.decode(), self.leaf))
        return self.new

    def encode(self, texts: list[bytes]) -> tuple[list[bytes], list[str]]:
        """Ids, as the bytes of 32-bit numbers, and decoding of each text."""
        split = [t.split() for t in texts]
        known = self._known(set().union(*split))
        ids, decoded = [], []
        for words in split:
            parts = list(map(known.__getitem__, words))
            ids.append(b"".join([p[0] for p in parts]))
            decoded.append(" ".join([p[1] for p in parts if p[0]]))
        return ids, decoded


def check_spec(spec: str) -> None:
    """Refuse a tokenizer for which words are not independent or whose decoder joins otherwise."""
    kind = json.loads(spec)
    splits = kind["pre_tokenizer"].get("pretokenizers", [kind["pre_tokenizer"]])
    dropped = any(p["type"] == "Split" and p["behavior"] == "Removed" and p["invert"] and r"\s" in p["pattern"].get("Regex", "") for p in splits)
    if not dropped or kind["decoder"] is not None or kind["post_processor"] is not None:
        raise ValueError("the tokenizer must drop white space before the merges and join tokens by spaces")


def encode(docs: DataFrame, tokenizer: str, text: str = "text", leaf: int = LEAF) -> DataFrame:
    """`docs` with `ids` (array of int) and `decoded`, as the tokenizer at the path `tokenizer` gives
    them for the whole text without special tokens added; the decoding keeps special tokens.

    A null or empty text has no ids and an empty decoding. Strings of special tokens in a text are
    encoded as these tokens, as the library does. Columns named `ids` or `decoded` are replaced. The
    file is read by the driver and sent to the tasks; its size is that of a vocabulary.
    """
    with open(tokenizer, encoding="utf-8") as file:
        spec = file.read()
    check_spec(spec)
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    added = T.StructType().add("ids", T.ArrayType(T.IntegerType())).add("decoded", T.StringType())
    rows, columns = shielded(docs, ("ids", "decoded"))
    place, names = rows.columns.index(text), [*rows.columns, "ids", "decoded"]

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # For each task anew, so that no memory is held between tasks.
        coder = Coder(shared.value, leaf)
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                some = batch.slice(at, _rows_for(batch.column(place), at))
                ids, decoded = coder.encode(texts_of(some.column(place)))
                offsets = np.zeros(len(ids) + 1, dtype=np.int32)
                np.cumsum([len(i) // 4 for i in ids], out=offsets[1:])
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(ids), dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([*some.columns, lists, pa.array(decoded, pa.string())], names=names)
                at += some.num_rows

    return rows.mapInArrow(coded, T.StructType([*rows.schema.fields, *added.fields])).select(*columns, "ids", "decoded")


def _rows_for(texts: pa.Array, at: int) -> int:
    """Rows from `at` on that hold about GROUP_BYTES of text, one at least."""
    sizes = pc.fill_null(pc.binary_length(texts.slice(at, 4096)), 0).to_numpy()
    return max(1, int(np.searchsorted(np.cumsum(sizes, dtype=np.int64), GROUP_BYTES, side="right")))
