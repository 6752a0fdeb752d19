"""Fill-in-middle: cuts at unit ends, found by rank and select on a wavelet matrix of character classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.frames import shielded

# Classes of characters, three bits each.
NEWLINE, BLANK, STOP, MARK, DIGIT, LOWER, UPPER, BEYOND = range(8)
BITS = 3
# A unit ends after each character of these classes; what follows the last end is a unit too.
UNITS = {"line": (NEWLINE,), "sentence": (NEWLINE, STOP), "word": (NEWLINE, BLANK)}
# Bytes of text of one matrix, and of texts that are worked on together; a longer text fills several matrices.
BLOCK = 1 << 20
GROUP = 4 << 20
# Marks of the output.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def _class_table() -> np.ndarray:
    """Class of the first byte of a character; 255 for the bytes that follow it."""
    kinds = np.full(256, BEYOND, dtype=np.uint8)
    kinds[:128] = MARK
    for chars, kind in ((b" \t\x0b\x0c\r", BLANK), (b"\n", NEWLINE), (b".!?", STOP), (b"0123456789", DIGIT)):
        kinds[list(chars)] = kind
    kinds[ord("a"): ord("z") + 1] = LOWER
    kinds[ord("A"): ord("Z") + 1] = UPPER
    kinds[0x80:0xC0] = 255
    return kinds


CLASSES = _class_table()


class WaveletMatrix:
    """Rank and select of symbols below 2 ** bits, over numpy arrays of places.

    Each level holds one bit of every symbol, packed in words with the ones before each word; the
    next level has the symbols with a zero first. Bits take `bits` / 8 bytes a symbol, counts half of that.
    """

    def __init__(self, symbols: np.ndarray, bits: int = BITS):
        self.size, self.bits = len(symbols), bits
        self.words, self.ones, self.zeros = [], [], []
        for level in range(bits - 1, -1, -1):
            bit = (symbols >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(len(bit) // 64 + 1, dtype="<u8")
            words.view(np.uint8)[: len(packed)] = packed
            self.words.append(words)
            self.ones.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]))
            self.zeros.append(len(bit) - int(bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def _ones_before(self, level: int, at: np.ndarray) -> np.ndarray:
        word, inside = at >> 6, (at & 63).astype(np.uint64)
        low = (np.uint64(1) << inside) - np.uint64(1)
        return self.ones[level][word] + np.bitwise_count(self.words[level][word] & low)

    def _nth(self, level: int, nth: np.ndarray, bit: int) -> np.ndarray:
        """Place of the bit with `nth` equal ones before it."""
        before = self.ones[level] if bit else np.arange(len(self.ones[level])) * 64 - self.ones[level]
        word = np.searchsorted(before, nth, side="right") - 1
        bits = np.unpackbits(self.words[level][word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little") == bit
        return word * 64 + np.argmax(np.cumsum(bits, axis=1) > (nth - before[word])[:, None], axis=1)

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often `symbol` occurs before each place."""
        start, at = np.zeros(1, dtype=np.int64), np.asarray(at, dtype=np.int64)
        for level in range(self.bits):
            ones = self._ones_before(level, at), self._ones_before(level, start)
            if symbol >> (self.bits - 1 - level) & 1:
                at, start = self.zeros[level] + ones[0], self.zeros[level] + ones[1]
            else:
                at, start = at - ones[0], start - ones[1]
        return at - start

    def select(self, symbol: int, nth: np.ndarray) -> np.ndarray:
        """Place of the occurrence of `symbol` that has `nth` others before it; it must be there."""
        start = np.zeros(1, dtype=np.int64)
        for level in range(self.bits):
            ones = self._ones_before(level, start)
            start = self.zeros[level] + ones if symbol >> (self.bits - 1 - level) & 1 else start - ones
        at = start + np.asarray(nth, dtype=np.int64)
        for level in range(self.bits - 1, -1, -1):
            bit = symbol >> (self.bits - 1 - level) & 1
            at = self._nth(level, at - self.zeros[level] if bit else at, bit)
        return at


class UnitEnds:
    """Ends of units in a run of texts, from one matrix for each block of their bytes."""

    def __init__(self, blocks: Iterator[np.ndarray], classes: tuple[int, ...]):
        self.classes = classes
        self.matrices, sizes, ends = [], [0], [0]
        for codes in blocks:
            matrix = WaveletMatrix(codes)
            self.matrices.append(matrix)
            sizes.append(matrix.size)
            ends.append(int(self._counted(matrix, np.array([matrix.size]))[0]))
        self.starts, self.before = np.cumsum(sizes), np.cumsum(ends)

    def _counted(self, matrix: WaveletMatrix, at: np.ndarray) -> np.ndarray:
        return sum(matrix.rank(c, at) for c in self.classes)

    def _by_block(self, edges: np.ndarray, keys: np.ndarray, side: str, found) -> np.ndarray:
        out = np.zeros(len(keys), dtype=np.int64)
        block = np.clip(np.searchsorted(edges, keys, side=side) - 1, 0, max(0, len(self.matrices) - 1))
        for b in np.unique(block):
            mine = block == b
            out[mine] = found(b, keys[mine])
        return out

    def count(self, at: np.ndarray) -> np.ndarray:
        """Unit ends before each place."""
        if not self.matrices:
            return np.zeros(len(at), dtype=np.int64)
        return self._by_block(self.starts, at, "right", lambda b, k: self.before[b] + self._counted(self.matrices[b], k - self.starts[b]))

    def locate(self, nth: np.ndarray) -> np.ndarray:
        """Place after the `nth` end, counted from 1: by select, or for several classes by bisection on their ranks."""
        def inside(b: int, k: np.ndarray) -> np.ndarray:
            matrix, k = self.matrices[b], k - self.before[b]
            if len(self.classes) == 1:
                return self.starts[b] + matrix.select(self.classes[0], k - 1) + 1
            low, high = np.zeros(len(k), dtype=np.int64), np.full(len(k), matrix.size)
            while np.any(low < high):  # smallest place with k ends before it
                middle = (low + high) // 2
                enough = self._counted(matrix, middle) >= k
                low, high = np.where(enough, low, middle + 1), np.where(enough, middle, high)
            return self.starts[b] + low

        return self._by_block(self.before, nth, "left", inside)


def _codes(data: np.ndarray, block: int) -> Iterator[np.ndarray]:
    """Classes of the characters, by blocks of bytes; a character belongs to the block of its first byte."""
    for at in range(0, len(data), block):
        kinds = CLASSES[data[at: at + block]]
        yield kinds[kinds != 255]


def located(texts: pa.Array, first: np.ndarray, second: np.ndarray, classes: tuple[int, ...], block: int = BLOCK, group: int = GROUP):
    """For each text its units n, and the places after the smaller and the larger of `first` and `second` modulo n + 1 units."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    lengths = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    raw = texts.cast(pa.large_binary()).buffers()
    offsets = np.frombuffer(raw[1], dtype=np.int64)[texts.offset: texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(raw[2], dtype=np.uint8) if raw[2] is not None else np.empty(0, dtype=np.uint8)
    out = np.zeros((3, len(texts)), dtype=np.int64)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + group, side="right")) - 1)
        ends = UnitEnds(_codes(data[offsets[low]: offsets[high]], block), classes)
        size = lengths[low:high]
        stop = np.cumsum(size)
        start = stop - size
        before, last = ends.count(start), ends.count(np.maximum(stop - 1, start))
        closed = ends.count(stop) - before
        n = closed + ((size > 0) & (last == before + closed))
        picks = np.sort(np.stack([first[low:high] % (n + 1), second[low:high] % (n + 1)]), axis=0)
        out[0, low:high] = n
        for row, k in zip((1, 2), picks):
            place = np.where(k > closed, size, 0)
            inner = (k > 0) & (k <= closed)
            place[inner] = ends.locate((before + k)[inner]) - start[inner]
            out[row, low:high] = place
        low = high
    return out


def cuts(text: Column, first: Column, second: Column, unit: str = "line") -> Column:
    """Struct (n, head, tail): units of the text, and the code points before its two cuts.

    The cuts lie after the smaller and after the larger of `first` and `second` modulo n + 1 units;
    null texts count as empty. Whole texts are read: the classes of a long one fill several matrices.
    """
    classes = UNITS[unit]

    @F.arrow_udf("n long, head long, tail long")
    def places(texts: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        found = located(texts, a.to_numpy(zero_copy_only=False), b.to_numpy(zero_copy_only=False), classes)
        return pa.StructArray.from_arrays([pa.array(x) for x in found], names=["n", "head", "tail"])

    return places(text, first, second)


def draw(doc_id: str, seed: int, number: int) -> Column:
    """The `number`-th 32-bit group, from 1, of the SHA-256 of `seed:doc_id`; a null id counts as empty."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"), 256)
    return F.conv(F.substring(digest, 8 * number - 7, 8), 16, 10).cast("long")


def fill_in_middle(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: str = "line", seed: int = 7,
    rate: int = 100, suffix_first: int = 50,
) -> DataFrame:
    """`docs` with n (units), form, prefix_chars, middle_chars (code points) and output.

    Form is `plain` for an empty or null text, a text that holds a mark already, and for the documents
    beyond `rate` in 100; else `spm` for `suffix_first` in 100, and `psm`. All follow from a hash of
    the id, so reruns agree; rows that share an id share the draws, each cut in its own units, and so
    do rows without an id. Output of a plain text is the text; its cuts are null. Columns with the
    names of the results are replaced. Texts stay in the JVM but for the search of the two places.
    """
    names = ("n", "form", "prefix_chars", "middle_chars", "output")
    rows, columns = shielded(docs, names)
    whole = F.coalesce(F.col(text), F.lit(""))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains(whole, F.lit(mark))
    form = (
        F.when((whole == "") | marked | (draw(doc_id, seed, 3) % 100 >= rate), "plain")
        .when(draw(doc_id, seed, 4) % 100 < suffix_first, "spm").otherwise("psm")
    )
    placed = rows.withColumn("_cut", cuts(F.col(text), draw(doc_id, seed, 1), draw(doc_id, seed, 2), unit)).withColumn("form", form)
    head, tail = F.col("_cut.head").cast("int"), F.col("_cut.tail").cast("int")
    prefix = F.substring(whole, F.lit(1), head)
    middle = F.substring(whole, head + 1, tail - head)
    suffix = F.substr(whole, tail + 1)
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(whole)
    )
    cut = F.col("form") != "plain"
    return placed.select(
        *columns, F.col("_cut.n").alias("n"), "form", F.when(cut, F.col("_cut.head")).alias("prefix_chars"),
        F.when(cut, F.col("_cut.tail") - F.col("_cut.head")).alias("middle_chars"), output.alias("output"))


def restored(output: str = "output", form: str = "form") -> Column:
    """The text from which an output was made. Each mark occurs once in a cut output."""
    def before(mark: str, part: Column) -> Column:
        return F.substring_index(part, mark, 1)

    def after(mark: str) -> Column:
        return F.substring_index(F.col(output), mark, -1)

    def opening(mark: str) -> Column:
        return F.substr(F.col(output), F.lit(len(mark) + 1))

    return (
        F.when(F.col(form) == "psm", F.concat(before(SUFFIX, opening(PREFIX)), after(MIDDLE), before(MIDDLE, after(SUFFIX))))
        .when(F.col(form) == "spm", F.concat(before(MIDDLE, after(PREFIX)), after(MIDDLE), before(PREFIX, opening(SUFFIX))))
        .otherwise(F.col(output))
    )
