"""LM scoring by prediction by partial matching over a byte-context trie."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.llm.frames import lower_words, texts_of
from newsloom.session import settle

# Bytes of context.
ORDER = 5
# Grams whose log10 probabilities the tasks hold; others are joined. Of a `Model`: its nodes, of which the rarest go.
NODES = 1_000_000
# Words whose counts the tasks hold; others are joined.
COMMON_WORDS = 100_000
# The byte before and after a text. It is white space, so no word holds it.
EDGE = b"\n"
SYMBOLS = 256


def spelled(text: bytes) -> bytes:
    """The tokens of a text as the model spells them: words in lower case, a space between, then the end;
    before them as many edges as there is context."""
    return EDGE * ORDER + b" ".join(lower_words(text)) + EDGE


def grams(spellings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each symbol after its ORDER bytes of context, and the number of symbols of each text."""
    buffer = np.frombuffer(b"".join(spellings), dtype=np.uint8)
    keys = np.zeros(max(0, len(buffer) - ORDER), dtype=np.int64)
    for at in range(ORDER + 1):
        keys <<= 8
        keys |= buffer[at: len(buffer) - ORDER + at]
    sizes = np.array([len(s) for s in spellings])
    starts = np.cumsum(sizes) - sizes
    inside = np.ones(len(keys), dtype=bool)
    for s in starts[1:]:
        inside[s - ORDER: s] = False
    return keys[inside], sizes - ORDER


def _count_grams(batches: Iterator[pa.RecordBatch], limit: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Counts of the grams of a task, brought together whenever `limit` keys wait. Rows are (text, learns);
    the lowest bit of a gram is set where its text is learned from."""
    def summed(keys, counts):
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        return keys[first], np.add.reduceat(counts, first)

    def rows(keys, counts):
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["gram", "n"])

    def counted(waiting, marks):
        keys, sizes = grams(waiting)
        return np.unique(keys << 1 | np.repeat(np.array(marks, dtype=np.int64), sizes), return_counts=True)

    kept = (np.empty(0, np.int64), np.empty(0, np.int64))
    waiting, marks, size = [], [], 0
    for batch in batches:
        texts, learns = texts_of(batch.column(0)), batch.column(1).fill_null(False).to_pylist()
        while texts or size:
            while texts and size < limit:
                waiting.append(spelled(texts.pop()))
                marks.append(learns.pop())
                size += len(waiting[-1])
            if size < limit:
                break
            keys, counts = counted(waiting, marks)
            kept = summed(np.concatenate([kept[0], keys]), np.concatenate([kept[1], counts]))
            waiting, marks, size = [], [], 0
            if len(kept[0]) > limit:
                yield rows(*kept)
                kept = (np.empty(0, np.int64), np.empty(0, np.int64))
    if waiting:
        keys, counts = counted(waiting, marks)
        kept = summed(np.concatenate([kept[0], keys]), np.concatenate([kept[1], counts]))
    if len(kept[0]):
        yield rows(*kept)


@dataclass
class Level:
    """The nodes of one depth. `keys` holds context and symbol, sorted, with `counts`; `contexts` the
    contexts, sorted. `total` and `kinds` are the counts and the number of symbols after a context;
    `rest` and `others` the same for the context one byte shorter, without the symbols seen here."""

    keys: np.ndarray
    counts: np.ndarray
    contexts: np.ndarray
    total: np.ndarray
    kinds: np.ndarray
    rest: np.ndarray | None = None
    others: np.ndarray | None = None


def _level(keys: np.ndarray, counts: np.ndarray) -> Level:
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order].astype(np.float64)
    first = np.flatnonzero(np.append(True, (keys[1:] >> 8) != (keys[:-1] >> 8)))[: len(keys)]
    if not len(keys):
        return Level(keys, counts, keys, counts, counts, counts, counts)
    return Level(keys, counts, keys[first] >> 8, np.add.reduceat(counts, first), np.diff(np.append(first, len(keys))).astype(np.float64))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Logs:
    """A hash table of log10 probabilities by gram."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(np.ceil(np.log2(max(1, 2 * len(keys))))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots, self.values = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.float32)
        at, waiting = self._slot(keys), np.arange(len(keys))
        while len(waiting):
            free = self.slots[at[waiting]] < 0
            places, first = np.unique(at[waiting[free]], return_index=True)
            placed = waiting[free][first]
            self.slots[places], self.values[places] = keys[placed], values[placed]
            waiting = np.setdiff1d(waiting, placed, assume_unique=True)
            at[waiting] = (at[waiting] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each key, 0 where it is not held, and the places of those that are not."""
        keys = np.ascontiguousarray(keys)
        out = np.zeros(len(keys))
        at, waiting = self._slot(keys), np.arange(len(keys))
        found, values = self.slots[at], self.values[at]
        hit = found == keys
        out[hit] = values[hit]
        open_ = ~hit & (found >= 0)
        missing = [waiting[found < 0]]
        waiting, at = waiting[open_], at[open_]
        while len(waiting):
            at = (at + 1) & self.mask
            found = self.slots[at]
            hit = found == keys[waiting]
            out[waiting[hit]] = self.values[at[hit]]
            missing.append(waiting[found < 0])
            open_ = ~hit & (found >= 0)
            waiting, at = waiting[open_], at[open_]
        return out, np.concatenate(missing)


class Model:
    """A trie in memory, as levels by depth, 0 to ORDER, and the deepest symbols' log10 probabilities. For
    samples and small tables; `score` joins a table of all grams instead."""

    def __init__(self, levels: list[Level]):
        self.levels = levels
        for depth in range(1, ORDER + 1):
            here, below = levels[depth], levels[depth - 1]
            short = (1 << 8 * depth) - 1
            at, _ = _find(below.keys, here.keys & short)
            inner, _ = _find(here.contexts, here.keys >> 8)
            parent, _ = _find(below.contexts, here.contexts & (short >> 8))
            seen = np.zeros(len(here.contexts))
            if len(here.keys):
                np.add.at(seen, inner, below.counts[at])
                here.rest = below.total[parent] - seen
                here.others = below.kinds[parent] - here.kinds
        top = levels[ORDER]
        inner, _ = _find(top.contexts, top.keys >> 8)
        self.top = Logs(top.keys, np.log10(top.counts / (top.total[inner] + top.kinds[inner])) if len(top.keys) else top.counts)

    def log10(self, keys: np.ndarray) -> np.ndarray:
        """Log10 probability of each symbol after its context. Most are in the hash table; the others are worked out."""
        out, rare = self.top.find(keys)
        out[rare] = self.escaped(keys[rare])
        return out

    def escaped(self, keys: np.ndarray) -> np.ndarray:
        """The same by walking down from the deepest context: at each one the symbol is predicted or escaped
        from, by the number of its symbols (method C), and symbols of deeper contexts are excluded."""
        out = np.zeros(len(keys))
        total, kinds = np.full(len(keys), np.nan), np.zeros(len(keys))  # of the context, less what is excluded
        open_ = np.arange(len(keys))
        for depth in range(ORDER, -1, -1):
            level = self.levels[depth]
            mine = keys[open_] & ((1 << 8 * (depth + 1)) - 1)
            at, known = _find(level.contexts, mine >> 8)
            fresh = known & np.isnan(total[open_])
            total[open_[fresh]], kinds[open_[fresh]] = level.total[at[fresh]], level.kinds[at[fresh]]
            sum_, q = total[open_], kinds[open_]
            place, hit = _find(level.keys, mine)
            if hit.any():
                out[open_[hit]] += np.log10(level.counts[place[hit]] / (sum_[hit] + q[hit]))
            miss = known & ~hit & (q > 0)
            out[open_[miss]] += np.log10(q[miss] / (sum_[miss] + q[miss]))
            if depth:
                down = known & ~hit
                total[open_[down]], kinds[open_[down]] = level.rest[at[down]], level.others[at[down]]
            open_ = open_[~hit]
        unseen = SYMBOLS - (self.levels[0].kinds[0] if len(self.levels[0].kinds) else 0)
        out[open_] -= np.log10(max(1.0, unseen))
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Log10 probability of the tokens of each text."""
        keys, sizes = grams([spelled(t) for t in texts])
        return np.add.reduceat(self.log10(keys), np.cumsum(sizes) - sizes)


def _counted(rows: DataFrame, text: str | Column, learns: Column) -> DataFrame:
    """Rows (gram, n, need): each gram of the texts, how often learning texts and how often all texts have it."""
    marked = rows.select(text, learns).mapInArrow(_count_grams, "gram long, n long")
    return settle(marked.groupBy(F.shiftright("gram", 1).alias("gram")).agg(
        F.sum(F.when(F.col("gram").bitwiseAND(F.lit(1).cast("long")) == 1, F.col("n")).otherwise(0)).alias("n"), F.sum("n").alias("need")))


def learn(texts: DataFrame, text: str, nodes: int = NODES) -> Model:
    """A model in memory of all texts. Every gram of the table is counted; the trie keeps the counts of `least`
    or more at all depths, where `least` is the smallest power of two that leaves at most `nodes` nodes."""
    counted = _counted(texts, text, F.lit(True))
    deep = counted.select("n", F.explode(F.array(*(
        F.struct(F.lit(d).alias("depth"), _low("gram", d + 1).alias("key")) for d in range(ORDER + 1)
    ))).alias("x"))
    tree = settle(deep.groupBy("x.depth", "x.key").agg(F.sum("n").alias("n")))
    power = F.floor(F.log2("n") + 1e-9).cast("int")
    by_power = dict(map(tuple, tree.groupBy(power.alias("p")).count().collect()))
    kept = tree.where(power >= _least(by_power, nodes)).toArrow()
    depth, key, n = (kept.column(c).to_numpy() for c in ("depth", "key", "n"))
    return Model([_level(key[depth == d], n[depth == d]) for d in range(ORDER + 1)])


def _low(column: str, size: int) -> Column:
    """The last `size` bytes of a key."""
    return F.col(column).bitwiseAND(F.lit((1 << 8 * size) - 1).cast("long"))


def probabilities(counted: DataFrame) -> DataFrame:
    """Rows (gram, need, log10) of rows (gram, n, need): the log10 probability of each gram's symbol after its
    context, by a trie of all grams with their counts n.

    The levels of the trie are tables. A gram that was learned is predicted by its own context. One that was
    not walks down the levels as in `Model.escaped`, by a join with the contexts and one with the symbols of
    each; only tables that the bytes bound, of at most 65,536 rows, are sent to all tasks. Of a level,
    at most 256 keys share all but their first byte, so no group of its windows and joins is hot.
    """
    learned = counted.where("n > 0")
    levels = [learned.select(F.col("gram").alias("key"), "n")]
    for size in range(ORDER, 0, -1):
        levels.insert(0, settle(levels[0].groupBy(_low("key", size).alias("key")).agg(F.sum("n").alias("n"))))
    sums = (F.sum("n").alias("total"), F.count("*").alias("kinds"))
    context = F.shiftright("key", 8).alias("context")
    nothing = F.lit(None).cast("long")
    contexts = [settle(levels[0].groupBy(context).agg(*sums).select("*", nothing.alias("rest"), nothing.alias("others")))]
    for depth in range(1, ORDER + 1):
        # Counts, one level up, of the symbols that a context has seen.
        shorter = levels[depth].withColumn("shorter", F.sum("n").over(Window.partitionBy(_low("key", depth))))
        own = shorter.groupBy(context).agg(*sums, F.sum("shorter").alias("seen"))
        up = contexts[-1].select(F.col("context").alias("_up"), F.col("total").alias("_total"), F.col("kinds").alias("_kinds"))
        contexts.append(settle(own.join(_small(up, depth - 1), _low("context", depth - 1) == F.col("_up")).select(
            "context", "total", "kinds", (F.col("_total") - F.col("seen")).alias("rest"), (F.col("_kinds") - F.col("kinds")).alias("others"))))
    seen = learned.join(contexts[ORDER], F.shiftright("gram", 8) == F.col("context")).select(
        "gram", "need", F.log10(F.col("n") / (F.col("total") + F.col("kinds"))).alias("log10"))

    number = F.lit(None).cast("double")
    open_ = counted.where("n = 0").select("gram", "need", F.lit(0.0).alias("out"), number.alias("log10"), nothing.alias("total"), nothing.alias("kinds"))
    for depth in range(ORDER, -1, -1):
        here = contexts[depth].select(*(F.col(c).alias(f"_{c}") for c in contexts[depth].columns))
        open_ = open_.join(_small(here, depth), F.shiftright(_low("gram", depth + 1), 8) == F.col("_context"), "left")
        if depth == ORDER:
            open_ = open_.withColumn("_n", nothing)
        else:
            keys = levels[depth].select(F.col("key").alias("_key"), F.col("n").alias("_n"))
            open_ = open_.join(_small(keys, depth + 1), _low("gram", depth + 1) == F.col("_key"), "left")
        total, kinds = F.coalesce("total", "_total"), F.coalesce("kinds", "_kinds")
        escape = F.when(kinds > 0, F.log10(kinds / (total + kinds))).otherwise(0.0)
        open_ = open_.select(
            "gram", "need", (F.col("out") + escape).alias("out"),
            F.coalesce("log10", F.col("out") + F.log10(F.col("_n") / (total + kinds))).alias("log10"),
            F.col("_rest").alias("total"), F.col("_others").alias("kinds"))
    never = math.log10(max(1, SYMBOLS - levels[0].count()))
    return settle(seen.unionAll(open_.select("gram", "need", F.coalesce("log10", F.col("out") - never))))


def _small(rows: DataFrame, size: int) -> DataFrame:
    """`rows`, one for each of some strings of `size` bytes, sent to all tasks if there can be few only."""
    return F.broadcast(rows) if size <= 2 else rows


def _least(by_power: dict[int, int], most: int) -> int:
    """The smallest power whose rows, with those of all larger ones, are at most `most`."""
    least = 0
    while sum(c for p, c in by_power.items() if p >= least) > most:
        least += 1
    return least


def _count_words(batches: Iterator[pa.RecordBatch], limit: int = 300_000) -> Iterator[pa.RecordBatch]:
    def rows(counts):
        return pa.RecordBatch.from_arrays(
            [pa.array(list(counts.keys()), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    counts = Counter()
    for batch in batches:
        for text in texts_of(batch.column(0)):
            counts.update(lower_words(text))
            counts[b""] += 1  # the end
            if len(counts) > limit:
                yield rows(counts)
                counts = Counter()
    yield rows(counts)


def score(docs: DataFrame, learns: str, doc_id: str = "doc_id", text: str = "text", nodes: int = NODES, common: int = COMMON_WORDS) -> DataFrame:
    """Rows (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one for each row of `docs`.

    The model and the base learn from the rows for which the condition `learns` holds; held_out is
    its negation. Tokens are the words, with A-Z in lower case, and one end. `base_score` is the log10
    probability by counts of tokens plus one; `score` that of the same tokens, spelled in bytes, by
    prediction by partial matching. A null text is the empty one, whose only token is the end. Rows
    that repeat an id are scored each. Other columns are ignored.

    Words are counted over all learning rows, and grams over all rows. Tasks hold the counts of at most
    `common` of the most frequent words and the log10 probabilities of at most `nodes` of the most frequent
    grams; what a text has beside them meets its values in a join, where no word and no gram is hot. So
    every count is used, and neither the driver nor a task holds the trie. Texts are read three times and
    never shuffled.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"), F.expr(learns).alias("_learns"))
    learning = rows.where("_learns")
    logs = probabilities(_counted(rows, "_text", F.col("_learns")))
    needed = F.floor(F.log2("need") * 4 + 1e-9).cast("int")
    often = _least(dict(map(tuple, logs.groupBy(needed.alias("p")).count().collect())), nodes)
    frequent = logs.where(needed >= often).select("gram", "log10").toArrow()
    model = Logs(*(frequent.column(c).to_numpy() for c in ("gram", "log10")))
    words = settle(learning.select("_text").mapInArrow(_count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")))
    sizes = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    below = float(sizes["n"] + sizes["v"] + 1)
    # At most `common` words, those of a count or more, so they may be sent to every task.
    power = F.floor(F.log2("n") * 4 + 1e-9).cast("int")
    least = _least(dict(map(tuple, words.groupBy(power.alias("p")).count().collect())), common)
    top = words.where(power >= least).toArrow()
    held = dict(zip(texts_of(top.column("word").combine_chunks()), top.column("n").to_pylist()))
    shared = docs.sparkSession.sparkContext.broadcast((model, held))

    @F.arrow_udf("struct<n_tokens: long, n_known: long, base: double, score: double, rest: array<string>, far: array<struct<gram: long, times: long>>>")
    def scored(texts: pa.Array) -> pa.Array:
        model, held = shared.value
        raw = texts_of(texts)
        logs = {w: math.log10((n + 1) / below) for w, n in held.items()} if raw else {}
        end = logs.get(b"")
        sizes, known, base, rest, total = [], [], [], [], []
        far: list[tuple] = []  # grams that are not held, their number in a text, and the grams of each text
        at = 0
        while at < len(raw):
            group, size = [], 0
            while at < len(raw) and (not group or size < 1 << 20):
                group.append(raw[at])
                size += len(raw[at])
                at += 1
            keys, lengths = grams([spelled(t) for t in group])
            values, missing = model.find(keys)
            total.append(np.add.reduceat(values, np.cumsum(lengths) - lengths))
            owner, keys = np.repeat(np.arange(len(group)), lengths)[missing], keys[missing]
            order = np.lexsort((keys, owner))
            owner, keys = owner[order], keys[order]
            first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (keys[1:] != keys[:-1])))[: len(keys)]
            far.append((keys[first], np.diff(np.append(first, len(keys))), np.bincount(owner[first], minlength=len(group))))
            for t in group:
                tokens = lower_words(t)
                found = [x for x in map(logs.get, tokens) if x is not None]
                sizes.append(len(tokens) + 1)
                known.append(len(found) + (end is not None))
                base.append(float(sum(found)) + (end if end is not None else np.log10(1 / below)))
                rest.append([w for w in tokens if w not in logs])
        offsets = np.zeros(len(rest) + 1, dtype=np.int32)
        np.cumsum([len(r) for r in rest], out=offsets[1:])
        words = pa.array([w for r in rest for w in r], pa.binary()).cast(pa.string())
        gram, times, number = (np.concatenate([f[i] for f in far]) if far else np.empty(0, np.int64) for i in range(3))
        places = np.append(0, np.cumsum(number)).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(gram, pa.int64()), pa.array(times, pa.int64())], names=["gram", "times"])
        return pa.StructArray.from_arrays(
            [pa.array(sizes, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64()),
             pa.array(np.concatenate(total) if total else [], pa.float64()), pa.ListArray.from_arrays(pa.array(offsets), words),
             pa.ListArray.from_arrays(pa.array(places), pairs)],
            names=["n_tokens", "n_known", "base", "score", "rest", "far"])

    read = settle(rows.select("doc_id", (~F.col("_learns")).alias("held_out"), scored("_text").alias("s"))
                  .select("doc_id", "held_out", "s.*", F.monotonically_increasing_id().alias("_row")))
    rare = read.select("_row", F.explode("rest").alias("word")).join(words, "word", "left")
    far = read.select("_row", F.explode("far").alias("f")).select("_row", "f.gram", "f.times").join(logs.where(needed < often), "gram")
    sums = rare.select(
        "_row", F.log10((F.coalesce("n", F.lit(0)) + 1) / F.lit(below)).alias("base"), F.col("n").isNotNull().cast("long").alias("known"), F.lit(0.0).alias("score"),
    ).unionAll(far.select("_row", F.lit(0.0), F.lit(0).cast("long"), F.col("times") * F.col("log10"))).groupBy("_row").agg(
        F.sum("base").alias("_base"), F.sum("known").alias("_known"), F.sum("score").alias("_score"))
    return read.drop("rest", "far").join(sums, "_row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(sizes["n"]).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("_score", F.lit(0.0))).alias("score"))
