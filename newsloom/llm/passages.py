"""Passages that repeat across documents: seeds joined, chained collinearly and aligned."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.frames import lower_words, shielded, texts_of
from newsloom.session import settle

# Words of a seed, and seeds of a window of which one is taken: texts that share K + WINDOW - 1 words share a seed.
K = 8
WINDOW = 16
# Words between two seeds of a chain at which their gap costs what a seed earns.
FAR = 64
GAP_COST = K / (2 * FAR)
# Words beside a chain that its alignment may take in, and words of a stored block.
FLANK = 32
BLOCK = 64
# A gap longer than this, of which less than half matches, ends a passage.
LOOSE = 8

ANCHOR = "doc_id long, pos int, source_id long, source_pos int"
LINK = f"seed long, {ANCHOR}"
PASSAGE = (
    "doc_id long, source_id long, start int, end int, source_start int, source_end int, identity double"
)


def word_hashes(text: bytes) -> np.ndarray:
    words = lower_words(text)
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words."""
    n = max(0, len(words) - k + 1)
    hashes = np.zeros(n, dtype=np.uint64)
    for at in range(k):
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + words[at: at + n]
    hashes ^= hashes >> np.uint64(31)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    hashes ^= hashes >> np.uint64(29)
    return hashes


def seeds(words: np.ndarray, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(seed, position): the smallest hash of k words in each window, once. Of equal hashes in a row one is
    kept for each window, so texts of one repeated word have few seeds."""
    n = len(words) - k + 1
    if n < 1:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    hashes = run_hashes(words, k)
    wide = min(window, n)
    low = np.lib.stride_tricks.sliding_window_view(hashes, wide).argmin(axis=1) + np.arange(n - wide + 1)
    at = low[np.append(True, low[1:] != low[:-1])]
    found = hashes[at]
    follows = np.append(False, (found[1:] == found[:-1]) & (np.diff(at) < window))
    run = np.maximum.accumulate(np.where(follows, 0, np.arange(len(at))))
    turn = (at - at[run]) // window
    keep = ~follows | np.append(True, turn[1:] != turn[:-1])
    return found[keep].view(np.int64), at[keep]


def _seed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0).to_numpy()
        parts = [seeds(word_hashes(t)) for t in texts_of(batch.column(1))]
        if parts:
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([s for s, _ in parts])), pa.array(np.repeat(ids, [len(s) for s, _ in parts])),
                pa.array(np.concatenate([p for _, p in parts]).astype(np.int32))], names=["seed", "doc_id", "pos"])


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where one of the columns changes from the row before; the first row counts as a change."""
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _anchors(batches: Iterator[pa.RecordBatch], linked: bool = False) -> Iterator[pa.RecordBatch]:
    """Rows (seed, doc_id, pos) sorted by all three become anchors on the first document of the seed.

    The t-th place of a document meets the t-th place of the first one, counted around. Of a seed
    only the places of its first document are held, however many documents share it. With `linked` the
    seed is a column too, and the places of the first document come as anchors on themselves, once
    another document has the seed. A fourth column says which rows ask for an anchor.
    """
    def out(s: np.ndarray, d: np.ndarray, p: np.ndarray, owner: np.ndarray, r: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(s), pa.array(d), pa.array(p.astype(np.int32)), pa.array(owner), pa.array(r.astype(np.int32))]
        names = ["seed", "doc_id", "pos", "source_id", "source_pos"]
        return pa.RecordBatch.from_arrays(columns, names=names) if linked else pa.RecordBatch.from_arrays(columns[1:], names=names[1:])

    seed = doc = last = None  # the row before
    source, places, nth = None, np.empty(0, np.int64), 0  # of the open seed; nth: places of the open document so far
    for batch in batches:
        s, d, p = (c.to_numpy().astype(np.int64) for c in batch.columns[:3])
        asked = batch.column(3).to_numpy(zero_copy_only=False) if batch.num_columns > 3 else np.ones(len(s), dtype=bool)
        new = _starts(s, d, p)
        if len(s) and (s[0], d[0], p[0]) == (seed, doc, last):
            new[0] = False
        s, d, p, asked = s[new], d[new], p[new], asked[new]
        if not len(s):
            continue
        by_seed, by_doc = _starts(s), _starts(s, d)
        goes_on, same_doc = s[0] == seed, (s[0], d[0]) == (seed, doc)
        first_seed = np.maximum.accumulate(np.where(by_seed, np.arange(len(s)), 0))
        first_doc = np.maximum.accumulate(np.where(by_doc, np.arange(len(s)), 0))
        turn = np.arange(len(s)) - first_doc
        if same_doc:
            turn[first_doc == 0] += nth
        owner, own = d[first_seed], first_doc == first_seed
        size = np.bincount(first_seed, weights=own, minlength=len(s)).astype(np.int64)[first_seed]
        held = np.zeros(len(s), dtype=bool)
        if goes_on:
            held = first_seed == 0
            if source == d[0]:
                places = np.concatenate([places, p[held & own]])
            owner = np.where(held, source, owner)
            size = np.where(held, len(places), size)
        r = p[np.minimum(first_seed + turn % size, len(p) - 1)]
        if held.any():
            r[held] = places[turn[held] % len(places)]
        keep = (d != owner) & asked
        if linked and goes_on and doc == source and keep[held].any():
            # Its places up to here were held; those in this batch are among them.
            first = np.full(len(places), source)
            yield out(np.full(len(places), seed), first, places, first, places)
        if linked:
            keep |= (np.bincount(first_seed, weights=keep, minlength=len(s))[first_seed] > 0) & ~held
            r = np.where(d == owner, p, r)
        if keep.any():
            yield out(s[keep], d[keep], p[keep], owner[keep], r[keep])
        if first_seed[-1] > 0 or not goes_on:
            open_ = first_seed == first_seed[-1]
            source, places = d[first_seed[-1]], p[open_ & own]
        seed, doc, last, nth = s[-1], d[-1], p[-1], turn[-1] + 1


def chains(p: np.ndarray, r: np.ndarray, earn: float = K, cost: float = GAP_COST) -> list[list[int]]:
    """Collinear chains of anchors (p, r), sorted by p, which are distinct: each chain ascends in both.

    The score of an anchor is what a seed earns and the best score before it less the cost of the gap
    in both texts. Gap costs are sums, so the best anchor before is a prefix maximum over r, kept in
    a Fenwick tree. Chains are cut out from the best end on; no anchor is in two.
    """
    rank = np.searchsorted(np.unique(r), r) + 1
    size = int(rank.max())
    best, place = [-np.inf] * (size + 1), [-1] * (size + 1)
    scores, before = [0.0] * len(p), [-1] * len(p)
    for i, (x, y, k) in enumerate(zip(p.tolist(), r.tolist(), rank.tolist())):
        top, at, node = -np.inf, -1, k - 1
        while node > 0:
            if best[node] > top:
                top, at = best[node], place[node]
            node -= node & -node
        gain = top - cost * (x + y)
        scores[i] = earn + max(0.0, gain)
        before[i] = at if gain > 0 else -1
        value, node = scores[i] + cost * (x + y), k
        while node <= size:
            if value > best[node]:
                best[node], place[node] = value, i
            node += node & -node
    used, out = [False] * len(p), []
    for end in sorted(range(len(p)), key=lambda i: (-scores[i], i)):
        chain = []
        while end >= 0 and not used[end]:
            used[end] = True
            chain.append(end)
            end = before[end]
        if chain:
            out.append(chain[::-1])
    return out


def _chain_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains of the anchors of each pair, which come sorted by pair and position."""
    def rows(table: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = np.flatnonzero(_starts(table[:, 0], table[:, 1]))
        out = []
        for a, b in zip(cuts, np.append(cuts[1:], len(table))):
            p, r = table[a:b, 2], table[a:b, 3]
            out += [(int(table[a, 0]), int(table[a, 1]), n, p[c].tolist(), r[c].tolist()) for n, c in enumerate(chains(p, r))]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        for at in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(c), k) for c, k in zip(zip(*out[at: at + 10_000]), kinds)], names=["doc_id", "source_id", "chain", "p", "r"])

    rest = np.empty((0, 4), dtype=np.int64)
    for batch in batches:
        rest = np.concatenate([rest, np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], axis=1)])
        cuts = np.flatnonzero(_starts(rest[:, 0], rest[:, 1]))
        if len(cuts) > 1:
            yield from rows(rest[: cuts[-1]])
            rest = rest[cuts[-1]:]
    if len(rest):
        yield from rows(rest)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, wanted blocks) to rows (doc_id, block, words), for blocks that are there."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            out = []
            for doc, text, wanted in zip(some.column(0).to_pylist(), texts_of(some.column(1)), some.column(2).to_pylist()):
                words = (word_hashes(text) & np.uint64(0x7FFFFFFF)).astype(np.int32)
                out += [(doc, b, words[b * BLOCK: (b + 1) * BLOCK]) for b in wanted if 0 <= b * BLOCK < len(words)]
            if out:
                yield pa.RecordBatch.from_arrays([
                    pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32()),
                    pa.array([o[2] for o in out], pa.list_(pa.int32()))], names=["at", "block", "words"])


def common_words(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, with a row of the table as the bits of a number."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        hits = row & places.get(y, 0)
        row = ((row + hits) | (row - hits)) & full
    return len(a) - row.bit_count()


def _stretch(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Words by which both texts go on alike, and how many of them match: +1 a match, -2 another word."""
    n = min(len(a), len(b))
    if not n:
        return 0, 0
    same = a[:n] == b[:n]
    score = np.cumsum(np.where(same, 1, -2))
    stop = np.flatnonzero(score < np.maximum.accumulate(np.maximum(score, 0)) - 8)
    score = score[: stop[0]] if len(stop) else score
    best = int(score.argmax()) if len(score) else 0
    return (best + 1, int(same[: best + 1].sum())) if len(score) and score[best] > 0 else (0, 0)


def align(a: np.ndarray, b: np.ndarray, p: list[int], r: list[int], k: int = K) -> list[tuple[int, int, int, int, float]]:
    """Passages (start, end, source start, source end, identity) along a chain of seeds of `k` words.

    Gaps are aligned by their longest common subsequence. A long gap that mostly differs ends a
    passage. Ends reach out as long as the words go on alike. identity is twice the matching words
    over the words of both sides.
    """
    parts: list[list[int]] = []  # start, end, source start, source end, matching words
    for x, y in zip(p, r):
        if x + k > len(a) or y + k > len(b) or x < 0 or y < 0 or not np.array_equal(a[x: x + k], b[y: y + k]):
            continue
        if not parts:
            parts.append([x, x + k, y, y + k, k])
            continue
        here = parts[-1]
        over = max(here[1] - x, here[3] - y, 0)
        if over >= k:
            continue
        left, right = a[here[1]: x + over], b[here[3]: y + over]
        if len(left) == len(right) and np.array_equal(left, right):
            match = len(left)
        else:
            match = common_words(left.tolist(), right.tolist())
        longest = max(len(left), len(right))
        if longest > LOOSE and 2 * match < longest:
            parts.append([x + over, x + k, y + over, y + k, k - over])
        else:
            parts[-1] = [here[0], x + k, here[2], y + k, here[4] + match + k - over]
    out = []
    for n, (s, e, t, u, match) in enumerate(parts):
        floor_a, floor_b = (parts[n - 1][1], parts[n - 1][3]) if n else (0, 0)
        more, same = _stretch(a[floor_a:s][::-1], b[floor_b:t][::-1])
        s, t, match = s - more, t - more, match + same
        top_a, top_b = (parts[n + 1][0], parts[n + 1][2]) if n + 1 < len(parts) else (len(a), len(b))
        more, same = _stretch(a[e:top_a], b[u:top_b])
        e, u, match = e + more, u + more, match + same
        out.append((s, e, t, u, 2 * match / (e - s + u - t)))
    return out


def _table(a: list[int], b: list[int]) -> Iterator[int]:
    """The rows of the table as numbers, before b and after each of its words; a bit is 0 where the length grows."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    yield row
    for y in b:
        hits = row & places.get(y, 0)
        row = ((row + hits) | (row - hits)) & full
        yield row


def _lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of b and each start of a."""
    row = 0
    for row in _table(a, b):
        pass
    bits = np.unpackbits(np.frombuffer(row.to_bytes(len(a) // 8 + 1, "little"), dtype=np.uint8), bitorder="little")[: len(a)]
    return np.append(0, np.cumsum(1 - bits.astype(np.int64)))


def matches(a: list[int], b: list[int], held: int = 1 << 26) -> list[tuple[int, int]]:
    """Places of one longest common subsequence, from the last to the first. A table of over `held` bits is
    not held: b is halved and a is cut where both halves together match most."""
    if len(b) > 1 and len(a) * len(b) > held:
        half = len(b) // 2
        cut = int((_lengths(a, b[:half]) + _lengths(a[::-1], b[half:][::-1])[::-1]).argmax())
        return [(i + cut, j + half) for i, j in matches(a[cut:], b[half:], held)] + matches(a[:cut], b[:half], held)
    rows = list(_table(a, b))
    out, i, j = [], len(a), len(b)
    while i and j:
        low = (1 << i) - 1
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif (rows[j - 1] & low).bit_count() == (rows[j] & low).bit_count():
            j -= 1
        else:
            i -= 1
    return out


def _matched(a: np.ndarray, b: np.ndarray, p: list[int], r: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in both texts of all words that match along a chain, its gaps and its ends."""
    out: list[tuple[int, int]] = []
    end = None  # the first places after the last seed
    for x, y in zip(p, r):
        if x + k > len(a) or y + k > len(b) or x < 0 or y < 0 or not np.array_equal(a[x: x + k], b[y: y + k]):
            continue
        over = 0
        if end is None:
            more, _ = _stretch(a[:x][::-1], b[:y][::-1])
            out += [(x - i, y - i) for i in range(more, 0, -1) if a[x - i] == b[y - i]]
        else:
            over = max(end[0] - x, end[1] - y, 0)
            if over >= k:
                continue
            left, right = a[end[0]: x + over].tolist(), b[end[1]: y + over].tolist()
            inner = [(i, i) for i in range(len(left))] if left == right else matches(left, right)[::-1]
            out += [(end[0] + i, end[1] + j) for i, j in inner]
        out += [(x + i, y + i) for i in range(over, k)]
        end = x + k, y + k
    if end is not None:
        more, _ = _stretch(a[end[0]:], b[end[1]:])
        out += [(end[0] + i, end[1] + i) for i in range(more) if a[end[0] + i] == b[end[1] + i]]
    both = np.array(out, dtype=np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def stretches(a: np.ndarray, b: np.ndarray, p: list[int], r: list[int], words: int, identity: float, k: int = K) -> list[tuple[int, int, int, int, float]]:
    """Passages of `words` words and that identity along a chain, from a match to a match, which cover all there are.

    A match scores 2 less the identity of its two words, any other word its identity below 0; a passage
    is any stretch that does not score below 0. From each start the farthest end is taken.
    """
    x, y = _matched(a, b, p, r, k)
    if not len(x):
        return []
    number = np.arange(len(x))
    before = 2.0 * number - identity * (x + y)
    after = 2.0 * (number + 1) - identity * (x + y + 2)
    farthest = np.searchsorted(-np.maximum.accumulate(after[::-1])[::-1], -before + 1e-9, side="right") - 1
    starts = np.flatnonzero((farthest >= number) & (x[np.maximum(farthest, 0)] + 1 - x >= words))
    out, at = [], 0
    while at < len(starts):
        # Of the starts up to the end of the last passage, the one that reaches farthest; else the next start.
        end = farthest[out[-1]] if out else -1
        inside = starts[at: np.searchsorted(starts, end, side="right")]
        if len(inside) and farthest[inside].max() > end:
            out.append(int(inside[farthest[inside].argmax()]))
        elif len(inside):
            at += len(inside)
            continue
        else:
            out.append(int(starts[at]))
        at = int(np.searchsorted(starts, out[-1], side="right"))
    found = []
    for i in out:
        j = farthest[i]
        s, e, t, u = int(x[i]), int(x[j]) + 1, int(y[i]), int(y[j]) + 1
        found.append((s, e, t, u, 2 * int(j - i + 1) / (e - s + u - t)))
    return found


def shared(a: np.ndarray, b: np.ndarray, p: list[int], r: list[int], words: int, identity: float) -> list[tuple[int, int, int, int, float]]:
    """The parts of a chain that are passages; where some are not, also the stretches of the chain that are."""
    parts = align(a, b, p, r)
    good = [x for x in parts if x[1] - x[0] >= words and x[4] >= identity]
    if len(good) == len(parts) or parts[-1][1] - parts[0][0] < words:
        return good
    at_most = sum(x[4] * (x[1] - x[0] + x[3] - x[2]) / 2 for x in parts) + sum(max(0, min(y[0] - x[1], y[2] - x[3])) for x, y in zip(parts, parts[1:]))
    if at_most < words * identity / (2 - identity) - 1e-6:
        return good
    return good + [x for x in stretches(a, b, p, r, words, identity) if not any(g[0] <= x[0] and x[1] <= g[1] for g in good)]


def _joined(blocks: list[tuple[int, list]], first: int) -> tuple[int, np.ndarray]:
    """Offset and words of the run of neighbouring blocks that holds block `first`."""
    held = dict(blocks)
    low = high = first
    while low - 1 in held:
        low -= 1
    while high + 1 in held and len(held[high]) == BLOCK:
        high += 1
    return low * BLOCK, np.concatenate([np.asarray(held.get(b, ()), dtype=np.int32) for b in range(low, high + 1)])


def _aligned(words: int, identity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                sides = [[(b["block"], b["words"]) for b in row["blocks"] if b["side"] == side] for side in (0, 1)]
                if not all(sides):
                    continue
                (x, a), (y, b) = (_joined(side, seeds[0] // BLOCK) for side, seeds in zip(sides, (row["p"], row["r"])))
                for s, e, t, u, same in shared(a, b, [v - x for v in row["p"]], [v - y for v in row["r"]], words, identity):
                    out.append((row["doc_id"], row["source_id"], s + x, e + x, t + y, u + y, same))
            kinds = [pa.int64(), pa.int64(), *(pa.int32(),) * 4, pa.float64()]
            names = ["doc_id", "source_id", "start", "end", "source_start", "source_end", "identity"]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=names)

    return run


def _by_seed(rows: DataFrame) -> DataFrame:
    return rows.repartition("seed").sortWithinPartitions("seed", "doc_id", "pos")


def _passages(texts: DataFrame, anchors: DataFrame, words: int, identity: float) -> DataFrame:
    """The passages along the chains of the anchors."""
    chained = settle(
        anchors.select("doc_id", "source_id", "pos", "source_pos").repartition("doc_id").sortWithinPartitions("doc_id", "source_id", "pos", "source_pos")
        .mapInArrow(_chain_rows, "doc_id long, source_id long, chain int, p array<int>, r array<int>")
    )

    def reach(column: str):
        low = F.greatest(F.lit(0), F.col(column)[0] - FLANK)
        return F.sequence((low / BLOCK).cast("int"), ((F.element_at(column, -1) + K + FLANK) / BLOCK).cast("int"))

    wanted = chained.select(
        "doc_id", "source_id", "chain", "p", "r",
        F.explode(F.concat(
            F.transform(reach("p"), lambda b: F.struct(F.lit(0).alias("side"), b.alias("block"))),
            F.transform(reach("r"), lambda b: F.struct(F.lit(1).alias("side"), b.alias("block"))))).alias("w"),
    ).select(
        "doc_id", "source_id", "chain", F.col("w.side").alias("side"), F.col("w.block").alias("_block"),
        F.when(F.col("w.side") == 0, F.col("doc_id")).otherwise(F.col("source_id")).alias("_at"))
    lists = settle(wanted.select("_at", "_block").distinct().groupBy("_at").agg(F.collect_list("_block").alias("_wanted")))
    blocks = texts.join(lists, F.col("doc_id") == F.col("_at")).select("doc_id", "text", "_wanted").mapInArrow(_blocks, "at long, block int, words array<int>")
    same = (F.col("_at") == F.col("at")) & (F.col("_block") == F.col("block"))
    parts = wanted.join(blocks, same).groupBy("doc_id", "source_id", "chain").agg(F.collect_list(F.struct("side", "block", "words")).alias("blocks"))
    return parts.join(chained, ["doc_id", "source_id", "chain"]).select("doc_id", "source_id", "p", "r", "blocks").mapInArrow(_aligned(words, identity), PASSAGE)


def _left_out(words: int):
    """Task over the linked places and the passages of documents: seeds of the runs of `words` words that hold
    a linked seed outside the passages. Such a run that is whole in another document has linked seeds all over."""
    def of(places: list, spans: list) -> tuple[np.ndarray, np.ndarray]:
        pos, seed = np.array([x["pos"] for x in places]), np.array([x["seed"] for x in places], dtype=np.int64)
        order = np.argsort(pos, kind="stable")
        pos, seed = pos[order], seed[order]
        edge = np.zeros(pos[-1] + K + 1, dtype=np.int64)
        for span in spans or ():
            edge[min(span["start"], len(edge) - 1)] += 1
            edge[min(span["end"], len(edge) - 1)] -= 1
        inside = np.append(0, np.cumsum(np.cumsum(edge) > 0))
        outside = pos[inside[pos + K] - inside[pos] < K]
        if not len(outside):
            return pos[:0], seed[:0]
        # Neighbouring seeds of a text lie at most two windows apart, equal ones included.
        breaks = np.append(True, np.diff(pos) > 2 * WINDOW)
        run = np.cumsum(breaks) - 1
        first, last = pos[breaks], pos[np.append(breaks[1:], True)]
        wide = (last - first)[run] >= words - K + 1 - 2 * WINDOW
        at = np.searchsorted(outside, pos)
        ahead = outside[np.minimum(at, len(outside) - 1)]
        behind = outside[np.maximum(at - 1, 0)]
        near = np.minimum(np.abs(ahead - pos), np.abs(behind - pos)) <= words - K
        return pos[wide & near], seed[wide & near]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            found = [of(row["places"], row["spans"]) for row in rows]
            if found:
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(np.array([row["doc_id"] for row in rows]), [len(p) for p, _ in found])),
                    pa.array(np.concatenate([p for p, _ in found]).astype(np.int32)),
                    pa.array(np.concatenate([s for _, s in found]))], names=["doc_id", "pos", "seed"])

    return run


def _runs(size: int):
    """Task over texts, places of seeds and those of them that ask: a key for each run of `size` words whose least
    seed is at such a place, and whether it asks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, text, places, asked in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = word_hashes(text)
                if len(words) < max(size, K):
                    continue
                wide = max(size, K) - K + 1
                least = np.lib.stride_tricks.sliding_window_view(run_hashes(words, K), wide).argmin(axis=1)
                least += np.arange(len(least))
                at = np.flatnonzero(np.isin(least, places))
                if len(at):
                    keys = run_hashes(words, max(size, K))[at].view(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys), pa.array(np.full(len(at), doc)), pa.array(at.astype(np.int32)), pa.array(np.isin(least[at], asked))],
                        names=["seed", "doc_id", "pos", "asked"])

    return run


def _thinned(size: int):
    """Task over anchors of runs of `size` words, sorted by pair, shift and place: anchors of seeds, one in K words."""
    reach = max(size, K) - K

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, pos, source, other = (batch.column(i).to_numpy().astype(np.int64) for i in range(4))
            starts = _starts(doc, source, other - pos, pos - np.arange(len(pos)))
            nth = np.arange(len(pos)) - np.maximum.accumulate(np.where(starts, np.arange(len(pos)), 0))
            ends = np.append(starts[1:], True) | (nth % K == 0)
            at, by = np.flatnonzero(ends), np.full(ends.sum(), reach)
            for offset in range(0, reach, K):
                at, by = np.append(at, np.flatnonzero(starts)), np.append(by, np.full(starts.sum(), offset))
            yield pa.RecordBatch.from_arrays(
                [pa.array(doc[at]), pa.array((pos[at] + by).astype(np.int32)), pa.array(source[at]), pa.array((other[at] + by).astype(np.int32))],
                names=["doc_id", "pos", "source_id", "source_pos"])

    return run


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 50, identity: float = 0.8) -> DataFrame:
    """Rows (doc_id, source_id, start, end, source_start, source_end, identity): passages of `words` words
    or more that a document shares with one of smaller id, of at least that identity.

    Places count words, with A-Z in lower case, from 0; `end` is the first word after. A passage may
    be found with several sources, and passages of one document may overlap. Documents without an
    id, a text or K words have none. Rows that repeat an id are one document and should agree.

    Each seed links its documents to the first of them, so the anchors do not grow with the square
    of a group, and a seed that many documents share passes through a task without being held. The
    anchors of a document are chained pair by pair. Alignments read blocks of words: only wanted ones
    are taken from the texts, and blocks of a source that many documents want are split by the join.
    """
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null and text is not null")
    rows = texts.mapInArrow(_seed_rows, "seed long, doc_id long, pos int")
    links = settle(_by_seed(rows).mapInArrow(lambda batches: _anchors(batches, linked=True), LINK))
    anchors = links.where("doc_id != source_id")
    found = settle(_passages(texts, anchors, words, identity))

    places = anchors.groupBy("doc_id").agg(F.collect_list(F.struct("pos", "seed")).alias("places"))
    spans = found.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    asking = settle(places.join(spans, "doc_id", "left").mapInArrow(_left_out(words), "doc_id long, pos int, seed long"))
    if asking.isEmpty():
        return found
    wanted = links.join(asking.select("seed").distinct(), "seed", "left_semi")
    asked = asking.select("doc_id", "pos", F.col("pos").alias("asked"))
    lists = wanted.join(asked, ["doc_id", "pos"], "left").groupBy(F.col("doc_id").alias("_at")).agg(
        F.collect_list("pos").alias("_places"), F.collect_list("asked").alias("_asked"))
    runs = texts.join(lists, F.col("doc_id") == F.col("_at")).select("doc_id", "text", "_places", "_asked").mapInArrow(
        _runs(words), "seed long, doc_id long, pos int, asked boolean")
    whole = _by_seed(runs).mapInArrow(_anchors, ANCHOR).withColumn("_shift", F.col("source_pos") - F.col("pos"))
    thin = whole.repartition("doc_id").sortWithinPartitions("doc_id", "source_id", "_shift", "pos").mapInArrow(_thinned(words), ANCHOR)
    same = ["doc_id", "source_id", "start", "end", "source_start", "source_end"]
    return found.unionByName(_passages(texts, thin, words, identity).join(found.select(*same), same, "left_anti").select(*found.columns))


WORDS = re.compile(rb"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*")


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A text without the words of the spans and the white space after them."""
    words = [m.span() for m in WORDS.finditer(text)]
    kept, at = [], 0
    for start, end in sorted(spans):
        start, end = max(0, start), min(end, len(words))
        if end > start:
            kept.append(text[at: max(at, words[start][0])])
            at = max(at, words[end - 1][1])
    return b"".join(kept) + text[at:]


def remove_passages(docs: DataFrame, passages: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` with the texts cut by their passages, and `removed_words`. The first document that holds a
    passage keeps it. Rows without passages are unchanged; a column `removed_words` is replaced."""
    spans = passages.groupBy(F.col("doc_id").alias("_at")).agg(F.collect_set(F.struct("start", "end")).alias("_spans"))

    @F.arrow_udf("string")
    def cut(texts: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([
            without(t, [(s["start"], s["end"]) for s in found]) if found else t
            for t, found in zip(texts_of(texts), spans.to_pylist())], pa.binary()).cast(pa.string())

    rows, columns = shielded(docs, ("removed_words",))
    whole = rows.join(spans, F.col(doc_id) == F.col("_at"), "left")
    part = whole.where("_spans is not null").withColumn("_cut", cut(F.col(text), F.col("_spans")))
    left = whole.where("_spans is null").withColumn("_cut", F.col(text))
    gone = F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")) - F.regexp_count("_cut", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0))
    both = part.unionAll(left).withColumn("_gone", gone.cast("long")).withColumn(text, F.col("_cut"))
    return both.select(*columns, F.col("_gone").alias("removed_words"))
