"""Language ID by a bidirectional gated recurrent network over bytes, trained in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsloom.llm.frames import shielded

UNITS = 8
# Bytes that run through the network as one sequence; a text is cut into such windows, all of them read.
WINDOW = 64
# Windows that are worked on together.
TOGETHER = 4096
UNDECIDED = "und"


@dataclass
class Network:
    """For each direction: `inputs` (3 units x 256), the gates' share of each byte; `states` (3 units x
    units); `bias` of the candidate's state part. Rows are reset, update and candidate. `out` and
    `shift` give the languages from both states."""

    languages: list[str]
    inputs: list[np.ndarray]
    states: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    shift: np.ndarray

    @classmethod
    def drawn(cls, languages: list[str], units: int = UNITS, seed: int = 11) -> Network:
        rng = np.random.default_rng(seed)

        def some(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        return cls(
            languages, [some(3 * units, 256, scale=0.3) for _ in "ab"], [some(3 * units, units, scale=0.4) for _ in "ab"],
            [np.zeros((units, 1), np.float32) for _ in "ab"], some(len(languages), 2 * units, scale=0.3), np.zeros((len(languages), 1), np.float32),
        )

    def parameters(self) -> list[np.ndarray]:
        return [*self.inputs, *self.states, *self.bias, self.out, self.shift]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _steps(length: int, way: int) -> range:
    return range(length) if way == 0 else range(length - 1, -1, -1)


def hidden(net: Network, windows: np.ndarray, live: np.ndarray | None, way: int, trace: list | None = None) -> np.ndarray:
    """States (length, units, windows) of one direction. `live` is 0 after the end of a window, where the
    state stays as it is. `trace` gets what the backward pass needs."""
    length, count = windows.shape
    units = net.states[way].shape[1]
    table, turn, bias = net.inputs[way], net.states[way], net.bias[way]
    states = np.empty((length, units, count), dtype=np.float32)
    state = np.zeros((units, count), dtype=np.float32)
    for t in _steps(length, way):
        given = table[:, windows[t]]
        led = turn @ state
        gates = _sigmoid(given[: 2 * units] + led[: 2 * units])
        reset, update = gates[:units], gates[units:]
        inner = led[2 * units:] + bias
        candidate = given[2 * units:] + reset * inner
        candidate *= 2
        candidate = _sigmoid(candidate) * 2 - 1  # tanh
        new = candidate + update * (state - candidate)
        if live is not None:
            new = state + live[t] * (new - state)
        if trace is not None:
            trace.append((t, state, reset, update, candidate, inner))
        states[t] = state = new
    return states


def position_probabilities(net: Network, windows: np.ndarray, live: np.ndarray | None = None) -> np.ndarray:
    """Probabilities (length, languages, windows) of every position."""
    both = [hidden(net, windows, live, way) for way in (0, 1)]
    units = net.states[0].shape[1]
    scores = np.matmul(net.out[:, :units], both[0]) + np.matmul(net.out[:, units:], both[1]) + net.shift
    scores -= scores.max(axis=1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=1, keepdims=True)
    return scores


def gradients(net: Network, windows: np.ndarray, live: np.ndarray, target: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Mean cross-entropy of the live positions and its gradients, by backpropagation through time."""
    units, count = net.states[0].shape[1], windows.shape[1]
    traces: list[list] = [[], []]
    both = [hidden(net, windows, live, way, traces[way]) for way in (0, 1)]
    scores = np.matmul(net.out[:, :units], both[0]) + np.matmul(net.out[:, units:], both[1]) + net.shift
    scores -= scores.max(axis=1, keepdims=True)
    np.exp(scores, out=scores)
    scores /= scores.sum(axis=1, keepdims=True)
    total = live.sum()
    loss = float(-(np.log(scores[:, target, np.arange(count)] + 1e-12) * live).sum() / total)
    wrong = scores.copy()
    wrong[:, target, np.arange(count)] -= 1
    wrong *= (live / total)[:, None, :]
    out = np.concatenate([np.einsum("tlc,tuc->lu", wrong, h) for h in both], axis=1)
    shift = wrong.sum(axis=(0, 2))[:, None]
    found: dict[str, list] = {"inputs": [], "states": [], "bias": []}
    for way in (0, 1):
        turn = net.states[way]
        reach = np.matmul(net.out[:, way * units: (way + 1) * units].T, wrong)
        d_table = np.zeros_like(net.inputs[way])
        d_turn, d_bias = np.zeros_like(turn), np.zeros_like(net.bias[way])
        carried = np.zeros((units, count), dtype=np.float32)
        for t, state, reset, update, candidate, inner in reversed(traces[way]):
            d_new = (carried + reach[t]) * live[t]
            passed = (carried + reach[t]) * (1 - live[t])
            d_candidate = d_new * (1 - update) * (1 - candidate**2)
            d_update = d_new * (state - candidate) * update * (1 - update)
            d_reset = d_candidate * inner * reset * (1 - reset)
            d_gates = np.concatenate([d_reset, d_update, d_candidate])
            d_led = np.concatenate([d_reset, d_update, d_candidate * reset])
            np.add.at(d_table.T, windows[t], d_gates.T)
            d_turn += d_led @ state.T
            d_bias += (d_candidate * reset).sum(axis=1, keepdims=True)
            carried = passed + d_new * update + turn.T @ d_led
        for name, value in (("inputs", d_table), ("states", d_turn), ("bias", d_bias)):
            found[name].append(value)
    return loss, [*found["inputs"], *found["states"], *found["bias"], out, shift]


def train(windows: np.ndarray, live: np.ndarray, target: np.ndarray, languages: list[str], steps: int = 500, batch: int = 192, seed: int = 3) -> Network:
    """Adam on batches drawn evenly from the languages."""
    net = Network.drawn(languages)
    rng = np.random.default_rng(seed)
    by_language = [np.flatnonzero(target == i) for i in range(len(languages))]
    values = net.parameters()
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for step in range(1, steps + 1):
        at = np.concatenate([rng.choice(own, max(1, batch // len(languages))) for own in by_language])
        _, slopes = gradients(net, windows[:, at], live[:, at], target[at])
        rate = 0.02 * min(1.0, 2 * (1 - step / (steps + 1)))
        for v, g, m, s in zip(values, slopes, first, second):
            g = np.clip(g, -1, 1).astype(np.float32)
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)
    return net


def cut(text: bytes, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(window, n) bytes of the whole text and 1 where a byte is there."""
    n = -(-len(text) // window)
    padded = np.zeros(n * window, dtype=np.uint8)
    padded[: len(text)] = np.frombuffer(text, dtype=np.uint8)
    live = np.zeros(n * window, dtype=np.float32)
    live[: len(text)] = 1
    return padded.reshape(n, window).T, live.reshape(n, window).T


def training_rows(docs: DataFrame, text: str, lang: str, doc_id: str, rows: int, least: int) -> DataFrame:
    """About the same number of distinct labelled rows for each language: `rows` shared by all, but `least` at least.

    A row is taken by a hash of its id, text and label, so null ids and hot ids are dealt like others, and
    rows that repeat each other count once. The share taken of a language follows from its distinct rows,
    of which few are all taken, so each language is learned, however rare.
    """
    labelled = docs.where(F.col(lang).isNotNull() & (F.length(text) > 0)).select(
        F.xxhash64(doc_id, text, lang).alias("h"), F.col(lang).alias("l"), F.encode(F.col(text), "utf-8").alias("t"))
    sizes = labelled.groupBy("l").agg(F.approx_count_distinct("h", 0.02).alias("n")).collect()
    wanted = max(least, rows // max(1, len(sizes)))
    share = [(r["l"], min(1 << 40, int(1.1 * wanted / r["n"] * (1 << 40)))) for r in sizes]
    # One row for each language, as in the output layer of the network.
    limits = F.broadcast(docs.sparkSession.createDataFrame(share, "l string, share long"))
    return labelled.join(limits, "l").where(F.pmod("h", F.lit(1 << 40)) < F.col("share")).drop("share")


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", rows: int = 3000, windows: int = 4, least: int = 30) -> Network | None:
    """A network of all languages that a row has, from about `rows` distinct rows, the same number of each
    language and at least about `least` of it (all, where it has fewer), and `windows` windows from each row,
    spread over its whole text. None if no document has a label and a text. The sample, about
    max(rows, least * languages) * windows * WINDOW bytes, is what the driver sees; the id deals rows to
    the sample and is no input.
    """
    sample = (
        training_rows(docs, text, lang, doc_id, rows, least)
        .select("h", "l", *(
            F.substring("t", (F.octet_length("t") * i / windows).cast("int") + 1, WINDOW).alias(f"w{i}") for i in range(windows)))
        .dropDuplicates(["h", "l"]).collect()
    )
    sample.sort(key=lambda r: (r["h"], r["l"]))
    known = sorted({r["l"] for r in sample})
    if not known:
        return None
    data, live, target = [], [], []
    for r in sample:
        for i in range(windows):
            a, b = cut(bytes(r[f"w{i}"]).ljust(1))
            data.append(a)
            live.append(b)
            target.append(known.index(r["l"]))
    return train(np.concatenate(data, axis=1), np.concatenate(live, axis=1), np.array(target), known)


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """Mean of the position probabilities of each whole text."""
    totals = np.zeros((len(texts), len(net.languages)))
    lengths = np.array([len(t) for t in texts])
    pieces = -(-lengths // WINDOW)
    owner = np.repeat(np.arange(len(texts)), pieces)
    first = np.cumsum(pieces) - pieces
    for at in range(0, len(owner), TOGETHER):
        last = min(at + TOGETHER, len(owner))
        parts = [
            cut(texts[d][max(0, at - first[d]) * WINDOW: (last - first[d]) * WINDOW])
            for d in range(owner[at], owner[last - 1] + 1)
        ]
        windows, live = (np.concatenate([p[i] for p in parts], axis=1) for i in (0, 1))
        shares = (position_probabilities(net, windows, live) * live[:, None, :]).sum(axis=0)
        np.add.at(totals, owner[at:last], shares.T)
    return totals / np.maximum(lengths, 1)[:, None]


def languages_of(text: str, net: Network | None) -> Column:
    """Column of struct<lang_pred, score> of whole texts; `und` and 0 for a text that is null or has no letter."""
    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def labelled(texts: pa.Array) -> pa.Array:
        names, scores = [UNDECIDED] * len(texts), [0.0] * len(texts)
        raw = [t or "" for t in texts.to_pylist()]
        at = [i for i, t in enumerate(raw) if any(c.isalpha() for c in t)]
        if net and at:
            for i, shares in zip(at, pooled(net, [raw[i].encode() for i in at])):
                best = int(shares.argmax())
                names[i], scores[i] = net.languages[best], min(1.0, float(shares[best]))
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    return labelled(F.col(text))


def identify(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """`docs` with `lang_pred` and `score`, the mean probability of that language over all bytes.

    Every byte of every text is read, in windows that run through the network in both directions. A
    null text and one without a letter get `und` and 0, as does every text without a network. Ties
    go to the first language by code point. Columns named as the added ones are replaced.
    """
    rows, columns = shielded(docs, ("lang_pred", "score"))
    return rows.withColumn("_found", languages_of(text, net)).select(*columns, "_found.lang_pred", "_found.score")
