"""Toxicity by a weighted lexicon, matched by Aho-Corasick on folded text."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.frames import sampled, shielded, texts_of
from newsloom.session import settle

# Look-alike letters of other scripts, and digits that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c", "т": "t", "у": "y",
    "х": "x", "і": "i", "ј": "j", "ѕ": "s", "ԁ": "d", "ո": "n", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i",
    "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}
# One shape for letters that a 1 or a bar may stand for.
SHAPES = {"l": "i", "|": "i"}


def _table() -> dict[int, str]:
    to = {chr(c): " " for c in range(128) if not chr(c).isalnum()}
    to |= {chr(c): chr(c).lower() for c in range(0x41, 0x250) if chr(c).isupper() and len(chr(c).lower()) == 1}
    to |= HOMOGLYPHS | {k.upper(): v for k, v in HOMOGLYPHS.items() if len(k.upper()) == 1 and not k.upper().isascii()}
    to |= DIGITS | SHAPES
    to |= {chr(0xFEE0 + c): to.get(chr(c), chr(c)) for c in range(0x21, 0x7F)}  # full-width forms
    return {ord(k): SHAPES.get(v, v) for k, v in to.items()}


FOLD = _table()
LOOSE = re.compile(r"[$@](?=[$@]*(?:\W|$))")


def fold(text: str) -> str:
    """One folded character for each character, between two spaces. After a word, `$` and `@` are punctuation."""
    if "$" in text or "@" in text:
        text = LOOSE.sub(" ", text)
    return f" {text.translate(FOLD)} "


@dataclass(frozen=True)
class Lexicon:
    """Folded terms, with a space before and, for whole words, after, and their weights; phrases in
    which a term does not count; coefficients of the score."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    coefficients: tuple[float, ...] = (-30.0, 0.0, 0.0, 0.0)

    def _key(self):
        return tuple(sorted(self.weights.items())), self.exceptions


@lru_cache(maxsize=4)
def _automaton(terms: tuple[tuple[str, float], ...], exceptions: tuple[str, ...]):
    automaton = ahocorasick.Automaton()
    for term, weight in terms:
        automaton.add_word(term, (len(term), weight, term))
    for phrase in exceptions:
        automaton.add_word(phrase, (len(phrase), None, phrase))
    if len(automaton):
        automaton.make_automaton()
    return automaton


def matches(folded: str, lexicon: Lexicon) -> list[tuple[int, int, float, str]]:
    """(start, end, weight, term) in places of the text, without those inside an exception phrase."""
    automaton = _automaton(*lexicon._key())
    if not len(automaton):
        return []
    hits = [(end + 1 - size, end + 1, weight, term) for end, (size, weight, term) in automaton.iter(folded)]
    spared = [(s, e) for s, e, weight, _ in hits if weight is None]
    return [
        (s, e - 1 - term.endswith(" "), weight, term.strip())
        for s, e, weight, term in hits
        if weight is not None and not any(a <= s and e <= b for a, b in spared)
    ]


def features(folded: str, lexicon: Lexicon) -> tuple[list[float], list]:
    """Sum of weights and the sum for each hundred words, both as log(1 + x), and the largest weight."""
    found = matches(folded, lexicon)
    total = sum(m[2] for m in found)
    length = 20 + folded.count(" ")
    return [float(np.log1p(total)), float(np.log1p(100 * total / length)), max((m[2] for m in found), default=0.0)], found


def _grown(words: list[str]) -> Iterator[str]:
    """Candidate terms of each word: the whole word, and beginnings of 3 to 9 characters."""
    for w in words:
        if len(w) >= 3:
            yield f" {w} "
        for n in range(3, min(10, len(w) + 1)):
            yield f" {w[:n]}"


def _counts(words_of):
    """Task that counts the terms in rows of either label; it holds at most 200,000 terms.

    A term that occurs n times in a row counts 1 + floor(log2(n)): every repeat counts, the later ones less.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("term", pa.string()), ("pos", pa.int64()), ("neg", pa.int64())])

        def rows(pos, neg):
            terms = list(pos.keys() | neg.keys())
            return pa.RecordBatch.from_arrays(
                [pa.array(terms, pa.string()), pa.array([pos[t] for t in terms], pa.int64()), pa.array([neg[t] for t in terms], pa.int64())],
                schema=schema,
            )

        pos, neg = Counter(), Counter()
        for batch in batches:
            for text, label in zip(texts_of(batch.column(0)), batch.column(1).to_pylist()):
                side = pos if label else neg
                for term, n in Counter(words_of(fold(text.decode()))).items():
                    side[term] += n.bit_length()
                if len(pos) + len(neg) > 200_000:
                    yield rows(pos, neg)
                    pos, neg = Counter(), Counter()
        yield rows(pos, neg)

    return run


def choose(rows: list[tuple[str, int, int]], positive: int, negative: int, terms: int) -> dict[str, float]:
    """Terms by weight times support; none that begins another chosen term or is begun by one."""
    def weight(pos, neg):
        return float(np.log((pos + 0.5) / (positive + 1)) - np.log((neg + 0.5) / (negative + 1)))

    rated = sorted(((weight(p, n) * p, len(t), t, weight(p, n)) for t, p, n in rows), reverse=True)
    chosen: dict[str, float] = {}
    for _, _, term, w in rated:
        if len(chosen) < terms and not any(term.startswith(c) or c.startswith(term) for c in chosen):
            chosen[term] = w
    return chosen


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> tuple[float, float, float]:
    """Logistic regression by Newton steps."""
    design = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(design.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (y - p) - ridge * beta
        curve = (design * (p * (1 - p))[:, None]).T @ design + ridge * np.eye(len(beta))
        beta = beta + np.linalg.solve(curve, slope)
    return tuple(float(b) for b in beta)


def learn(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
    rows: int = 20_000, terms: int = 1_000, support: int = 10, least: float = 2.0, exceptions: Sequence[str] = (),
) -> Lexicon:
    """Lexicon from about `rows` labelled documents, those with a small hash of the id.

    Terms are words and beginnings of words that occur `support` or more times under label 1 and
    whose log odds are `least` or more; at most `terms` are kept. `exceptions` are phrases in
    which a term does not count; pairs of a term and a neighbouring word that occur in `support`
    times, never under label 1, are added. Rows with a null id, label or text are left out; an id
    with several labels counts once for each. Without rows of both labels the lexicon is empty and
    every score is about 0. What reaches the driver is bounded by `rows` and by 20 * `terms`.
    """
    marks = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).select(
        F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_label"))
    # The picked rows are about `rows` ids and labels, so they may be broadcast.
    picked = sampled(marks, F.col("_id"), rows).distinct()
    sample = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).where("_text is not null").join(
        F.broadcast(picked), "_id").select("_text", "_label")
    sample = settle(sample)
    sizes = dict(map(tuple, sample.groupBy("_label").count().collect()))
    positive, negative = sizes.get(1, 0), sizes.get(0, 0)
    if not positive or not negative:
        return Lexicon()

    def counted(words_of):
        return sample.mapInArrow(_counts(words_of), "term string, pos long, neg long").groupBy("term").agg(
            F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))

    odds = F.log((F.col("pos") + 0.5) / (positive + 1)) - F.log((F.col("neg") + 0.5) / (negative + 1))
    found = (
        counted(lambda folded: _grown(folded.split())).where(F.col("pos") >= support).where(odds >= least)
        .orderBy((odds * F.col("pos")).desc(), F.length("term").desc(), "term").limit(20 * terms)
    )
    weights = choose(list(map(tuple, found.collect())), positive, negative, terms)
    plain = Lexicon(weights)

    def beside(folded):
        for s, e, _, _ in matches(folded, plain):
            first, last = folded.rfind(" ", 0, s), folded.find(" ", e + 1)
            word_end = folded.find(" ", s + 1)
            if folded[first: s].strip():
                yield folded[first: word_end + 1]
            after = folded.find(" ", word_end + 1)
            if after > word_end + 1:
                yield folded[s: after + 1]

    spared = counted(beside).where((F.col("pos") == 0) & (F.col("neg") >= support)).orderBy(F.col("neg").desc(), "term").limit(terms)
    phrases = sorted({f" {' '.join(fold(p).split())} " for p in exceptions} | {r["term"] for r in spared.collect()})
    lexicon = Lexicon(weights, tuple(phrases))

    def featured(batches):
        for batch in batches:
            values = [features(fold(t.decode()), lexicon)[0] for t in texts_of(batch.column(0))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v[i] for v in values], pa.float64()) for i in range(3)] + [batch.column(1)], names=["x", "y", "z", "label"])

    fitted = np.array([tuple(r) for r in sample.mapInArrow(featured, "x double, y double, z double, label int").collect()])
    fitted = fitted[np.lexsort(fitted.T)]
    return Lexicon(weights, tuple(phrases), fit(fitted[:, :3], fitted[:, 3]))


def score(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """`docs` with `toxicity` (0 to 1) and `toxic_spans`, the places of the matches in the text.

    Whole texts are read. A null or empty text has no match and the score of such a text. Columns
    with the names of the added ones are replaced.
    """
    @F.arrow_udf("struct<toxicity: double, toxic_spans: array<struct<start: int, end: int, term: string>>>")
    def scored(texts: pa.Array) -> pa.Array:
        first, *rest = lexicon.coefficients
        scores, spans = [], []
        for t in texts_of(texts):
            values, found = features(fold(t.decode()), lexicon)
            logit = first + sum(a * x for a, x in zip(rest, values))
            scores.append(1 / (1 + math.exp(-min(30.0, max(-30.0, logit)))))
            spans.append([{"start": s, "end": e, "term": term} for s, e, _, term in found])
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("term", pa.string())]))
        return pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(spans, kind)], names=["toxicity", "toxic_spans"])

    rows, columns = shielded(docs, ("toxicity", "toxic_spans"))
    return rows.withColumn("_found", scored(F.col(text))).select(*columns, "_found.toxicity", "_found.toxic_spans")
