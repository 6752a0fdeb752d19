"""Which of many searches a text meets, in one pass over the text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Up to so many searches are expressions of their own, which stay in generated code.
FEW = 32

Searches = tuple[tuple[str, tuple[str, ...]], ...]


class _Matcher:
    """An automaton of all words; each search waits at its longest word, which is rarest as a rule."""

    def __init__(self, searches: Searches):
        self.order = {name: i for i, (name, _) in enumerate(searches)}
        self.always = [name for name, words in searches if not any(words)]
        self.waiting: dict[str, list[tuple[str, frozenset[str]]]] = {}
        self.words = ahocorasick.Automaton()
        for name, words in searches:
            held = frozenset(w for w in words if w)
            for word in held:
                self.words.add_word(word, word)
            if held:
                self.waiting.setdefault(max(held, key=lambda w: (len(w), w)), []).append((name, held))
        self.words.make_automaton()

    def names(self, text: str) -> list[str]:
        found = {word for _, word in self.words.iter(text)} if len(self.words) else set()
        met = {name for word in found for name, held in self.waiting.get(word, ()) if held <= found}
        return sorted({*met, *self.always}, key=self.order.__getitem__)


@lru_cache(maxsize=2)
def _matcher(searches: Searches) -> _Matcher:
    return _Matcher(searches)


def met_searches(text: Column, searches: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The names of the searches `(name, words)` of which the text holds every word as a substring, in the
    given order; a search without words is met by every text, a null text meets none.

    Few searches are tests of their own. Of many the words form one automaton that reads each text once,
    so the plan does not grow with them and words of any length are found; it is sent to the tasks and is
    as large as the searches.
    """
    wanted: Searches = tuple((name, tuple(words)) for name, words in dict(searches).items())
    if len(wanted) <= FEW:
        tests = []
        for name, words in wanted:
            held = text.isNotNull()
            for word in words:
                held = held & F.contains(text, F.lit(word))
            tests.append(F.when(held, F.lit(name)))
        return F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")

    @F.arrow_udf("array<string>")
    def names(texts: pa.Array) -> pa.Array:
        matcher = _matcher(wanted)
        return pa.array([[] if t is None else matcher.names(t) for t in texts.to_pylist()], pa.list_(pa.string()))

    return names(text)
