"""Conversation repair: rows stream in the order of their turns through a small dynamic program over roles."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsloom.session import settle

# Costs of the edits: a row may be kept, get another role, be deleted; a row without text may be inserted.
RENAME, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
# Roles read so far, as a state: nothing, a system row, a user row last, an assistant row last. The first and the last may end.
START, SYSTEM, USER, ASSISTANT = range(4)
ENDS = (START, ASSISTANT)
# What follows a state when a role may be chosen, and the role it gets.
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
# State after a row that keeps its role, by the first letter of the role.
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
LEGAL = {"su", "ua", "au"}
FINE, BLANK, REPEATED, CUT = range(4)
# A back pointer: where the path came from, how many rows were inserted before the row, and its edit.
LETTERS = "DKR"
WORDS = ["I" * (c >> 2) + LETTERS[c & 3] if c & 3 < 3 else "" for c in range(12)]

# Rows and characters of a conversation that a task holds; a longer one leaves in parts of that size.
HOLD_ROWS, HOLD_CHARS = 4096, 4 << 20
TOTALS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class Paths:
    """The cheapest edits up to a row, for each state that the roles can then be in.

    A configuration holds for each state its cost above the cheapest and the rank of its edits in the
    order of letters. Two ways of the same rows never begin each other, so the rank decides between ways
    that go on from different states. There are few configurations, and each step between them is
    worked out once in a task; a row then costs a look-up and four bytes of back pointers.
    """

    first = ((0, 0), None, None, None)

    def __init__(self):
        self.steps: dict = {}

    def step(self, config: tuple, initial: str, fault: int) -> tuple[int, tuple, int]:
        """Cost that the cheapest gains, the next configuration, and the back pointers of its states."""
        key = config, initial, fault
        if key not in self.steps:
            self.steps[key] = self._step(*key)
        return self.steps[key]

    def _step(self, config: tuple, initial: str, fault: int) -> tuple[int, tuple, int]:
        best: dict[int, tuple] = {}
        for origin, held in enumerate(config):
            if held is None:
                continue
            state = origin
            for inserted in range(3):  # two lead back to where one may go on
                edits = [("D", DELETE, state)]
                if fault in (FINE, CUT):
                    late = TRUNCATED if fault == CUT else 0
                    edits.append(("R", RENAME + late, NEXT[state]))
                    if (state, initial) in KEPT:
                        edits.append(("K", late, KEPT[state, initial]))
                for letter, cost, target in edits:
                    way = (held[0] + INSERT * inserted + cost, held[1], "I" * inserted + letter,
                           origin << 4 | inserted << 2 | LETTERS.index(letter))
                    if target not in best or way < best[target]:
                        best[target] = way
                state = NEXT[state]
        low = min(way[0] for way in best.values())
        ranks = {t: i for i, t in enumerate(sorted(best, key=lambda t: best[t][1:3]))}
        config = tuple((best[t][0] - low, ranks[t]) if t in best else None for t in range(4))
        return low, config, sum(best[t][3] << 8 * t for t in best)

    @staticmethod
    def end(config: tuple) -> tuple[int, int, int]:
        """Cost above the cheapest, state and rows to insert for the best way to end."""
        ways = []
        for origin, held in enumerate(config):
            state = origin
            for inserted in range(3 if held else 0):
                if state in ENDS:
                    ways.append((held[0] + INSERT * inserted, held[1], inserted, origin))
                state = NEXT[state]
        cost, _, inserted, origin = min(ways)
        return cost, origin, inserted


def traced(pointers: array, state: int) -> tuple[str, int]:
    """Edits of the rows whose back pointers are given, from the state after them; and the state before them."""
    words = []
    for packed in reversed(pointers):
        code = packed >> 8 * state & 255
        words.append(WORDS[code & 15])
        state = code >> 4
    return "".join(reversed(words)), state


def edited(edits: str, state: int, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits, from the state before them."""
    out: tuple[list[str], list[str]] = [], []
    rows = zip(roles, texts)
    for letter in edits:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter == "K":
            state = KEPT[state, role[:1]]
        else:
            state = NEXT[state]
            role = NAMES[state]
        out[0].append(role)
        out[1].append(text)
    return out


@dataclass
class _Open:
    """A conversation that is being read."""

    name: str | None
    config: tuple = Paths.first
    cost: int = 0
    part: int = 0
    chars: int = 0
    roles: list = field(default_factory=list)
    texts: list = field(default_factory=list)
    pointers: array = field(default_factory=lambda: array("I"))
    faults: list = field(default_factory=lambda: [0, 0, 0, 0])
    illegal: int = 0
    before: str | None = None
    turns: list = field(default_factory=list)  # the first and the last
    distinct: int = 0


_PARTS = ("conv string, part int, last boolean, edits string, pointers binary, state int, inserted int, "
          "roles array<string>, texts array<string>, " + ", ".join(f"{t} long" for t in TOTALS))


def _streamed(hold_rows: int, hold_chars: int):
    """Task over rows sorted by conversation and turn: a whole conversation, or the parts of a long one."""
    def part(talk: _Open, last: bool) -> tuple:
        edits = pointers = state = inserted = None
        totals: tuple = (None,) * len(TOTALS)
        roles, texts = talk.roles, talk.texts
        if last:
            cost, state, inserted = Paths.end(talk.config)
            span = talk.turns[1] - talk.turns[0] + 1 - talk.distinct if talk.turns else 0
            totals = (span, *talk.faults[1:], talk.illegal, talk.cost + cost)
        if last and not talk.part:
            edits, before = traced(talk.pointers, state)
            edits += "I" * inserted
            roles, texts = edited(edits, before, roles, texts)
        else:
            pointers = talk.pointers.tobytes()
        return talk.name, talk.part, last, edits, pointers, state, inserted, roles, texts, *totals

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        paths, talk, out, held = Paths(), None, [], 0
        for batch in batches:
            for name, there, turned, turn, role, text, fault in zip(*(batch[c].tolist() for c in _ROW)):
                if talk is None or name != talk.name:
                    if talk is not None:
                        out.append(part(talk, True))
                    talk = _Open(name)
                if not there:
                    continue
                initial = role[:1]
                gained, talk.config, pointers = paths.step(talk.config, initial if initial in "sua" else "", fault)
                talk.cost += gained
                talk.pointers.append(pointers)
                talk.roles.append(role)
                talk.texts.append(text)
                talk.chars += len(role) + len(text)
                held += len(text)
                talk.faults[fault] += 1
                if talk.before is not None and talk.before + initial not in LEGAL:
                    talk.illegal += 1
                talk.before = initial
                if turned:
                    if not talk.turns or talk.turns[1] != turn:
                        talk.distinct += 1
                    talk.turns = [talk.turns[0] if talk.turns else turn, turn]
                if len(talk.roles) >= hold_rows or talk.chars >= hold_chars:
                    out.append(part(talk, False))
                    talk.part, talk.chars, talk.roles, talk.texts, talk.pointers = talk.part + 1, 0, [], [], array("I")
                if len(out) >= 2000 or held >= hold_chars and out:
                    yield _frame(out)
                    out, held = [], 0
        if talk is not None:
            out.append(part(talk, True))
        if out:
            yield _frame(out)

    return run


_ROW = ("conv", "there", "turned", "turn", "role", "text", "fault")
_COLUMNS = [c.split()[0] for c in _PARTS.split(", ")]


def _frame(parts: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series(x, dtype=object) for c, x in zip(_COLUMNS, zip(*parts))})


def _traced_back(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Task over the parts of long conversations from the last to the first: edits, and the state before each part."""
    state = 0
    for batch in batches:
        out = []
        for name, number, last, pointers, end, inserted in batch.itertuples(index=False):
            after = "I" * int(inserted) if last else ""
            edits, state = traced(array("I", pointers), int(end) if last else state)
            out.append((name, number, edits + after, state))
        yield pd.DataFrame(out, columns=["conv", "part", "edits", "before"])


def _edited_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        done = [edited(e, s, list(r), list(t)) for e, s, r, t in zip(batch["edits"], batch["before"], batch["roles"], batch["texts"])]
        yield batch.assign(roles=[d[0] for d in done], texts=[d[1] for d in done]).drop(columns="before")


def _faults(text: Column, seen: Column) -> Column:
    spaces = r"\x20\x09-\x0D"
    return (
        F.when(~text.rlike(f"[^{spaces}]"), BLANK).when(seen > 1, REPEATED)
        .when(~text.rlike(f"[.!?][{spaces}]*\\z"), CUT).otherwise(FINE)
    )


def repair(
    rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    there: str | None = None, hold_rows: int = HOLD_ROWS, hold_chars: int = HOLD_CHARS,
) -> DataFrame:
    """The repaired conversations: (conv, part, last, edits, messages, gaps, blank, duplicate, truncated, illegal, cost).

    Messages are an array of (role, text). A conversation is one row, or, beyond `hold_rows` rows or
    `hold_chars` characters, several parts of that size, of which the last has the totals. The edits are
    the letters of the cheapest edits, of equally cheap ones the least in the order of letters, that make
    the roles `(system? (user assistant)+)?` by their first letters: K keeps a row, R gives it the role
    that is due, D deletes it, I inserts a row without text. Blank and repeated rows must go.

    Rows go by turn, nulls first, then by role and text, so ties have an order and reruns agree. Null
    roles and texts count as one space; an empty role fits nowhere. Rows without a conversation are one
    conversation. Rows whose column `there` is not true only name their conversation; one without other
    rows has zero totals and no edits. Other columns are ignored.

    One shuffle by conversation serves the search for repeated rows and the stream. The stream holds a
    bounded part of a conversation: of a longer one it writes back pointers of four bytes a row beside
    the rows of each part, the parts are traced back from the last to the first, and then edited
    independently of each other.
    """
    kind = rows.schema[conv].dataType
    blank = F.lit(" ")
    plain = rows.select(
        F.col(conv).cast("string").alias("conv"), (F.coalesce(F.col(there), F.lit(False)) if there else F.lit(True)).alias("there"),
        F.col(turn).isNotNull().alias("turned"), F.coalesce(F.col(turn).cast("long"), F.lit(0)).alias("turn"),
        F.coalesce(F.col(role), blank).alias("role"), F.coalesce(F.col(text), blank).alias("text"))
    order = ["turned", "turn"]
    same = Window.partitionBy("conv", "there", F.xxhash64("role", "text"), "role", "text").orderBy(*order)
    sorted_rows = (
        plain.repartition("conv").withColumn("seen", F.row_number().over(same))
        .withColumn("fault", _faults(F.col("text"), F.col("seen")))
        .sortWithinPartitions("conv", *order, "role", "text", "seen").select(*_ROW)
    )
    found = settle(sorted_rows.mapInPandas(_streamed(hold_rows, hold_chars), _PARTS))
    done = found.where("pointers IS NULL")
    long = found.where("pointers IS NOT NULL")
    back = (
        long.select("conv", "part", "last", "pointers", "state", "inserted").repartition("conv")
        .sortWithinPartitions("conv", F.desc("part")).mapInPandas(_traced_back, "conv string, part int, edits string, before int")
    )
    columns = ["conv", "part", "last", "edits", "roles", "texts", *TOTALS]
    p, b = long.drop("edits").alias("p"), back.alias("b")
    joined = p.join(b, F.col("p.conv").eqNullSafe(F.col("b.conv")) & (F.col("p.part") == F.col("b.part")))
    wide = joined.select("p.conv", "p.part", "last", "edits", "roles", "texts", *(F.coalesce(F.col(t), F.lit(0)).alias(t) for t in TOTALS), "before")
    parts = wide.mapInPandas(_edited_parts, ", ".join(c for c in (f"{n} {k}" for n, k in wide.dtypes if n != "before")))
    messages = F.transform(F.arrays_zip("roles", "texts"), lambda m: F.struct(m["roles"].alias("role"), m["texts"].alias("text")))
    return done.select(*columns).unionAll(parts.select(*columns)).select(
        F.col("conv").cast(kind).alias(conv), "part", "last", "edits", messages.alias("messages"),
        *(F.when(F.col("last"), F.col(t)).alias(t) for t in TOTALS))


def _digested(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Task over the parts of long conversations in order: all edits, and the hash of the joined rows."""
    letters, digest, empty = [], hashlib.sha256(), True
    for batch in batches:
        for row in batch.to_dict("records"):
            if row["part"] == 0:
                letters, digest, empty = [], hashlib.sha256(), True
            letters.append(row["edits"])
            if row["lines"]:
                digest.update((row["joined"] if empty else "\n" + row["joined"]).encode())
                empty = False
            if row["last"]:
                yield pd.DataFrame([{**{k: row[k] for k in ("conv", *TOTALS)}, "audit": "".join(letters), "repaired_sha256": digest.hexdigest()}])


def summaries(parts: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row for each conversation of `repair`: its totals, all edits as `audit`, and the SHA-256 of its
    rows `role:text`, joined by line ends. The parts of a long conversation stream through one task."""
    kind = parts.schema[conv].dataType
    lines = F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"]))
    joined = parts.select("*", F.array_join(lines, "\n").alias("joined"))
    whole = (F.col("part") == 0) & F.col("last")
    short = joined.where(whole).select(conv, *TOTALS, F.col("edits").alias("audit"), F.sha2(F.col("joined").cast("binary"), 256).alias("repaired_sha256"))
    long = (
        joined.where(~whole).select(
            F.col(conv).cast("string").alias("conv"), "part", "last", "edits", F.size("messages").alias("lines"), "joined",
            *(F.coalesce(F.col(t), F.lit(0)).alias(t) for t in TOTALS))
        .repartition("conv").sortWithinPartitions("conv", "part")
        .mapInPandas(_digested, "conv string, " + ", ".join(f"{t} long" for t in TOTALS) + ", audit string, repaired_sha256 string")
    )
    return short.unionAll(long.select(F.col("conv").cast(kind).alias(conv), *TOTALS, "audit", "repaired_sha256"))
