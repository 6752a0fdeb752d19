import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from newsloom.llm import queries, turns

SCHEMA = "conv_id long, turn long, role string, text string, part int, seen string"
WHITE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit, repaired) over all edit sequences, with whole strings instead of back pointers; rows are (role, text, fault)."""
    name = {"u": "user", "a": "assistant"}
    due = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, "", ())}
    for role, text, fault in [*rows, (None, None, None)]:
        opened = dict(best)
        for _ in range(3):  # rows that are inserted before this one
            for state, (cost, audit, done) in list(opened.items()):
                way = (cost + 3, audit + "I", (*done, name[due[state]] + ":"))
                opened[due[state]] = min(opened.get(due[state], way), way)
        if role is None:
            break
        late = 3 if fault == "truncated" else 0
        best = {}
        for state, (cost, audit, done) in opened.items():
            ways = [(state, (cost + 4, audit + "D", done))]
            if fault not in ("blank", "duplicate"):
                ways.append((due[state], (cost + 3 + late, audit + "R", (*done, f"{name[due[state]]}:{text}"))))
                if role[:1] == due[state] or (state == "" and role[:1] == "s"):
                    ways.append((role[:1], (cost + late, audit + "K", (*done, f"{role}:{text}"))))
            for target, way in ways:
                best[target] = min(best.get(target, way), way)
    return min(opened[s] for s in ("", "a") if s in opened)


def every_way(rows):
    """As `cheapest`, by trying all edits."""
    found = []

    def go(at, state, cost, audit, done, free):
        if at == len(rows):
            if state in ("", "a"):
                found.append((cost, audit, done))
        if free < 2:
            nxt = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
            go(at, nxt, cost + 3, audit + "I", (*done, {"u": "user:", "a": "assistant:"}[nxt]), free + 1)
        if at < len(rows):
            role, text, fault = rows[at]
            late = 3 if fault == "truncated" else 0
            go(at + 1, state, cost + 4, audit + "D", done, 0)
            if fault not in ("blank", "duplicate"):
                nxt = {"": "u", "s": "u", "u": "a", "a": "u"}[state]
                go(at + 1, nxt, cost + 3 + late, audit + "R", (*done, {"u": "user:", "a": "assistant:"}[nxt] + text), 0)
                if role[:1] == nxt or (state == "" and role[:1] == "s"):
                    go(at + 1, role[:1], cost + late, audit + "K", (*done, f"{role}:{text}"), 0)

    go(0, "", 0, "", (), 0)
    return min(found)


ROWS = st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", "", " "]), st.sampled_from("xyz"),
                          st.sampled_from(["", "", "", "blank", "duplicate", "truncated"])), max_size=5)


def streamed(rows):
    paths, config, cost, pointers = turns.Paths(), turns.Paths.first, 0, []
    for role, _, fault in rows:
        initial = role[:1] if role[:1] in "sua" else ""
        more, config, packed = paths.step(config, initial, ["", "blank", "duplicate", "truncated"].index(fault))
        cost += more
        pointers.append(packed)
    more, state, inserted = turns.Paths.end(config)
    edits, before = turns.traced(turns.array("I", pointers), state)
    edits += "I" * inserted
    done = turns.edited(edits, before, [r[0] for r in rows], [r[1] for r in rows])
    return cost + more, edits, tuple(map(":".join, zip(*done)))


@settings(max_examples=300, deadline=None)
@given(ROWS)
def test_paths_equal_every_way(rows):
    assert streamed(rows) == every_way(rows) == cheapest(rows)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "user", "assistant", "tool"]), st.sampled_from("xyz"),
                          st.sampled_from(["", "", "", "", "blank", "duplicate", "truncated"])), max_size=60))
def test_long_paths(rows):
    assert streamed(rows) == cheapest(rows)


def judged(rows):
    """Rows (turn, role, text) in order, with their faults."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    seen, out = set(), []
    for turn, role, text in rows:
        bare = text.strip(WHITE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((turn, role, text, fault))
    return out


def summary(rows):
    done = judged(rows)
    known = [t for t, *_ in done if t is not None]
    cost, audit, repaired = cheapest([r[1:] for r in done])
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(done, done[1:])]
    return (
        max(known) - min(known) + 1 - len(set(known)) if known else 0, *(sum(r[3] == f for r in done) for f in ("blank", "duplicate", "truncated")),
        sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest())


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        mine += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return {conv: summary(mine) for conv, mine in out.items()}


def conversations(seed):
    rng = random.Random(seed)
    texts = ["Well.", "And then", "Why?", "", None, " \t", "é!  \n", "No. ", "x\x1c", "Fine.\n\n", "a:b\nc."]
    rows = [(c, t, ["system", "user", "assistant"][0 if t == 0 else 2 - t % 2], rng.choice(texts)) for c in range(80) for t in range(rng.randrange(9))]
    rows += [(c, rng.choice([None, 1, 2, 2, 5, 2**60]), rng.choice(["user", "assistant", "system", None, "", "tool", "aide"]), rng.choice(texts)) for c in range(80, 130) for _ in range(rng.randrange(12))]
    rows += [(None, t, rng.choice(["user", "assistant"]), rng.choice(texts) or "z.") for t in range(150)]
    rows += [(-(2**62) - 1, 3, "user", "same."), (2**62 + 1, None, None, None)] + [(500, 7, "user", "same.")] * 40
    return rows + rows[:20]


@pytest.mark.parametrize("hold", [1, 7, turns.HOLD_ROWS])
def test_table_equals_plain_version(spark, hold):
    rows = conversations(3)
    frame = spark.createDataFrame([(*r, 1, "s") for r in rows], SCHEMA).repartition(3)
    damaged = queries.damaged(frame)
    found = turns.summaries(turns.repair(damaged, there="there", hold_rows=hold)).collect()
    want = damage(rows)
    assert len(found) == len(want)
    for r in found:
        assert (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) == want[r["conv_id"]], r["conv_id"]


def test_parts_hold_the_repaired_rows(spark):
    rows = [(1, t, "user" if t % 2 else "assistant", f"row {t}.") for t in range(1, 24)] + [(2, 1, "user", "x" * 3_000_000 + "."), (2, 2, "assistant", "y.")]
    frame = spark.createDataFrame([(*r, 1, "s") for r in rows], SCHEMA)
    parts = turns.repair(frame, hold_rows=5, hold_chars=1 << 20).orderBy("conv_id", "part").collect()
    by = {c: [p for p in parts if p["conv_id"] == c] for c in (1, 2)}
    assert len(by[1]) == 5 and len(by[2]) == 2
    assert [(m["role"], m["text"]) for p in by[1] for m in p["messages"]] == [(r, t) for _, _, r, t in rows[:23]] + [("assistant", "")]
    assert "".join(p["edits"] for p in by[1]) == "K" * 23 + "I"
    assert [m["text"] for p in by[2] for m in p["messages"]] == [rows[-2][3], "y."]
    assert [p["last"] for p in by[1]] == [False] * 4 + [True] and by[1][0]["cost"] is None


def test_text_keys_and_empty_table(spark):
    assert turns.summaries(turns.repair(spark.createDataFrame([], SCHEMA))).collect() == []
    named = spark.createDataFrame([("a", 1, "user", "x."), ("a", 2, "assistant", "y."), ("b", 1, "user", "x.")], "conv_id string, turn int, role string, text string")
    assert sorted((r["conv_id"], r["audit"]) for r in turns.summaries(turns.repair(named)).collect()) == [("a", "KK"), ("b", "KI")]
