"""Conversation repair against every possible sequence of edits."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest
from hypothesis import given, settings, strategies as st

from episodia.llm import conversations as conv
from episodia.llm.common import ship

WHITE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def marked(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.rstrip(WHITE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def brute(rows):
    """(cost, audit, repaired) of the cheapest, then audit-least of all edits of rows (role, text, fault)."""
    best = None

    def go(k, audit, cost, initials, out):
        nonlocal best
        if (best and cost > best[0]) or not re.fullmatch("s?(ua)*u?", initials):
            return
        for n in range(3):
            for roles in itertools.product(("user", "assistant"), repeat=n):
                more = (audit + "I" * n, cost + 5 * n, initials + "".join(r[0] for r in roles), out + [f"{r}:" for r in roles])
                if k == len(rows):
                    if re.fullmatch("(s?(ua)+)?", more[2]):
                        found = (more[1], more[0], "\n".join(more[3]))
                        best = found if best is None else min(best, found)
                    continue
                step(k, *more)

    def step(k, audit, cost, initials, out):
        role, text, fault = rows[k]
        go(k + 1, audit + "D", cost + 2, initials, out)
        if fault not in ("blank", "duplicate"):
            stay = 5 if fault == "truncated" else 0
            go(k + 1, audit + "K", cost + stay, initials + (role[:1] if role[:1] in "sua" and role else "x"), out + [f"{role}:{text}"])
            for r in ("user", "assistant"):
                go(k + 1, audit + "R", cost + 1 + stay, initials + r[0], out + [f"{r}:{text}"])

    go(0, "", 0, "", [])
    return best


def reported(edits):
    report = conv.Report()
    for edit in edits:
        report.add(*edit)
    return report.row()


ROW = st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "uncle"]),
                st.sampled_from(["Hi.", "x", "", "What?", " \n", "Yes!", "no", "So. "]))


@settings(max_examples=400, deadline=None)
@given(st.lists(ROW, max_size=5))
def test_edits_equal_the_best_of_all(rows):
    got = reported(conv.repaired([(k, *r) for k, r in enumerate(rows)]))
    cost, audit, text = brute(marked(rows))
    assert got[5:] == (cost, audit, hashlib.sha256(text.encode()).hexdigest())


def forward_only(steps):
    """Cost and edits by a plain table over all states, with whole audit strings."""
    table = {conv.START: (0, "")}
    for kind in steps:
        new = {}
        for state, (cost, audit) in table.items():
            for after, more, _ in conv.STEPS[kind][state]:
                way = (cost + more, audit + conv.WORDS[kind][state][after])
                new[after] = min(new.get(after, way), way)
        table = new
    return min((cost + conv.CLOSING_COST[s], audit + conv.CLOSING[s]) for s, (cost, audit) in table.items())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 11), min_size=1, max_size=120))
def test_halves_meet_where_whole_tables_do(kinds):
    steps = [conv.STEPS[k] for k in kinds]
    states = conv.crossings(steps, conv.START, conv.CLOSING_COST)
    audit = "".join(conv.WORDS[k][a][b] for k, a, b in zip(kinds, [conv.START, *states], states)) + conv.CLOSING[states[-1]]
    cost, order = conv.ahead(steps, 0, len(steps), conv.START)
    assert (cost[states[-1]] + conv.CLOSING_COST[states[-1]], audit) == forward_only(kinds)
    cut = len(steps) // 2
    whole = [conv.composed(steps[:cut]), conv.composed(steps[cut:])] if cut else [conv.composed(steps)]
    assert conv.crossings(whole, conv.START, conv.CLOSING_COST)[-1] == states[-1]


def plain_query(rows):
    """The contract, row by row in Python."""
    def text(v):
        return " " if v is None else str(v)

    kept, out = {}, []
    for conv_id, turn, role, body in rows:
        group = kept.setdefault(conv_id, [])
        fate = zlib.crc32(f"{text(conv_id)}:{text(turn)}".encode()) % 20
        role, body = text(role), text(body)
        if fate == 0:
            continue
        body = "" if fate == 1 else re.sub("[.!?]", "", body) if fate == 2 else body
        group += [(turn, "user" if fate == 4 else role, body)] * (2 if fate == 3 else 1)
    for conv_id, group in kept.items():
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults = marked([r[1:] for r in group])
        turns = [r[0] for r in group if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        initials = [r[1][:1] for r in group]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        counts = [sum(f[2] == name for f in faults) for name in ("blank", "duplicate", "truncated")]
        if len(group) <= 6:
            cost, audit, repaired = brute(faults)
            tail = (cost, audit, hashlib.sha256(repaired.encode()).hexdigest())
        else:
            tail = forward_only([conv.kind_of(r, f) for r, _, f in faults])
        out.append((conv_id, gaps, *counts, illegal, *tail))
    return sorted(out, key=str)


def messy(n, seed):
    rng = random.Random(seed)
    roles, texts = ["user", "assistant", "system", None, "", "tool"], ["Hi.", "yes", "", None, " ", "Why?", "é!", "a. b"]
    return [(rng.choice([None, 1, 2, 3, 4, 5, 6, 7]), rng.choice([None, 1, 2, 3, 3, 9, 10]), rng.choice(roles),
             rng.choice(texts) if rng.random() < .6 else f"T {rng.randrange(40)}.") for _ in range(n)]


def plain(rows):
    return sorted(map(tuple, rows), key=str)


def test_query_on_nulls_ties_and_repeats(spark):
    rows = messy(45, 1) + [(90, k, "user", "x.") for k in (3, 3)] + [(1 << 60, None, None, None)]
    got = plain(conv.conversation_repair(spark.createDataFrame(rows, SCHEMA)).collect())
    expected = plain_query(rows)
    assert [r[:8] for r in got] == [r[:8] for r in expected]
    assert [g for g, e in zip(got, expected) if len(e) == 9 and g != e] == []


def test_query_on_the_given_table(spark, tiny):
    table = spark.read.parquet(f"{tiny}/conversations.parquet")
    got = plain(conv.conversation_repair(table).collect())
    expected = plain_query([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    assert len(got) == table.select("conv_id").distinct().count()
    assert [g[:8] for g in got] == [e[:8] for e in expected]
    assert all(g == e for g, e in zip(got, expected) if len(e) == 9)


def test_conversations_without_rows(spark):
    gone = next(k for k in range(999) if zlib.crc32(f"{k}:1".encode()) % 20 == 0)
    rows = conv.conversation_repair(spark.createDataFrame([(gone, 1, "user", "x.")], SCHEMA)).collect()
    assert [tuple(r) for r in rows] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
    assert conv.conversation_repair(spark.createDataFrame([], SCHEMA)).collect() == []
    assert conv.repair(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_conversations_go_block_by_block(spark, monkeypatch):
    """Blocks, parts and whole conversations give what one task gives, repeated and equal rows included."""
    rows = messy(700, 2) + [(1, 5, "user", "same.")] * 30
    table = spark.createDataFrame(rows, SCHEMA).withColumn("conv", conv.F.lit(7)).withColumn("_long", conv.F.lit(1))
    whole = plain(conv.repair_report(table).collect())
    edits = conv.repair(table)
    monkeypatch.setattr(conv, "LONG_ROWS", 20)
    split = conv.repair_report(table, block_rows=7)
    assert plain(split.collect()) == whole
    by_block = conv.repair(table, block_rows=7)
    order = ["conv_id", "part", "block", "place"]
    values = ["conv_id", "edit", "fault", "turn", "was", "role", "text"]
    assert by_block.columns == edits.columns
    assert by_block.orderBy(*order).select(*values).collect() == edits.orderBy(*order).select(*values).collect()
