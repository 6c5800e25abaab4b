"""Stored transcripts and cells: what windows read and what moves."""

from __future__ import annotations

import pytest

from episodia.operators import tallies as t
from episodia.operators import windows as w
from episodia.plans import assemble
from episodia.session import materialize
from episodia.sources.store import CHUNK_KEYS, Store, shelf, store_cells, store_transcripts

W = ("window_key", "campaign")


@pytest.fixture
def chunks(spark):
    rows = [(f"c{c}", e, k, 12, f"{c}-{e}-{k} text\n") for c in (1, 2) for e in range(1, 40) for k in range(1 + 3 * (e == 5))]
    return materialize(spark.createDataFrame(rows, "campaign string, episode int, chunk long, chars long, text string"))


@pytest.fixture
def members(spark):
    rows = [(f"w{n}", "c1", e) for n in range(3) for e in (2, 5, 18, 34)] + [("w9", "c2", 5), ("w9", "c2", 77)]
    return materialize(w.number_members(spark.createDataFrame(rows, "window_key string, campaign string, episode int"), W))


@pytest.fixture
def joins_by_bucket(spark):
    """No side is small enough to be sent to all tasks, as in a store of many windows."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan_of(df) -> list[str]:
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("+- == Initial Plan ==")[0].split("\n")


def above_scan(lines: list[str], mark: str) -> list[str]:
    """Operators over the scan whose line holds ``mark``, nearest first."""
    at = next(k for k, line in enumerate(lines) if mark in line)
    depth, out = len(lines[at]) - len(lines[at].lstrip(" :+-")), []
    for line in reversed(lines[:at]):
        indent = len(line) - len(line.lstrip(" :+-"))
        if indent < depth:
            out.append(line.strip(" :+-"))
            depth = indent
    return out


def test_texts_stay_in_their_buckets_and_other_shelves_shut(spark, tmp_path, chunks, members, joins_by_bucket):
    store = Store(spark, str(tmp_path), buckets=4)
    store_transcripts(store, chunks)
    asked = store.asked_for("transcripts", members)
    joined = members.join(asked.select(*t.EPISODE, "chunk", "text"), list(t.EPISODE))
    wanted = materialize(members.join(chunks.select(*CHUNK_KEYS), list(t.EPISODE)))
    by_bucket = wanted.join(asked, CHUNK_KEYS)
    lines = plan_of(by_bucket.select(*W, "episode", "text"))
    scan = next(line for line in lines if "FileScan parquet" in line and "shelf" in line)
    assert "dynamicpruning" in scan
    over = above_scan(lines, "dynamicpruning")
    to_join = over[:next(k for k, line in enumerate(over) if "SortMergeJoin" in line)]
    assert to_join and not any("Exchange" in line for line in to_join)
    # c1 of shelves 2 and 5, c2 of shelves 5 and 13
    assert {r[0] for r in asked.select(shelf()).distinct().collect()} == {"c1-2", "c1-5", "c2-5", "c2-13"}
    assert joined.count() == 3 * (1 + 4 + 1 + 1) + 4


def test_stored_texts_equal_plain_ones(spark, tmp_path, chunks, members):
    store = Store(spark, str(tmp_path), buckets=4)
    store_transcripts(store, chunks)
    plain = assemble.context_texts(members, chunks, W, part_chars=40).collect()
    stored = assemble.context_texts(members, store.asked_for("transcripts", members), W, part_chars=40).collect()
    assert sorted(map(tuple, stored)) == sorted(map(tuple, plain)) and len(plain) > 4


def test_a_store_opens_again(spark, tmp_path, chunks, members):
    store_transcripts(Store(spark, f"{tmp_path}/a", buckets=4), chunks)
    spark.sql(f"DROP TABLE {Store(spark, f'{tmp_path}/a')._table('transcripts')}")  # another session knows files only
    again = Store(spark, f"{tmp_path}/a", buckets=4)
    read = again.open("transcripts", "campaign STRING, episode INT, chunk LONG, chars LONG, text STRING", CHUNK_KEYS)
    assert sorted(map(tuple, read.drop("shelf").collect())) == sorted(map(tuple, chunks.collect()))
    log = spark.createDataFrame([("c1", 2, k, "x") for k in range(5)], "campaign string, episode int, seq long, roll_type string")
    for rows in (log, log.where("seq < 3")):  # a second write replaces the first
        store_cells(again, t.compact(t.as_cells(rows), [*t.EPISODE, "roll_type"]), "rolls")
    found = w.spread(again.asked_for("rolls", members), members).collect()
    assert [(r["window_key"], r["n"]) for r in sorted(found)] == [("w0", 3), ("w1", 3), ("w2", 3)]
