"""Answers that follow a growing log."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from episodia.operators import tallies as t
from episodia.plans import rolls as r
from episodia.plans.refresh import KeptAnswers, listed
from episodia.sources.logs import ROLL_COLUMNS, read_log

ANSWERS = "window_key string, campaign string, answer string"
HEADER = "\t".join(ROLL_COLUMNS) + "\n"


class Killed(Exception):
    pass


def write(folder, name, *rows):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(HEADER + "".join(f"{e}\t0:00\tA\t{kind}\t1\t1\t\t\t\t\n" for e, kind in rows))


@pytest.fixture
def kept(spark, tmp_path):
    members = spark.createDataFrame([("w1", "c", 1), ("w1", "c", 2), ("w2", "c", 2), ("w3", "c", 3)], "window_key string, campaign string, episode int")

    def open_(answer=r.roll_type_rarest):
        return KeptAnswers(spark, f"{tmp_path}/kept", ["roll_type"], answer, ANSWERS)

    def refresh(step=None, more=None):
        return open_().refresh(listed(spark, f"{tmp_path}/logs", "*.tsv"), lambda paths: read_log(spark, paths, "c", ROLL_COLUMNS),
                               members if more is None else members.union(more), step)

    open_.refresh, open_.logs = refresh, tmp_path / "logs"
    return open_


def answers(kept):
    return {r["window_key"]: r["answer"] for r in kept().answers().collect()}


def answered(kept, number):
    return {r["window_key"] for r in kept().ledger.part("windows", "window_key string", number).collect()}


def test_only_touched_windows_are_answered_again(spark, kept):
    write(kept.logs, "1.tsv", (1, "Zeal"), (2, "Aid"), (3, "Hit"))
    assert kept.refresh() == 1
    assert answers(kept) == {"w1": "Zeal, Aid", "w2": "Aid", "w3": "Hit"}
    assert kept.refresh() == 0 and kept().ledger.last()["number"] == 0  # nothing new, nothing written
    write(kept.logs, "0.tsv", (1, "Aid"), (1, "Bow"))  # counts after what was read before, whatever its name
    write(kept.logs, "2.tsv", (1, "Bow"))
    assert kept.refresh() == 2
    assert answered(kept, 1) == {"w1"}
    assert answers(kept) == {"w1": "Zeal", "w2": "Aid", "w3": "Hit"}
    write(kept.logs, "3.tsv", (1, "Zeal"), (3, "Hit"), (9, "Out"))
    kept.refresh()
    assert answered(kept, 2) == {"w1", "w3"}
    assert answers(kept) == {"w1": "Zeal, Aid, Bow", "w2": "Aid", "w3": "Hit"}
    new = spark.createDataFrame([("w4", "c", 9), ("w4", "c", 2)], "window_key string, campaign string, episode int")
    assert kept.refresh(more=new) == 0
    assert answered(kept, 3) == {"w4"} and answers(kept)["w4"] == "Aid, Out"
    merged = kept().cells().agg(F.sum("n"), F.count(F.lit(1))).first()
    whole = t.compact(t.as_cells(read_log(spark, str(kept.logs), "c", ROLL_COLUMNS)), [*t.EPISODE, "roll_type"])
    assert tuple(merged) == tuple(whole.agg(F.sum("n"), F.count(F.lit(1))).first()) and kept().ledger.last()["n_files"] == 4


def test_a_refresh_broken_off_counts_nothing_twice(spark, kept):
    write(kept.logs, "1.tsv", (1, "Zeal"), (1, "Zeal"), (2, "Aid"))
    kept.refresh()
    write(kept.logs, "2.tsv", (1, "Bow"), (2, "Bow"))

    def step(name):
        if name == "windows":
            raise Killed

    with pytest.raises(Killed):
        kept.refresh(step)
    assert answers(kept) == {"w1": "Aid", "w2": "Aid"}  # w3 holds no rows
    assert kept.refresh() == 1
    assert answers(kept) == {"w1": "Aid", "w2": "Aid, Bow"}


def test_changed_files_are_refused(spark, kept):
    write(kept.logs, "1.tsv", (1, "Zeal"))
    kept.refresh()
    write(kept.logs, "1.tsv", (1, "Zeal"), (1, "Aid"))
    with pytest.raises(ValueError, match="have changed"):
        kept.refresh()
