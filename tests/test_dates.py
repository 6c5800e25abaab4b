"""Free dates and bitmap sets against plain Python."""

from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from episodia.functions.parsing import free_date, full_date
from episodia.operators import distinct_sets as ds
from episodia.operators import tallies as t

DATES = {
    "5 January 2024": (2024, 1, 5), "January 5th, 2024": (2024, 1, 5), "the 5th of Jan., 2024": (2024, 1, 5),
    "Fri, 05-JAN-2024": (2024, 1, 5), "1/5/2024": (2024, 1, 5), "13/1/2024": (2024, 1, 13), "1.13.24": (2024, 1, 13),
    "13-1-24": (2024, 1, 13), "2024 5 January": (2024, 1, 5), "5jan2024": (2024, 1, 5), "Jan 5 '69": (1969, 1, 5),
    "Jan 5, 68": (2068, 1, 5), "Sept 3 2021": (2021, 9, 3), "2024-02-29": (2024, 2, 29), "0005-01-02": (5, 1, 2),
    "\tFebruary 1st 2024 \n": (2024, 2, 1), "3 may 2020": (2020, 5, 3), "2024-01-05T00:00:00Z": (2024, 1, 5),
}
NO_DATES = ["", "January 5", "2023-02-29", "13/13/2024", "January 2024", "5 6", "Jan 5 2024 10:30", "5 Janu 2024", "many",
            "2024-1-5-6", "January February 2024", "32/1/2024", "0/1/2024", "-", "12345-1-1", "1 2 3 4"]


def test_free_dates(spark):
    rows = spark.createDataFrame([(x,) for x in [*DATES, *NO_DATES, None]], "text string")
    got = {r["text"]: (r["a"], r["b"]) for r in rows.select("text", free_date(F.col("text")).alias("a"), full_date(F.col("text")).alias("b")).collect()}
    for text, day in DATES.items():
        assert got[text] == (datetime.date(*day),) * 2, text
    assert [x for x in [*NO_DATES, None] if got[x] != (None, None)] == []


@pytest.fixture(scope="module")
def cells(spark):
    rng = random.Random(5)
    rows = [("c", rng.randrange(6), rng.choice("xyz"), None if rng.random() < .1 else f"v{rng.randrange(90_000)}", k) for k in range(60_000)]
    rows += [("c", 1, "none", None, 1), ("c", 2, None, "v1", 2)]
    log = spark.createDataFrame(rows, "campaign string, episode int, key string, value string, seq long")
    return t.compact(t.as_cells(log), [*t.EPISODE, "key", "value"])


def test_united_bitmaps_count_like_pairs(spark, cells):
    members = spark.createDataFrame([("a", "c", e) for e in (0, 1, 2, 3)] + [("b", "c", e) for e in (2, 3, 5)], "w string, campaign string, episode int")
    sets = ds.episode_sets(cells, "key", "value")
    assert sets.where("bucket > 1").count() > 0  # codes beyond one bitmap
    spread = members.join(sets, list(t.EPISODE))
    got = ds.set_sizes(ds.united(spread, ["w"], "key"), ["w"], "key").collect()
    plain = t.distinct_count(members.join(cells, list(t.EPISODE)), ["w"], "key", "value").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, plain)) and ("a", "none", 0, 1) in set(map(tuple, got))
    many = ds.shared_by_many(ds.united(spread, ["w"], "key"), ["w"], "key")
    assert {(r["w"], r["key"]) for r in many.collect()} == {(w, k) for w in "ab" for k in "xyz"}


def test_codes_are_dense_and_in_order(spark, cells):
    rows = ds.codes(cells, "value").orderBy("code").collect()
    assert [r["code"] for r in rows] == list(range(1, len(rows) + 1))
    assert [r["value"] for r in rows] == sorted(r["value"] for r in rows)
