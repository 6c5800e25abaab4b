"""Decontamination against a plain search for every window."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from episodia.llm import decontam
from episodia.llm.common import ship

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(docs, items, window=10):
    windows: dict = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[k:k + window]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text in docs:
        w, found = words(text), set()
        hit = [False] * len(w)
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                held = windows.get(tuple(w[k:k + n]))
                if held:
                    found |= held
                    hit[k:k + n] = [True] * n
        out.append((doc_id, len(w), sum(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(hit)))
    return sorted(out, key=str)


def some(n_docs, n_items, seed):
    rng = random.Random(seed)

    def text(n, letters):
        return " ".join(rng.choice("abcdefgh"[:letters]) + rng.choice(["", ".", "É", "-X"]) for _ in range(n))

    docs = [(rng.randrange(50) if rng.random() < .9 else None, text(rng.randrange(120), rng.choice([1, 2, 4]))) for _ in range(n_docs)]
    items = [(rng.randrange(20) if rng.random() < .9 else None, text(rng.choice([0, 1, 3, 9, 10, 11, 30]), rng.choice([1, 2, 4])))
             for _ in range(n_items)]
    share = "one two three four five six seven eight nine ten eleven twelve"
    return (docs + [(7, None), (8, ""), (9, share), (9, share.upper()), (10, "x " + share + " " + share)],
            items + [(3, None), (100, share), (101, share), (101, share), (102, "Ten, eleven;\ntwelve")])


def digests(found):
    return sorted(((r["doc_id"], r["n_words"], sum(s["end"] - s["start"] for s in r["spans"]), len(r["items"]),
                    hashlib.sha256(",".join(sorted(r["items"])).encode()).hexdigest(), bool(r["spans"])) for r in found.collect()), key=str)


def test_query_equals_plain_search(spark):
    docs, items = some(90, 20, 1)
    rows = decontam.decontamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)).collect()
    assert sorted(map(tuple, rows), key=str) == plain(docs, items)


@pytest.mark.parametrize("options", [{"block_words": 60}, {"shard_words": 50}, {"piece_words": 3}, {"window": 4}])
def test_blocks_shards_and_pieces_change_nothing(spark, options):
    docs, items = some(50, 14, 2)
    found = decontam.contamination(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **options)
    assert digests(found) == plain(docs, items, options.get("window", 10))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 9))
def test_suffixes_are_in_order(ids, depth):
    array = np.array([*ids, 0, 0], dtype=np.int64)
    order = decontam.suffix_array(array, depth)

    def known(k):  # up to depth, and up to the first 0, beyond which nothing matches
        part = [*array[k:k + depth].tolist()]
        return part[:part.index(0) + 1] if 0 in part else part

    assert sorted(order.tolist()) == np.flatnonzero(array).tolist()
    held = [known(k) for k in order]
    assert held == sorted(held)


def test_longest_matches(spark):
    docs = [(1, "z a b c d e q"), (2, "a b c x"), (3, None)]
    items = [(5, "A b, c d"), (6, "e f")]
    rows = decontam.longest_matches(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), least=1)
    assert {tuple(r) for r in rows.collect()} == {("5", 0, 4, "1", 1), ("5", 1, 3, "1", 2), ("5", 2, 2, "1", 3),
                                                  ("5", 3, 1, "1", 4), ("6", 0, 1, "1", 5)}


def test_affected_rows_go_and_others_stay(spark):
    docs, items = some(60, 12, 3)
    table = spark.createDataFrame([(*d, k, "x") for k, d in enumerate(docs)], DOCS + ", row long, _doc_row string")
    kept = decontam.decontaminate(table, spark.createDataFrame(items, ITEMS))
    clean = [r for r in map(tuple, table.collect()) if not plain([r[:2]], items)[0][5]]
    assert kept.columns == table.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(clean, key=str)


def test_empty_tables(spark):
    docs, items = some(5, 5, 4)
    a, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    assert decontam.decontamination(a.where("false"), b).collect() == []
    none = decontam.decontamination(a, b.where("false")).collect()
    assert sorted(map(tuple, none), key=str) == plain(docs, [])
    assert decontam.decontaminate(a, b.where("false")).count() == len(docs)
    assert decontam.longest_matches(a, b.where("false")).where(F.lit(True)).collect() == []


def test_the_given_tables(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    items = spark.read.parquet(f"{tiny}/benchmark.parquet")
    rows = decontam.decontamination(docs, items).collect()
    expected = plain([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert sorted(map(tuple, rows), key=str) == expected and any(r[5] for r in expected)
