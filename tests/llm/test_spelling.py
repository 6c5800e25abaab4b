"""Spelling variants and pivots against all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st

from episodia.llm import spelling
from episodia.llm.common import ship


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def lowered(run):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)


def plain_counts(docs):
    total = Counter()
    for doc_id, text in docs:
        for run in map(lowered, re.findall("[A-Za-zÀ-ÿ]+", text or "")):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            total[run if h % 97 else run[:at] + run[at + 1:]] += 1
    return {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain(docs):
    counts = plain_counts(docs)
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        if others:
            best = min(others, key=lambda v: (-counts[v], v))
            if counts[best] >= 2 * counts[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), counts[w], len(near[w]), counts.get(form.get(w))) for w in counts)


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(2)

    def word():
        return "".join(rng.choice("abAé") for _ in range(rng.choice([4, 5, 6, 7])))

    rows = [(rng.randrange(40) if rng.random() < .9 else None, " ".join(word() for _ in range(rng.randrange(160))))
            for _ in range(45)]
    long = " ".join("x" * n for n in (63, 64, 65, 66, 300, 301)) + " " + "q" * 3000 + "×ÿ÷"
    return rows + [(k, long) for k in range(1, 5)] + [(7, None), (8, ""), (9, "日本 ab\ud800cdefg".replace("\ud800", "ł"))]


@pytest.mark.parametrize("options", [{}, {"hot": 0}, {"hot": 1}, {"long": 6}])
def test_variants_equal_all_pairs(spark, docs, options):
    rows = spelling.spelling_variants(spark.createDataFrame(docs, "doc_id long, text string"), **options).collect()
    assert sorted(map(tuple, rows)) == plain(docs)


def test_chains_reach_their_end(spark):
    links = [(f"w{k:02}", f"w{k + 1:02}") for k in range(37)] + [("a", "w05")]
    rows = spelling.roots(spark.createDataFrame(links, "word string, form string")).collect()
    assert {tuple(r) for r in rows} == {(a, "w37") for a, _ in links}


WORDS = st.text("abcé", min_size=5, max_size=9)


@settings(max_examples=300, deadline=None)
@given(WORDS, st.data())
def test_a_pivot_of_one_word_finds_the_other(word, data):
    k = data.draw(st.integers(0, len(word)))
    other = data.draw(st.sampled_from([word[:k] + word[k + 1:], word[:k] + "b" + word[k:], word[:k] + "c" + word[k + 1:]]))
    if other == word or len(other) < 5:
        return
    grams = {w[i:i + 2] for w in (word, other) for i in range(len(w) - 1)}
    ranks = {g: (r, data.draw(st.integers(1, 9))) for r, g in enumerate(data.draw(st.permutations(sorted(grams))))}
    (pre_a, last_a), (pre_b, last_b) = spelling.gram_prefix(word, ranks), spelling.gram_prefix(other, ranks)
    if last_a > last_b:
        word, other, pre_a, pre_b = other, word, pre_b, pre_a
    first, second = spelling.pivots(pre_a)
    cost = {place: count for place, _, count in pre_a}
    assert cost[first] + cost[second] == min(cost[a] + cost[b] for a in cost for b in cost if b - a >= 2)
    found = {key for place, _, _ in pre_b for key in spelling.prefix_keys(other, place)}
    assert found & set(spelling.pivot_keys(word, first, second))


def test_empty_table(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_clashing_names(spark, docs):
    table = spark.createDataFrame([(*r, 1, 2, "x") for r in docs], "doc_id long, text string, n int, key int, word string")
    assert sorted(map(tuple, spelling.spelling_variants(table).collect())) == plain(docs)
