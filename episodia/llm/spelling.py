"""Spelling variants: words within one edit by pivotal bigrams, each led to its most frequent form."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

GRAM = 2
LEAST_CHARS, LEAST_COUNT = 5, 3
DAMAGE = 97  # one run in so many, by its hash with the document, loses a code point
HELD_WORDS = 400_000  # words a task counts before it hands them on
LONG = 64  # code points; longer words, with bigrams by the thousand, are looked up by what one deletion leaves
HOT = 64  # so do the words of a key whose pivots and prefixes make more pairs than so many a row

#: one byte a character: letters of the first 256 code points stay, A-Z in lower case, and all else parts words
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))
WORDS = "word string, n long"
KEYS = "key long, word string, n long, last int, pivot boolean"
VARIANTS = "key long, word string, n long, kind string"


class _Utf8(dict):
    def __missing__(self, run: bytes) -> bytes:
        value = self[run] = run if run.isascii() else run.decode("latin-1").encode()
        return value


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
        zip(*rows) if rows else [[]] * len(schema), schema.types)], schema=schema)


COUNTED = pa.schema([("word", pa.string()), ("n", pa.int64())])


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words of whole texts, damaged where the hash of document and run says so."""
    total: Counter = Counter()
    coded = _Utf8()

    def handed() -> pa.RecordBatch:
        rows = [(word.decode("latin-1"), n) for word, n in total.items() if n > 0 and len(word) >= LEAST_CHARS]
        total.clear()
        coded.clear()
        return _table(rows, COUNTED)

    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            if not text:
                continue
            runs = text.encode("latin-1", "replace").translate(LETTERS).split()
            total.update(runs)
            start = zlib.crc32(f"{doc_id}:".encode())
            for run in set(runs):
                h = zlib.crc32(coded[run], start)
                if not h % DAMAGE:
                    at, n = h % len(run), runs.count(run)
                    total[run] -= n
                    total[run[:at] + run[at + 1:]] += n
            if len(total) > HELD_WORDS:
                yield handed()
    yield handed()


def word_counts(docs: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """word, n: words of at least ``LEAST_CHARS`` code points with at least ``least`` occurrences in all texts.

    A null text has no words; a null doc_id reads as empty in the hash; every row counts, repeated ones too.
    """
    named = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"), "text")
    counted = named.mapInArrow(count_words, WORDS)
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def gram_ranks(words: DataFrame) -> dict[str, tuple[int, int]]:
    """Rank and count of every bigram of the words, the rarest first; the alphabet bounds them at 90 x 90."""
    schema = pa.schema([("gram", pa.string()), ("n", pa.int64())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for word in batch.column("word").to_pylist():
                total.update(map("".join, zip(word, word[1:])))
        yield _table(list(total.items()), schema)

    found = words.mapInArrow(rows, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    return {gram: (rank, n) for rank, (n, gram) in enumerate(sorted((r["n"], r["gram"]) for r in found))}


def gram_prefix(word: str, ranks: dict[str, tuple[int, int]]) -> tuple[list[tuple[int, int, int]], int]:
    """(place, rank, count) by place of the rarest bigrams, and the rank of the last of them.

    One edit touches at most two bigrams, so three are enough; all of the third's rank belong to them.
    """
    grams = [(k, *ranks[word[k:k + GRAM]]) for k in range(len(word) - GRAM + 1)]
    last = sorted(r for _, r, _ in grams)[GRAM]
    return [g for g in grams if g[1] <= last], last


def pivots(prefix: list[tuple[int, int, int]]) -> tuple[int, int]:
    """Places of the two disjoint bigrams of the prefix with the least summed count, by dynamic programming.

    ``best`` is the cheapest bigram that ends before the current one; ties go to the first places.
    """
    best, chosen, waiting = None, None, []
    for place, _, count in prefix:
        waiting.append((count, place))
        while waiting and waiting[0][1] + GRAM <= place:
            best = min(best or waiting[0], waiting[0])
            waiting.pop(0)
        if best is not None:
            chosen = min(chosen or (best[0] + count, best[1], place), (best[0] + count, best[1], place))
    return chosen[1], chosen[2]


def halves(part: str, whole: int) -> Iterator[tuple[str, str]]:
    """What an edit in a part that had ``whole`` code points before it leaves alone: its first half, or its second."""
    first = whole // 2
    if first <= len(part):
        yield "first", part[:first]
    if whole - first <= len(part):
        yield "second", part[len(part) - whole + first:]


def pivot_keys(word: str, first: int, second: int) -> list[str]:
    """Keys of a word's pivots: a bigram at its place with all that one edit elsewhere leaves alone.

    As the pivots are disjoint, an edit stands right of the first or left of the second. So the first is met with the
    same beginning of the word, or the second with the same ending, and on the other side one half is the same too.
    """
    ahead, behind = word[:second], word[first + GRAM:]
    return [f"< {word[:first + GRAM]} {side} {half}" for side, half in halves(behind, len(behind))] + [
        f"> {word[second:]} {side} {half}" for side, half in halves(ahead, len(ahead))]


def prefix_keys(word: str, place: int) -> set[str]:
    """The keys under which pivots of near words look for the word's bigram at that place."""
    ahead, behind = word[:place], word[place + GRAM:]
    keys = {f"< {word[:place + GRAM]} {side} {half}" for more in (-1, 0, 1)
            for side, half in halves(behind, max(len(behind) + more, 0))}
    return keys | {f"> {word[place:]} {side} {half}" for more in (-1, 0, 1)
                   for side, half in halves(ahead, max(len(ahead) + more, 0))}


def word_keys(words: DataFrame, ranks: dict[str, tuple[int, int]]) -> DataFrame:
    """(key, word, n, last, pivot): hashes of the keys of every word's pivots and of its prefix."""
    shared = words.sparkSession.sparkContext.broadcast(ranks)
    schema = pa.schema([("key", pa.int64()), ("word", pa.string()), ("n", pa.int64()), ("last", pa.int32()),
                        ("pivot", pa.bool_())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                prefix, last = gram_prefix(word, shared.value)
                out += [(hashed(key), word, n, last, True) for key in pivot_keys(word, *pivots(prefix))]
                out += [(hashed(key), word, n, last, False) for place, _, _ in prefix for key in prefix_keys(word, place)]
            yield _table(out, schema)

    return words.mapInArrow(rows, KEYS)


def hashed(text: str) -> int:
    """A signed 64-bit hash; equal keys of different texts only add pairs that verifying drops."""
    import xxhash

    value = xxhash.xxh3_64_intdigest(text.encode())
    return value - (1 << 64) if value >> 63 else value


def one_edit_variants(words: DataFrame) -> DataFrame:
    """Pairs (a, n_a, b, n_b) of ``words`` within one edit, by what is left when one code point is deleted.

    Two words with one replaced code point leave the same rest at the same place, which at most 90 words do; a
    longer word leaves the shorter one. So every pair that meets is one that counts, whatever the words share.
    """
    schema = pa.schema([("key", pa.int64()), ("word", pa.string()), ("n", pa.int64()), ("kind", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
                rest = [word[:k] + word[k + 1:] for k in range(len(word))]
                out = [(hashed("=" + word), word, n, "whole")]
                out += [(hashed(f"{k}:{r}"), word, n, "place") for k, r in enumerate(rest)]
                out += [(hashed("=" + r), word, n, "rest") for r in set(rest)]
                for start in range(0, len(out), 10_000):
                    yield _table(out[start:start + 10_000], schema)

    found = materialize(words.mapInArrow(rows, VARIANTS))
    a = found.where("kind <> 'rest'").select("key", F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("kind").alias("k_a"))
    b = found.where("kind <> 'whole'").select("key", F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("kind").alias("k_b"))
    met = ((F.col("k_a") == "place") & (F.col("k_b") == "place") & (F.col("a") < F.col("b"))) | (
        (F.col("k_a") == "whole") & (F.col("k_b") == "rest"))
    return a.join(b, "key").where(met & near()).select("a", "n_a", "b", "n_b")


def parallel(words: DataFrame) -> int:
    return int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def near():
    return F.levenshtein("a", "b", 1) == 1


def near_words(words: DataFrame, hot: int = HOT, long: int = LONG) -> DataFrame:
    """All pairs (a, n_a, b, n_b) of words that differ by one inserted, deleted or replaced code point, once each."""
    ordinary = words.where(F.length("word") <= long)
    keys = materialize(word_keys(ordinary, gram_ranks(ordinary)))
    sides = keys.groupBy("key").agg(F.count_if("pivot").alias("p"), F.count_if(~F.col("pivot")).alias("q"))
    crowded = materialize(sides.where(F.col("p") * F.col("q") > hot * (F.col("p") + F.col("q"))).select("key"))
    # pairs cost more than their rows weigh, so their partitions are not to be joined up by size
    left = keys.join(crowded, "key", "left_anti").repartition(parallel(words), "key")
    a = left.where("pivot").select("key", F.col("word").alias("a"), F.col("n").alias("n_a"), F.col("last").alias("l_a"))
    b = left.where("not pivot").select("key", F.col("word").alias("b"), F.col("n").alias("n_b"), F.col("last").alias("l_b"))
    limits = (F.col("l_a") <= F.col("l_b")) & (F.col("a") != F.col("b")) & (
        F.abs(F.length("a") - F.length("b")) <= 1) & near()
    met = a.join(b, "key").where(limits).select("a", "n_a", "b", "n_b")
    rest = keys.join(crowded, "key").select("word", "n").union(words.where(F.length("word") >= long)).distinct()
    more = one_edit_variants(rest)
    turned = met.union(more)
    first = F.col("a") < F.col("b")
    return turned.select(F.least("a", "b").alias("a"), F.when(first, F.col("n_a")).otherwise(F.col("n_b")).alias("n_a"),
                         F.greatest("a", "b").alias("b"), F.when(first, F.col("n_b")).otherwise(F.col("n_a")).alias("n_b")).distinct()


def roots(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(word, root): from word along ``links`` (word, form) to the end, by doubling the steps each round.

    Counts at least double with every step, so a chain is shorter than 64 and a few rounds reach its end.
    """
    state = materialize(links.select("word", F.col("form").alias("root")))
    for _ in range(rounds):
        further = state.select(F.col("word").alias("root"), F.col("root").alias("end"))
        state = materialize(state.select("word", "root").join(further, "root", "left").select(
            "word", F.coalesce("end", "root").alias("root"), F.col("end").isNotNull().alias("moved")))
        if state.where("moved").isEmpty():
            return state.select("word", "root")
    raise ValueError("links run in a circle")


def spelling_variants(docs: DataFrame, hot: int = HOT, long: int = LONG) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of ``word_counts``.

    A word's form is its near word with the largest n, ties to the smallest in code-point order, if that n is twice
    the word's own at least; root follows forms to the last. Words are keyed by two disjoint rare bigrams each, the
    pivots, and looked up among other words' rarest bigrams; what meets is verified. No words, no rows.
    """
    words = materialize(word_counts(docs))
    pairs = materialize(near_words(words, hot, long))
    sides = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("n_b").alias("n_near")).union(
        pairs.select("b", "a", "n_a"))
    best = sides.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                     F.min(F.struct((-F.col("n_near")).alias("n"), "near")).alias("best"))
    enough = -F.col("best.n") >= 2 * F.col("n")
    found = materialize(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.n")).alias("form_n")))
    return found.join(roots(found.where("form is not null")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
