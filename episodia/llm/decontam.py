"""Benchmark decontamination by suffix arrays over the training words, searched with every suffix of the benchmark."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialize, text_bytes, worker_cache

WINDOW = 10  # words of an item that stand together in a document
SHARD_WORDS = 1 << 19  # words under one suffix array; a longer document is a shard of its own
BLOCK_WORDS = 1 << 20  # words of benchmark pieces that go to the tasks together
PIECE_WORDS = 1 << 12  # a longer item is cut into pieces that overlap, so that no window is lost

#: digits, letters and all bytes of characters beyond ASCII make words; A-Z in lower case
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32
                for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case, as UTF-8 bytes."""
    return text_bytes(text).translate(LETTERS).split()


class Vocabulary(dict):
    """Word numbers from 1; 0 for a word of no benchmark item."""

    def __missing__(self, word: bytes) -> int:
        return 0


class TestSuffixes:
    """Every suffix of a block of benchmark pieces, as runs of one array that ends pieces by 0."""

    def __init__(self, pieces: Iterable[tuple[str, int, str]], window: int = WINDOW):
        self.vocabulary, self.items, ids, owner, start, width = Vocabulary(), [], [], [], [], []
        for item, first, text in pieces:
            words = text.encode("utf-8", "surrogatepass").split(b" ")
            for k in range(len(words)):
                owner.append(len(self.items))
                start.append(first + k)
                # windows start where so many words follow; an item of fewer words is one window
                width.append(window if k + window <= len(words) else len(words) if k == 0 and first == 0 else 0)
                ids.append(self.vocabulary.setdefault(words[k], len(self.vocabulary) + 1))
            ids.append(0)
            owner.append(-1)
            start.append(-1)
            width.append(0)
            self.items.append(item)
        self.ids = np.array([*ids, 0], dtype=np.int64)
        self.owner, self.start, self.width = (np.array(x, dtype=np.int64) for x in (owner, start, width))
        self.at = np.flatnonzero(self.ids)  # where suffixes start
        ends = np.flatnonzero(self.ids == 0)
        self.length = ends[np.searchsorted(ends, self.at)] - self.at
        self.depth = int(self.length.max(initial=0))


def suffix_array(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places of all suffixes that start with a benchmark word, in the order of their first ``depth`` words.

    Prefix doubling: ranks by h words give ranks by 2h words. A 0 ends what can match, so nothing is told apart
    beyond one; only groups of suffixes that still tie are ranked again.
    """
    places, ends = np.flatnonzero(ids), np.flatnonzero(ids == 0)
    rank = np.zeros(len(ids) + depth + 1, dtype=np.int64)
    run = np.zeros(len(ids), dtype=np.int64)  # words up to the next 0
    run[places] = ends[np.searchsorted(ends, places)] - places
    # a rank is the number of suffixes before a group, and 1; so what stands alone keeps its rank
    held = places[np.argsort(ids[places], kind="stable")]
    first = np.flatnonzero(np.diff(ids[held], prepend=0))
    sizes = np.diff(np.r_[first, len(held)])
    rank[held] = np.repeat(first + 1, sizes)
    held = held[np.repeat(sizes, sizes) > 1]
    h = 1
    while h < depth and len(held):
        behind = rank[held + h]
        order = np.lexsort((behind, rank[held]))
        held, behind = held[order], behind[order]
        own = rank[held]
        group = np.diff(own, prepend=0) != 0
        first = np.flatnonzero(group | (np.diff(behind, prepend=-1) != 0))
        start = np.maximum.accumulate(np.where(group, np.arange(len(own)), 0))
        sizes = np.diff(np.r_[first, len(own)])
        rank[held] = np.repeat(own[first] + first - start[first], sizes)
        h *= 2
        held = held[(np.repeat(sizes, sizes) > 1) & (run[held] >= h)]
    return places[np.argsort(rank[places], kind="stable")]


def common_words(ids: np.ndarray, places: np.ndarray, tests: TestSuffixes, which: np.ndarray,
                 most: np.ndarray) -> np.ndarray:
    """How many words each training suffix shares with its test suffix, up to ``most``."""
    shared = np.zeros(len(places), dtype=np.int64)
    open_ = np.arange(len(places))
    while len(open_):
        more = shared[open_] < most[open_]
        open_ = open_[more]
        x = ids[np.minimum(places[open_] + shared[open_], len(ids) - 1)]
        y = tests.ids[tests.at[which[open_]] + shared[open_]]
        open_ = open_[(x == y) & (y > 0)]
        shared[open_] += 1
    return shared


def search(ids: np.ndarray, order: np.ndarray, tests: TestSuffixes, which: np.ndarray, most: np.ndarray,
           above: bool = False) -> np.ndarray:
    """Binary search: where each test suffix, cut to ``most`` words, stands among the sorted training suffixes.

    The first place whose suffix is not smaller, or with ``above`` the first that is greater and no continuation.
    """
    low, high = np.zeros(len(which), dtype=np.int64), np.full(len(which), len(order), dtype=np.int64)
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) // 2
        places = order[middle]
        shared = common_words(ids, places, tests, which[open_], most[open_])
        x = ids[np.minimum(places + shared, len(ids) - 1)]
        y = tests.ids[tests.at[which[open_]] + shared]
        before = np.where(shared == most[open_], above, x < y)
        low[open_[before]] = middle[before] + 1
        high[open_[~before]] = middle[~before]


class Shard:
    """The suffix array of some whole documents and what the benchmark finds in it."""

    def __init__(self, rows: list[tuple], tests: TestSuffixes):
        """``rows`` are (key, words); documents are parted by 0, which no test suffix holds."""
        self.keys = [key for key, _ in rows]
        self.n_words = np.array([len(words) for _, words in rows], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.n_words + 1)])
        lookup, ids = tests.vocabulary.__getitem__, np.zeros(int(self.starts[-1]) + 1, dtype=np.int64)
        for start, (_, words) in zip(self.starts.tolist(), rows):
            ids[start:start + len(words)] = np.fromiter(map(lookup, words), dtype=np.int64, count=len(words))
        self.ids, self.tests, self.order = ids, tests, suffix_array(ids, tests.depth)
        self._longest()

    def _longest(self) -> None:
        """The longest match of every test suffix, and one place where it stands."""
        tests, every = self.tests, np.arange(len(self.tests.at))
        self.longest = np.zeros(len(every), dtype=np.int64)
        self.place = np.full(len(every), -1, dtype=np.int64)
        if not len(self.order) or not len(every):
            return
        found = search(self.ids, self.order, tests, every, tests.length)
        for side in (0, -1):  # a longest match is a neighbour of where the suffix would stand
            near = found + side
            inside = np.flatnonzero((near >= 0) & (near < len(self.order)))
            places = self.order[near[inside]]
            shared = common_words(self.ids, places, tests, inside, tests.length[inside])
            better = shared > self.longest[inside]
            self.longest[inside[better]] = shared[better]
            self.place[inside[better]] = places[better]

    def matches(self, least: int) -> list[tuple]:
        """(item, item_word, n_words, key, word): longest matches of at least ``least`` words and a place of each."""
        hit = np.flatnonzero(self.longest >= max(1, least))
        document = np.searchsorted(self.starts, self.place[hit], side="right") - 1
        at = self.tests.at[hit]
        return [(self.tests.items[o], s, n, self.keys[d], p) for o, s, n, d, p in zip(
            self.tests.owner[at].tolist(), self.tests.start[at].tolist(), self.longest[hit].tolist(),
            document.tolist(), (self.place[hit] - self.starts[document]).tolist())]

    def windows(self) -> list[tuple[list[tuple[int, int]], set[str]]]:
        """Of each document the spans of words under any occurrence of a window, and the items of those windows."""
        tests, out = self.tests, [([], set()) for _ in self.keys]
        width = tests.width[tests.at]
        hit = np.flatnonzero((width > 0) & (self.longest >= width))
        if not len(hit):
            return out
        low = search(self.ids, self.order, tests, hit, width[hit])
        high = search(self.ids, self.order, tests, hit, width[hit], above=True)
        covered = np.zeros(len(self.ids) + 1, dtype=np.int64)
        for k, a, b in zip(hit.tolist(), low.tolist(), high.tolist()):
            places = self.order[a:b]
            covered[places] += 1  # the places of one window differ
            covered[places + tests.width[tests.at[k]]] -= 1
            item = tests.items[tests.owner[tests.at[k]]]
            for d in np.unique(np.searchsorted(self.starts, places, side="right") - 1).tolist():
                out[d][1].add(item)
        edges = np.diff(np.concatenate([[0], (np.cumsum(covered) > 0).astype(np.int8), [0]]))
        begins, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        # words of two documents are parted by a 0, which nothing covers
        document = np.searchsorted(self.starts, begins, side="right") - 1
        for d, b, e in zip(document.tolist(), begins.tolist(), ends.tolist()):
            first = int(self.starts[d])
            out[d][0].append((b - first, e - first))
        return out


def shards(batches: Iterator[pa.RecordBatch], key: str, tests: TestSuffixes,
           shard_words: int) -> Iterator[Shard]:
    held, size = [], 0
    for batch in batches:
        for row, text in zip(batch.column(key).to_pylist(), batch.column("text").to_pylist()):
            words = words_of(text)
            if held and size + len(words) > shard_words:
                yield Shard(held, tests)
                held, size = [], 0
            held.append((row, words))
            size += len(words) + 1
    if held:
        yield Shard(held, tests)


def benchmark_pieces(benchmark: DataFrame, window: int, piece_words: int) -> DataFrame:
    """(item, first, text): distinct items cut into pieces of ``piece_words`` words, which overlap by a window.

    A null item_id reads as the empty text, and a null text has no words.
    """
    schema = pa.schema([("item", pa.string()), ("first", pa.int64()), ("text", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(text)
                for first in range(0, max(1, len(words) - window + 1) if words else 0, piece_words):
                    part = words[first:first + piece_words + window - 1]
                    out.append((item, first, b" ".join(part).decode("utf-8", "surrogatepass")))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*out) if out else ([], [], []), schema.types)], schema=schema)

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return items.distinct().mapInArrow(rows, "item string, first long, text string")


def benchmark_blocks(benchmark: DataFrame, window: int, piece_words: int, block_words: int) -> Iterator[list[tuple]]:
    """The pieces in blocks of about ``block_words`` words: whatever the size of the benchmark, one block is bounded."""
    pieces = materialize(benchmark_pieces(benchmark, window, piece_words))
    words = pieces.agg(F.sum(F.size(F.split("text", " ")))).first()[0] or 0
    count = -(-words // block_words)
    dealt = pieces.withColumn("block", F.pmod(F.xxhash64("item", "first", "text"), F.lit(max(count, 1))))
    for block in range(count):
        yield [tuple(r) for r in dealt.where(F.col("block") == block).select("item", "first", "text").collect()]


def _scan(docs: DataFrame, key: str, tests: list[tuple], window: int, shard_words: int, schema: str, fields: pa.Schema, fn):
    """``fn`` of every shard of ``docs``, with the suffixes of ``tests`` in memory."""
    shared, name = docs.sparkSession.sparkContext.broadcast(tests), uuid.uuid4().hex

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = worker_cache(("benchmark", name), lambda: TestSuffixes(shared.value, window))
        for shard in shards(batches, key, ready, shard_words):
            out = fn(shard)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*out) if out else [[]] * len(fields), fields.types)], schema=fields)

    return docs.select(key, "text").mapInArrow(rows, schema)


def longest_matches(docs: DataFrame, benchmark: DataFrame, least: int = WINDOW, window: int = WINDOW,
                    shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS,
                    piece_words: int = PIECE_WORDS) -> DataFrame:
    """item_id, item_word, n_words, doc_id, word: for every place in every benchmark item the longest verbatim run of
    words from there that stands in a document, if of ``least`` words, with one place where it does.

    A run ends with its item, or with its piece of ``piece_words`` words in longer items; words count from 0. Ties
    between shards go to the smallest doc_id and word; null ids come first. ids are text.
    """
    named = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    fields = pa.schema([("item_id", pa.string()), ("item_word", pa.int64()), ("n_words", pa.int64()),
                        ("doc_id", pa.string()), ("word", pa.int64())])
    schema = "item_id string, item_word long, n_words long, doc_id string, word long"
    found = docs.sparkSession.createDataFrame([], schema)
    for block in benchmark_blocks(benchmark, window, piece_words, block_words):
        found = found.union(_scan(named, "doc_id", block, window, shard_words, schema, fields,
                                  lambda shard: shard.matches(least)))
    best = F.min(F.struct((-F.col("n_words")).alias("n"), "doc_id", "word")).alias("m")
    return found.groupBy("item_id", "item_word").agg(best).select(
        "item_id", "item_word", (-F.col("m.n")).alias("n_words"), "m.doc_id", "m.word")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans (start, end) in order, those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS,
                  block_words: int = BLOCK_WORDS, piece_words: int = PIECE_WORDS) -> DataFrame:
    """doc_id, n_words, spans (runs of hit words) and items (ids of the items that hit) of every row of ``docs``.

    A window is ``window`` consecutive words of an item; an item of fewer words, but not none, is one. Every task
    sorts the suffixes of its documents, shard by shard, and searches them for every suffix of the benchmark, which
    comes in blocks of bounded size; there is no shuffle with one block. A null or empty text has no words; repeated
    rows each have their row; a null item_id is the empty text. An empty benchmark hits nothing.
    """
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    blocks = list(benchmark_blocks(benchmark, window, piece_words, block_words)) or [[]]
    many = len(blocks) > 1
    rows = docs.select("doc_id", "text")
    if many:  # the results of a row's blocks meet by its number
        rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()))
    key = "row" if many else "doc_id"
    of_key = pa.int64() if many else to_arrow_type(docs.schema["doc_id"].dataType)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    fields = pa.schema([(key, of_key), ("n_words", pa.int64()), ("spans", span), ("items", pa.list_(pa.string()))])
    schema = (f"{key} {'long' if many else doc_id}, n_words long, spans array<struct<start: long, end: long>>, "
              "items array<string>")

    def found(shard: Shard) -> list[tuple]:
        return [(key, n, [{"start": a, "end": b} for a, b in spans], sorted(items))
                for key, n, (spans, items) in zip(shard.keys, shard.n_words.tolist(), shard.windows())]

    parts = [_scan(rows, key, block, window, shard_words, schema, fields, found) for block in blocks]
    if not many:
        return parts[0]
    every = parts[0]
    for part in parts[1:]:
        every = every.union(part.where("size(items) > 0"))
    joined = F.udf(merged, "array<struct<start: long, end: long>>")
    by_row = every.groupBy("row").agg(F.max("n_words").alias("n_words"),
                                      joined(F.flatten(F.collect_list("spans"))).alias("spans"),
                                      F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return rows.select("row", "doc_id").join(by_row, "row").select("doc_id", "n_words", "spans", "items")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the rows that hold a window of the benchmark, all other rows and columns as they are."""
    named = [c for c in ("_doc_row", "_doc_row_") if c not in docs.columns][0]
    numbered = materialize(docs.withColumn(named, F.monotonically_increasing_id()))
    found = contamination(numbered.select(F.col(named).alias("doc_id"), "text"), benchmark, window)
    hit = found.where("size(spans) > 0").select(F.col("doc_id").alias(named))
    return numbered.join(hit, named, "left_anti").drop(named)


def decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every row, in the words of ``contamination``."""
    found = contamination(docs, benchmark)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"))
