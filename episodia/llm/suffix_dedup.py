"""Repeated byte strings removed, by deep-shallow sorting of the suffixes at sampled anchors.

A string of W bytes that occurs twice has the same smallest K-gram hash in both places, at the same offset. So every
window of W bytes belongs to the anchor where its smallest K-gram starts, equal windows have equal anchors, and only
anchors are sorted: about one for every (W - K) / 2 bytes. What stands left and right of an anchor then tells which of
its windows occur elsewhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_bytes

WINDOW = 400
GRAM = 64
SEGMENT = 1 << 19  # window starts handled at once in a very long text
SHALLOW = 32  # bytes ordered by multikey partitioning before blind tries
CLASSES = 256  # different surroundings of one gram that a task sorts; beyond it they are dealt out by finer grams
SLICES = (16, 1)  # offsets per slice of such a group, step by step

_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 2**64)
_BYTES = np.random.Generator(np.random.PCG64(400)).integers(0, 2**64, 256, dtype=np.uint64)


# --- anchors --------------------------------------------------------------------------------------------------------

_POWERS = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2^64; kept between texts."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 14)
        for i, base in enumerate((_BASE, _INVERSE)):
            out = np.full(size, base, dtype=np.uint64)
            out[0] = 1
            _POWERS[i] = np.multiply.accumulate(out)
    return _POWERS[0][:n], _POWERS[1][:n]


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of every ``width`` neighbours, from running minima inside blocks of that width."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n - width + 1], ahead[width - 1:n])


def segment_anchors(data: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(anchor, first window, last window, gram hash) of every run of windows with one anchor."""
    n = len(data)
    up, down = powers(n)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTES[data] * down, dtype=np.uint64)])
        h = (total[gram:] - total[:n - gram + 1]) * up[:n - gram + 1]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(28)
    bits = np.uint64(20)
    place = np.arange(len(h), dtype=np.uint64)
    least = sliding_least((h >> bits << bits) | place, window - gram + 1)  # ties: the leftmost
    at = (least & np.uint64((1 << 20) - 1)).astype(np.int64)
    last = np.append(np.flatnonzero(at[1:] != at[:-1]), len(at) - 1)
    first = np.append(0, last[:-1] + 1)
    return at[last], first, last, h[at[last]].view(np.int64)


def anchors(text: bytes, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor, first, last, gram hash, hash of the bytes of all its windows), every window in one run."""
    import xxhash

    data = np.frombuffer(text, dtype=np.uint8)
    parts = []
    for start in range(0, len(data) - window + 1, SEGMENT):
        at, first, last, key = segment_anchors(data[start:start + SEGMENT + window - 1], window, gram)
        parts.append((at + start, first + start, last + start, key))
    if not parts:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    at, first, last, key = map(np.concatenate, zip(*parts))
    view, digest = memoryview(text), xxhash.xxh3_64_intdigest
    held = np.fromiter((digest(view[a:b + window]) for a, b in zip(first.tolist(), last.tolist())), np.uint64, len(at))
    return at, first, last, key, held.view(np.int64)


# --- deep-shallow sorting ----------------------------------------------------------------------------------------------

def common_prefix(x: bytes, y: bytes) -> int:
    n = min(len(x), len(y))
    if x[:n] == y[:n]:
        return n
    differ = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
    return n - (differ.bit_length() + 7) // 8


class BlindTrie:
    """Trie of strings that keeps only where they part; a descent reads single bytes and compares once, at its end."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: tuple | None = None

    @staticmethod
    def _byte(string: bytes, depth: int) -> int:
        return string[depth] if depth < len(string) else -1  # the end sorts first

    def insert(self, i: int) -> None:
        """A node is (depth, {byte: node}); a leaf is [strings that are equal]."""
        string = self.strings[i]
        if self.root is None:
            self.root = [i]
            return
        node = self.root
        while isinstance(node, tuple):
            node = node[1].get(self._byte(string, node[0])) or next(iter(node[1].values()))
        other = self.strings[node[0]]
        depth = common_prefix(string, other)
        if depth == len(string) == len(other):
            node.append(i)
            return
        parent, node = None, self.root
        while isinstance(node, tuple) and node[0] < depth:
            parent, node = node, node[1][self._byte(string, node[0])]
        if isinstance(node, tuple) and node[0] == depth:
            node[1][self._byte(string, depth)] = [i]
            return
        split = (depth, {self._byte(other, depth): node, self._byte(string, depth): [i]})
        if parent is None:
            self.root = split
        else:
            parent[1][self._byte(string, parent[0])] = split

    def ordered(self) -> tuple[list[int], list[int]]:
        """The strings in order, and how many bytes each shares with the one before (0 for the first)."""
        order, shared = [], []
        todo = [(self.root, 0)] if self.root is not None else []
        while todo:
            node, depth = todo.pop()
            if isinstance(node, list):
                for k, i in enumerate(node):
                    order.append(i)
                    shared.append(len(self.strings[i]) if k else depth)
            else:
                children = sorted(node[1].items())
                todo += [(child, node[0] if k else depth) for k, (_, child) in reversed(list(enumerate(children)))]
        return order, shared


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> tuple[list[int], list[int]]:
    """Order of ``strings`` and the common prefix of each with the one before.

    Multikey quicksort parts them by one byte after the other, three ways around a pivot, down to ``shallow`` bytes;
    what is still together then has a long common prefix and is ordered by a blind trie.
    """
    order: list[int] = []
    shared: list[int] = []
    todo = [(list(range(len(strings))), 0, 0)]  # members, depth, bytes shared with the string before
    while todo:
        members, depth, before = todo.pop()
        if len(members) == 1:
            order.append(members[0])
            shared.append(before)
        elif depth >= shallow:
            trie = BlindTrie([strings[i] for i in members])
            for k in range(len(members)):
                trie.insert(k)
            places, lengths = trie.ordered()
            order += [members[k] for k in places]
            shared += [before, *lengths[1:]]
        else:
            byte = [strings[i][depth] if depth < len(strings[i]) else -1 for i in members]
            pivot = sorted((byte[0], byte[len(byte) // 2], byte[-1]))[1]
            less = [i for i, c in zip(members, byte) if c < pivot]
            same = [i for i, c in zip(members, byte) if c == pivot]
            more = [i for i, c in zip(members, byte) if c > pivot]
            if pivot < 0:  # all ended: equal strings
                order += same
                shared += [depth if (less or k) else before for k in range(len(same))]
                if more:
                    todo.append((more, depth, depth))
                continue
            parts = [(less, depth), (same, depth + 1), (more, depth)]
            parts = [(p, d) for p, d in parts if p]
            todo += [(p, d, before if k == 0 else depth) for k, (p, d) in reversed(list(enumerate(parts)))]
    return order, shared


def prefix_table(strings: list[bytes]) -> np.ndarray:
    """Common prefix of every two strings, from the sorted order: the least of the steps between them."""
    order, shared = deep_shallow(strings)
    n = len(order)
    out = np.zeros((n, n), dtype=np.int64)
    at = np.array(order)
    for i in range(n - 1):
        steps = np.minimum.accumulate(np.array(shared[i + 1:]))
        out[at[i], at[i + 1:]] = out[at[i + 1:], at[i]] = steps
    return out


def repeated_windows(contexts: list[bytes], offsets: list[int], window: int) -> list[list[tuple[int, int]]]:
    """Per context the runs [first, last] of windows, by start, that another context has at the same offset.

    ``contexts`` are the bytes of all windows of an anchor each, which stands ``offsets`` bytes from the start. A
    window that starts o bytes before the anchor is shared if o bytes to the left and window - o to the right are.
    """
    left = prefix_table([c[:o][::-1] for c, o in zip(contexts, offsets)])
    right = prefix_table([c[o:] for c, o in zip(contexts, offsets)])
    fits = left + right >= window
    np.fill_diagonal(fits, False)
    out = []
    for i, o in enumerate(offsets):
        at = np.flatnonzero(fits[i])
        lo = np.maximum(o - left[i, at], 0)
        hi = np.minimum(o + right[i, at] - window, min(len(contexts[i]) - window, o))
        out.append(sorted({(x, y) for x, y in zip(lo.tolist(), hi.tolist()) if x <= y}))
    return out


# --- the operator --------------------------------------------------------------------------------------------------------

def anchored(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Per row its text compressed, its size and hash, and its anchors as arrays."""
    doc_id = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"row long, doc_id {doc_id}, n_bytes long, sha256 string, packed binary, at array<long>, "
              "first array<long>, last array<long>, key array<long>, held array<long>")

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for start in range(0, len(batch), 500):
                part, out = batch.iloc[start:start + 500], []
                for row, doc_id, value in zip(part["row"], part["doc_id"].array, part["text"]):
                    text = text_bytes(value)
                    out.append((row, doc_id, len(text), hashlib.sha256(text).hexdigest(), pack(text),
                                *anchors(text, window, gram)))
                yield pd.DataFrame(out, columns=["row", "doc_id", "n_bytes", "sha256", "packed", "at", "first", "last",
                                                 "key", "held"])

    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInPandas(rows, schema)


def contexts(texts: DataFrame, chosen: DataFrame, window: int) -> DataFrame:
    """``chosen`` (row, at, first, last, ...) with the bytes of all windows of each anchor."""
    own = chosen.columns

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        row, text = None, b""
        for batch in batches:
            out = []
            for this, packed, first, last in zip(batch["row"], batch["packed"], batch["first"], batch["last"]):
                if this != row:
                    row, text = this, unpack(packed)
                out.append(text[first:last + window])
            yield batch[own].assign(context=out)

    from pyspark.sql.types import BinaryType, StructType

    joined = chosen.join(texts.select("row", "packed"), "row")
    schema = StructType([joined.schema[c] for c in own]).add("context", BinaryType())
    return joined.select(*own, "packed").mapInPandas(rows, schema)


def sorted_groups(held: DataFrame, window: int) -> DataFrame:
    """(row, start, end) of repeated windows, from all surroundings of a gram sorted in one task."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None

        def spans(frame: pd.DataFrame) -> pd.DataFrame:
            out, key = [], frame["key"].to_numpy()
            offsets = (frame["at"] - frame["first"]).tolist()
            texts, single = frame["context"].tolist(), frame["single"].tolist()
            row, first = frame["row"].tolist(), frame["first"].tolist()
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(key)]):
                found = repeated_windows(texts[start:end], offsets[start:end], window)
                for i, runs in enumerate(found, start):
                    if single[i]:  # the others are removed as a whole already
                        out += [(row[i], first[i] + lo, first[i] + hi + window) for lo, hi in runs]
            return pd.DataFrame(out, columns=["row", "start", "end"], dtype="int64")

        for batch in batches:
            rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            if len(rest):
                whole = (rest["key"] != rest["key"].iloc[-1]).to_numpy()
                if whole.any():
                    yield spans(rest[whole])
                    rest = rest[~whole]
        if rest is not None and len(rest):
            yield spans(rest)

    return (held.select("key", "row", "at", "first", "single", "context").repartition("key")
            .sortWithinPartitions("key").mapInPandas(rows, "row long, start long, end long"))


def sliced(held: DataFrame, window: int, width: int) -> DataFrame:
    """The windows of large groups in slices of ``width`` offsets from the anchor, as finer grams.

    A slice's gram is the part that all its windows share, so equal windows at the same offset have equal grams; and
    a slice whose gram occurs once is done with. The last width is 1, where a gram is a whole window.
    """
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash

        digest = xxhash.xxh3_64_intdigest
        names = ["row", "at", "first", "last", "key", "held"]
        for batch in batches:
            for begin in range(0, len(batch), 500):
                out = []
                part = batch.iloc[begin:begin + 500]
                for row, at, first, last, key, text in zip(*(part[c] for c in (*names[:5], "context"))):
                    view = memoryview(text)
                    for s in range((at - last) // width, (at - first) // width + 1):
                        near, far = s * width, s * width + width - 1
                        start, end = max(at - far, first), min(at - near, last)
                        gram = digest(view[at - near - first:at - far + window - first], (key + s) % 2**64)
                        out.append((row, at, start, end, gram, digest(view[start - first:end + window - first], 1)))
                frame = pd.DataFrame(out, columns=names)
                for c in ("key", "held"):
                    frame[c] = frame[c].astype("uint64").astype("int64")
                yield frame

    return held.select("row", "at", "first", "last", "key", "context").mapInPandas(
        rows, "row long, at long, first long, last long, key long, held long")


def inner_contexts(outer: DataFrame, chosen: DataFrame, window: int) -> DataFrame:
    """The bytes of slices, from the surroundings they were cut from."""
    source = outer.select("row", "at", F.col("first").alias("_first"), F.col("last").alias("_last"),
                          F.col("context").alias("_context"))
    within = chosen.join(source, ["row", "at"]).where("first >= _first and last <= _last")
    cut = F.substring("_context", (F.col("first") - F.col("_first") + 1).cast("int"),
                      (F.col("last") - F.col("first") + window).cast("int"))
    return within.withColumn("context", cut).drop("_first", "_last", "_context")


def repeated_spans(found: DataFrame, cut, window: int, classes: int, slices: tuple[int, ...]) -> DataFrame:
    """(row, start, end) of all repeated windows among the runs ``found`` (row, at, first, last, key, held).

    ``cut`` gives chosen runs their bytes.
    """
    often = (found.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("held").alias("lo"), F.max("held").alias("hi"))
             .where("n > 1").select("key", (F.col("lo") == F.col("hi")).alias("alike")))
    shared = materialize(found.join(often, "key"))
    kinds = materialize(shared.where("not alike").groupBy("key", "held").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("row", "at", "first", "last")).alias("x")))
    per_gram = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).where("least = 1")
    held = materialize(cut(kinds.join(per_gram, "key").select("key", "kinds", (F.col("n") == 1).alias("single"), "x.*")))
    twice = shared.where("not alike").join(kinds.where("n > 1").select("key", "held"), ["key", "held"])
    whole = (shared.where("alike").select("row", "first", "last").unionByName(twice.select("row", "first", "last"))
             .select("row", F.col("first").alias("start"), (F.col("last") + window).alias("end")))
    spans = whole.unionByName(sorted_groups(held.where(F.col("kinds") <= classes), window))
    large = held.where(F.col("kinds") > classes)
    if not slices or large.isEmpty():
        return spans
    finer = materialize(sliced(large, window, slices[0]))
    return spans.unionByName(repeated_spans(
        finer, lambda chosen: inner_contexts(large, chosen, window), window, classes, slices[1:]))


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, classes: int = CLASSES) -> DataFrame:
    """Per row doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed spans as arrays of start and end.

    A byte goes if a string of ``window`` bytes that covers it also starts at another place of any text. Grams that
    occur once are dropped by their hashes. An anchor whose whole surroundings occur twice is removed with all its
    windows; where surroundings differ, one of each kind meets the others of its gram and is sorted both ways from
    the anchor. Copies so count once, however many there are. More than ``classes`` kinds of one gram fit no task:
    they are dealt out by the finer grams of their slices, and again. A null text is empty; repeated rows repeat each other,
    so both lose what they share; texts shorter than ``window`` stay whole.
    """
    base = materialize(anchored(docs.select("doc_id", "text"), window, gram))
    found = base.select("row", F.explode(F.arrays_zip("at", "first", "last", "key", "held")).alias("x")).select("row", "x.*")
    spans = repeated_spans(found, lambda chosen: contexts(base, chosen, window), window, classes, SLICES)
    per_row = spans.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("spans"))  # of one text only

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            out = []
            for row, packed, starts, ends in zip(batch["row"], batch["packed"], batch["starts"], batch["ends"]):
                text, kept, at, merged = unpack(packed), hashlib.sha256(), 0, []
                for start, end in sorted(zip(starts.tolist(), ends.tolist())):
                    if merged and start <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], end)
                    else:
                        merged.append([start, end])
                for start, end in merged:
                    kept.update(text[at:start])
                    at = end
                kept.update(text[at:])
                out.append((row, sum(e - s for s, e in merged), len(merged), kept.hexdigest(),
                            [s for s, _ in merged], [e for _, e in merged]))
            yield pd.DataFrame(out, columns=["cut_row", "n_removed", "n_spans", "kept_sha256", "starts", "ends"])

    cut = (base.select("row", "packed").join(per_row, "row")
           .select("row", "packed", F.col("spans.start").alias("starts"), F.col("spans.end").alias("ends"))
           .mapInPandas(rows, "cut_row long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, "
                              "ends array<long>"))
    none = F.array().cast("array<bigint>")
    return (base.select("row", "doc_id", "n_bytes", "sha256").join(cut, F.col("row") == F.col("cut_row"), "left")
            .select("doc_id", "n_bytes", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"),
                    F.coalesce("n_spans", F.lit(0).cast("long")).alias("n_spans"),
                    F.coalesce("kept_sha256", "sha256").alias("kept_sha256"),
                    F.coalesce("starts", none).alias("starts"), F.coalesce("ends", none).alias("ends")))
