"""MinHash near-duplicates: a multi-index Hamming join of b-bit signatures, links confirmed on full shingle sets."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_bytes, worker_cache
from .graph import components

POSITIONS = 32  # b-bit values per signature
CHUNKS = 8  # a signature is split into so many parts
ERRORS = 1  # differing values looked up within a part
#: by pigeonhole, two signatures that differ in at most so many places have a part with at most ERRORS differences
DISTANCE = CHUNKS * (ERRORS + 1) - 1
CONFIRM = 20  # pairs that share a bucket are confirmed on full sets up to this distance
BLOCK = 2048  # members of a bucket that make a block; two blocks meet in a cell, so a cell has twice as many at most
KEEP = 250_000  # words whose hashes a worker remembers


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        return x ^ (x >> np.uint64(27))


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``width`` words; a shorter text is one shingle."""
    words = text.lower().split()  # both work on ASCII bytes only
    if not words:
        return np.empty(0, dtype=np.uint64)
    hashes = worker_cache("shingles", _Hashes)
    if len(hashes) > KEEP:
        hashes.clear()
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - width + 1)
    total = np.full(n, len(h) if len(h) < width else width, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(min(width, len(h))):
            total = mix(total * np.uint64(0x9E3779B97F4A7C15) + h[k:k + n])
    return np.unique(total)


def signature(shingles: np.ndarray) -> bytes:
    """The low 16 bits of the smallest value under each of ``POSITIONS`` hash functions."""
    rng = np.random.Generator(np.random.PCG64(20240229))
    odd, flip = (rng.integers(1, 2**63, POSITIONS, dtype=np.uint64) for _ in range(2))
    odd = odd * np.uint64(2) + np.uint64(1)
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 1 << 16):
            least = np.minimum(least, ((shingles[at:at + (1 << 16), None] ^ flip) * odd).min(axis=0))
    return mix(least).astype("<u2").tobytes()


def described(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, set_key, signature) of every row; set_key is a 128-bit hash of the whole set."""
    import xxhash

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"].array, batch["text"]):
                held = shingle_set(text_bytes(text), width)
                out.append((doc_id, len(held), xxhash.xxh3_128_digest(held.tobytes()) if len(held) else None,
                            signature(held) if len(held) else None))
            yield pd.DataFrame(out, columns=["doc_id", "n_shingles", "set_key", "signature"])

    doc_id = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(
        rows, f"doc_id {doc_id}, n_shingles long, set_key binary, signature binary")


def bucket_keys(signatures: np.ndarray) -> np.ndarray:
    """Keys [signature, key]: each part of a signature with each choice of ``ERRORS`` places left out."""
    size = POSITIONS // CHUNKS
    out = []
    for chunk in range(CHUNKS):
        part = signatures[:, chunk * size:(chunk + 1) * size].astype(np.uint64)
        for left_out in range(size):
            key = np.full(len(part), chunk * size + left_out + 1, dtype=np.uint64)
            for k in range(size):
                if k != left_out:
                    key = mix((key << np.uint64(16)) * np.uint64(0x9E3779B97F4A7C15) + part[:, k])
            out.append(key)
    return np.stack(out, axis=1).view(np.int64)


def buckets(nodes: DataFrame) -> DataFrame:
    """(key, node) for all keys of all signatures."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                held = np.frombuffer(b"".join(batch["signature"]), dtype="<u2").reshape(len(batch), POSITIONS)
                keys = bucket_keys(held)
                yield pd.DataFrame({"key": keys.ravel(), "node": np.repeat(batch["node"].to_numpy(), keys.shape[1])})

    return nodes.select("node", "signature").mapInPandas(rows, "key long, node long")


def likely(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) within ``CONFIRM`` of each other's signature whose set sizes allow the similarity."""
    sizes = nodes.select("node", "n_shingles", "signature")
    both = (pairs.join(sizes.toDF("a", "n_a", "s_a"), "a").join(sizes.toDF("b", "n_b", "s_b"), "b")
            .where("100 * least(n_a, n_b) >= {0} * greatest(n_a, n_b)".format(percent)))

    def near(s_a: pd.Series, s_b: pd.Series) -> pd.Series:
        x, y = (np.frombuffer(b"".join(s), dtype="<u2").reshape(-1, POSITIONS) for s in (s_a, s_b))
        return pd.Series((x != y).sum(axis=1) <= CONFIRM)

    return both.where(F.pandas_udf(near, "boolean")("s_a", "s_b")).select("a", "b")


def packed_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, packed): the compressed texts of the nodes ``wanted`` (node, set_key)."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "packed": [pack(text_bytes(t)) for t in batch["text"]]})

    small = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(
        rows, "doc_id long, packed binary")
    return small.join(wanted, F.col("doc_id") == F.col("node")).select("node", "set_key", "packed")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xxhash
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        last: tuple = (None, None)

        def whole(packed: bytes, key: bytes):
            held = shingle_set(unpack(packed), width)
            return held if xxhash.xxh3_128_digest(held.tobytes()) == key else None  # another row of that doc_id

        for batch in batches:
            out = []
            for a, b, text_a, key_a, text_b, key_b in batch.itertuples(index=False, name=None):
                if last[0] != (b, text_b):
                    last = ((b, text_b), whole(text_b, key_b))
                x, y = whole(text_a, key_a), last[1]
                if x is None or y is None:
                    continue
                common = len(x) + len(y) - len(np.union1d(x, y))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    out.append((a, b))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return (pairs.join(texts.toDF("a", "key_a", "text_a"), "a").join(texts.toDF("b", "key_b", "text_b"), "b")
            .select("a", "b", "text_a", "key_a", "text_b", "key_b").mapInPandas(rows, "a long, b long").distinct())


def near_in_cells(starts: np.ndarray, sizes: np.ndarray, component: np.ndarray, n: np.ndarray, signatures: np.ndarray,
                  percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows (i, j) within ``CONFIRM`` and of different components, of cells that are runs of rows.

    Cells of one size go together.
    """
    for size in np.unique(sizes[sizes > 1]):
        of_size = starts[sizes == size]
        step = max(1, (1 << 19) // int(size * size))
        upper = np.triu(np.ones((size, size), dtype=bool), 1)
        for begin in range(0, len(of_size), step):
            at = of_size[begin:begin + step, None] + np.arange(size)
            differ = np.zeros((len(at), size, size), dtype=np.uint8)
            for k in range(POSITIONS):
                value = signatures[at, k]
                differ += value[:, :, None] != value[:, None, :]
            c = component[at]
            which, i, j = np.nonzero((differ <= CONFIRM) & upper & (c[:, :, None] != c[:, None, :]))
            i, j = at[which, i], at[which, j]
            fit = 100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j])
            yield i[fit], j[fit]


class Linker:
    """Links between components, confirmed on full sets; a task remembers which components it has joined."""

    def __init__(self, width: int, percent: int):
        import zstandard

        self.width, self.percent = width, percent
        self.unpack = zstandard.ZstdDecompressor().decompress
        self.joined: dict[int, int] = {}
        self.sets: dict[tuple[int, bytes], np.ndarray] = {}

    def root(self, component: int) -> int:
        while component in self.joined:
            component = self.joined[component]
        return component

    def set_of(self, node: int, packed: bytes, key: bytes) -> np.ndarray:
        import xxhash

        if (node, key) not in self.sets:
            held = shingle_set(self.unpack(packed), self.width)
            if xxhash.xxh3_128_digest(held.tobytes()) != key:  # another row of that doc_id
                return np.empty(0, dtype=np.uint64)
            if len(self.sets) > 4096:
                self.sets.clear()
            self.sets[node, key] = held
        return self.sets[node, key]

    def links(self, frame: pd.DataFrame, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, int]]:
        """(larger, smaller node) of pairs that join two components which nothing joined before."""
        node, component, packed, key = (frame[c].tolist() for c in ("node", "component", "packed", "set_key"))
        order = np.argsort(i, kind="stable")
        i, j = i[order], j[order]
        starts = np.flatnonzero(np.diff(i, prepend=-1))
        for begin, end in zip(starts.tolist(), [*starts[1:].tolist(), len(i)]):
            a = int(i[begin])
            for at in range(begin, end, 64):
                others = [b for b in j[at:min(end, at + 64)].tolist()
                          if self.root(component[b]) != self.root(component[a])]
                if not others:
                    continue
                x = self.set_of(node[a], packed[a], key[a])
                held = [self.set_of(node[b], packed[b], key[b]) for b in others]
                sizes = np.array([len(y) for y in held])
                if not len(x) or not sizes.all():
                    held, others = [y for y in held if len(x) and len(y)], [b for b, n in zip(others, sizes) if len(x) and n]
                    sizes = np.array([len(y) for y in held])
                    if not held:
                        continue
                every = np.concatenate(held)
                hit = x[np.minimum(np.searchsorted(x, every), len(x) - 1)] == every
                common = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
                for b in np.flatnonzero(100 * common >= self.percent * (len(x) + sizes - common)).tolist():
                    r, s = self.root(component[a]), self.root(component[others[b]])
                    if r != s:
                        self.joined[max(r, s)] = min(r, s)
                        yield max(node[a], node[others[b]]), min(node[a], node[others[b]])


def cross_links(rest: DataFrame, width: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) between bucket members in different components, enough to join what belongs together.

    ``rest`` has key, node, component, n_shingles, signature, set_key, packed and the bucket's size. A large bucket
    is dealt into cells: its members into blocks, and a cell for every two blocks, so no task meets a whole bucket.
    Pairs within ``CONFIRM`` of each other's signature are found and confirmed inside the cell; only links leave it.
    """
    blocks = F.ceil(F.col("size") / BLOCK)
    columns = ["cell", "node", "component", "n_shingles", "signature", "set_key", "packed"]
    cells = (rest.withColumn("own", F.pmod(F.xxhash64("node"), blocks))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
             .withColumn("cell", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
             .select(*columns))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, linker = None, Linker(width, percent)

        def found(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.reset_index(drop=True)
            cell, component, n = (frame[c].to_numpy() for c in ("cell", "component", "n_shingles"))
            signatures = np.frombuffer(b"".join(frame["signature"]), dtype="<u2").reshape(len(frame), POSITIONS)
            starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
            sizes = np.diff(np.r_[starts, len(cell)])
            out = [link for i, j in near_in_cells(starts, sizes, component, n, signatures, percent)
                   for link in linker.links(frame, i, j)]
            return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

        for batch in batches:
            held = batch if held is None else pd.concat([held, batch], ignore_index=True)
            if len(held):
                whole = (held["cell"] != held["cell"].iloc[-1]).to_numpy()
                if whole.any():
                    yield found(held[whole])
                    held = held[~whole]
        if held is not None and len(held):
            yield found(held)

    return cells.repartition("cell").sortWithinPartitions("cell").mapInPandas(rows, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row: components of documents linked by similarity.

    Documents with equal sets are one node. All keys of a signature with up to ``ERRORS`` values of a part left
    out put every two signatures within ``DISTANCE`` into a common bucket. First each member of a bucket is held
    against the bucket's smallest node; where members then still lie in different components, all of those pairs
    within ``CONFIRM`` follow, cell by cell. Links are confirmed on the full sets of whole texts. A group of
    near copies so makes about one row a member, and no link between components is left out.

    A null or empty text has an empty set and no links. Rows with one doc_id are one document; a row without
    doc_id has no component and is kept. ``docs`` needs integer doc_id and text.
    """
    rows = materialize(described(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), width))
    classes = (rows.where("set_key is not null and doc_id is not null").groupBy("set_key")
               .agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"),
                    F.first("signature").alias("signature")))
    nodes = materialize(classes)
    members = materialize(buckets(nodes))
    heads = members.groupBy("key").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = materialize(members.join(heads, "key").where("node <> head"))  # head and size of every other member
    pairs = materialize(likely(shared.select(F.col("node").alias("a"), F.col("head").alias("b")).distinct(), nodes, percent))

    # texts of the nodes that may be compared in either round
    later = shared.where("size > 2").select("node")
    wanted = pairs.select("a").union(pairs.select("b")).union(later).toDF("node").distinct()
    texts = materialize(packed_texts(docs.select("doc_id", "text"), nodes.select("node", "set_key").join(wanted, "node")))
    edges = materialize(confirmed(pairs, texts, width, percent))
    first = components(edges)

    placed = (shared.where("size > 2").join(first, "node", "left")
              .withColumn("component", F.coalesce("component", "node")))
    mixed = (placed.groupBy("key").agg(F.min("component").alias("least"), F.max("component").alias("most"))
             .where("least <> most").select("key"))
    rest = placed.join(mixed, "key").join(nodes.select("node", "n_shingles", "signature"), "node").join(texts, "node")
    more = materialize(cross_links(rest, width, percent))
    if not more.isEmpty():
        first = components(first.toDF("a", "b").union(more))

    of_class = nodes.select("set_key", "node").join(first, "node", "left").select(
        "set_key", F.coalesce("component", "node").alias("linked"))
    return (rows.join(of_class, "set_key", "left")
            .select("doc_id", "n_shingles", F.coalesce("linked", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def one_of_each_group(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near copies: the one with the smallest doc_id, then of equal rows any.

    Every row is a document of its own here, so rows that share a doc_id with different texts are told apart. Rows
    without doc_id stay, and of rows without a word those of one doc_id and text stay once. ``docs`` needs doc_id and
    text, and no columns of the names ``row`` and ``alike``.
    """
    alike = F.xxhash64("doc_id", "text")
    numbered = materialize(docs.where("doc_id is not null").withColumns(
        {"row": F.monotonically_increasing_id(), "alike": alike}))
    found = near_duplicates(numbered.select(F.col("row").alias("doc_id"), "text"), width, percent)
    of_row = found.select(F.col("doc_id").alias("row"), "component_id", (F.col("n_shingles") > 0).alias("worded"))
    group = F.when(F.col("worded"), F.struct(F.lit(0).alias("alike"), F.col("component_id").alias("id"))).otherwise(
        F.struct("alike", F.col("doc_id").cast("long").alias("id")))
    least = F.min(F.struct("doc_id", "row"))["row"].alias("row")
    stay = numbered.select("row", "doc_id", "alike").join(of_row, "row").groupBy("worded", group.alias("group")).agg(least)
    kept = numbered.join(stay.select("row"), "row", "left_semi").drop("row", "alike")
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns]).union(docs.where("doc_id is null"))
