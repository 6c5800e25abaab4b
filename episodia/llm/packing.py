"""Bounded-space online best-fit packing of token pieces into sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from .tokens import chunk_tokenizer

CAPACITY = 4096
OPEN_BINS = 512
END = (1).to_bytes(4, "little")
PACKED = ("doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


class OpenBins:
    """A fixed number of open bins; ``free`` has bit f set while a bin with free space f is open.

    An item goes to the open bin with the least sufficient space. Without one a new bin opens, and if that is one
    too many, the fullest closes.
    """

    def __init__(self, capacity: int, most: int, first: int = 0):
        self.capacity, self.most = capacity, most
        self.free, self.bins, self.n_open, self.next = 0, {}, 0, first

    def _take(self, space: int) -> int:
        held = self.bins[space]
        bin_id = held.pop()
        if not held:
            self.free &= ~(1 << space)
        self.n_open -= 1
        return bin_id

    def _put(self, space: int, bin_id: int) -> None:
        if not space:
            return  # full
        if self.n_open == self.most:
            fullest = (self.free & -self.free).bit_length() - 1
            if fullest >= space:
                return  # this bin is the fullest, so it is the one that closes
            self._take(fullest)
        self.bins.setdefault(space, []).append(bin_id)
        self.free |= 1 << space
        self.n_open += 1

    def place(self, size: int) -> tuple[int, int]:
        """Bin and offset of an item of ``size`` tokens, 1 to the capacity."""
        fitting = self.free >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            bin_id = self._take(space)
        else:
            space, bin_id = self.capacity, self.next
            self.next += 1
        self._put(space - size, bin_id)
        return bin_id, self.capacity - space


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY,
         open_bins: int = OPEN_BINS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and then id 1, so a null or empty text is one piece of one token. Only documents longer
    than ``capacity`` are cut. Every task packs what it reads with bins of its own, the pieces of one batch from
    the longest to the shortest; there is no shuffle, and a lost task is repeated with the same result. Repeated
    rows are packed each; an empty table gives an empty result.
    """
    def packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        coder = chunk_tokenizer(tokenizer)
        bins = OpenBins(capacity, open_bins, TaskContext.get().partitionId() << 40)
        step = 4 * capacity
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch["doc_id"], coder.encode(batch["text"].tolist())):
                ids += END
                for piece, at in enumerate(range(0, len(ids), step)):
                    cut = ids[at:at + step]
                    rows.append((doc_id, piece, at // 4, len(cut) // 4, zlib.crc32(cut)))
            rows.sort(key=lambda r: -r[3])
            placed = [(*r, *bins.place(r[3])) for r in rows]
            yield pd.DataFrame(placed, columns=PACKED.replace(" long", "").replace(" int", "").split(", "))

    return docs.select("doc_id", "text").mapInPandas(packed, PACKED)
