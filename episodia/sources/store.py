"""Transcripts and folded logs stored so that windows find their episodes without moving them.

A stored table lies in partitions by shelf, a share of a campaign's episodes, and in buckets by its join keys. Windows
join it bucket by bucket: their own few columns travel to the buckets, the texts stay. Shelves that no window asks for
are not opened.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tallies import EPISODE

SHELVES = 16  # of a campaign; so many partitions at most are told to the tasks
BUCKETS = 64


def shelf() -> Column:
    return F.concat_ws("-", F.col("campaign"), F.pmod(F.col("episode"), F.lit(SHELVES)).cast("string"))


class Store:
    """Bucketed tables under ``folder``, which any session may open again."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def _table(self, name: str) -> str:
        return f"{name}_{hashlib.md5(self.folder.encode()).hexdigest()[:12]}"

    def write(self, name: str, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        """Store ``rows``, which have campaign and episode, in buckets by ``keys``; an older table goes.

        Each task writes one bucket, sorted, so a shelf has at most a file for each bucket. Give keys that part a hot
        episode, such as its chunks.
        """
        table = self._table(name)
        self.spark.sql(f"DROP TABLE IF EXISTS {table}")
        (rows.withColumn("shelf", shelf()).repartition(self.buckets, *keys).sortWithinPartitions("shelf", *keys)
         .write.mode("overwrite").partitionBy("shelf").bucketBy(self.buckets, *keys).sortBy(*keys)
         .option("path", f"{self.folder}/{name}").saveAsTable(table))
        return self.read(name)

    def open(self, name: str, schema: str, keys: Sequence[str]) -> DataFrame:
        """A table that another session wrote, by its columns and keys; ``buckets`` must be what it was written with."""
        table, names = self._table(name), ", ".join(keys)
        if not self.spark.catalog.tableExists(table):
            self.spark.sql(f"CREATE TABLE {table} ({schema}, shelf STRING) USING parquet PARTITIONED BY (shelf) CLUSTERED BY ({names}) "
                           f"SORTED BY ({names}) INTO {self.buckets} BUCKETS LOCATION '{self.folder}/{name}'")
            self.spark.sql(f"MSCK REPAIR TABLE {table}")
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.table(self._table(name))

    def asked_for(self, name: str, members: DataFrame) -> DataFrame:
        """Rows of a table on the shelves of the episodes in ``members``, still in their buckets.

        The shelves are known when the windows are, so the scan lists their folders alone. There are as many at most as
        the table has partitions, whatever the number of windows.
        """
        asked = members.select(shelf().alias("shelf")).where(F.length("shelf") > 0).distinct()
        return self.read(name).join(F.broadcast(asked), "shelf", "left_semi").drop("shelf")


CHUNK_KEYS = [*EPISODE, "chunk"]


def store_transcripts(store: Store, chunks: DataFrame, name: str = "transcripts") -> DataFrame:
    """Transcript chunks (campaign, episode, chunk, chars, text), for ``context_texts`` by ``store.asked_for``."""
    return store.write(name, chunks, CHUNK_KEYS)


def store_cells(store: Store, cells: DataFrame, name: str) -> DataFrame:
    """A log folded to its cells, for ``windows.spread``: a window's episodes meet their cells in the buckets."""
    return store.write(name, cells, list(EPISODE))
