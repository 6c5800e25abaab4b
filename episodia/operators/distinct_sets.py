"""Exact distinct counts of overlapping windows, from bitmaps that are made once per episode.

Values get dense codes; an episode's set is a bitmap per 32,768 codes. Windows unite the bitmaps of their episodes, so
a pair is aggregated once, in its episode, however many windows hold it. Bitmaps pay where sets are large or windows
many: each takes 4 KiB, whatever is in it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import sorted_positions
from .tallies import EPISODE


def codes(cells: DataFrame, value: str) -> DataFrame:
    """(value, code): numbers from 1 without gaps, in the order of the values; nulls have none."""
    return sorted_positions(cells.where(F.col(value).isNotNull()).select(value).distinct(), [value], "code")


def episode_sets(cells: DataFrame, key: str, counted: str, of: DataFrame | None = None) -> DataFrame:
    """(campaign, episode, key, bucket, bits, first_seq): the set of ``counted`` codes of each key in each episode.

    A key that goes with nulls alone has a row without bits, so that it is known with a count of 0.
    """
    coded = cells.join(codes(cells, counted) if of is None else of, counted, "left")
    return coded.where(F.col(key).isNotNull()).groupBy(
        *EPISODE, key, F.bitmap_bucket_number("code").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("code")).alias("bits"), F.min("first_seq").alias("first_seq"))


def united(sets: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """The sets of larger groups: bitmaps of one key and bucket meet in one, partly before the shuffle."""
    return sets.groupBy(*by, key, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"), F.min("first_seq").alias("first_seq"))


def set_sizes(sets: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    """Exact numbers of distinct values per key, with the key's first place."""
    sizes = F.when(F.col("bucket").isNotNull(), F.bitmap_count("bits")).otherwise(F.lit(0).cast("bigint"))
    return sets.groupBy(*by, key).agg(F.sum(sizes).alias("n"), F.min("first_seq").alias("first_seq"))


def shared_by_many(sets: DataFrame, by: Sequence[str], key: str, others: int = 1) -> DataFrame:
    """Keys that go with more than ``others`` values."""
    return set_sizes(sets, by, key).where(F.col("n") > others)
