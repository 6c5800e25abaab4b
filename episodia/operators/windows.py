"""Context windows: sampled sets of episodes, their members, and sampled question parameters.

Samples are ranked by an MD5 digest of seed and value: the same rows come out whatever the
partitioning, and ``k`` smallest per group is a limit Spark applies before the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.text import valid_character, valid_roll_type, valid_spell, window_id
from .tallies import EPISODE

WINDOW = ("context_window_id", "campaign")


def draw(*parts: Column | str, seed: int = fixed.SEED) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[
        (F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]))


def keep_smallest(rows: DataFrame, by: Sequence[str], order: Sequence[Column], k: int | Column) -> DataFrame:
    window = Window.partitionBy(*by).orderBy(*order)
    limit = F.lit(k) if isinstance(k, int) else k
    return rows.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= limit)


# --- episodes -----------------------------------------------------------------------------------

def episodes_of(log: DataFrame) -> DataFrame:
    return log.select(*EPISODE).distinct()


def with_transcript(episodes: DataFrame, transcripts: DataFrame) -> DataFrame:
    return episodes.join(transcripts.select(*EPISODE).distinct(), list(EPISODE), "left_semi")


def without_transcript(episodes: DataFrame, transcripts: DataFrame) -> DataFrame:
    return episodes.join(transcripts.select(*EPISODE).distinct(), list(EPISODE), "left_anti")


# --- sampled windows -----------------------------------------------------------------------------

def single_windows(episodes: DataFrame, count: int = fixed.WINDOWS_PER_SIZE) -> DataFrame:
    """Up to ``count`` one-episode windows per campaign."""
    order = [draw(F.lit("single"), "campaign", "episode"), F.col("episode")]
    picked = keep_smallest(episodes.select(*EPISODE), ["campaign"], order, count)
    return _as_windows(picked.select("campaign", F.array("episode").alias("episodes")))


def multi_windows(episodes: DataFrame, sizes: Sequence[int] = fixed.WINDOW_SIZES,
                  count: int = fixed.WINDOWS_PER_SIZE) -> DataFrame:
    """Distinct sampled episode sets, up to ``count`` per size and campaign.

    Each episode row is unfolded to (size, sample) tickets and every sample keeps its ``size``
    lowest tickets, so no table is paired with another. Sizes beyond the number of episodes are
    left out.
    """
    tickets = (
        episodes.select(*EPISODE)
        .withColumn("size", F.explode(F.array(*[F.lit(s) for s in sizes])))
        .withColumn("sample", F.explode(F.sequence(F.lit(1), F.lit(count))))
    )
    order = [draw(F.lit("multi"), "campaign", "size", "sample", "episode"), F.col("episode")]
    by = ["campaign", "size", "sample"]
    # the constant bound lets Spark cut each group before the shuffle
    picked = keep_smallest(tickets, by, order, max(sizes)).where("_rank <= size")
    sets = picked.groupBy(*by).agg(F.sort_array(F.collect_list("episode")).alias("episodes"))
    return _as_windows(
        sets.where(F.size("episodes") == F.col("size")).select("campaign", "episodes").distinct())


def _as_windows(sets: DataFrame) -> DataFrame:
    return sets.select(
        window_id(F.col("campaign"), F.col("episodes")).alias("context_window_id"),
        "campaign", F.col("episodes").cast("array<int>").alias("episodes"))


def sampled_windows(episodes: DataFrame, toy: bool = False) -> DataFrame:
    """One-episode and several-episode windows of a question set."""
    count = fixed.WINDOWS_PER_SIZE_TOY if toy else fixed.WINDOWS_PER_SIZE
    return single_windows(episodes, count).unionByName(multi_windows(episodes, count=count))


def members_of(windows: DataFrame, *carried: str) -> DataFrame:
    """One row per window and episode; ``ordinal`` is the 1-based place in the window."""
    return windows.select(*WINDOW, *carried, F.posexplode("episodes").alias("ordinal", "episode")).select(
        *WINDOW, *carried, "episode", (F.col("ordinal") + 1).alias("ordinal"))


def number_members(members: DataFrame, by: Sequence[str]) -> DataFrame:
    """Add ``ordinal`` to given window members."""
    return members.withColumn(
        "ordinal", F.row_number().over(Window.partitionBy(*by).orderBy("episode")))


def spread(cells: DataFrame, members: DataFrame) -> DataFrame:
    """Cells of every window. Give compacted cells: each one is repeated for all its windows."""
    return members.join(cells, list(EPISODE))


# --- sampled parameters ----------------------------------------------------------------------------

def candidates(cells: DataFrame, by: Sequence[str], **kinds: Column) -> DataFrame:
    """Distinct ``(by, kind, value)`` rows of several columns in one pass; null values are left out."""
    pairs = F.array(*[F.struct(F.lit(kind).alias("kind"), value.alias("value"))
                      for kind, value in kinds.items()])
    return cells.select(*by, F.inline(pairs)).where("value is not null").distinct()


def dice(groups: DataFrame, by: Sequence[str]) -> DataFrame:
    """The natural values 1–20 of every group, whether rolled or not."""
    return groups.select(*by, F.lit("roll_value").alias("kind"),
                         F.explode(F.array(*[F.lit(v) for v in fixed.ROLL_VALUES])).alias("value"))


def sample_values(values: DataFrame, by: Sequence[str], k: int = fixed.PARAMS_PER_KIND) -> DataFrame:
    """Up to ``k`` of the given ``(by, kind, value)`` rows per group and kind."""
    order = [draw(*by, "kind", "value"), F.col("value")]
    return keep_smallest(values, [*by, "kind"], order, k).drop("_rank")


def when_valid(column: str, valid) -> Column:
    return F.when(valid(F.col(column)), F.col(column))


def sample_params(roll_cells: DataFrame, spell_cells: DataFrame, groups: DataFrame,
                  by: Sequence[str]) -> DataFrame:
    """All sampled question parameters of each group, ``(by, kind, value)``."""
    of_rolls = candidates(roll_cells, by, roll_character=when_valid("character", valid_character),
                          roll_type=when_valid("roll_type", valid_roll_type))
    of_spells = candidates(spell_cells, by, spell_character=when_valid("character", valid_character),
                           spell=when_valid("spell", valid_spell))
    return sample_values(of_rolls.unionByName(of_spells).unionByName(dice(groups, by)), by)


PROBE_KINDS = ("rolls_cumulative", "rolls_cumulative_by_character", "spells_cumulative",
               "nth_1", "nth_2", "nth_3")


def probe_ordinals(members: DataFrame, by: Sequence[str], kinds: Sequence[str] = PROBE_KINDS,
                   k: int = fixed.PROBES) -> DataFrame:
    """Up to ``k`` places per window and question kind."""
    tickets = members.select(*by, "ordinal").withColumn(
        "kind", F.explode(F.array(*[F.lit(kind) for kind in kinds])))
    order = [draw(*by, "kind", "ordinal"), F.col("ordinal")]
    return keep_smallest(tickets, [*by, "kind"], order, k).drop("_rank")
