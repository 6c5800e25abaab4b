"""Questions over the roll log. ``by`` names the group: an episode or a context window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.text import decimal_or_null, digits, percentage, valid_character, valid_roll_type
from ..operators import tallies as t

ROLL_KEYS = ("character", "roll_type", "natural_value")


def rolls_total(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    return t.row_count(cells, by)


def rolls_by_character(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    kept = cells.where(valid_character(F.col("character")))
    return t.count_by(kept, by, "character").drop("first_seq")


def by_player(character_counts: DataFrame, players: DataFrame) -> DataFrame:
    """Hand each character's count to every player who plays it; the game master is left out."""
    on = ["campaign", "character"] if "campaign" in players.columns else ["character"]
    kept = players.where(F.col("character") != fixed.GAME_MASTER).select(*on, "player")
    return character_counts.join(kept, on).drop("character")


def rolls_by_player(cells: DataFrame, by: Sequence[str], players: DataFrame) -> DataFrame:
    return by_player(rolls_by_character(cells, by), players)


def rolls_by_type(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    kept = cells.where(valid_roll_type(F.col("roll_type")))
    return t.count_by(kept, by, "roll_type").drop("first_seq")


def value_table(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """One wide row per group: all rolls, and the rolls of each natural value, in one pass."""
    value = F.col("natural_value")
    return t.totals(cells, by, total=F.lit(1),
                    **{f"v{v}": t.flag(value == v) for v in fixed.ROLL_VALUES})


def values_long(wide: DataFrame, by: Sequence[str]) -> DataFrame:
    """Every natural value of every group, values never rolled included."""
    pairs = ", ".join(f"'{v}', v{v}" for v in fixed.ROLL_VALUES)
    return wide.select(*by, "total", F.expr(f"stack({len(fixed.ROLL_VALUES)}, {pairs}) as (roll_value, n)"))


def rolls_by_value(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    return values_long(value_table(cells, by), by).drop("total")


def rolls_value_pct(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    counted = values_long(value_table(cells, by), by)
    return counted.select(*by, "roll_value", percentage(F.col("n"), F.col("total")).alias("pct"))


def roll_type_mode(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    return t.most_common(cells, by, "roll_type")


def roll_type_rarest(cells: DataFrame, by: Sequence[str], min_count: int = 1) -> DataFrame:
    return t.least_common(cells, by, "roll_type", min_count)


def roll_value_mode(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    return t.most_common(cells, by, "natural_value")


def roll_value_rarest(cells: DataFrame, by: Sequence[str], min_count: int = 1) -> DataFrame:
    return t.least_common(cells, by, "natural_value", min_count)


def rolls_of_values(cells: DataFrame, by: Sequence[str], values: Sequence[str]) -> DataFrame:
    return t.totals(cells, by, n=t.flag(F.col("natural_value").isin(*values)))


def crits(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    return rolls_of_values(cells, by, ("1", "20"))


def nat20s(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    return rolls_of_values(cells, by, ("20",))


def nat1s(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    return rolls_of_values(cells, by, ("1",))


def kills_total(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    return t.totals(cells, by, n=digits(F.col("kills")))


def kills_by_character(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Kills of every named character, zero where none is a plain number."""
    return t.totals(cells.where(F.col("character").isNotNull()), [*by, "character"],
                    n=digits(F.col("kills")))


def damage_dealt(log: DataFrame, by: Sequence[str]) -> DataFrame:
    """Damage of the whole group (``scope`` total) and of each named character.

    Sums are decimal, so they do not depend on partitioning.
    """
    per_character = log.groupBy(*by, "character").agg(
        F.sum(decimal_or_null(F.col("damage_dealt"))).alias("part"))
    # each small sum goes to its character and to the whole, so the log is scanned once
    scopes = F.array(
        F.struct(F.lit("total").alias("scope"), F.lit(None).cast("string").alias("name")),
        F.struct(F.lit("character").alias("scope"), F.col("character").alias("name")))
    long = per_character.select(*by, "part", F.inline(scopes)).where("scope = 'total' or name is not null")
    return long.groupBy(*by, "scope", F.col("name").alias("character")).agg(
        F.coalesce(F.sum("part").cast("double"), F.lit(0.0)).alias("damage"))


# --- several episodes -------------------------------------------------------------------------------

def cumulative(members: DataFrame, counts: DataFrame, by: Sequence[str],
               extra: Sequence[str] = ()) -> DataFrame:
    """Running total per window member; members without log rows add nothing."""
    order = Window.partitionBy(*by, *extra).orderBy("ordinal").rowsBetween(
        Window.unboundedPreceding, 0)
    dense = members.join(counts, [*t.EPISODE, *extra], "left")
    return dense.select(
        *by, *extra, "ordinal",
        F.sum(F.coalesce(F.col("n"), F.lit(0))).over(order).cast("bigint").alias("n"))


def rolls_cumulative(cells: DataFrame, members: DataFrame, by: Sequence[str]) -> DataFrame:
    return cumulative(members, t.row_count(cells, t.EPISODE), by)


def rolls_cumulative_by_character(cells: DataFrame, members: DataFrame, characters: DataFrame,
                                  by: Sequence[str]) -> DataFrame:
    """``characters`` holds the sampled ``(by, character)`` pairs; each gets every place of its window."""
    counts = t.row_count(cells, [*t.EPISODE, "character"])
    return cumulative(members.join(characters, list(by)), counts, by, ["character"])
