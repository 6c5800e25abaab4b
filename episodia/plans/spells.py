"""Questions over the spell log. ``by`` names the group: an episode or a context window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.text import is_upcast, occurrences, valid_character, valid_spell
from ..operators import ordered as o
from ..operators import tallies as t
from .rolls import by_player, cumulative

SPELL_KEYS = ("character", "spell", "base_lvl", "cast_at")


def spells_total(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    return t.row_count(cells, by)


def spells_by_character(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    kept = cells.where(valid_character(F.col("character")))
    return t.count_by(kept, by, "character").drop("first_seq")


def spells_by_player(cells: DataFrame, by: Sequence[str], players: DataFrame) -> DataFrame:
    return by_player(spells_by_character(cells, by), players)


def spells_by_name(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    return t.count_by(cells.where(valid_spell(F.col("spell"))), by, "spell").drop("first_seq")


def spells_first_k(log: DataFrame, by: Sequence[str], ks: Sequence[int] = (1, 2, 3)) -> DataFrame:
    return o.head_lists(o.head_rows(log, by, max(ks)), by, "spell", ks)


def spells_last_k(log: DataFrame, by: Sequence[str], ks: Sequence[int] = (1, 2, 3)) -> DataFrame:
    return o.head_lists(o.head_rows(log, by, max(ks), last=True), by, "spell", ks)


def spell_first_per_character(cells: DataFrame, by: Sequence[str], appearance: bool = False) -> DataFrame:
    return t.edge_value_list(cells, by, "character", "spell", appearance=appearance)


def spell_last_per_character(cells: DataFrame, by: Sequence[str], appearance: bool = False) -> DataFrame:
    return t.edge_value_list(cells, by, "character", "spell", last=True, appearance=appearance)


def spell_caster_count(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    kept = cells.where(valid_spell(F.col("spell")))
    return t.distinct_count(kept, by, "spell", "character").drop("first_seq")


def spell_mode(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    return t.most_common(cells, by, "spell")


def spell_rarest(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    return t.least_common(cells, by, "spell")


def spells_multi_caster(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    return t.shared_values(cells, by, "spell", "character")


def cantrips(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    return t.totals(cells, by, n=t.flag(F.col("base_lvl") == fixed.CANTRIP))


def _upcast():
    return is_upcast(F.col("cast_at"), F.col("base_lvl"))


def upcast_count(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    return t.totals(cells, by, n=t.flag(_upcast()))


def upcast_spells(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    return t.values_in_order(cells.where(_upcast()), by, "spell")


def spells_in_order(log: DataFrame, by: Sequence[str], part_rows: int = 100_000) -> DataFrame:
    return o.list_parts(log, by, "spell", part_rows)


# --- several episodes -------------------------------------------------------------------------------

def spells_cumulative(cells: DataFrame, members: DataFrame, by: Sequence[str]) -> DataFrame:
    return cumulative(members, t.row_count(cells, t.EPISODE), by)


def nth_spell(log: DataFrame, members: DataFrame, by: Sequence[str], n: int = 3) -> DataFrame:
    """First to ``n``-th row of each member episode; episodes with fewer rows give fewer."""
    heads = o.head_rows(log.select(*t.EPISODE, "seq", "spell"), t.EPISODE, n)
    return nth_of(heads, members, by)


def nth_of(heads: DataFrame, members: DataFrame, by: Sequence[str]) -> DataFrame:
    return members.join(heads, list(t.EPISODE)).select(
        *by, "ordinal", F.col("pos").cast("int").alias("nth"), "spell")


def first_spell_per_episode(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    return t.edge_value_list(cells, by, "episode", "spell")


def last_spell_per_episode(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    return t.edge_value_list(cells, by, "episode", "spell", last=True)


def first_spell_by_character(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    kept = cells.where(valid_character(F.col("character")))
    return t.edge_value_list(kept, [*by, "character"], "episode", "spell")


def last_spell_by_character(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    kept = cells.where(valid_character(F.col("character")))
    return t.edge_value_list(kept, [*by, "character"], "episode", "spell", last=True)


# --- transcripts --------------------------------------------------------------------------------------

def phrase_count(lines: DataFrame, by: Sequence[str], phrase: str = fixed.PHRASE,
                 speakers: Sequence[str] | None = None) -> DataFrame:
    """How often the named speakers say ``phrase``; groups where nobody does count zero."""
    said = occurrences(F.col("text"), phrase)
    if speakers is not None:
        said = F.when(F.upper(F.col("name")).isin(*[s.upper() for s in speakers]), said).otherwise(0)
    return lines.groupBy(*by).agg(F.sum(said).cast("bigint").alias("n"))
