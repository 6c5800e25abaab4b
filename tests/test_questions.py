"""Questions on small hand-written logs, one trap each, and properties on larger ones."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from episodia.operators import tallies as t
from episodia.operators import windows as w
from episodia.plans import rolls as r
from episodia.plans import spells as s

E = t.EPISODE
ROLLS = [
    # seq, episode, character, roll_type, natural_value, damage_dealt, kills
    (1, 1, "Grog", "Attack", "20", "12", "1"),
    (2, 1, "Pike", "Insight", "1", None, "1.0"),
    (3, 1, "Grog", "Attack", "Unknown", "7.5", "-1"),
    (4, 1, None, "Insight", "20", "x", ""),
    (5, 1, "Others", " ", "3", None, "2"),
    (6, 1, "Pike", None, "3", None, None),
    (7, 1, "Pike", "Unknown", "7", None, None),
    (8, 1, "Scanlan", "Stealth", "7", None, None),
    (9, 2, "Grog", "Attack", "5", None, None),
]
SPELLS = [
    # seq, episode, character, spell, base_lvl, cast_at
    (1, 1, "Pike", None, "1", "1"),
    (2, 1, "Scanlan", "Bless", "1", "3"),
    (3, 1, "Pike", "Bless", "1", "1"),
    (4, 1, "Pike", "Light", "Cantrip", "Cantrip"),
    (5, 1, "Keyleth", "Fog", "3", "Cantrip"),
    (6, 1, "Keyleth", "Gust", "2", None),
    (7, 2, "Pike", "Heal", "6", "6"),
    (8, 3, "Pike", None, "6", "7"),
    (9, 3, "Pike", "Heal", "6", "7"),
]


@pytest.fixture(scope="module")
def rolls(spark):
    rows = [(seq, "campaign1", *rest) for seq, *rest in ROLLS]
    return spark.createDataFrame(
        rows, "seq bigint, campaign string, episode int, character string, roll_type string, "
              "natural_value string, damage_dealt string, kills string").repartition(3)


@pytest.fixture(scope="module")
def spells(spark):
    rows = [(seq, "campaign1", *rest) for seq, *rest in SPELLS]
    return spark.createDataFrame(
        rows, "seq bigint, campaign string, episode int, character string, spell string, "
              "base_lvl string, cast_at string").repartition(3)


def one(df, value="answer", **where):
    for key, wanted in where.items():
        df = df.where(F.col(key) == wanted)
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0][value]


def test_counts_keep_incomplete_rows(rolls):
    cells = t.as_cells(rolls)
    assert one(r.rolls_total(cells, E), "n", episode=1) == 8
    names = {x.character: x.n for x in r.rolls_by_character(cells, E).where("episode = 1").collect()}
    assert names == {"Grog": 2, "Pike": 3, "Scanlan": 1}
    types = {x.roll_type: x.n for x in r.rolls_by_type(cells, E).where("episode = 1").collect()}
    assert types == {"Attack": 2, "Insight": 2, "Stealth": 1}


def test_most_and_least_common(rolls):
    cells = t.as_cells(rolls)
    assert one(r.roll_type_mode(cells, E), episode=1) == "Attack, Insight"
    # order of appearance, and soft nulls take part
    assert one(r.roll_type_rarest(cells, E), episode=1) == " , Unknown, Stealth"
    assert one(r.roll_type_rarest(cells, E, min_count=2), episode=1) == "Attack, Insight"
    # values order as text
    assert one(r.roll_value_mode(cells, E), episode=1) == "20, 3, 7"
    assert one(r.roll_value_rarest(cells, E), episode=1) == "1, Unknown"


def test_values_percent_and_crits(rolls):
    cells = t.as_cells(rolls)
    pct = r.rolls_value_pct(cells, E)
    assert one(pct, "pct", episode=1, roll_value="1") == 12  # 12.5, ties go to even
    assert one(pct, "pct", episode=1, roll_value="20") == 25
    assert one(r.rolls_by_value(cells, E), "n", episode=1, roll_value="9") == 0
    assert one(r.crits(cells, E), "n", episode=1) == 3
    assert one(r.nat20s(cells, E), "n", episode=1) == 2
    assert one(r.nat1s(cells, E), "n", episode=2) == 0


def test_kills_and_damage(rolls):
    cells = t.as_cells(rolls)
    assert one(r.kills_total(cells, E), "n", episode=1) == 3
    kills = {x.character: x.n for x in r.kills_by_character(cells, E).where("episode = 1").collect()}
    assert kills == {"Grog": 1, "Pike": 0, "Others": 2, "Scanlan": 0}
    damage = r.damage_dealt(rolls, E).where("episode = 1")
    assert one(damage, "damage", scope="total") == 19.5
    assert one(damage, "damage", character="Pike") == 0.0


def test_players_share_and_game_master_is_left_out(spark, rolls):
    players = spark.createDataFrame(
        [("Travis", "Grog", 1), ("Ashley", "Pike", 2), ("Guest", "Pike", 3), ("Matt", "DM", 4)],
        "player string, character string, first_seq bigint")
    got = {x.player: x.n for x in r.rolls_by_player(t.as_cells(rolls), E, players).where("episode = 1").collect()}
    assert got == {"Travis": 2, "Ashley": 3, "Guest": 3}


def test_spell_lists(spells):
    cells = t.as_cells(spells)
    first = {x.k: x.answer for x in s.spells_first_k(spells, E).where("episode = 1").collect()}
    assert first == {1: "", 2: "Bless", 3: "Bless, Bless"}
    last = {x.k: x.answer for x in s.spells_last_k(spells, E).where("episode = 1").collect()}
    assert last == {1: "Gust", 2: "Fog, Gust", 3: "Light, Fog, Gust"}
    # sorted by character: Keyleth, Pike, Scanlan
    assert one(s.spell_first_per_character(cells, E), episode=1) == "Fog, Bless, Bless"
    assert one(s.spell_last_per_character(cells, E), episode=1) == "Gust, Light, Bless"
    assert one(s.spell_first_per_character(cells, E, appearance=True), episode=1) == "Bless, Bless, Fog"
    assert one(s.spells_multi_caster(cells, E), episode=1) == "Bless"
    assert one(s.spell_caster_count(cells, E), "n", episode=1, spell="Bless") == 2
    assert one(s.spells_in_order(spells, E), episode=1) == "Bless, Bless, Light, Fog, Gust"


def test_levels_compare_as_text(spells):
    cells = t.as_cells(spells)
    assert one(s.cantrips(cells, E), "n", episode=1) == 1
    assert one(s.upcast_count(cells, E), "n", episode=1) == 2  # 3 over 1, Cantrip over 3; null is not above
    assert one(s.upcast_spells(cells, E), episode=1) == "Bless, Fog"
    assert one(s.upcast_count(cells, E), "n", episode=3) == 2
    assert one(s.upcast_spells(cells, E), episode=3) == "Heal"


@pytest.fixture(scope="module")
def members(spark):
    rows = [("a", "campaign1", 1), ("a", "campaign1", 3), ("a", "campaign1", 2), ("b", "campaign1", 3), ("b", "campaign1", 9)]
    df = spark.createDataFrame(rows, "window_key string, campaign string, episode int")
    return w.number_members(df, ["window_key", "campaign"])


def test_window_orders(spells, rolls, members):
    by = ["window_key", "campaign"]
    running = {(x.window_key, x.ordinal): x.n for x in s.spells_cumulative(t.as_cells(spells), members, by).collect()}
    assert running == {("a", 1): 6, ("a", 2): 7, ("a", 3): 9, ("b", 1): 2, ("b", 2): 2}
    nth = {(x.window_key, x.ordinal, x.nth): x.spell for x in s.nth_spell(spells, members, by).collect()}
    assert nth[("a", 1, 1)] is None and nth[("a", 1, 2)] == "Bless" and ("a", 2, 2) not in nth
    cells = w.spread(t.compact(t.as_cells(spells), [*E, "spell", "character"]), members)
    assert one(s.first_spell_per_episode(cells, by), window_key="a") == "Bless, Heal, Heal"
    assert one(s.last_spell_by_character(cells, by), window_key="a", character="Pike") == "Light, Heal, Heal"


def test_compacting_changes_nothing(rolls, spells):
    small = t.compact(t.as_cells(spells), [*E, *s.SPELL_KEYS])
    for fn in (s.spells_total, s.spells_by_character, s.spell_mode, s.spell_rarest, s.spell_caster_count,
               s.spell_first_per_character, s.spell_last_per_character, s.upcast_spells, s.cantrips):
        assert sorted(map(str, fn(t.as_cells(spells), E).collect())) == sorted(map(str, fn(small, E).collect())), fn
    small = t.compact(t.as_cells(rolls), [*E, *r.ROLL_KEYS])
    for fn in (r.rolls_total, r.rolls_by_type, r.rolls_by_value, r.roll_type_rarest, r.roll_value_mode, r.crits):
        assert sorted(map(str, fn(t.as_cells(rolls), E).collect())) == sorted(map(str, fn(small, E).collect())), fn


def test_samples_do_not_depend_on_partitions(spark):
    episodes = spark.createDataFrame([("campaign1", i) for i in range(1, 31)], "campaign string, episode int")
    a, b = (w.sampled_windows(episodes.repartition(n)).orderBy("context_window_id").collect() for n in (1, 6))
    assert a == b
    sizes = [len(x.episodes) for x in a]
    assert sizes.count(1) == 10 and sizes.count(24) == 10 and len(set(x.context_window_id for x in a)) == len(a)
    toy = w.sampled_windows(episodes, toy=True).collect()
    assert sorted(len(x.episodes) for x in toy) == [1, 2, 3, 4, 5, 6, 7, 8, 10, 16, 24]
    few = w.multi_windows(episodes.where("episode <= 3")).collect()
    assert {len(x.episodes) for x in few} == {2, 3}
