"""Question sets: windows, sampled parameters, answers, ids, prompts and context texts."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.text import (clean_text, is_upcast, percentage, question_id, usable_answer,
                              valid_character, valid_roll_type, valid_spell)
from ..operators import ordered as o
from ..operators import tallies as t
from ..operators import windows as w
from ..operators.tallies import EPISODE, listing
from ..session import materialize
from ..sources.dialogue import PART_CHARS
from . import rolls as r
from . import spells as s

KEY = ("context_window_id",)
QA_COLUMNS = ("id", "context_window_id", "question", "answer", "question_type", "episodes", "campaign")

# sampled parameter kind -> (question kind, fact that counts it)
PARAM_QUESTIONS = {
    "roll_character": (("rolls_by_character", "roll_character"),),
    "roll_type": (("rolls_by_type", "roll_type"),),
    "roll_value": (("rolls_by_value", "roll_value"), ("rolls_value_pct", "roll_value")),
    "spell_character": (("spells_by_character", "spell_character"),),
    "spell": (("spells_by_name", "spell"), ("spell_caster_count", "caster_count")),
}
# question kind -> (fact, value or None for any) whose counts it sums
FIXED_QUESTIONS = {
    "rolls_total": (("rolls", None),),
    "crits": (("roll_value", "1"), ("roll_value", "20")),
    "nat20s": (("roll_value", "20"),),
    "nat1s": (("roll_value", "1"),),
    "spells_total": (("spells", None),),
    "cantrips": (("cantrip", None),),
    "upcast_count": (("upcast", None),),
}


@dataclass
class QuestionSet:
    """``windows``: one row per context window; ``rows``: its questions and answers, without text."""

    windows: DataFrame
    members: DataFrame
    rows: DataFrame


def build_questions(rolls: DataFrame, spells: DataFrame, players: DataFrame,
                    transcripts: DataFrame, toy: bool = False) -> QuestionSet:
    """Sample windows among the episodes that have a transcript and answer every question kind on each."""
    episodes = materialize(w.with_transcript(w.episodes_of(spells), transcripts))
    windows = materialize(w.sampled_windows(episodes, toy))
    members = w.members_of(windows)
    answers = answer_windows(rolls, spells, players, windows,
                             fixed.PROBES_TOY if toy else fixed.PROBES)
    return QuestionSet(windows, members, finish(answers, windows))


def episode_facts(rolls: DataFrame, spells: DataFrame, episodes: DataFrame) -> DataFrame:
    """What the questions count, per episode: ``(campaign, episode, fact, v1, v2, n, first…, last…)``.

    Each log is scanned once, cut to the wanted episodes and folded to cells; cells are unfolded to
    facts, which one aggregation sums. ``n`` counts log rows; ``first_spell`` and ``last_spell`` are
    the outermost named spells of a fact in file order.
    """
    def cells_of(log: DataFrame, keys: Sequence[str]) -> DataFrame:
        return t.compact(t.as_cells(log.join(episodes, list(EPISODE), "left_semi")), [*EPISODE, *keys])

    def fact(name: str, v1: Column | None = None, v2: Column | None = None,
             when: Column | None = None) -> Column:
        value = F.lit("") if v1 is None else v1
        return F.struct(
            F.lit(name).alias("fact"), (value if when is None else F.when(when, value)).alias("v1"),
            (F.lit("") if v2 is None else v2).alias("v2"))

    def facts_of(cells: DataFrame, facts: Sequence[Column], spell_column: Column) -> DataFrame:
        return cells.select(*EPISODE, "n", "first_seq", "last_seq", spell_column.alias("spell"),
                            F.inline(F.array(*facts))).where("v1 is not null")

    character, spell = F.col("character"), F.col("spell")
    upcast = is_upcast(F.col("cast_at"), F.col("base_lvl"))
    of_rolls = (
        fact("rolls"), fact("roll_character", character), fact("roll_type", F.col("roll_type")),
        fact("roll_value", F.col("natural_value")),
    )
    of_spells = (
        fact("spells"), fact("cantrip", when=F.col("base_lvl") == fixed.CANTRIP),
        fact("upcast", when=upcast), fact("spell_character", character), fact("spell", spell),
        fact("upcast_spell", spell, when=upcast), fact("caster", spell, character),
    )
    rows = facts_of(cells_of(rolls, r.ROLL_KEYS), of_rolls, F.lit(None).cast("string")).unionByName(
        facts_of(cells_of(spells, s.SPELL_KEYS), of_spells, spell))
    named = spell.isNotNull()
    return rows.groupBy(*EPISODE, "fact", "v1", "v2").agg(
        F.sum("n").alias("n"), F.min("first_seq").alias("first_seq"),
        F.min_by("spell", F.when(named, F.col("first_seq"))).alias("first_spell"),
        F.max_by("spell", F.when(named, F.col("last_seq"))).alias("last_spell"))


def window_facts(facts: DataFrame, members: DataFrame) -> DataFrame:
    """Episode facts summed per window; who cast what is left to the windows that ask for it."""
    additive = facts.where("fact <> 'caster'").select(*EPISODE, "fact", "v1", "n", "first_seq")
    return w.spread(additive, members).groupBy(*KEY, "fact", "v1").agg(
        F.sum("n").alias("n"), F.min("first_seq").alias("first_seq"))


def edge_spells(spells: DataFrame, episodes: DataFrame, k: int = 3) -> DataFrame:
    """First and last ``k`` rows of each wanted episode; ``pos`` counts from that end."""
    rows = spells.join(episodes, list(EPISODE), "left_semi").select(*EPISODE, "seq", "spell")
    ends = [o.head_rows(rows, EPISODE, k, last).withColumn("edge", F.lit(edge))
            for edge, last in (("first", False), ("last", True))]
    return ends[0].unionByName(ends[1])


def answer_windows(rolls: DataFrame, spells: DataFrame, players: DataFrame, windows: DataFrame,
                   probes: int = fixed.PROBES) -> DataFrame:
    """Answers of all question kinds for all windows: ``(window, kind, p1, p2, answer)``."""
    members = w.members_of(windows.withColumn("single", F.size("episodes") == 1), "single")
    episodes = members.select(*EPISODE).distinct()
    by_episode = materialize(episode_facts(rolls, spells, episodes))
    edges = materialize(edge_spells(spells, episodes))
    facts = materialize(window_facts(by_episode, members))
    params = materialize(sampled_params(facts, windows))
    alone, several = members.where("single"), members.where("not single")
    probe = w.probe_ordinals(several, KEY, k=probes)

    counted = param_counts(facts, caster_counts(by_episode, members, params), params)
    parts = [
        counted.select(*KEY, "kind", "p1", F.lit("").alias("p2"), F.col("n").cast("string").alias("answer")),
        player_counts(counted, players, windows),
        fixed_counts(facts, windows),
        listed_answers(facts, by_episode, edges, params, alone, several),
        cumulative_counts(by_episode, params, several, probe),
        nth_answers(edges, several, probe),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def sampled_params(facts: DataFrame, windows: DataFrame) -> DataFrame:
    """Up to two characters, types, values and spells per window: ``(window, kind, value)``."""
    value = F.col("v1")
    valid = ((F.col("fact").isin("roll_character", "spell_character") & valid_character(value))
             | ((F.col("fact") == "roll_type") & valid_roll_type(value))
             | ((F.col("fact") == "spell") & valid_spell(value)))
    seen = facts.where(valid).select(*KEY, F.col("fact").alias("kind"), value.alias("value"))
    return w.sample_values(seen.unionByName(w.dice(windows, KEY)), KEY)


def caster_counts(by_episode: DataFrame, members: DataFrame, params: DataFrame) -> DataFrame:
    """Distinct characters who cast each sampled spell of a window."""
    asked = params.where("kind = 'spell'").select(*KEY, F.col("value").alias("v1")).join(members, list(KEY))
    pairs = by_episode.where("fact = 'caster'").select(*EPISODE, "v1", "v2")
    return asked.join(pairs, [*EPISODE, "v1"]).groupBy(*KEY, "v1").agg(F.countDistinct("v2").alias("n"))


def param_counts(facts: DataFrame, casters: DataFrame, params: DataFrame) -> DataFrame:
    """Counts asked for a sampled parameter, zero where it never occurs."""
    asked = F.create_map(*[x for kind, questions in PARAM_QUESTIONS.items() for x in (
        F.lit(kind), F.array(*[F.struct(F.lit(q).alias("question"), F.lit(f).alias("fact"))
                               for q, f in questions]))])
    wanted = params.select(*KEY, F.col("value").alias("v1"), F.inline(F.element_at(asked, F.col("kind"))))
    sources = facts.select(*KEY, "fact", "v1", "n").unionByName(
        casters.select(*KEY, F.lit("caster_count").alias("fact"), "v1", "n"))
    total = facts.where("fact = 'rolls'").select(*KEY, F.col("n").alias("total"))
    n = F.coalesce(F.col("n"), F.lit(0))
    return wanted.join(sources, [*KEY, "fact", "v1"], "left").join(total, list(KEY), "left").select(
        *KEY, F.col("question").alias("kind"), F.col("v1").alias("p1"),
        F.when(F.col("question") == "rolls_value_pct", percentage(n, F.col("total"))).otherwise(n).alias("n"))


def player_counts(counted: DataFrame, players: DataFrame, windows: DataFrame) -> DataFrame:
    rows = counted.where("kind in ('rolls_by_character', 'spells_by_character')")
    if "campaign" in players.columns:
        rows = rows.join(windows.select(*KEY, "campaign"), list(KEY))
    by_player = r.by_player(rows.withColumnRenamed("p1", "character"), players)
    return by_player.select(
        *KEY, F.replace("kind", F.lit("character"), F.lit("player")).alias("kind"),
        F.col("player").alias("p1"), F.lit("").alias("p2"), F.col("n").cast("string").alias("answer"))


def fixed_counts(facts: DataFrame, windows: DataFrame) -> DataFrame:
    """Counts every window is asked for; a zero row per window and kind keeps empty ones."""
    def asks(kind: str) -> Column:
        hit = F.lit(False)
        for fact, value in FIXED_QUESTIONS[kind]:
            same = F.col("fact") == fact
            hit = hit | (same if value is None else same & (F.col("v1") == value))
        return F.when(hit, kind)

    kinds = F.array_compact(F.array(*[asks(kind) for kind in FIXED_QUESTIONS]))
    found = facts.select(*KEY, F.explode(kinds).alias("kind"), "n")
    zero = windows.select(*KEY, F.explode(F.array(*[F.lit(k) for k in FIXED_QUESTIONS])).alias("kind"),
                          F.lit(0).cast("bigint").alias("n"))
    summed = found.unionByName(zero).groupBy(*KEY, "kind").agg(F.sum("n").cast("string").alias("answer"))
    return summed.select(*KEY, "kind", F.lit("").alias("p1"), F.lit("").alias("p2"), "answer")


def listed_answers(facts: DataFrame, by_episode: DataFrame, edges: DataFrame, params: DataFrame,
                   alone: DataFrame, several: DataFrame) -> DataFrame:
    """All list answers: rows ``(window, kind, p1, item, order)`` from every source, one aggregation."""
    def at(number: str) -> Column:
        return F.format_string("%020d", F.col(number).cast("bigint"))

    def item(kind: Column, text: Column | str, order: Column) -> Column:
        text = F.col(text) if isinstance(text, str) else text
        return F.struct(kind.alias("kind"), text.alias("item"), order.alias("place"))

    def rows(source: DataFrame, p1: Column, *items: Column) -> DataFrame:
        kept = F.filter(F.array(*items), lambda x: x["kind"].isNotNull())
        return source.select(*KEY, p1.alias("p1"), F.inline(kept))

    def named(condition: Column, name: str) -> Column:
        return F.when(condition, name)

    nothing = F.lit("")
    # most and least common: the extremes meet in partial aggregates and join back
    valued = facts.where("fact in ('roll_type', 'roll_value', 'spell')")
    extremes = valued.groupBy(*KEY, "fact").agg(F.max("n").alias("most"), F.min("n").alias("least"))
    ranked = valued.join(extremes, [*KEY, "fact"])
    ties = rows(
        ranked, nothing,
        item(F.when(F.col("n") == F.col("most"), F.concat("fact", F.lit("_mode"))), "v1", F.col("v1")),
        item(F.when(F.col("n") == F.col("least"), F.concat("fact", F.lit("_rarest"))), "v1", at("first_seq")))
    fact = F.col("fact")
    upcast = rows(facts.where("fact = 'upcast_spell'"), nothing, item(F.lit("upcast_spells"), "v1", at("first_seq")))
    in_one = alone.join(by_episode.where("fact = 'spell_character'"), list(EPISODE))
    per_character = rows(
        in_one, nothing,
        item(F.lit("spell_first_per_character"), "first_spell", F.col("v1")),
        item(F.lit("spell_last_per_character"), "last_spell", F.col("v1")))
    chosen = params.where("kind = 'spell_character'").select(*KEY, F.col("value"))
    in_many = several.join(by_episode.where("fact in ('spells', 'spell_character')"), list(EPISODE))
    wanted = in_many.join(chosen, (in_many.v1 == chosen.value) & (
        in_many.context_window_id == chosen.context_window_id), "left").drop(chosen.context_window_id)
    whole, by_name = fact == "spells", F.col("value").isNotNull() & (fact == "spell_character")
    per_episode = rows(
        wanted, F.col("v1"),
        item(named(whole, "first_spell_per_episode"), "first_spell", at("ordinal")),
        item(named(whole, "last_spell_per_episode"), "last_spell", at("ordinal")),
        item(named(by_name, "first_spell_by_character"), "first_spell", at("ordinal")),
        item(named(by_name, "last_spell_by_character"), "last_spell", at("ordinal")))
    casters = alone.join(by_episode.where("fact = 'caster'"), list(EPISODE)).groupBy(*KEY, "v1").agg(
        F.count("v2").alias("n"), F.min("first_seq").alias("first_seq"))
    shared = rows(casters.where("n > 1"), nothing, item(F.lit("spells_multi_caster"), "v1", at("first_seq")))
    ends = rows(alone.join(edges, list(EPISODE)), nothing, *[
        item(F.when(F.col("pos") <= k, F.concat("edge", F.lit(f"_{k}"))), "spell", at("seq")) for k in (1, 2, 3)])
    every = ties
    for part in (upcast, per_character, per_episode, shared, ends):
        every = every.unionByName(part)
    return every.groupBy(*KEY, "kind", "p1").agg(listing("item", "place").alias("answer")).select(
        *KEY, "kind", "p1", F.lit("").alias("p2"), "answer")


def cumulative_counts(by_episode: DataFrame, params: DataFrame, several: DataFrame, probe: DataFrame) -> DataFrame:
    """Running totals at the probed places; zero rows make every window dense."""
    zero = F.lit(0).cast("bigint").alias("n")
    kinds = F.array(F.lit("rolls_cumulative"), F.lit("spells_cumulative"))
    dense = several.select(*KEY, "ordinal", F.explode(kinds).alias("kind"), F.lit("").alias("p1"), zero)
    chosen = params.where("kind = 'roll_character'").select(*KEY, F.col("value").alias("p1"))
    named = F.lit("rolls_cumulative_by_character").alias("kind")
    dense_named = several.select(*KEY, "ordinal").join(chosen, list(KEY)).select(*KEY, "ordinal", named, "p1", zero)
    at = several.join(by_episode.where("fact in ('rolls', 'spells', 'roll_character')"), list(EPISODE))
    found = at.where("fact <> 'roll_character'").select(
        *KEY, "ordinal", F.concat("fact", F.lit("_cumulative")).alias("kind"), F.lit("").alias("p1"), "n")
    found_named = at.where("fact = 'roll_character'").select(
        *KEY, "ordinal", named, F.col("v1").alias("p1"), "n").join(chosen, [*KEY, "p1"], "left_semi")
    rows = dense.unionByName(dense_named).unionByName(found).unionByName(found_named)
    order = Window.partitionBy(*KEY, "kind", "p1").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    running = rows.groupBy(*KEY, "kind", "p1", "ordinal").agg(F.sum("n").alias("n")).withColumn(
        "total", F.sum("n").over(order))
    place = F.col("ordinal").cast("string")
    return running.join(probe, [*KEY, "kind", "ordinal"]).select(
        *KEY, "kind", F.when(F.col("p1") == "", place).otherwise(F.col("p1")).alias("p1"),
        F.when(F.col("p1") == "", "").otherwise(place).alias("p2"), F.col("total").cast("string").alias("answer"))


def nth_answers(edges: DataFrame, several: DataFrame, probe: DataFrame) -> DataFrame:
    nth = s.nth_of(edges.where("edge = 'first'"), several, KEY)
    tagged = nth.withColumn("kind", F.concat(F.lit("nth_"), F.col("nth")))
    return tagged.join(probe, [*KEY, "kind", "ordinal"]).select(
        *KEY, "kind", F.col("ordinal").cast("string").alias("p1"), F.lit("").alias("p2"),
        F.col("spell").alias("answer"))


def _texts(templates: dict[str, str]) -> Column:
    return F.from_json(F.lit(json.dumps(templates)), "map<string,string>")


def question_text(kind: Column, single: Column, p1: Column, p2: Column) -> Column:
    template = F.when(single, F.element_at(_texts(fixed.EPISODE_QUESTIONS), kind)).otherwise(
        F.element_at(_texts(fixed.WINDOW_QUESTIONS), kind))
    return F.call_function("format_string", template, p1, p2)


def finish(answers: DataFrame, windows: DataFrame) -> DataFrame:
    """Question texts, escaping, the answer filter, and ids."""
    spell_kinds = F.col("kind").rlike("spell|cantrip|upcast|^first_|^last_|^nth_")
    single = F.size("episodes") == 1
    qtype = (
        F.when(single & spell_kinds, fixed.SINGLE_SPELLS)
        .when(single, fixed.SINGLE_ROLLS)
        .when(spell_kinds, fixed.MULTI_SPELLS)
        .otherwise(fixed.MULTI_ROLLS)
    )
    text = question_text(F.col("kind"), single, F.col("p1"), F.col("p2"))
    worded = answers.join(windows.select(*w.WINDOW, "episodes"), list(KEY)).select(
        *w.WINDOW, "episodes", clean_text(text).alias("question"),
        clean_text(F.col("answer")).alias("answer"), qtype.alias("question_type"))
    return worded.where(usable_answer(F.col("answer"))).withColumn(
        "id", question_id(F.col("campaign"), F.col("question"), F.col("episodes"))).select(*QA_COLUMNS)


# --- prompts and context texts --------------------------------------------------------------------------

def player_prompt(players: DataFrame) -> DataFrame:
    """The player map as sentences, in order of first appearance; one row (per campaign, if given)."""
    by = ["campaign"] if "campaign" in players.columns else []
    sentence = F.format_string(fixed.PLAYER_SENTENCE, F.col("player"), F.col("character"))
    lines = players.withColumn("sentence", sentence).groupBy(*by).agg(
        listing("sentence", "first_seq", "\\n").alias("sentences"))
    return lines.select(*by, F.concat(
        F.lit(fixed.PLAYER_PROMPT_HEAD), F.coalesce("sentences", F.lit("")),
        F.lit(fixed.PLAYER_PROMPT_TAIL)).alias("prompt"))


def window_prompt(episode_count: Column, player_text: Column) -> Column:
    head = F.when(episode_count == 1, fixed.SINGLE_PROMPT).otherwise(fixed.MULTI_PROMPT)
    return F.concat(head, F.lit("\n\n"), player_text)


def context_texts(members: DataFrame, chunks: DataFrame, by: Sequence[str], prompts: DataFrame | None = None,
                  part_chars: int = PART_CHARS) -> DataFrame:
    """Context text of each window: ``(by, part, parts, text)``.

    Each member episode is wrapped in its delimiters; members are joined by a blank line in window
    order after the prompt. A window whose text fits into ``part_chars`` is one row (``part`` 1); a
    larger one comes as ``parts`` rows whose texts, joined in order, are the whole. ``chunks`` has the
    transcript texts ``(campaign, episode, chunk, chars, text)`` and is read twice, once without its
    texts, so it should be a written table; ``prompts`` has the player sentences.
    """
    last = Window.partitionBy(*EPISODE).orderBy("chunk")
    edges = chunks.select(*EPISODE, "chunk", "chars").withColumns({
        "opens": F.lag("chunk").over(last).isNull(), "closes": F.lead("chunk").over(last).isNull()})
    # Window order and sizes are settled on rows without text; texts join at the end.
    plan = members.join(edges, list(EPISODE))
    order = Window.partitionBy(*by).orderBy("ordinal", "chunk")
    upto = F.sum("chars").over(order.rowsBetween(Window.unboundedPreceding, 0))
    whole = Window.partitionBy(*by)
    plan = plan.withColumn("part", (F.floor((upto - 1) / F.lit(part_chars)) + 1).cast("bigint")).withColumns({
        "parts": F.max("part").over(whole),
        "leads": F.row_number().over(order) == 1,
        "place": F.row_number().over(order),
        "episode_count": F.sum(F.col("opens").cast("int")).over(whole),
    }).drop("chars")
    pieces = plan.join(chunks.select(*EPISODE, "chunk", "text"), [*EPISODE, "chunk"])
    if prompts is None:
        head = F.lit("")
    else:
        # one prompt for all is a single value, not a side to join
        pieces = (pieces.join(prompts, "campaign", "left") if "campaign" in prompts.columns
                  else pieces.withColumn("prompt", prompts.select("prompt").scalar()))
        head = F.when(F.col("leads"), window_prompt(F.col("episode_count"), F.col("prompt"))).otherwise("")
    gap = F.when(F.col("opens") & ~F.col("leads"), "\n\n").otherwise("")
    piece = F.concat(
        head, gap,
        F.when(F.col("opens"), fixed.EPISODE_START).otherwise(""), F.col("text"),
        F.when(F.col("closes"), fixed.EPISODE_END).otherwise(""))
    return pieces.withColumn("piece", piece).groupBy(*by, "part", "parts").agg(
        listing("piece", "place", "").alias("text"))


def export_rows(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Question rows with their whole context text, one row per id; text is joined last.

    For exports that want it in the row: windows whose text one value cannot hold need ``write_question_set``.
    """
    whole = texts.groupBy("context_window_id").agg(listing("text", "part", "").alias("context_window_text"))
    return rows.join(whole, "context_window_id").select(
        "id", "context_window_id", "context_window_text", "question", "answer",
        "question_type", "episodes", "campaign")
