"""Named queries over the test tables. Each runs a library plan over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import parsing, scores
from ..functions.text import (clean_text, episodes_key, question_id, valid_character,
                              valid_roll_type, valid_spell, window_id)
from ..functions import fixed_values as fixed
from ..operators import distinct_sets as ds
from ..operators import tallies as t
from ..operators import windows as w
from ..plans import assemble, evaluation as ev, rolls as r, scoring, spells as s
from ..plans.refresh import KeptAnswers, listed
from ..session import materialize, shared_folder, small_tasks
from ..sources import dialogue, results
from ..sources.files import mounted, write_files
from ..sources.logs import ROLL_COLUMNS, SPELL_COLUMNS, player_map, read_episode_files, read_log
from ..sources.store import Store, store_cells, store_transcripts
from ..streaming import run_stream as rs
from ..streaming.running_score import running_score, running_score_stream
from ..streaming.score_stream import score_stream
from .views import SCHEMAS, VIEWS, table, view, window_members

E = t.EPISODE
W = ("window_key", "campaign")
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
BATCH_SIZE = 8
STREAM_BATCH_SIZE = 16
MODEL = "m1"
RENAMING = 16  # files renamed at a time
ROWS_A_FILE = 200_000  # of all arriving outputs


def query(name: str):
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return register


# --- inputs -------------------------------------------------------------------------------------------

def rolls(spark, d):
    return view(spark, d, "roll_log")


def spells(spark, d):
    return view(spark, d, "spell_log")


def players(spark, d):
    return player_map(view(spark, d, "player_rows"))


def lines(spark, d):
    turns = view(spark, d, "turns").select(
        "campaign", "episode", F.col("seq").alias("turn"),
        F.when(F.col("seq") % 3 == 1, F.array("name", F.lit("GUEST"))).otherwise(F.array("name")).alias("names"),
        F.split("utterance", " ").alias("utterances"))
    return dialogue.transcript_lines(turns)


def members(spark, d):
    return w.number_members(window_members(spark, d), W)


def in_windows(log: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """Fold the log to episode cells first, then repeat those for the windows."""
    return w.spread(t.compact(t.as_cells(log), [*E, *keys]), windows)


def window_list(spark, d):
    """Each window once, with its episodes."""
    grouped = window_members(spark, d).groupBy(*W).agg(
        F.sort_array(F.collect_list("episode")).alias("episodes"))
    return grouped.withColumn("context_window_id", window_id(F.col("campaign"), F.col("episodes")))


# --- counting questions, one episode and several -----------------------------------------------------------

def both_grains(name: str, log, fn, keys: list[str], needs_players: bool = False):
    def single(spark, d):
        extra = (players(spark, d),) if needs_players else ()
        return fn(t.as_cells(log(spark, d)), E, *extra)

    def several(spark, d):
        extra = (players(spark, d),) if needs_players else ()
        return fn(in_windows(log(spark, d), window_members(spark, d), keys), W, *extra)

    QUERIES[name] = single
    QUERIES[f"window_{name}"] = several


both_grains("rolls_total", rolls, r.rolls_total, [])
both_grains("rolls_by_character", rolls, r.rolls_by_character, ["character"])
both_grains("rolls_by_player", rolls, r.rolls_by_player, ["character"], True)
both_grains("rolls_by_type", rolls, r.rolls_by_type, ["roll_type"])
both_grains("rolls_by_value", rolls, r.rolls_by_value, ["natural_value"])
both_grains("rolls_value_pct", rolls, r.rolls_value_pct, ["natural_value"])
both_grains("roll_type_mode", rolls, r.roll_type_mode, ["roll_type"])
both_grains("roll_type_rarest", rolls, r.roll_type_rarest, ["roll_type"])
both_grains("roll_value_mode", rolls, r.roll_value_mode, ["natural_value"])
both_grains("roll_value_rarest", rolls, r.roll_value_rarest, ["natural_value"])
both_grains("crits", rolls, r.crits, ["natural_value"])
both_grains("nat20s", rolls, r.nat20s, ["natural_value"])
both_grains("nat1s", rolls, r.nat1s, ["natural_value"])
both_grains("spells_total", spells, s.spells_total, [])
both_grains("spells_by_character", spells, s.spells_by_character, ["character"])
both_grains("spells_by_player", spells, s.spells_by_player, ["character"], True)
both_grains("spells_by_name", spells, s.spells_by_name, ["spell"])
both_grains("spell_caster_count", spells, s.spell_caster_count, ["spell", "character"])
both_grains("spell_mode", spells, s.spell_mode, ["spell"])
both_grains("spell_rarest", spells, s.spell_rarest, ["spell"])
both_grains("cantrips", spells, s.cantrips, ["base_lvl"])
both_grains("upcast_count", spells, s.upcast_count, ["base_lvl", "cast_at"])
both_grains("upcast_spells", spells, s.upcast_spells, ["spell", "base_lvl", "cast_at"])


def episode_only(name: str, log, fn, cells: bool = True):
    QUERIES[name] = lambda spark, d: fn(t.as_cells(log(spark, d)) if cells else log(spark, d), E)


episode_only("spells_first_k", spells, s.spells_first_k, cells=False)
episode_only("spells_last_k", spells, s.spells_last_k, cells=False)
episode_only("spell_first_per_character", spells, s.spell_first_per_character)
episode_only("spell_last_per_character", spells, s.spell_last_per_character)
episode_only("spells_multi_caster", spells, s.spells_multi_caster)
episode_only("kills_total", rolls, r.kills_total)
episode_only("kills_by_character", rolls, r.kills_by_character)
episode_only("damage_dealt", rolls, r.damage_dealt, cells=False)
episode_only("spells_in_order", spells, s.spells_in_order, cells=False)


@query("phrase_count")
def _(spark, d):
    return s.phrase_count(lines(spark, d), E, phrase="the", speakers=["assistant"])


# --- several episodes only --------------------------------------------------------------------------------

@query("window_rolls_cumulative")
def _(spark, d):
    return r.rolls_cumulative(t.as_cells(rolls(spark, d)), members(spark, d), W)


@query("window_rolls_cumulative_by_character")
def _(spark, d):
    log, wins = rolls(spark, d), members(spark, d)
    cells = t.compact(t.as_cells(log), [*E, "character"])
    seen = w.candidates(w.spread(cells, wins), W,
                        roll_character=w.when_valid("character", valid_character))
    picked = w.sample_values(seen, W)
    return r.rolls_cumulative_by_character(
        cells, wins, picked.select(*W, F.col("value").alias("character")), W)


@query("window_spells_cumulative")
def _(spark, d):
    return s.spells_cumulative(t.as_cells(spells(spark, d)), members(spark, d), W)


@query("window_nth_spell")
def _(spark, d):
    return s.nth_spell(spells(spark, d), members(spark, d), W)


def window_only(name: str, fn, keys: list[str]):
    QUERIES[name] = lambda spark, d: fn(in_windows(spells(spark, d), window_members(spark, d), keys), W)


window_only("window_first_spell_per_episode", s.first_spell_per_episode, ["spell"])
window_only("window_last_spell_per_episode", s.last_spell_per_episode, ["spell"])
window_only("window_first_spell_by_character", s.first_spell_by_character, ["character", "spell"])
window_only("window_last_spell_by_character", s.last_spell_by_character, ["character", "spell"])


def window_sets(spark, d, key: str, counted: str, log=spells, valid=valid_spell) -> DataFrame:
    """Sets of episodes, stored once, united for the windows."""
    kept = log(spark, d).where(valid(F.col(key)))
    cells = materialize(t.compact(t.as_cells(kept), [*E, key, counted]))
    sets = materialize(ds.episode_sets(cells, key, counted))
    return ds.united(w.spread(sets, window_members(spark, d)), W, key)


@query("window_caster_sets")
def _(spark, d):
    """Characters by spell of every window, from bitmaps of its episodes."""
    return ds.set_sizes(window_sets(spark, d, "spell", "character"), W, "spell").drop("first_seq")


@query("window_type_sets")
def _(spark, d):
    """Roll types with more than ten different natural values in a window, and how many."""
    sets = window_sets(spark, d, "roll_type", "natural_value", rolls, valid_roll_type)
    return ds.shared_by_many(sets, W, "roll_type", 10)


# --- parameters, samples and windows ------------------------------------------------------------------------

@query("player_map_last_wins")
def _(spark, d):
    return players(spark, d)


@query("player_prompt")
def _(spark, d):
    return assemble.player_prompt(players(spark, d))


@query("valid_roll_types")
def _(spark, d):
    kept = t.as_cells(rolls(spark, d)).where(valid_roll_type(F.col("roll_type")))
    return t.count_by(kept, E, "roll_type").drop("n")


@query("valid_characters")
def _(spark, d):
    kept = t.as_cells(rolls(spark, d)).where(valid_character(F.col("character")))
    return t.count_by(kept, E, "character").drop("n")


@query("valid_spells")
def _(spark, d):
    kept = t.as_cells(spells(spark, d)).where(valid_spell(F.col("spell")))
    return t.count_by(kept, E, "spell").drop("n")


@query("episodes_with_transcript")
def _(spark, d):
    return w.with_transcript(w.episodes_of(spells(spark, d)), view(spark, d, "turns"))


@query("episodes_missing_transcript")
def _(spark, d):
    return w.without_transcript(w.episodes_of(spells(spark, d)), view(spark, d, "turns"))


@query("sample_params")
def _(spark, d):
    wins = window_members(spark, d)
    return w.sample_params(
        in_windows(rolls(spark, d), wins, ["character", "roll_type"]),
        in_windows(spells(spark, d), wins, ["character", "spell"]),
        wins.select(*W).distinct(), W)


@query("sample_single_windows")
def _(spark, d):
    picked = w.single_windows(w.episodes_of(spells(spark, d)))
    return picked.withColumn("episodes", episodes_key(F.col("episodes")))


@query("sample_multi_windows")
def _(spark, d):
    picked = w.multi_windows(w.episodes_of(spells(spark, d)))
    return picked.withColumn("episodes", episodes_key(F.col("episodes")))


@query("probe_ordinals")
def _(spark, d):
    return w.probe_ordinals(members(spark, d), W)


@query("window_ids")
def _(spark, d):
    return window_list(spark, d).withColumn("episodes", episodes_key(F.col("episodes")))


@query("qa_ids")
def _(spark, d):
    counts = QUERIES["window_rolls_by_character"](spark, d)
    question = F.format_string(fixed.WINDOW_QUESTIONS["rolls_by_character"], F.col("character"))
    rows = window_list(spark, d).join(counts, list(W)).withColumn("question", clean_text(question))
    return rows.select(*W, "question", question_id(
        F.col("campaign"), F.col("question"), F.col("episodes")).alias("id"))


# --- question sets -------------------------------------------------------------------------------------------

def question_set(spark, d):
    return assemble.build_questions(rolls(spark, d), spells(spark, d), players(spark, d),
                                    view(spark, d, "turns"))


@query("qa_rows")
def _(spark, d):
    return question_set(spark, d).rows.withColumn("episodes", episodes_key(F.col("episodes")))


@query("qa_counts_by_type")
def _(spark, d):
    return question_set(spark, d).rows.groupBy("campaign", "question_type").agg(
        F.count(F.lit(1)).alias("n"))


def type_mode_answers(spark, d):
    answers = QUERIES["roll_type_mode"](spark, d)
    return answers.select(
        *E, F.lit(fixed.EPISODE_QUESTIONS["roll_type_mode"]).alias("question"), "answer")


@query("qa_filter")
def _(spark, d):
    """Natural values as answers: words without content are dropped."""
    rows = rolls(spark, d).select("seq", *E, F.col("natural_value").alias("answer"))
    return rows.where(assemble.usable_answer(F.col("answer")))


@query("qa_pairs_json")
def _(spark, d):
    return results.question_answer_json(type_mode_answers(spark, d))


@query("split_routing")
def _(spark, d):
    return results.with_split(QUERIES["rolls_total"](spark, d))


@query("clean_text")
def _(spark, d):
    rows = table(spark, d, "events")
    return rows.select(
        "event_id", clean_text(F.col("props")).alias("cleaned"),
        clean_text(F.col("user_id"), "number").alias("number"),
        F.array_join(clean_text(F.split("props", " "), "list"), "|").alias("items"))


@query("transcript_lines")
def _(spark, d):
    return lines(spark, d).select(*E, "seq", "line")


@query("context_window_text")
def _(spark, d):
    chunks = materialize(dialogue.text_chunks(lines(spark, d)))
    prompts = assemble.player_prompt(players(spark, d))
    return assemble.context_texts(members(spark, d), chunks, W, prompts).drop("parts")


def odd_windows(spark, d) -> DataFrame:
    """The windows of even numbers without the episodes of a third of the days, so that parts of a store stay unread."""
    return w.number_members(window_members(spark, d).where("window_key IN ('w0', 'w2', 'w4') AND episode % 16 < 10"), W)


@query("stored_context_text")
def _(spark, d):
    """Context texts of some windows from transcripts stored in buckets."""
    store = Store(spark, fresh_folder(spark, "store"), buckets=8)
    store_transcripts(store, dialogue.text_chunks(lines(spark, d)))
    wanted = materialize(odd_windows(spark, d))
    return assemble.context_texts(wanted, store.asked_for("transcripts", wanted), W).drop("parts")


@query("stored_window_rolls")
def _(spark, d):
    """Rolls by type of some windows from a log stored as cells."""
    store = Store(spark, fresh_folder(spark, "store"), buckets=8)
    store_cells(store, t.compact(t.as_cells(rolls(spark, d)), [*E, "roll_type"]), "rolls")
    wanted = materialize(odd_windows(spark, d))
    return r.rolls_by_type(w.spread(store.asked_for("rolls", wanted), wanted), W)


# --- evaluation planning -----------------------------------------------------------------------------------------

def measured(spark, d):
    return ev.with_context_len(table(spark, d, "documents").select("doc_id", "text"), "text")


@query("context_len")
def _(spark, d):
    return measured(spark, d).select("doc_id", "context_len")


@query("context_len_range")
def _(spark, d):
    # the length is stored before it is filtered, so each text is measured once
    return ev.in_length_range(materialize(measured(spark, d).select("doc_id", "context_len")))


@query("text_variant_select")
def _(spark, d):
    docs = table(spark, d, "documents").select(
        "doc_id", F.col("text").alias("context_window_text"),
        F.concat("text", F.lit(" [language "), "lang", F.lit("]")).alias("context_window_text_with_labels"))
    picked = ev.text_variant(docs, labels=True)
    return picked.select("doc_id", F.length("context").cast("bigint").alias("chars"),
                         F.md5("context").alias("context_md5"))


def datapoints(spark, d):
    return view(spark, d, "boxed_outputs").select("id", "context_window_id", "answer")


def outputs(spark, d):
    return view(spark, d, "boxed_outputs").select("id", "output", "finish_reason").where("output is not null")


@query("prompt_messages")
def _(spark, d):
    docs = table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("id"), F.col("text").alias("context"),
        F.format_string("Which language does source %s use?", F.col("source")).alias("question"))
    parts = ev.message_parts(ev.request_messages(docs))
    return parts.withColumn("text", F.md5("text"))


@query("batch_assign")
def _(spark, d):
    return ev.batches(datapoints(spark, d), BATCH_SIZE).select(
        "id", "context_window_id", "row_no", "batch_id")


@query("seed_and_rest")
def _(spark, d):
    return ev.seed_and_rest(datapoints(spark, d)).select("id", "context_window_id", "role")


def finished(spark, d):
    """Scored rows of an earlier run: every datapoint that has an output."""
    return scoring.score_boxed(scoring.match_outputs(datapoints(spark, d), outputs(spark, d)), MODEL)


@query("resume_pending")
def _(spark, d):
    return ev.pending(datapoints(spark, d), outputs(spark, d))


@query("resume_state")
def _(spark, d):
    return ev.resume_state(finished(spark, d), scores.exact(F.col("score")))


@query("partial_batch_ranges")
def _(spark, d):
    return ev.batch_ranges(ev.batches(datapoints(spark, d), BATCH_SIZE))


@query("running_score")
def _(spark, d):
    batched = ev.batches(datapoints(spark, d), BATCH_SIZE).select("id", "batch_id")
    scored = everything_scored(spark, d).select("id", scores.exact(F.col("score")).alias("score"))
    return ev.running_score(batched.join(scored, "id"))


# --- scoring ---------------------------------------------------------------------------------------------------------

def everything_scored(spark, d):
    return scoring.score_all(scoring.match_outputs(datapoints(spark, d), outputs(spark, d)), model=MODEL)


@query("parse_boxed")
def _(spark, d):
    rows = parsing.parse_boxed(outputs(spark, d), "output")
    return rows.select("id", F.coalesce("boxed", "output").alias("parsed"), "parse_confidence")


@query("type_answer")
def _(spark, d):
    rows = parsing.type_answer(datapoints(spark, d), "answer", "a_")
    return rows.select("id", F.col("a_kind").alias("kind"), F.col("a_i").alias("i"),
                       F.array_join("a_l", "|").alias("items"))


@query("score_boxed")
def _(spark, d):
    return finished(spark, d)


@query("parse_cued")
def _(spark, d):
    rows = parsing.parse_cued(view(spark, d, "cued_outputs"), "output")
    return rows.select("id", "candidate", "parse_confidence")


@query("gold_literal")
def _(spark, d):
    rows = parsing.gold_literal(view(spark, d, "cued_outputs"), "answer")
    return rows.select("id", "gold_text", F.col("gold_date").cast("string").alias("gold_date"))


@query("score_cued")
def _(spark, d):
    return scoring.score_cued(view(spark, d, "cued_outputs"), MODEL).drop("dataset")


#: forty writings of a date
DATE_FORMS = (
    "MMMM d, yyyy", "MMMM d yyyy", "MMM d, yyyy", "MMM d yyyy", "MMM. d, yyyy", "d MMMM yyyy", "d MMMM, yyyy", "d MMM yyyy",
    "dd-MMM-yyyy", "dd.MMM.yyyy", "d/MMM/yyyy", "yyyy MMMM d", "yyyy-MMM-dd", "yyyy, MMM d", "yyyy-MM-dd", "yyyy/M/d", "yyyy.MM.dd",
    "yyyyMMdd", "M/d/yyyy", "MM-dd-yyyy", "M.d.yyyy", "M/d/yy", "MM-dd-yy", "MMMM d, yy", "d MMM yy", "EEEE, MMMM d, yyyy",
    "EEE, d MMM yyyy", "EEEE d MMMM yyyy", "MMMM d, yyyy (EEEE)", "d'th' 'of' MMMM yyyy", "'the' d'th' 'of' MMMM, yyyy",
    "MMMM 'the' d'th', yyyy", "MMMM d'th' yyyy", "'on' MMMM d, yyyy", "dMMMyyyy", "MMMd,yyyy", "yyyy-MM-dd'T'00:00:00", "M/d/yyyy 00:00",
    "yyyy d MMMM", "MMMM d, ''yy")


@query("free_dates")
def _(spark, d):
    """Days of the events written in forty ways, some in capitals, and read again; every eleventh is no date."""
    day, n = F.col("ts").cast("date"), len(DATE_FORMS)
    form = F.col("event_id") % n
    text = F.lit(None).cast("string")
    for k, pattern in enumerate(DATE_FORMS):
        written = F.regexp_replace(F.date_format(day, pattern), "[()]", "")
        text = F.when(form == k, F.regexp_replace(written, "([0-9])th", "$1" + ("th", "st", "nd")[k % 3])).otherwise(text)
    text = F.when(F.col("event_id") % 11 == 0, F.concat(F.date_format(day, "MMMM d"), F.lit(" at noon"))).otherwise(text)
    shown = F.when(F.col("event_id") % 4 == 0, F.upper(text)).otherwise(F.concat(F.lit(" "), text))
    given = table(spark, d, "events").select("event_id", shown.alias("given"))
    return given.select("event_id", parsing.full_date(F.col("given")).cast("string").alias("day"))


@query("score_error_rows")
def _(spark, d):
    rows = scoring.match_outputs(datapoints(spark, d), outputs(spark, d))
    return scoring.error_rows(rows, MODEL).select(
        "id", "context_window_id", "model", "attempted_parse", "parse_confidence", "full_answer",
        "score", "answer")


@query("content_filtered")
def _(spark, d):
    rows = view(spark, d, "boxed_outputs").select("id", "output", "finish_reason")
    return scoring.resolve_filtered(rows).select("id", "output")


@query("overall_score")
def _(spark, d):
    todo = scoring.match_outputs(datapoints(spark, d), outputs(spark, d))
    return scoring.overall_score(finished(spark, d), scoring.error_rows(todo, MODEL))


@query("overall_summary")
def _(spark, d):
    return scoring.overall_summary(MODEL, everything_scored(spark, d))


@query("label_frequency_compare")
def _(spark, d):
    from pyspark.sql import Window

    labelled = table(spark, d, "documents").select("doc_id", "lang").join(
        table(spark, d, "labels").select("doc_id", F.concat(
            F.lit("quality "), F.col("quality").cast("string"),
            F.lit(" toxic "), F.col("toxic").cast("string")).alias("label")), "doc_id")
    counts = materialize(labelled.groupBy("lang", "label").agg(F.count(F.lit(1)).alias("n")))
    following = F.lead("label").over(Window.partitionBy("lang").orderBy("label"))
    asked = counts.select("lang", F.col("label").alias("label_a"), following.alias("label_b")).where(
        "label_b is not null")
    return scoring.label_frequency_compare(counts, asked, ["lang"])


@query("score_stream")
def _(spark, d):
    """The events file read as a stream of outputs, scored until all available files are done."""
    import uuid

    base, _, columns = VIEWS["boxed_outputs"]
    stream = spark.readStream.schema(SCHEMAS[base]).option("pathGlobFilter", f"{base}.parquet").parquet(d)
    arriving = stream.selectExpr(*[f"{columns[c]} AS {c}" for c in ("id", "output", "finish_reason")])
    folder = f"{shared_folder(spark)}/score-stream-{uuid.uuid4()}"
    job = score_stream(arriving, datapoints(spark, d), f"{folder}/rows", f"{folder}/progress",
                       model=MODEL, fmt="parquet")
    job.awaitTermination()
    return spark.read.schema(results.SCORED_ROW).parquet(f"{folder}/rows")


class Killed(Exception):
    pass


def killed_once(at: int):
    """A listener that breaks a run off after the ``at``-th part it has written, in the midst of a trigger."""
    parts = []

    def step(name: str) -> None:
        parts.append(name)
        if len(parts) == at:
            raise Killed(name)
    return step


def until_done(start) -> None:
    """Run a stream that breaks off, then again from its checkpoint."""
    from pyspark.errors import StreamingQueryException

    for _ in range(2):
        try:
            start().awaitTermination()
            return
        except StreamingQueryException as broken:
            if "Killed" not in str(broken):
                raise
    raise RuntimeError("the repeated stream broke off again")


def boxed_table(spark, d) -> DataFrame:
    """Questions with their outputs, written once for the shares and the plan of a stream.

    The events are dealt out before anything is computed from them, as a file with few row groups is read by few tasks.
    """
    base, _, columns = VIEWS["boxed_outputs"]
    with small_tasks(spark):
        return materialize(table(spark, d, base).repartition("event_id").selectExpr(*[f"{expr} AS {name}" for name, expr in columns.items()]))


def arriving_outputs(spark, d, folder: str, boxed: DataFrame | None = None) -> DataFrame:
    """Outputs as a stream of three triggers and more: shares of the events by id, the last with repeats of the others, and
    then one late output of no question, which moves the watermark on."""
    given = (boxed_table(spark, d) if boxed is None else boxed).select("id", "output", "finish_reason")
    schema = T.StructType([*results.OUTPUT_ROW.fields, T.StructField("time", T.TimestampType())])
    files = 1 + given.count() // ROWS_A_FILE  # of a share, and a trigger takes as many

    def write(rows: DataFrame, day: int, files: int) -> None:
        timed = rows.withColumn("time", F.lit(f"2024-01-{day:02} 12:00:00").cast("timestamp"))
        timed.repartition(files, "id").write.mode("append").json(folder)

    for share in range(3):
        write(given.where(f"crc32(id) % 3 = {share} OR crc32(id) % 3 < {share} AND crc32(id) % 5 = 0"), 1, files)
    write(spark.range(1).select(F.lit("none").alias("id"), F.lit("").alias("output"), F.lit("stop").alias("finish_reason")), 20, 1)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder)


def stream_plan(boxed: DataFrame) -> DataFrame:
    with small_tasks(boxed.sparkSession):
        return materialize(ev.batches(boxed.select("id", "context_window_id", "answer"), STREAM_BATCH_SIZE).drop("row_no"))


@query("running_score_stream")
def _(spark, d):
    """The running score kept by a stream, which breaks off in its last trigger and goes on."""
    boxed, folder, step = boxed_table(spark, d), fresh_folder(spark, "running"), killed_once(3)
    plan, gold = stream_plan(boxed), boxed.select("id", "context_window_id", "answer")
    outputs_ = arriving_outputs(spark, d, f"{folder}/outputs", boxed)
    until_done(lambda: running_score_stream(outputs_, gold, plan.select("id", "batch_id"), f"{folder}/run",
                                            f"{folder}/progress", step=step))
    return running_score(spark, f"{folder}/run")


def streamed_run(spark, d) -> tuple[str, DataFrame]:
    """A streamed run that breaks off between two parts of its second trigger and is repeated."""
    boxed, folder, step = boxed_table(spark, d), fresh_folder(spark, "streamed"), killed_once(6)
    plan, outputs_ = stream_plan(boxed), arriving_outputs(spark, d, f"{folder}/outputs", boxed)
    until_done(lambda: rs.run_stream(outputs_.drop("time"), plan, f"{folder}/run", f"{folder}/progress", MODEL, step=step))
    return f"{folder}/run", plan


@query("run_stream_rows")
def _(spark, d):
    folder, _ = streamed_run(spark, d)
    return rs.run_rows(spark, folder).select("id", "batch_id", "parse_confidence", "full_answer", "score", "answer")


@query("run_stream_parts")
def _(spark, d):
    """What else the commits hold: sums of batches, rejected ids, and the summary line."""
    folder, plan = streamed_run(spark, d)
    batches = rs.run_batches(spark, folder).select(
        F.lit("batch").alias("part"), F.col("batch_id").cast("string").alias("name"), "n", F.col("batch_score").cast("double").alias("score"))
    rejects = rs.run_rejects(spark, folder).select(
        F.lit("reject").alias("part"), F.concat_ws(" ", "id", "finish_reason").alias("name"), F.lit(1).cast("bigint").alias("n"), F.lit(0.0).alias("score"))
    line = rs.run_summary(spark, folder, plan, MODEL).select(
        F.lit("summary").alias("part"), F.col("summary").alias("name"), F.lit(1).cast("bigint").alias("n"), F.lit(0.0).alias("score"))
    return batches.union(rejects).union(line)


# --- files written and read again ---------------------------------------------------------------------------------

def fresh_folder(spark, name: str) -> str:
    import uuid

    return f"{shared_folder(spark)}/{name}-{uuid.uuid4()}"


@query("log_files_edges")
def _(spark, d):
    """The roll log as several tab-separated files, read back in one order."""
    folder = fresh_folder(spark, "logs")
    rows = rolls(spark, d).select(
        "seq", "campaign", F.concat_ws("/", "campaign", "episode").alias("episode"), F.lit("0").alias("time"),
        F.coalesce("character", F.lit("nobody")).alias("character"), F.lit("r").alias("roll_type"),
        F.lit("1").alias("total_value"), "natural_value")
    (rows.repartitionByRange(5, "seq").sortWithinPartitions("seq").drop("seq", "campaign")
     .write.option("sep", "\t").option("header", True).csv(folder))
    back = read_log_rows(spark, folder)
    place = F.split("place", "/")
    return back.groupBy(place[0].alias("campaign"), place[1].cast("int").alias("episode")).agg(
        F.count(F.lit(1)).alias("n"), F.min_by("character", "seq").alias("first_character"),
        F.max_by("natural_value", "seq").alias("last_value"))


def read_log_rows(spark, folder: str) -> DataFrame:
    from ..sources.logs import _read_tsv

    return _read_tsv(spark, folder, ("place", "time", "character", "roll_type", "total_value", "natural_value"), "*.csv")


def named_files(spark, rows: DataFrame, folder: str, name: str, write) -> None:
    """Write one file for each value of the column ``name`` and call it so; only names pass through the driver.

    The files are listed in one go and renamed by many threads: a folder asked for at a time takes most of the run.
    """
    from concurrent.futures import ThreadPoolExecutor

    parts = f"{folder}-parts"
    write(rows.repartition(name).sortWithinPartitions(name, "seq").drop("seq").write.partitionBy(name), parts)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = path(parts).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.mkdirs(path(folder))

    def rename(found) -> None:
        file = found.getPath()
        value = file.getParent().getName().partition("=")[2]
        if not system.rename(file, path(f"{folder}/{value}")):
            raise OSError(f"a file was not renamed to {folder}/{value}")

    with ThreadPoolExecutor(RENAMING) as pool:
        for _ in pool.map(rename, system.globStatus(path(f"{parts}/*=*/part-*"))):
            pass


@query("episode_files")
def _(spark, d):
    """Spells in a file for each episode, a third of them with a column more ahead, merged again."""
    folder = fresh_folder(spark, "episodes")
    log = spells(spark, d).select(
        "campaign", "seq", F.concat(F.lit("Spells - 2-"), F.col("episode").cast("string"), F.lit(".tsv")).alias("name"),
        (F.col("episode") % 3 == 0).alias("more"), F.lit("old").alias("Old"), F.lit("0:01").alias("Time"),
        F.col("character").alias("Character"), F.col("spell").alias("Spell"), F.col("base_lvl").alias("Base Lvl"),
        F.col("cast_at").alias("Cast At"), F.lit(None).cast("string").alias("Notes"))
    merged = None
    for campaign in fixed.SPLIT_BY_CAMPAIGN:
        own = log.where(F.col("campaign") == campaign).drop("campaign")
        for more, rows in ((True, own.where("more").drop("more")), (False, own.where("not more").drop("more", "Old"))):
            named_files(spark, rows, f"{folder}/{campaign}-{more}", "name",
                        lambda w, path: w.option("sep", "\t").option("header", True).csv(path))
            part = read_episode_files(spark, f"{folder}/{campaign}-{more}", campaign, SPELL_COLUMNS)
            merged = part if merged is None else merged.union(part)
    return merged.groupBy(*E).agg(
        F.count(F.lit(1)).alias("n"), F.min_by(F.coalesce("spell", F.lit("-")), "seq").alias("first_spell"),
        F.max_by("character", "seq").alias("last_character"), F.count("cast_at").alias("n_cast"),
        F.count_if(F.col("time") == "0:01").alias("n_time"))


ANSWERS = "window_key string, campaign string, question string, key string, answer string"


def roll_answers(cells: DataFrame, by) -> DataFrame:
    mode = r.roll_type_mode(cells, by).select(*by, F.lit("roll_type_mode").alias("question"), F.lit("").alias("key"), "answer")
    counts = r.rolls_by_type(cells, by).select(
        *by, F.lit("rolls_by_type").alias("question"), F.col("roll_type").alias("key"), F.col("n").cast("string").alias("answer"))
    rarest = r.roll_type_rarest(cells, by).select(*by, F.lit("roll_type_rarest").alias("question"), F.lit("").alias("key"), "answer")
    return mode.union(counts).union(rarest)


@query("kept_answers")
def _(spark, d):
    """Answers over a log that comes in three steps of files, the last for a few episodes, refreshed after each."""
    folder = fresh_folder(spark, "kept")
    log = rolls(spark, d).select(
        "seq", "campaign", F.col("episode").cast("string").alias("episode"), F.lit("0").alias("time"), "character", "roll_type",
        F.lit("1").alias("total_value"), "natural_value")
    # the log is in the order of its steps and files, as its oracle reads it
    rank = F.when(F.col("seq") % 3 == 0, 0).when(F.col("episode") % 9 == 4, 2).otherwise(1)
    kept = KeptAnswers(spark, f"{folder}/kept", ["roll_type"], roll_answers, ANSWERS)
    wins = window_members(spark, d)

    def read(paths: list[str]) -> DataFrame:
        parts = [read_log(spark, own, c, ROLL_COLUMNS) for c in fixed.SPLIT_BY_CAMPAIGN if (own := [p for p in paths if f"/{c}/" in p])]
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    for step in range(3):
        for campaign in fixed.SPLIT_BY_CAMPAIGN:
            part = log.where((F.col("campaign") == campaign) & (rank == step)).repartitionByRange(2, "seq").sortWithinPartitions("seq")
            (part.drop("seq", "campaign").write.option("sep", "\t").option("header", True).option("ignoreLeadingWhiteSpace", False)
             .option("ignoreTrailingWhiteSpace", False).csv(f"{folder}/logs/{campaign}/{step}"))
        kept.refresh(listed(spark, f"{folder}/logs/*/*", "*.csv"), read, wins)
    return kept.answers().select("window_key", "campaign", "question", "key", "answer")


def dialogue_files(spark, d) -> str:
    """Conversations as one dialogue file each, of two campaigns and of none."""
    folder = fresh_folder(spark, "dialogues")
    turns = view(spark, d, "turns").select(
        F.concat(F.when(F.col("episode") % 10 == 7, "X").when(F.col("campaign") == "campaign1", "C1").otherwise("C2"), F.lit("E"),
                 F.format_string("%03d", "episode"), F.lit(".json")).alias("name"), "seq",
        F.struct(F.when(F.col("seq") % 3 == 1, F.array("name", F.lit("GUEST"))).otherwise(F.array("name")).alias("NAMES"),
                 F.split("utterance", " ").alias("UTTERANCES")).alias("turn"))
    rows = turns.groupBy("name").agg(F.sort_array(F.collect_list(F.struct("seq", "turn"))).alias("turns")).select(
        "name", F.lit(0).alias("seq"), F.col("turns.turn").alias("TURNS"))
    if (own := mounted(spark, folder)) is not None:
        write_files(rows.select("name", F.to_json(F.struct("TURNS")).alias("json")).where("name is not null"), own, "name", "json")
    else:
        named_files(spark, rows, folder, "name", lambda w, path: w.json(path))
    return folder


@query("transcript_files")
def _(spark, d):
    """Dialogue files to transcripts, written and read again; files of no campaign are listed with no text."""
    from ..plans import jobs

    folder = dialogue_files(spark, d)
    rejects = jobs.prepare_transcripts(spark, folder, f"{folder}-texts")
    texts = dialogue.read_written_transcripts(spark, f"{folder}-texts").select(
        *E, "chars", F.md5("text").alias("text_md5"))
    return texts.unionByName(rejects.select(F.lit("none").alias("campaign"), F.regexp_extract("stem", "E([0-9]+)", 1).cast("int").alias("episode"),
                                            F.lit(0).cast("bigint").alias("chars"), F.lit("").alias("text_md5")))


@query("transcript_named_files")
def _(spark, d):
    """Transcripts as one text file each, told apart by their names, read line by line into texts."""
    folder = fresh_folder(spark, "transcripts")
    rows = lines(spark, d).where("campaign = 'campaign1'").select(
        F.format_string("C1E%03d.txt", "episode").alias("name"), "seq", F.col("line").alias("value"))
    named_files(spark, rows, folder, "name", lambda w, path: w.text(path))
    texts = dialogue.read_transcripts(spark, folder, "campaign1")
    return texts.select(*E, "chars", F.md5("text").alias("text_md5"))


@query("dataset_files")
def _(spark, d):
    """An export whose rows carry their texts, read and split into questions and texts, each window's once."""
    from ..plans import jobs

    folder = fresh_folder(spark, "dataset")
    docs = table(spark, d, "documents").select("doc_id", "text")
    asked = docs.select(F.explode(F.array(F.lit("a"), F.lit("b"))).alias("q"), "doc_id", "text").select(
        F.concat_ws("-", F.col("doc_id").cast("string"), "q").alias("id"), F.col("doc_id").cast("string").alias("context_window_id"),
        F.col("text").alias("context_window_text"), F.col("q").alias("question"), F.lit("1").alias("answer"),
        F.lit("t").alias("question_type"), F.array(F.lit(1)).alias("episodes"), F.lit("campaign1").alias("campaign"))
    asked.write.json(folder)
    questions, windows = jobs.split_texts(results.read_dataset(spark, folder).drop("part"))
    counted = questions.groupBy("context_window_id").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last_id"))
    return counted.join(windows.select("context_window_id", F.md5("context_window_text").alias("text_md5")), "context_window_id")


@query("question_set_files")
def _(spark, d):
    """Documents as windows cut into short parts, written with their questions, read back and measured."""
    from ..plans import jobs

    folder = fresh_folder(spark, "questions")
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    lines = F.split("text", "\n")
    parts = docs.select("id", F.size(lines).alias("parts"), F.posexplode(lines).alias("place", "line"))
    texts = parts.select(
        F.col("id").alias("context_window_id"), (F.col("place") + 1).alias("part"), "parts",
        F.concat("line", F.when(F.col("place") + 1 < F.col("parts"), "\n").otherwise("")).alias("context_window_text"))
    asked = docs.select("id", F.col("id").alias("context_window_id"), F.lit("q").alias("question"), F.lit("a").alias("answer"),
                        F.lit("t").alias("question_type"), F.array(F.lit(1)).alias("episodes"), F.lit("campaign1").alias("campaign"))
    results.write_question_set(asked, texts, folder)
    questions, windows = results.read_question_set(spark, folder, "test")
    whole = results.whole_texts(windows).select(
        "context_window_id", F.length("context_window_text").cast("bigint").alias("chars"),
        F.md5("context_window_text").alias("text_md5"))
    counted = questions.groupBy("id", "context_window_id").agg(F.count(F.lit(1)).alias("n"))
    return (counted.join(whole, "context_window_id").join(jobs.window_lengths(windows), "context_window_id")
            .select("id", "n", "chars", "text_md5", "context_len"))


@query("score_run_summary")
def _(spark, d):
    """A run in two calls: repeated, filtered, empty and missing outputs over the whole set of questions."""
    from ..plans import jobs

    folder = fresh_folder(spark, "run")
    given = view(spark, d, "boxed_outputs").select("id", "output", "finish_reason")
    # filtered ones would score against their fixed text, which equals no answer; so they are errors in the oracle
    twice = given.where("crc32(id) % 2 = 0").union(given.where("crc32(id) % 4 = 0"))
    jobs.score_run(datapoints(spark, d), twice, folder, MODEL)
    return jobs.score_run(datapoints(spark, d), given.where("output is not null or crc32(id) % 3 > 0"), folder, MODEL)
