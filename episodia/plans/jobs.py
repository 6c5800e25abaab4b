"""End-to-end jobs: transcripts, question sets, evaluation plans, scored results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.scores import exact
from ..functions.text import word_count
from ..operators.windows import episodes_of, without_transcript
from ..sources import dialogue, results
from ..session import materialize
from ..sources.logs import SPELL_COLUMNS, read_episode_files, read_players, read_rolls, read_spells
from . import evaluation as ev
from . import scoring
from .assemble import KEY, QuestionSet, build_questions, context_texts, player_prompt


def prepare_transcripts(spark: SparkSession, data_dir: str, output_dir: str) -> DataFrame:
    """Dialogue files to transcript texts; returns the files that belong to no campaign."""
    dialogues = dialogue.read_dialogues(spark, data_dir)
    lines = dialogue.transcript_lines(dialogue.dialogue_turns(dialogues))
    dialogue.write_transcripts(lines, output_dir)
    return dialogue.dialogue_rejects(dialogues)


def _each_campaign(campaigns: Sequence[str], read) -> DataFrame:
    frames = [read(campaign) for campaign in campaigns]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def read_logs(spark: SparkSession, stats_dir: str, campaign: str, by_episode: bool) -> tuple[DataFrame, DataFrame]:
    """Roll and spell log of a campaign; ``by_episode`` takes the spells from one file per episode.

    Some of the spell files have one more leading column, which is cut.
    """
    folder = f"{stats_dir}/{campaign}"
    rolls = read_rolls(spark, f"{folder}/rolls.tsv", campaign)
    if not by_episode:
        return rolls, read_spells(spark, f"{folder}/spells.tsv", campaign)
    extra = fixed.EXTRA_COLUMN_EPISODES if campaign == fixed.EXTRA_COLUMN_CAMPAIGN else None
    return rolls, read_episode_files(spark, f"{folder}/spells", campaign, SPELL_COLUMNS, extra_column=extra)


def prepare_questions(spark: SparkSession, stats_dir: str, transcripts: DataFrame, output_dir: str,
                      campaigns: Sequence[str] = tuple(fixed.SPLIT_BY_CAMPAIGN), toy: bool = False,
                      by_episode: bool = False, part_chars: int = dialogue.PART_CHARS) -> tuple[QuestionSet, DataFrame]:
    """Logs and transcripts to a question set: questions by split, and each window's text once, in parts.

    ``transcripts`` has ``(campaign, episode, chunk, text)`` as the transcript readers give it; ``by_episode``
    reads one spell file per episode. Returns the question set and the logged episodes without transcript.
    """
    logs = [read_logs(spark, stats_dir, c, by_episode) for c in campaigns]
    rolls, spells = (_each_campaign(range(len(logs)), lambda i, k=k: logs[i][k]) for k in (0, 1))
    players = _each_campaign(campaigns, lambda c: read_players(spark, f"{stats_dir}/{c}/characters.tsv", c))
    questions = build_questions(rolls, spells, players, transcripts, toy)
    texts = context_texts(questions.members.select(*KEY, "campaign", "episode", "ordinal"), transcripts,
                          [*KEY, "campaign"], player_prompt(players), part_chars)
    results.write_question_set(questions.rows, texts.withColumnRenamed("text", "context_window_text"), output_dir)
    return questions, without_transcript(episodes_of(spells), transcripts)


def split_texts(dataset: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A data set whose rows carry their context text, as one question per id without text and the window texts.

    Rows of an export that cuts long texts have a ``part`` (null or 1 for the first): a question is then its first
    row, and the window keeps every part.
    """
    texts = [c for c in dataset.columns if c.startswith("context_window_text")]
    if "part" not in dataset.columns:
        windows = dataset.groupBy("context_window_id").agg(*[F.any_value(c).alias(c) for c in texts])
        return dataset.drop(*texts), windows
    numbered = dataset.withColumn("part", F.coalesce("part", F.lit(1).cast("bigint")))
    windows = numbered.groupBy("context_window_id", "part").agg(*[F.any_value(c).alias(c) for c in texts])
    return numbered.where("part = 1").drop("part", *texts), windows


def window_lengths(windows: DataFrame, measure=word_count) -> DataFrame:
    """(context_window_id, context_len), written once: texts are measured once, and what follows reads two columns.

    Parts break at line ends, where no word goes on, so a window's length is the sum over its parts.
    """
    measured = ev.with_context_len(windows, measure=measure).select("context_window_id", "context_len")
    return materialize(measured.groupBy("context_window_id").agg(F.sum("context_len").alias("context_len")))


def plan_run(questions: DataFrame, windows: DataFrame, finished: DataFrame | None = None,
             by_window: bool = False, batch_size: int = 1,
             minimum: int = fixed.MIN_CONTEXT_LEN, maximum: int = fixed.MAX_CONTEXT_LEN,
             measure=word_count) -> DataFrame:
    """Questions still to run, in length range, each with its batch; no text is moved.

    ``by_window`` runs the first row of a window as seed, whose context is marked for caching
    (``cache``), and its other rows as one batch; otherwise batches have ``batch_size`` rows in
    window order. A stored ``context_len`` is used as it is; without one, each window's text is
    measured once, over all its parts.
    """
    if "context_len" not in questions.columns:
        questions = questions.join(window_lengths(windows, measure), "context_window_id")
    todo = ev.in_length_range(questions, minimum, maximum)
    if finished is not None:
        todo = ev.pending(todo, finished)
    if by_window:
        return ev.seed_and_rest(todo).withColumn("cache", F.col("role") == "seed")
    return ev.batches(todo, batch_size).withColumn("cache", F.lit(True))


def request_table(plan: DataFrame, windows: DataFrame, labels: bool = False,
                  rows_per_copy: int = 64) -> DataFrame:
    """Planned questions with their request messages; the one step that repeats texts per question.

    A window with many questions is dealt out in shares of about ``rows_per_copy``, each with its own
    copy of the text, so that the rows of one huge window are built by many tasks. A window in parts is
    joined first: what is planned has a length within range.
    """
    shares = plan.groupBy("context_window_id").agg(
        F.ceil(F.count(F.lit(1)) / F.lit(rows_per_copy)).cast("bigint").alias("shares"))
    planned = results.whole_texts(windows.join(shares.select("context_window_id"), "context_window_id", "left_semi"))
    texts = ev.text_variant(planned, labels).select("context_window_id", "context").join(shares, "context_window_id")
    copies = texts.withColumn("share", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1)))
    dealt = plan.join(shares, "context_window_id").withColumn(
        "share", F.pmod(F.xxhash64("id"), F.col("shares"))).drop("shares")
    joined = dealt.join(copies.drop("shares"), ["context_window_id", "share"]).drop("share")
    return ev.request_messages(joined, F.col("cache")).drop("context")


def finished_rows(spark: SparkSession, results_dir: str) -> DataFrame:
    """Scored rows of a run so far, from plain and from batched output."""
    parts = []
    for folder in ("full_output", "batch_output"):
        path = f"{results_dir}/{folder}"
        if _exists(spark, path):
            parts.append(results.read_scored(spark, path))
    if not parts:
        return spark.createDataFrame([], results.SCORED_ROW)
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def score_run(dataset: DataFrame, outputs: DataFrame, results_dir: str, model: str,
              scorer=scoring.score_boxed, batches: DataFrame | None = None) -> DataFrame:
    """Score what has outputs, append it, write and return the overall summary over the whole data set.

    Ids that have a result already are not scored again, so a run can be repeated or resumed, and an id's
    repeated outputs count once. An output that is empty for no accepted reason is listed under ``rejects`` and
    stays to be asked again; it and every missing output count as errors in the summary. With ``batches``
    (id, batch_id) rows go to one folder per batch.
    """
    spark = dataset.sparkSession
    single = materialize(scoring.one_output(outputs))
    todo = ev.pending(dataset, finished_rows(spark, results_dir))
    resolved = scoring.resolve_filtered(single).where("output is not null")
    scored = scoring.score_all(scoring.match_outputs(todo, resolved).where("output is not null"), scorer, model)
    if batches is None:
        results.append_scored(scored, f"{results_dir}/full_output")
    else:
        results.write_batches(scored.join(batches.select("id", "batch_id"), "id"), f"{results_dir}/batch_output")
    scoring.empty_outputs(single).select("id", "finish_reason").write.mode("overwrite").json(f"{results_dir}/rejects")
    done = finished_rows(spark, results_dir)
    missing = ev.pending(dataset, done).withColumn("output", F.lit(None).cast("string"))
    summary = scoring.overall_summary(model, done.join(dataset.select("id"), "id", "left_semi"),
                                      scoring.error_rows(missing, model))
    summary.write.mode("overwrite").text(f"{results_dir}/overall")
    return summary


def resume_state(spark: SparkSession, results_dir: str) -> DataFrame:
    """How many rows a run has finished and what they scored."""
    return ev.resume_state(finished_rows(spark, results_dir), exact(F.col("score")))
