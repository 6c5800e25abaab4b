"""Dialogue files to transcript lines, transcript texts, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as fixed
from ..functions.text import capitalise
from ..operators.tallies import EPISODE, listing
from .files import few_listing_tasks, mounted, write_files
from .logs import in_file_order

TURN = T.StructType([
    T.StructField("NAMES", T.ArrayType(T.StringType())),
    T.StructField("UTTERANCES", T.ArrayType(T.StringType())),
])
DIALOGUE = T.StructType([T.StructField("TURNS", T.ArrayType(TURN))])

# A line's order number: turn in the high bits, place of the name in its turn in the low ones.
NAME_BITS = 16
PART_CHARS = 1 << 24
LINE_CHARS = 256


def read_dialogues(spark: SparkSession, path: str) -> DataFrame:
    """One row per dialogue file: ``stem``, ``campaign`` (null for an unknown prefix), ``episode``, ``TURNS``."""
    rows = spark.read.schema(DIALOGUE).option("multiLine", True).option(
        "pathGlobFilter", "*.json").json(path)
    stem = F.regexp_replace(F.col("_metadata.file_name"), "\\.json$", "")
    campaign = F.lit(None).cast("string")
    for prefix, name in fixed.CAMPAIGN_BY_PREFIX.items():
        campaign = F.when(F.startswith(stem, F.lit(prefix)), name).otherwise(campaign)
    return rows.select(
        stem.alias("stem"), campaign.alias("campaign"),
        F.regexp_extract(stem, "E([0-9]+)", 1).try_cast("int").alias("episode"), "TURNS")


def dialogue_rejects(dialogues: DataFrame) -> DataFrame:
    """Files that belong to no known campaign."""
    return dialogues.where(F.col("campaign").isNull()).select("stem")


def dialogue_turns(dialogues: DataFrame) -> DataFrame:
    """One row per turn of the accepted files."""
    kept = dialogues.where(F.col("campaign").isNotNull())
    turns = kept.select(*EPISODE, F.posexplode("TURNS").alias("turn", "t"))
    return turns.select(*EPISODE, F.col("turn").cast("bigint").alias("turn"),
                        F.col("t.NAMES").alias("names"), F.col("t.UTTERANCES").alias("utterances"))


def transcript_lines(turns: DataFrame) -> DataFrame:
    """``Name: text`` lines; a turn of several names yields as many lines. Narrow, no shuffle."""
    named = turns.select(*EPISODE, "turn", "utterances", F.posexplode("names").alias("place", "name"))
    text = F.array_join("utterances", " ")
    return named.select(
        *EPISODE,
        (F.shiftleft(F.col("turn"), NAME_BITS) + F.col("place")).alias("seq"),
        "name", text.alias("text"),
        F.concat(capitalise(F.col("name")), F.lit(": "), text).alias("line"))


def text_chunks(lines: DataFrame, part_chars: int = PART_CHARS, step: int = 1 << NAME_BITS) -> DataFrame:
    """Transcript texts, every line ended by a line break, in chunks of about ``part_chars`` characters.

    A chunk is a run of so many lines of usual length, told by their order numbers, which are ``step`` apart from
    turn to turn. So a line knows its chunk, the text crosses one shuffle, and a chunk's lines are bounded whatever
    the length of an episode. ``chunk`` grows along the episode; ordinary ones have one.
    """
    lines_of_chunk = max(1, part_chars // LINE_CHARS)
    chunk = F.floor(F.col("seq") / F.lit(lines_of_chunk * step)).cast("bigint")
    broken = lines.select(*EPISODE, "seq", chunk.alias("chunk"), F.concat("line", F.lit("\n")).alias("line"))
    return broken.groupBy(*EPISODE, "chunk").agg(
        F.sum(F.length("line")).cast("bigint").alias("chars"), listing("line", "seq", "").alias("text"))


def read_transcript_lines(spark: SparkSession, path: str, campaign: str) -> DataFrame:
    """Transcript files ``C*E*.txt`` line by line, in file order; the number after ``E`` is the episode.

    Files of any size are split over tasks.
    """
    glob = "C*E*.txt"
    rows = in_file_order(spark.read.option("pathGlobFilter", glob).text(path), path, glob)
    number = F.regexp_extract("file_name", "E([0-9]+)", 1).try_cast("int")
    return rows.select(F.lit(campaign).alias("campaign"), number.alias("episode"), "seq",
                       F.col("value").alias("line")).where(F.col("episode").isNotNull())


def read_transcripts(spark: SparkSession, path: str, campaign: str, part_chars: int = PART_CHARS) -> DataFrame:
    """Transcript files as texts in chunks of bounded size, one for ordinary files; every line ends with a break."""
    return text_chunks(read_transcript_lines(spark, path, campaign), part_chars, step=1)


def write_transcripts(lines: DataFrame, path: str, part_chars: int = PART_CHARS) -> None:
    """Text files under ``campaign=…/episode=…/chunk=…``, one per chunk, lines in order."""
    chunks = text_chunks(lines, part_chars)
    body = chunks.select(*EPISODE, "chunk", F.regexp_replace("text", "\n$", "").alias("value"))
    if (folder := mounted(lines.sparkSession, path)) is not None:
        file = F.format_string("part-%016x.txt", F.xxhash64(*EPISODE, "chunk"))
        write_files(body.withColumn("file", file), folder, "file", "value", (*EPISODE, "chunk"))
    else:
        body.write.mode("overwrite").partitionBy(*EPISODE, "chunk").text(path)


def read_written_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Transcripts as ``write_transcripts`` left them."""
    with few_listing_tasks(spark):
        rows = spark.read.option("basePath", path).text(path, wholetext=True)
    return rows.select("campaign", F.col("episode").cast("int").alias("episode"),
                       F.col("chunk").cast("bigint").alias("chunk"),
                       F.length("value").cast("bigint").alias("chars"), F.col("value").alias("text"))
