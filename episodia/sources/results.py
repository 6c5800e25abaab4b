"""Readers and writers for question sets, model outputs and scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as fixed
from ..functions.text import clean_text
from ..operators.tallies import listing

QUESTION_ROW = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("context_window_id", T.StringType()),
    T.StructField("context_window_text", T.StringType()),
    T.StructField("question", T.StringType()),
    T.StructField("answer", T.StringType()),
    T.StructField("question_type", T.StringType()),
    T.StructField("episodes", T.ArrayType(T.IntegerType())),
    T.StructField("campaign", T.StringType()),
    T.StructField("part", T.LongType()),  # only in exports that cut long texts into several rows
])

SCORED_ROW = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("context_window_id", T.StringType()),
    T.StructField("dataset", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("attempted_parse", T.StringType()),
    T.StructField("parse_confidence", T.StringType()),
    T.StructField("full_answer", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("context_len", T.LongType()),
    T.StructField("task_group", T.StringType()),
    T.StructField("task", T.StringType()),
    T.StructField("answer_type", T.StringType()),
    T.StructField("answer", T.StringType()),
])

# a window's context text, in parts whose texts in order are the whole
WINDOW_TEXT = T.StructType([
    T.StructField("context_window_id", T.StringType()),
    T.StructField("part", T.LongType()),
    T.StructField("parts", T.LongType()),
    T.StructField("context_window_text", T.StringType()),
])

OUTPUT_ROW = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("output", T.StringType()),
    T.StructField("finish_reason", T.StringType()),
])


def read_dataset(spark: SparkSession, path: str, fmt: str = "json",
                 schema: T.StructType | None = None) -> DataFrame:
    """An exported question set, JSON lines (``QUESTION_ROW`` by default) or Parquet."""
    reader = spark.read
    if fmt == "json":
        reader = reader.schema(schema or QUESTION_ROW)
    return reader.format(fmt).load(path)


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    """Scored rows of earlier runs, also those written by batch."""
    return spark.read.schema(SCORED_ROW).json(path).select(*SCORED_ROW.names)


def read_outputs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OUTPUT_ROW).json(path)


def as_scored(rows: DataFrame, *more: str) -> DataFrame:
    """Bring scored rows of any kind to the common nullable schema, with the columns ``more`` after it."""
    return rows.select(*[
        (F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in SCORED_ROW.fields], *more)


def append_scored(rows: DataFrame, path: str) -> None:
    """Append scored rows as JSON lines. Tasks that are lost and re-run leave no duplicates."""
    as_scored(rows).write.mode("append").json(path)


def write_batches(rows: DataFrame, path: str) -> None:
    """Append scored rows with their ``batch_id``, one folder per batch. For batches of many rows:
    every batch costs a folder, so row-sized batches belong into ``append_scored``."""
    kept = rows.select(*[c for c in rows.columns if c == "batch_id" or c in SCORED_ROW.names])
    kept.write.mode("append").partitionBy("batch_id").json(path)


def with_split(rows: DataFrame) -> DataFrame:
    """Split of each row by its campaign."""
    split = F.lit(None).cast("string")
    for campaign, name in fixed.SPLIT_BY_CAMPAIGN.items():
        split = F.when(F.col("campaign") == campaign, name).otherwise(split)
    return rows.withColumn("split", split)


def write_questions(rows: DataFrame, path: str) -> None:
    """Question rows as JSON lines, one folder per split."""
    with_split(rows).write.mode("overwrite").partitionBy("split").json(path)


def write_question_set(rows: DataFrame, texts: DataFrame, path: str) -> None:
    """Questions under ``questions`` and their windows' texts, once each and in parts, under ``texts``."""
    write_questions(rows, f"{path}/questions")
    texts.select(*[F.col(f.name).cast(f.dataType) for f in WINDOW_TEXT.fields]).write.mode("overwrite").json(f"{path}/texts")


def read_question_set(spark: SparkSession, path: str, split: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Questions without text, one row per id, and window texts as ``write_question_set`` left them."""
    schema = T.StructType([f for f in QUESTION_ROW.fields if f.name not in ("context_window_text", "part")]).add("split", "string")
    questions = spark.read.schema(schema).json(f"{path}/questions")
    if split is not None:
        questions = questions.where(F.col("split") == split)
    return questions, spark.read.schema(WINDOW_TEXT).json(f"{path}/texts")


def whole_texts(windows: DataFrame) -> DataFrame:
    """One row per window, its parts joined in order. Only for windows whose text one value can hold."""
    if "part" not in windows.columns:
        return windows
    texts = [c for c in windows.columns if c.startswith("context_window_text")]
    return windows.groupBy("context_window_id").agg(*[listing(c, "part", "").alias(c) for c in texts])


def question_answer_json(rows: DataFrame) -> DataFrame:
    """Bare ``{question, answer}`` lines with quotes escaped in both."""
    pair = F.struct(clean_text(F.col("question")).alias("question"),
                    clean_text(F.col("answer")).alias("answer"))
    return rows.select(F.to_json(pair).alias("value"))


def write_question_answers(rows: DataFrame, path: str) -> None:
    question_answer_json(rows).write.mode("overwrite").text(path)
