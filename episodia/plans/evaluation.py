"""Planning of evaluation runs: lengths, ranges, resuming, batches and request tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions.text import word_count
from ..operators.ordered import running_totals, seq_levels, sorted_positions
from ..session import materialize


def with_context_len(windows: DataFrame, text: str = "context_window_text",
                     measure=word_count) -> DataFrame:
    """Add ``context_len``. Measure windows, not questions: a text is then counted once.

    ``measure`` is a column function: the built-in word count, or ``token_counter`` around a
    tokenizer. Store the result before filtering on it, so that later runs can push the filter down.
    """
    return windows.withColumn("context_len", measure(F.col(text)))


def in_length_range(rows: DataFrame, minimum: int = fixed.MIN_CONTEXT_LEN,
                    maximum: int = fixed.MAX_CONTEXT_LEN) -> DataFrame:
    """Lengths above ``minimum`` and up to ``maximum``."""
    return rows.where((F.col("context_len") <= maximum) & (F.col("context_len") > minimum))


def pending(rows: DataFrame, finished: DataFrame) -> DataFrame:
    """Rows whose id has no finished result."""
    return rows.join(finished.select("id"), "id", "left_anti")


def resume_state(finished: DataFrame, score: Column) -> DataFrame:
    """Finished rows and their score so far; one row, also when nothing is finished."""
    return finished.agg(F.count(F.lit(1)).alias("n_done"),
                        F.coalesce(F.sum(score), F.lit(0)).cast("double").alias("sum_score"))


def text_variant(rows: DataFrame, labels: bool = False) -> DataFrame:
    """Add ``context``: the plain text, or the one with labels."""
    return rows.withColumn(
        "context", F.col("context_window_text_with_labels" if labels else "context_window_text"))


def window_order(rows: DataFrame) -> DataFrame:
    """Rows sorted by window and id, so that requests over one context follow each other.

    The sort ranges over both columns, so that a huge window is still spread over tasks.
    """
    return rows.orderBy("context_window_id", "id")


def batches(rows: DataFrame, size: int = 1) -> DataFrame:
    """Add ``row_no`` (1-based, ordered by window and id) and ``batch_id`` (0-based). Ids must be unique."""
    numbered = sorted_positions(rows, ["context_window_id", "id"], "row_no")
    return numbered.withColumn("batch_id", F.floor((F.col("row_no") - 1) / F.lit(size)).cast("bigint"))


def batch_ranges(batched: DataFrame, done: Column | None = None) -> DataFrame:
    """First and last 0-based output row of each batch, counted on from ``done`` earlier rows."""
    base = F.lit(0) if done is None else done
    return batched.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n"),
        (F.min("row_no") - 1 + base).cast("bigint").alias("first_row"),
        (F.max("row_no") - 1 + base).cast("bigint").alias("last_row"))


def seed_and_rest(rows: DataFrame) -> DataFrame:
    """Add ``role``: the first row of each window by id is its ``seed``, all others its ``rest``.

    Seeds come from a partial minimum and are matched by id, so one huge window is never gathered.
    """
    seeds = rows.groupBy("context_window_id").agg(F.min("id").alias("id"))
    marked = seeds.select("context_window_id", "id", F.lit("seed").alias("role"))
    return rows.join(marked, ["id", "context_window_id"], "left").withColumn(
        "role", F.coalesce("role", F.lit("rest")))


def request_messages(rows: DataFrame, cache: Column | None = None) -> DataFrame:
    """Add ``messages``: system texts (the context may be marked for caching) and the question."""
    mark = F.lit(True) if cache is None else cache

    def part(text: Column, marked: Column) -> Column:
        return F.struct(F.lit("text").alias("type"), text.alias("text"),
                        F.when(marked, "ephemeral").alias("cache_control"))

    def message(role: str, *parts: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), F.array(*parts).alias("content"))

    off = F.lit(False)
    return rows.withColumn("messages", F.array(
        message("system", part(F.lit(fixed.SYSTEM_TEXT), off), part(F.col("context"), mark)),
        message("user", part(F.col("question"), off))))


def message_parts(rows: DataFrame) -> DataFrame:
    """``messages`` as one row per text, in order."""
    flat = rows.select("id", F.posexplode("messages").alias("message_no", "m"))
    flat = flat.select("id", "message_no", F.col("m.role").alias("role"),
                       F.posexplode("m.content").alias("part_no", "p"))
    return flat.select("id", "message_no", "part_no", "role", F.col("p.text").alias("text"),
                       F.col("p.cache_control").alias("cache_control"))


def running_score(scored_batches: DataFrame) -> DataFrame:
    """Rows, score and score so far after each batch, from rows ``(batch_id, score)``.

    ``score`` must be exact (decimal), so that the running value does not depend on partitioning.
    """
    per_batch = scored_batches.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("score").cast("decimal(28,12)").alias("batch_score"))
    totals = running_totals(
        materialize(per_batch), {"rows_so_far": F.col("n"), "sum_so_far": F.col("batch_score")},
        [], seq_levels("batch_id"), [F.col("batch_id")])
    return totals.select(
        "batch_id", "n", "rows_so_far",
        (F.col("sum_so_far").cast("double") / F.col("rows_so_far").cast("double")).alias("score_so_far"))
