"""The running score of a run as its outputs arrive: batches close when full or overdue, and count in their order."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scores import exact
from ..operators.ordered import running_totals, seq_levels, sorted_positions
from ..plans.scoring import resolve_filtered, score_boxed
from ..session import keyed_state, materialize
from .ledger import Ledger
from .open_batch import CLOSED, OpenBatch

PATIENCE = 24 * 3600  # seconds of the outputs' own time that a batch waits for its missing ones
RUNNING = "batch_id long, n long, n_missing long, rows_so_far long, score_so_far double"
TOTALS = "frontier long, rows_so_far long, sum_so_far decimal(28,12)"


def closed_batches(outputs: DataFrame, gold: DataFrame, plan: DataFrame, time_column: str, late: str,
                   patience: int = PATIENCE, scorer=score_boxed) -> DataFrame:
    """Stream of batches (batch_id, n, n_missing, batch_score), each once, as they fill or run over.

    ``outputs`` has id, output, finish_reason and a time, ``gold`` the answers and ``plan`` (id, batch_id). Outputs are
    scored before they meet the state, which holds ids and sums and no text. An empty output counts as missing.
    """
    sizes = plan.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))
    asked = materialize(gold.join(plan.select("id", "batch_id").join(sizes, "batch_id"), "id"))
    known = resolve_filtered(outputs.withWatermark(time_column, late)).where("id is not null and output is not null")
    met = known.select("id", "output", F.unix_millis(F.col(time_column).cast("timestamp")).alias("at")).join(asked, "id")
    # scorers hand on a row's window as it is, so place and time of an output ride along with it
    ride = F.struct("batch_id", "n", "at")
    scored = scorer(met.withColumn("context_window_id", ride)).select(
        "id", "context_window_id.*", exact(F.col("score")).cast("decimal(28,12)").alias("score"))
    return scored.groupBy("batch_id").transformWithState(OpenBatch(patience), CLOSED, "Append", "EventTime")


def release(spark: SparkSession, folder: str, closed: DataFrame, trigger: int,
            step: Callable[[str], None] | None = None) -> None:
    """One trigger's closed batches into the run: those that continue the order without a gap get their running score.

    Others wait in ``pending``. A batch that is known already changes nothing, nor does a repeated trigger.
    """
    ledger = Ledger(spark, folder, TOTALS)
    last = ledger.last()
    if ledger.is_done(trigger, last):
        return
    frontier, rows, total = (last["frontier"], last["rows_so_far"], last["sum_so_far"]) if last else (0, 0, Decimal(0))
    waiting = ledger.part("pending", CLOSED, last["number"] if last else -1).drop("trigger")
    fresh = closed.where(F.col("batch_id") >= frontier).dropDuplicates(["batch_id"])
    known = materialize(waiting.union(fresh.join(waiting.select("batch_id"), "batch_id", "left_anti").select(*waiting.columns)))
    if known.isEmpty():
        return
    # numbers without a gap stand at their own distance from the frontier
    placed = sorted_positions(known, ["batch_id"], "place").withColumn(
        "in_turn", F.col("batch_id") == F.lit(frontier) + F.col("place") - 1)
    ready = materialize(placed.where("in_turn").drop("place", "in_turn"))
    totals = running_totals(ready, {"rows_so_far": F.col("n"), "sum_so_far": F.col("batch_score")},
                            [], seq_levels("batch_id"), [F.col("batch_id")])
    so_far = F.col("rows_so_far") + F.lit(rows)
    summed = (F.col("sum_so_far") + F.lit(total).cast("decimal(28,12)")).cast("decimal(28,12)")
    running = totals.select("batch_id", "n", "n_missing", so_far.alias("rows_so_far"),
                            (summed.cast("double") / so_far.cast("double")).alias("score_so_far"))

    def after() -> dict:
        done = ready.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0)),
                         F.coalesce(F.sum("batch_score"), F.lit(0)).cast("decimal(28,12)")).first()
        return {"frontier": frontier + done[0], "rows_so_far": rows + done[1], "sum_so_far": total + done[2]}

    ledger.commit(trigger, {"running": running, "pending": placed.where("not in_turn").drop("place", "in_turn")}, after, step)


def running_score_stream(outputs: DataFrame, gold: DataFrame, plan: DataFrame, folder: str, checkpoint: str,
                         time_column: str = "time", late: str = "10 minutes", patience: int = PATIENCE,
                         scorer=score_boxed, step: Callable[[str], None] | None = None) -> StreamingQuery:
    """Keep the running score of a run under ``folder`` while its outputs arrive; a restart goes on from ``checkpoint``.

    Batches count in the order of their numbers, which ``plan`` (id, batch_id) gives from 0 without gaps.
    """
    closed = closed_batches(outputs, gold, plan, time_column, late, patience, scorer)
    with keyed_state(outputs.sparkSession):
        return (closed.writeStream.foreachBatch(lambda rows, trigger: release(rows.sparkSession, folder, rows, trigger, step))
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def running_score(spark: SparkSession, folder: str) -> DataFrame:
    """batch_id, n, n_missing, rows_so_far, score_so_far of all batches that count so far."""
    return Ledger(spark, folder, TOTALS).part("running", RUNNING).drop("trigger")
