"""A run's outputs as a stream: scored rows, batches, rejects and the summary in one commit per trigger."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scores import exact
from ..plans import evaluation as ev
from ..plans import scoring
from ..session import materialize, small_tasks
from ..sources.results import SCORED_ROW
from .ledger import Ledger

ROWS = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in SCORED_ROW.fields) + ", batch_id long"
BATCHES = "batch_id long, n long, batch_score decimal(28,12)"
REJECTS = "id string, finish_reason string"
TOTALS = "n_rows long, sum_score decimal(28,12), n_rejects long"


def commit_outputs(spark: SparkSession, folder: str, outputs: DataFrame, asked: DataFrame, trigger: int, model: str,
                   scorer=scoring.score_boxed, step: Callable[[str], None] | None = None) -> None:
    """Score one trigger's ``outputs`` and commit its rows, batches and rejects together.

    An id counts once: the finished ids of earlier triggers are read, narrowly, and no state is kept for them. Outputs
    that are empty for no accepted reason are listed under rejects and may come again. Unknown ids are left out.
    """
    ledger = Ledger(spark, folder, TOTALS)
    last = ledger.last()
    if ledger.is_done(trigger, last):
        return
    fresh = ev.pending(scoring.resolve_filtered(scoring.one_output(outputs)), ledger.part("ids", "id string"))
    # the questions are as many as the whole run has, so a trigger meets them once, for its rows and rejects alike
    met = materialize(fresh.join(asked.drop("finish_reason"), "id"))
    # scorers hand on a row's window as it is, so its batch rides along with it
    scored = scorer(met.where("output is not null").withColumn("context_window_id", F.struct("context_window_id", "batch_id")), model)
    rows = scoring.as_scored(scored.withColumns({
        "context_window_id": F.col("context_window_id.context_window_id"), "batch_id": F.col("context_window_id.batch_id")}), "batch_id")

    # what follows from the rows reads them as they are written instead of scoring again
    def batches() -> DataFrame:
        score = exact(F.col("score")).cast("decimal(28,12)")
        return ledger.written("rows", "batch_id long, score double", trigger).groupBy("batch_id").agg(
            F.count(F.lit(1)).alias("n"), F.sum(score).cast("decimal(28,12)").alias("batch_score"))

    def totals() -> dict:
        n, total = ledger.written("batches", BATCHES, trigger).agg(
            F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("batch_score"), F.lit(0)).cast("decimal(28,12)")).first()
        before = (last["n_rows"], last["sum_score"], last["n_rejects"]) if last else (0, Decimal(0), 0)
        return {"n_rows": before[0] + n, "sum_score": before[1] + total,
                "n_rejects": before[2] + ledger.written("rejects", REJECTS, trigger).count()}

    ledger.commit(trigger, {"rows": rows, "batches": batches, "rejects": met.where("output is null").select("id", "finish_reason"),
                            "ids": lambda: ledger.written("rows", "id string", trigger)}, totals, step)


def run_stream(outputs: DataFrame, dataset: DataFrame, folder: str, checkpoint: str, model: str = "model",
               scorer=scoring.score_boxed, step: Callable[[str], None] | None = None) -> StreamingQuery:
    """Score a stream of outputs of the questions ``dataset`` into ``folder``, from which ``run_rows`` and others read.

    ``dataset`` has the gold columns and batch_id. A trigger that broke off is repeated from the checkpoint and shows up
    once; nothing of it can be read before its commit.
    """
    asked = materialize(dataset)
    with small_tasks(outputs.sparkSession):
        return (outputs.writeStream
                .foreachBatch(lambda rows, trigger: commit_outputs(rows.sparkSession, folder, rows, asked, trigger, model, scorer, step))
                .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def run_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Committed scored rows with their batch."""
    return Ledger(spark, folder, TOTALS).part("rows", ROWS).drop("trigger")


def run_batches(spark: SparkSession, folder: str) -> DataFrame:
    """batch_id, n, batch_score over all committed triggers; a batch whose rows came in several has them summed."""
    parts = Ledger(spark, folder, TOTALS).part("batches", BATCHES)
    return parts.groupBy("batch_id").agg(F.sum("n").alias("n"), F.sum("batch_score").cast("decimal(28,12)").alias("batch_score"))


def run_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """Ids whose outputs were empty and that have no row since, with the smallest reason."""
    ledger = Ledger(spark, folder, TOTALS)
    open_ = ev.pending(ledger.part("rejects", REJECTS), ledger.part("ids", "id string"))
    return open_.groupBy("id").agg(F.min("finish_reason").alias("finish_reason"))


def run_summary(spark: SparkSession, folder: str, dataset: DataFrame, model: str = "model") -> DataFrame:
    """The summary line over the whole data set, from the newest ledger entry: rows without a result count as errors."""
    last = Ledger(spark, folder, TOTALS).last()
    correct = F.lit(last["sum_score"] if last else Decimal(0)).cast("decimal(28,12)").cast("double")
    n = dataset.agg(F.count(F.lit(1)).alias("n"))
    mean = correct / F.nullif(F.col("n"), F.lit(0)).cast("double")
    return n.select(F.concat(
        F.lit(f"Overall score for {model} on "), F.col("n").cast("string"), F.lit(" examples: "), correct.cast("string"), F.lit("/"),
        F.col("n").cast("string"), F.lit(" = "), mean.cast("string")).alias("summary"))
