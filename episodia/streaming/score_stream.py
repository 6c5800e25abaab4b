"""Scoring as a stream: outputs arrive in a folder, each id is scored once and appended."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.scoring import score_boxed
from ..sources.results import OUTPUT_ROW, as_scored


def output_stream(spark: SparkSession, path: str, fmt: str = "json", schema=OUTPUT_ROW,
                  max_files: int = 1000, glob: str | None = None) -> DataFrame:
    """Model outputs as they arrive; one trigger takes at most ``max_files`` files."""
    reader = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", max_files)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path)


def score_stream(outputs: DataFrame, gold: DataFrame, target: str, checkpoint: str,
                 scorer=score_boxed, model: str = "model", fmt: str = "json", late: str | None = None,
                 time_column: str | None = None) -> StreamingQuery:
    """Score ``outputs`` against the static ``gold`` table and append files to ``target``.

    An id counts once; a restart on the same checkpoint goes on after the finished files. The
    duplicate check keeps all ids in the state store unless outputs carry a time, in which case
    ``late`` bounds how long an id is remembered.
    """
    fresh = outputs.where("output is not null")
    if time_column and late:
        fresh = fresh.withWatermark(time_column, late).dropDuplicatesWithinWatermark(["id"])
    else:
        fresh = fresh.dropDuplicates(["id"])
    scored = as_scored(scorer(fresh.join(gold, "id"), model))
    return (
        scored.writeStream.format(fmt).outputMode("append")
        .option("path", target).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
