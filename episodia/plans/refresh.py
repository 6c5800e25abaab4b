"""Answers kept up to date: new log files are counted once, and only windows that hold a changed episode are answered again.

A refresh commits four parts under one ledger entry: the files it counted, their cells, the windows it answered and the
answers. Cells of all refreshes merge by sums, minima and maxima, so counting a file never opens an older one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tallies as t
from ..operators.windows import spread
from ..session import materialize
from ..streaming.ledger import Ledger

TOTALS = "next_seq long, n_files long, n_rows long"
FILES = "path string, length long"
MEASURES = ("n", "first_seq", "last_seq")

Read = Callable[[list[str]], DataFrame]
Answer = Callable[[DataFrame, Sequence[str]], DataFrame]


def listed(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(path, length) of the files there are; they are not read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    return files.select(F.col("_metadata.file_path").alias("path"), "length")


class KeptAnswers:
    """Answers about windows of a growing log, under ``folder``.

    ``keys`` are the log's columns that the questions read, ``answer`` makes answers of window cells by group, and
    ``schema`` is that of the answers.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: Sequence[str], answer: Answer, schema: str,
                 by: Sequence[str] = ("window_key", "campaign")):
        self.ledger = Ledger(spark, folder, TOTALS)
        self.keys, self.answer, self.schema, self.by = [*t.EPISODE, *keys], answer, schema, list(by)

    def cells(self) -> DataFrame:
        """The cells of all counted files."""
        parts = self.ledger.part("cells", self._cell_schema())
        return t.compact(parts, self.keys)

    def _cell_schema(self) -> str:
        kinds = {"episode": "int", **{m: "long" for m in MEASURES}}
        return ", ".join(f"{c} {kinds.get(c, 'string')}" for c in (*self.keys, *MEASURES))

    def new_files(self, files: DataFrame) -> list[str]:
        """Paths not counted yet. A file that has grown since would be counted twice in part, so that is an error."""
        known = self.ledger.part("files", FILES).select("path", F.col("length").alias("counted"))
        met = files.join(known, "path", "left").where("counted is null or counted <> length").collect()
        grown = [r["path"] for r in met if r["counted"] is not None]
        if grown:
            raise ValueError(f"files that were counted have changed: {grown[:3]}")
        return sorted(r["path"] for r in met)

    def refresh(self, files: DataFrame, read: Read, members: DataFrame, step: Callable[[str], None] | None = None) -> int:
        """Count what is new among ``files`` and answer the windows it touches; returns how many files were new.

        ``read`` makes a log of paths, with ``seq`` in their order; rows of later refreshes come after earlier ones.
        New windows in ``members`` are answered too. Only paths come to the driver.
        """
        spark, last = self.ledger.spark, self.ledger.last()
        number, start = (last["number"] + 1, last["next_seq"]) if last else (0, 0)
        members = materialize(members)
        answered = self.ledger.part("windows", ", ".join(f"{c} string" for c in self.by)).select(*self.by).distinct()
        unknown = members.join(answered, self.by, "left_anti").select(*self.by).distinct()
        paths = self.new_files(files)
        if not paths and unknown.isEmpty():
            return 0
        counted = files.where(F.col("path").isin(paths)) if paths else files.where("false")
        if paths:
            log = read(paths)
            placed = log.withColumn("seq", F.col("seq") + F.lit(start).cast("long"))
            fresh = materialize(t.compact(t.as_cells(placed), self.keys).select(*self.keys, *MEASURES))
        else:
            fresh = spark.createDataFrame([], self._cell_schema())
        touched = members.join(fresh.select(*t.EPISODE).distinct(), list(t.EPISODE), "left_semi").select(*self.by)
        again = materialize(touched.union(unknown).distinct())
        asked = members.join(again, self.by, "left_semi")
        before = self.ledger.part("cells", self._cell_schema()).select(*self.keys, *MEASURES)
        # cells of episodes that no window to be answered holds are not merged
        needed = before.join(asked.select(*t.EPISODE).distinct(), list(t.EPISODE), "left_semi").union(fresh)
        answers = self.answer(spread(t.compact(needed, self.keys), asked), self.by)

        def totals() -> dict:
            n, top = fresh.agg(F.coalesce(F.sum("n"), F.lit(0)), F.max("last_seq")).first()
            old = (last["n_files"], last["n_rows"]) if last else (0, 0)
            return {"next_seq": start if top is None else top + 1, "n_files": old[0] + len(paths), "n_rows": old[1] + n}

        self.ledger.commit(number, {"files": counted, "cells": fresh, "windows": again, "answers": answers}, totals, step)
        return len(paths)

    def answers(self) -> DataFrame:
        """Every window's answers as of the last refresh that answered it."""
        newest = self.ledger.part("windows", ", ".join(f"{c} string" for c in self.by)).groupBy(*self.by).agg(
            F.max("trigger").alias("trigger"))
        return self.ledger.part("answers", self.schema).join(newest, [*self.by, "trigger"]).drop("trigger")
