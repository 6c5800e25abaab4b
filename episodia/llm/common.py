"""Readers, word splitting and small tables shared by the operators of this folder."""

from __future__ import annotations

import json
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, shared_folder

__all__ = ["SPACE", "WORD", "let", "literal_table", "materialize", "read_table", "remainder",
           "shared_folder", "ship", "text_bytes", "worker_cache"]

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(modulus: int, doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo ``modulus``; -1 for a null id, which so belongs to no fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus, F.lit(-1))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, also where the lambdas of ``body`` read it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def literal_table(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small table of parameters, made by the JVM from one JSON text."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), f"array<struct<{schema}>>")))


def text_bytes(text: str | None) -> bytes:
    """UTF-8 bytes; null is empty and a lone surrogate does not fail."""
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


_HELD: dict = {}


def worker_cache(owner: object, make: Callable[[], object]):
    """What a Python worker remembers between batches and tasks; another owner's memory goes first."""
    if owner not in _HELD:
        _HELD.clear()
        _HELD[owner] = make()
    return _HELD[owner]


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python, once per application, as ``--py-files`` would.

    Batches of the default 10,000 rows are made for short rows; where nothing else is set, whole documents go to
    Python 1000 at a time.
    """
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "1000")
    context = spark.sparkContext
    if getattr(context, "_episodia_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="episodia-"), f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    context._episodia_shipped = True
