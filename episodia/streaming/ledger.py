"""A run's results as parts that count from one commit per trigger.

A trigger of a stream writes each of its parts into a folder of its own and then one ledger entry. Only what the ledger
lists is read, so a trigger that broke off between two parts shows nothing, and its repeat overwrites what it left.
A trigger that is in the ledger already writes nothing again.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERY_ID = "sql.streaming.queryId"  # the stream's own name, which its checkpoint keeps over restarts


@dataclass
class Ledger:
    """The commits of one run folder. ``totals`` is the schema of what an entry carries on from the one before."""

    spark: SparkSession
    folder: str
    totals: str

    def _files(self, path: str) -> list[str]:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        system = hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return [s.getPath().getName() for s in system.listStatus(hadoop)] if system.exists(hadoop) else []

    def _row(self, values: Sequence, schema: T.StructType) -> DataFrame:
        """One row of literals: rows that Python hands over would start its workers for them."""
        return self.spark.range(1, numPartitions=1).select(
            *[F.lit(value).cast(f.dataType).alias(f.name) for value, f in zip(values, schema, strict=True)])

    def last(self) -> Row | None:
        """The newest entry: trigger, stream and totals so far. Every trigger up to it is committed."""
        triggers = sorted((int(name.split("=")[1]) for name in self._files(f"{self.folder}/ledger") if "=" in name), reverse=True)
        for trigger in triggers:
            path = f"{self.folder}/ledger/trigger={trigger}"
            if any(name.startswith("part-") for name in self._files(path)):
                return self.spark.read.schema(f"number long, stream string, {self.totals}").json(path).first()
        return None

    def part(self, name: str, schema: T.StructType | str, trigger: int | None = None) -> DataFrame:
        """Committed rows of a part, of all triggers or of one; ``trigger`` is a column, by which folders are left out."""
        if isinstance(schema, str):
            schema = T._parse_datatype_string(schema)
        schema = T.StructType([*schema.fields, T.StructField("trigger", T.LongType())])
        last, path = self.last(), f"{self.folder}/{name}"
        if last is None or not self._files(path):
            return self._row([None] * len(schema), schema).where(F.lit(False))
        rows = self.spark.read.schema(schema).parquet(path)
        return rows.where(F.col("trigger") <= last["number"] if trigger is None else F.col("trigger") == trigger)

    def written(self, name: str, schema: str, trigger: int) -> DataFrame:
        """A part of the trigger that is being committed, as it stands by now."""
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}/trigger={trigger}")

    def commit(self, trigger: int, parts: dict[str, DataFrame | Callable[[], DataFrame]], totals: Callable[[], dict],
               step: Callable[[str], None] | None = None) -> None:
        """Write ``parts``, then the entry with ``totals``, computed when the parts stand. ``step`` hears of each part.

        A part that is made from those before it is given as a function, called when they are written.
        """
        for name, rows in parts.items():
            rows = rows if isinstance(rows, DataFrame) else rows()
            rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/trigger={trigger}")
            if step:
                step(name)
        entry = self._row([trigger, self.stream(), *totals().values()],
                          T._parse_datatype_string(f"number long, stream string, {self.totals}"))
        entry.write.mode("overwrite").json(f"{self.folder}/ledger/trigger={trigger}")

    def stream(self) -> str:
        return self.spark.sparkContext.getLocalProperty(QUERY_ID) or "batch"

    def is_done(self, trigger: int, last: Row | None) -> bool:
        """Whether a trigger is committed. Triggers of another checkpoint would count from 0 again, so they are refused."""
        if last is not None and last["stream"] != self.stream():
            raise ValueError(f"{self.folder} belongs to the stream {last['stream']}; give each checkpoint a folder of its own")
        return last is not None and trigger <= last["number"]
