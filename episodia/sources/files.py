"""Many small files, each written whole by the task that holds it.

Where a folder is of the machine itself or mounted by all (``file:``), Hadoop without its native library starts a process
for the mode of each folder, file and checksum file it makes, which takes nearly all the time of a write of many files.
There tasks open the files themselves. On any other store Spark's writers do.
"""

from __future__ import annotations

import uuid
from contextlib import AbstractContextManager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import held

# of whole transcripts: a task holds one such batch at a time
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "32m"}
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"
ESCAPED = "".join(map(chr, range(1, 32))) + "\"#%'*/:=?\\\x7f{[]^"  # in names of folders, as Spark does


def few_listing_tasks(spark: SparkSession) -> AbstractContextManager[None]:
    """Folders listed inside are dealt out to some tasks for each core; by default each folder, up to 10,000, is a task."""
    return held(spark, {"spark.sql.sources.parallelPartitionDiscovery.parallelism": str(8 * spark.sparkContext.defaultParallelism)})


def mounted(spark: SparkSession, path: str) -> str | None:
    """``path`` as tasks may open it without Hadoop; None where it is on another store."""
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    uri = name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(name).toUri()
    return uri.getPath() if uri.getScheme() == "file" and not uri.getAuthority() else None


def write_files(rows: DataFrame, path: str, name: str, text: str, folders: tuple[str, ...] = ()) -> None:
    """A file called ``name`` for each row, with its ``text`` and a line break, under a folder for each of ``folders``.

    ``path`` is ``mounted``, and no two rows have one name in one folder. What is there is replaced when all files are
    written; a repeated task writes its own again.
    """
    spark, target = rows.sparkSession, path.rstrip("/")
    staging = f"{target}-{uuid.uuid4()}"
    escapes, no_value = {ord(c): f"%{ord(c):02X}" for c in ESCAPED}, NO_VALUE

    def write(batches):
        import os
        import uuid

        import pyarrow as pa

        mark = uuid.uuid4().hex  # of this try of the task
        for batch in batches:
            *parts, names, texts = (column.to_pylist() for column in batch.columns)
            for *values, file, body in zip(*parts, names, texts):
                into = os.path.join(staging, *[f"{c}={str(v).translate(escapes) if v not in (None, '') else no_value}"
                                               for c, v in zip(folders, values)])
                os.makedirs(into, exist_ok=True)
                own = os.path.join(into, f".{file}-{mark}")
                with open(own, "wb") as out:
                    out.write((body or b"") + b"\n")
                os.replace(own, os.path.join(into, file))
            yield pa.record_batch([pa.array([len(names)], pa.int64())], ["n"])

    with held(spark, BATCHES):
        rows.select(*folders, F.col(name).alias("_name"), F.col(text).cast("binary").alias("_text")).mapInArrow(
            write, "n long").agg(F.sum("n")).collect()
    name_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    system = name_of(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.create(name_of(f"{staging}/_SUCCESS")).close()
    system.delete(name_of(target), True)
    if not system.rename(name_of(staging), name_of(target)):
        raise OSError(f"the files were not moved to {target}")
