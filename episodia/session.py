"""Session settings, and the one place where intermediate tables are written."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager
from weakref import WeakSet

from pyspark.sql import DataFrame, SparkSession

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # plans are built from many small expressions; recording a call site for each one is slow
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    STATE_STORE:
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "episodia", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the plans expect; ``conf`` entries win over the defaults."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def held(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """Session with ``settings`` inside; its own come back after. A stream takes them over when it starts."""
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def keyed_state(spark: SparkSession) -> AbstractContextManager[None]:
    """Streams started inside keep their state in RocksDB, whoever built the session.

    Spark's default store has no room for state with timers.
    """
    return held(spark, {STATE_STORE: DEFAULTS[STATE_STORE]})


def small_tasks(spark: SparkSession) -> AbstractContextManager[None]:
    """Jobs inside, and streams started there, cut their work into some tasks for each core.

    By default a scan or a shuffle of a few GB makes one task for each core and one more or two, for which all wait.
    """
    return held(spark, {"spark.sql.files.minPartitionNum": str(4 * spark.sparkContext.defaultParallelism),
                        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m"})


_OWN_FOLDERS: dict[str, str] = {}  # by application
_WRITTEN: dict[str, list[str]] = {}
_TABLES: WeakSet[DataFrame] = WeakSet()  # what ``materialize`` gave out and is still held


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only with a local master (tests, notebooks), where driver and tasks share one machine, an unset name gives a
    folder of our own, which goes when the program ends. A cluster without the setting is an error: a folder of
    one machine would be lost on the others.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isDefined():
        return context.getCheckpointDir().get()
    master = spark.sparkContext.master
    if not re.fullmatch(r"local(\[.*\])?", master):
        raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    application = spark.sparkContext.applicationId
    if application not in _OWN_FOLDERS:
        _OWN_FOLDERS[application] = tempfile.mkdtemp(prefix="episodia-")
        atexit.register(shutil.rmtree, _OWN_FOLDERS[application], ignore_errors=True)
    return _OWN_FOLDERS[application]


def drop_tables(spark: SparkSession) -> int:
    """Delete the tables ``materialize`` wrote in this application; DataFrames over them end. Returns how many."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    dropped = 0
    _TABLES.clear()
    for name in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        dropped += bool(path.getFileSystem(hadoop).delete(path, True))
    return dropped


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once as a table in the shared folder and go on from there.

    For small tables that several branches read (windows, per-window facts): the log behind them is
    scanned once, a lost executor costs a re-read and no recomputation, and later joins know the
    true size. Such a table itself is given back as it is.
    """
    if df in _TABLES:
        return df
    path = f"{shared_folder(df.sparkSession)}/episodia-{uuid.uuid4()}"
    _WRITTEN.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _TABLES.add(table)
    return table
