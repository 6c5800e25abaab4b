"""Readers for the tab-separated logs and the player map.

Headers are imposed, never inferred: values and levels must stay text, or they would no longer
compare with texts such as "20" and "Cantrip".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as fixed


def _texts(*names: str) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in names])


# Fixed column order of the source files
ROLL_COLUMNS = ("episode", "time", "character", "roll_type", "total_value", "natural_value",
                "crit", "damage_dealt", "kills", "notes")
SPELL_COLUMNS = ("episode", "time", "character", "spell", "base_lvl", "cast_at", "notes")
PLAYER_COLUMNS = ("player", "character", "notes")


def null_if_missing(text: Column) -> Column:
    return F.when(~text.isin(*fixed.MISSING_TEXTS), text)


# A row's order number: where its split starts in all files laid end to end, in units, then its place in its task.
UNIT_BITS, ROW_BITS = 16, 29


def file_starts(spark: SparkSession, path: str, glob: str | None, order: Column | None = None) -> DataFrame:
    """(_path, _base): every file and the units of all files before it, in the order of ``order`` and path.

    Files are listed, not read.
    """
    listed = spark.read.format("binaryFile")
    if glob:
        listed = listed.option("pathGlobFilter", glob)
    files = listed.load(path).select(F.col("_metadata.file_path").alias("_path"),
                                     F.col("_metadata.file_name").alias("_name"), F.col("length"))
    files = files.withColumn("_key", F.lit(0) if order is None else order)
    units = F.floor(F.col("length") / F.lit(1 << UNIT_BITS)).cast("bigint") + 1
    before = Window.orderBy("_key", "_path").rowsBetween(Window.unboundedPreceding, -1)
    return files.select("_path", F.coalesce(F.sum(units).over(before), F.lit(0).cast("bigint")).alias("_base"))


def in_file_order(raw: DataFrame, path: str, glob: str | None = None, order: Column | None = None) -> DataFrame:
    """``raw`` as read from ``path``, with ``seq``: unique, and growing along each file and from file to file.

    Splits start at least a unit (64 KiB) apart, so no two share a lead; a task has fewer rows than 2^29, as it
    reads fewer bytes. No row is shuffled for its number: only the list of files joins.
    """
    spark = raw.sparkSession
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    if size(spark.conf.get("spark.sql.files.maxPartitionBytes")) < 1 << UNIT_BITS:
        raise ValueError("spark.sql.files.maxPartitionBytes must be 64k at least to keep the order of rows")
    columns = raw.columns
    placed = raw.select(
        "*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_name").alias("_name"),
        F.floor(F.col("_metadata.file_block_start") / F.lit(1 << UNIT_BITS)).cast("bigint").alias("_split"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("_row"))
    lead = F.shiftleft(F.col("_base") + F.col("_split"), ROW_BITS)
    return placed.join(file_starts(spark, path, glob, order), "_path").select(
        lead.bitwiseOR(F.col("_row")).alias("seq"), F.regexp_replace("_name", "%20", " ").alias("file_name"), *columns)


def _read_tsv(spark: SparkSession, path: str, columns: tuple[str, ...], glob: str | None = None,
              order: Column | None = None, header: bool = True) -> DataFrame:
    reader = spark.read.schema(_texts(*columns)).option("sep", "\t").option("header", header).option("enforceSchema", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    rows = in_file_order(reader.csv(path), path, glob, order)
    return rows.select("seq", "file_name", *[null_if_missing(F.col(c)).alias(c) for c in columns])


def read_log(spark: SparkSession, path: str, campaign: str, columns: tuple[str, ...]) -> DataFrame:
    """The merged log of one campaign, a file or a folder of files, with ``seq`` in file order."""
    rows = _read_tsv(spark, path, columns)
    return rows.select(F.lit(campaign).alias("campaign"), F.col("episode").try_cast("int").alias("episode"),
                       "seq", *columns[1:])


def read_rolls(spark: SparkSession, path: str, campaign: str) -> DataFrame:
    return read_log(spark, path, campaign, ROLL_COLUMNS)


def read_spells(spark: SparkSession, path: str, campaign: str) -> DataFrame:
    return read_log(spark, path, campaign, SPELL_COLUMNS)


MOST_EXTRA = 3  # leading columns beyond the log's that a file may have


def header_offsets(spark: SparkSession, path: str, fields: tuple[str, ...], glob: str | None = None) -> DataFrame:
    """(file_name, offset): how many columns each file has before the log's own, as its header line says.

    A header is a first line in which the names of the first two fields stand side by side, in any case and with blanks
    for underscores. A file without one has no row.
    """
    generic = tuple(f"_c{i}" for i in range(MOST_EXTRA + 2))

    def named(k: int, field: str) -> Column:
        return F.regexp_replace(F.lower(F.trim(F.col(generic[k]))), " +", "_") == field

    offset = F.coalesce(*[F.when(named(k, fields[0]) & named(k + 1, fields[1]), F.lit(k)) for k in range(MOST_EXTRA + 1)])
    lines = _read_tsv(spark, path, generic, glob, header=False).withColumn("offset", offset)
    return lines.groupBy("file_name").agg(F.min_by("offset", "seq").alias("offset")).where("offset is not null")


def read_episode_files(spark: SparkSession, path: str, campaign: str, columns: tuple[str, ...],
                       glob: str = "*.tsv", episode_pattern: str = "-([0-9]+)\\.tsv$",
                       extra_column: tuple[int, int] | None = None) -> DataFrame:
    """One log file per episode: merge them, with the episode taken from the file name.

    ``columns`` are those of the merged log, whose first is the episode. Leading columns that a file's header has
    beyond them are cut. ``extra_column`` is the range of episodes that have one more where no header tells. ``seq``
    grows from episode to episode and along each file. Files are read row by row and split over tasks, whatever their
    size; only the list of files and offsets joins.
    """
    fields = columns[1:]
    number = F.regexp_extract(F.regexp_replace("_name", "%20", " "), episode_pattern, 1).try_cast("int")
    generic = tuple(f"_c{i}" for i in range(len(fields) + MOST_EXTRA))
    rows = _read_tsv(spark, path, generic, glob, number).withColumn(
        "episode", F.regexp_extract("file_name", episode_pattern, 1).try_cast("int")).where("episode is not null")
    told = rows.join(header_offsets(spark, path, fields, glob), "file_name", "left")
    untold = F.when(F.col("episode").between(*extra_column), 1).otherwise(0) if extra_column else F.lit(0)
    offset = F.coalesce("offset", untold)
    return told.select(F.lit(campaign).alias("campaign"), "episode", "seq", *[
        F.get(F.array(*generic[i:i + MOST_EXTRA + 1]), offset).alias(c) for i, c in enumerate(fields)])


def read_players(spark: SparkSession, path: str, campaign: str | None = None) -> DataFrame:
    rows = _read_tsv(spark, path, PLAYER_COLUMNS).drop("file_name")
    if campaign is not None:
        rows = rows.withColumn("campaign", F.lit(campaign))
    return player_map(rows)


def player_map(rows: DataFrame) -> DataFrame:
    """One character per player: rows without player go, the last row of a player wins.

    ``first_seq`` is where a player appears first, which is the order of the map.
    """
    by = ["campaign", "player"] if "campaign" in rows.columns else ["player"]
    return rows.where(F.col("player").isNotNull()).groupBy(*by).agg(
        F.max_by("character", "seq").alias("character"), F.min("seq").alias("first_seq"))
