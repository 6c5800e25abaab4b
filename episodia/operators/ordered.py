"""Order-dependent operators that never put one group's rows into one task.

File order is a column (``seq``). Heads and tails use ranked windows whose limit Spark applies
before the shuffle; positions and running totals go through nested buckets, so that a group of any
size is spread over as many tasks as it has buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .tallies import listing


def head_rows(log: DataFrame, by: Sequence[str], k: int, last: bool = False) -> DataFrame:
    """The first (or last) ``k`` rows of each group, numbered ``pos`` = 1..k from that end.

    The ``pos <= k`` filter over a ranking window becomes a per-task limit ahead of the shuffle:
    at most ``k`` rows per group and task travel.
    """
    order = F.desc("seq") if last else F.asc("seq")
    window = Window.partitionBy(*by).orderBy(order)
    return log.withColumn("pos", F.row_number().over(window)).where(F.col("pos") <= k)


def head_lists(heads: DataFrame, by: Sequence[str], value: str, ks: Sequence[int]) -> DataFrame:
    """Text of the first 1, 2, … rows in file order. Null values leave no text but keep their place."""
    grown = heads.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where("pos <= k")
    return grown.groupBy(*by, "k").agg(
        F.coalesce(listing(value, "seq"), F.lit("")).alias("answer"))


def running_totals(rows: DataFrame, values: dict[str, Column], within: Sequence[str],
                   levels: Sequence[tuple[str, Column]], order: Sequence[Column]) -> DataFrame:
    """Running sums over a total order, without one task per group; ``values`` maps names to summands.

    ``levels`` are buckets from coarse to fine; each must keep the order (a row of a lower bucket
    comes before every row of a higher one) and the finest must hold few rows. Bucket sums are
    rolled up level by level, turned into offsets from the top down, and joined back; the row-level
    window then runs inside one finest bucket and shares the join's partitioning. ``rows`` is read
    twice, so an expensive input should be a written table.
    """
    names = [name for name, _ in levels]
    marked = rows.withColumns({**dict(levels), **{f"_v_{out}": value for out, value in values.items()}})
    kinds = {out: marked.schema[f"_v_{out}"].dataType for out in values}

    def upto(window: Window, prefix: str) -> dict[str, Column]:
        # sums keep the summand's type: decimals must not lose places on the way
        return {out: F.sum(f"{prefix}{out}").over(window.rowsBetween(Window.unboundedPreceding, 0))
                .cast(kinds[out]) for out in values}

    def summed(source: DataFrame, depth: int, prefix: str) -> DataFrame:
        return source.groupBy(*within, *names[:depth]).agg(
            *[F.sum(f"{prefix}{out}").cast(kinds[out]).alias(f"_s_{out}") for out in values])

    by_depth = {len(names): summed(marked, len(names), "_v_")}
    for depth in range(len(names) - 1, 0, -1):
        by_depth[depth] = summed(by_depth[depth + 1], depth, "_s_")

    offsets = None
    for depth in range(1, len(names) + 1):
        outer = [*within, *names[: depth - 1]]
        running = upto(Window.partitionBy(*outer).orderBy(names[depth - 1]), "_s_")
        step = by_depth[depth] if offsets is None else by_depth[depth].join(offsets, outer)
        above = {out: F.lit(0) if offsets is None else F.col(f"_o_{out}") for out in values}
        offsets = step.select(*within, *names[:depth], *[
            (running[out] - F.col(f"_s_{out}") + above[out]).cast(kinds[out]).alias(f"_o_{out}")
            for out in values])

    inner = upto(Window.partitionBy(*within, *names).orderBy(*order), "_v_")
    return marked.join(offsets, [*within, *names]).select(
        *rows.columns,
        *[(F.col(f"_o_{out}") + inner[out]).cast(kinds[out]).alias(out) for out in values])


def seq_levels(order: str, fine: int = 1 << 12, coarse: int = 1 << 24) -> list[tuple[str, Column]]:
    """Buckets for a non-negative integer order column."""
    col = F.col(order).cast("bigint")
    return [("_b1", F.floor(col / F.lit(coarse)).cast("bigint")),
            ("_b2", F.floor(col / F.lit(fine)).cast("bigint"))]


def sorted_positions(rows: DataFrame, order: Sequence[str], out: str) -> DataFrame:
    """1-based place of each row in the order of unique ``order`` columns, over the whole table.

    The rows are written sorted, which spreads even one huge leading value over many files. A place
    is then the row's index in its file plus the rows of all files before it; nothing is gathered. A
    sorted part may be cut into several files, whose counter follows the part's number in the name.
    """
    table = materialize(rows.orderBy(*order))
    placed = table.select("*", F.col("_metadata.file_name").alias("_name"), F.col("_metadata.row_index").alias("_row"))
    sizes = placed.groupBy("_name").agg((F.max("_row") + 1).alias("_n"))
    in_order = Window.orderBy(
        F.regexp_extract("_name", "part-([0-9]+)", 1).cast("bigint"),
        F.regexp_extract("_name", "-c([0-9]+)[.]", 1).cast("bigint")).rowsBetween(Window.unboundedPreceding, 0)
    # one row a file: written, so that the join knows how small they are and leaves the rows where they stand
    offsets = materialize(sizes.select("_name", (F.sum("_n").over(in_order) - F.col("_n")).alias("_before")))
    return placed.join(offsets, "_name").select(
        *rows.columns, (F.col("_before") + F.col("_row") + 1).cast("bigint").alias(out))


def positions(rows: DataFrame, out: str, within: Sequence[str],
              levels: Sequence[tuple[str, Column]], order: Sequence[Column]) -> DataFrame:
    """1-based place of each row in a total order."""
    return running_totals(rows, {out: F.lit(1).cast("bigint")}, within, levels, order)


def list_parts(log: DataFrame, by: Sequence[str], value: str, part_rows: int = 100_000) -> DataFrame:
    """All non-null values in file order, as text parts of at most ``part_rows`` values.

    ``part`` counts from 1; the parts of a group, joined in order with ``", "``, are its full list.
    """
    kept = log.select(*by, "seq", value).where(F.col(value).isNotNull())
    placed = positions(kept, "pos", by, seq_levels("seq"), [F.col("seq")])
    part = (F.floor((F.col("pos") - 1) / F.lit(part_rows)) + 1).cast("bigint")
    return placed.withColumn("part", part).groupBy(*by, "part").agg(
        listing(value, "seq").alias("answer"))
