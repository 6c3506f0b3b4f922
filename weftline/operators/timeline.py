"""Ordered operations on timelines: rows with key columns and integer times.

Everything is windows and equi-joins. Windows are per timeline; range joins are
cut into time buckets first, so a timeline of any length spreads over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, keys: list[str], order: list[str], new: Column, name: str = "island") -> DataFrame:
    """Number the runs of each timeline; ``new`` says that a row starts one (null counts as yes)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def gap(keys: list[str], order: list[str], start: str, end: str) -> Column:
    """Time from the end of the row before to this row's start; null on the first row."""
    return F.col(start) - F.lag(end).over(Window.partitionBy(*keys).orderBy(*order))


def sessions(df: DataFrame, keys: list[str], time: str, most: int, tie: str) -> DataFrame:
    """Runs of rows at most ``most`` apart: session, start, end, rows."""
    w = islands(df, keys, [time, tie], gap(keys, [time, tie], time, time) > most, "session")
    return w.groupBy(*keys, "session").agg(F.min(time).alias("start_ms"), F.max(time).alias("end_ms"), F.count("*").alias("n"))


def prefix_sum(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """Sum of the rows before."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))


def asof_last(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, value: str, name: str) -> DataFrame:
    """For each left row the ``value`` of the last right row at or before it: one union, one window, no range join."""
    cols = left.columns
    a = left.select(*cols, F.lit(None).cast(right.schema[value].dataType).alias(name), F.lit(1).alias("wl_side"), F.col(left_time).alias("wl_time"))
    b = right.select(*[(F.col(c) if c in keys else F.lit(None).cast(left.schema[c].dataType)).alias(c) for c in cols], F.col(value).alias(name), F.lit(0).alias("wl_side"), F.col(right_time).alias("wl_time"))
    w = Window.partitionBy(*keys).orderBy("wl_time", "wl_side", name).rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn(name, F.last(name, True).over(w)).where("wl_side = 1").drop("wl_side", "wl_time")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, name: str = "distance") -> DataFrame:
    """For each left row the distance to the nearest right row of its timeline; null if there is none."""
    cols = left.columns
    marks = right.select(*[(F.col(c) if c in keys else F.lit(None).cast(left.schema[c].dataType)).alias(c) for c in cols], F.col(right_time).alias("wl_time"), F.lit(True).alias("wl_mark"))
    rows = left.select(*cols, F.col(left_time).alias("wl_time"), F.lit(False).alias("wl_mark"))
    mark = F.when(F.col("wl_mark"), F.col("wl_time"))
    by = Window.partitionBy(*keys).orderBy("wl_time")
    before = F.last(mark, True).over(by.rangeBetween(Window.unboundedPreceding, 0))
    after = F.first(mark, True).over(by.rangeBetween(0, Window.unboundedFollowing))
    t = F.col("wl_time")
    return rows.unionByName(marks).withColumn(name, F.least(t - before, after - t)).where("not wl_mark").drop("wl_time", "wl_mark")


def range_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, window: int) -> DataFrame:
    """Pairs of one timeline at most ``window`` apart; the right side is put into its bucket and the two beside it."""
    a = left.withColumn("wl_bucket", F.floor(F.col(left_time) / window))
    b = right.withColumn("wl_bucket", F.explode(F.array(*(F.floor(F.col(right_time) / window) + k for k in (-1, 0, 1)))))
    return a.join(b, [*keys, "wl_bucket"]).where(F.abs(F.col(right_time) - F.col(left_time)) <= window).drop("wl_bucket")


def nearest_rank(df: DataFrame, keys: list[str], value: str, percent: int, name: str) -> DataFrame:
    """Per key the value at index round((n - 1) * percent / 100) of the sorted values."""
    w = Window.partitionBy(*keys)
    ranked = df.where(F.col(value).isNotNull()).withColumns({"wl_at": F.row_number().over(w.orderBy(value)), "wl_n": F.count("*").over(w)})
    return ranked.where(F.col("wl_at") == F.round((F.col("wl_n") - 1) * percent / 100) + 1).select(*keys, F.col(value).alias(name))


def upper_median(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Per key the value at index n div 2: of an even number of values the larger middle one."""
    w = Window.partitionBy(*keys)
    ranked = df.where(F.col(value).isNotNull()).withColumns({"wl_at": F.row_number().over(w.orderBy(value)), "wl_n": F.count("*").over(w)})
    return ranked.where(F.expr("wl_at = wl_n div 2 + 1")).select(*keys, F.col(value).alias(name))


def run_lengths(df: DataFrame, keys: list[str], order: list[str], label: str, hold: tuple = ()) -> DataFrame:
    """Collapse equal neighbours into (label, first, last, n) by ``order[0]``; labels in ``hold`` are dropped after."""
    w = Window.partitionBy(*keys).orderBy(*order)
    runs = islands(df, keys, order, ~F.col(label).eqNullSafe(F.lag(label).over(w)), "run")
    out = runs.groupBy(*keys, "run", label).agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("n"))
    return out.where(~F.col(label).isin(*hold)) if hold else out


def sliding_windows(files: DataFrame, keys: list[str], total: str, size: int, overlap: int) -> DataFrame:
    """Hopping windows over [0, total): each drops half the overlap at a side that has a neighbour.

    The window after a full one exists only if more than half an overlap of new time remains.
    """
    hop = size - overlap
    t = F.col(total)
    n = F.when(t <= 0, 0).otherwise(1 + F.greatest(F.lit(0), F.ceil((t - size - overlap // 2) / hop)))
    grid = files.where(t > 0).withColumn("wl_n", n.cast("int")).withColumn("window", F.explode(F.sequence(F.lit(0), F.col("wl_n") - 1)))
    start = F.col("window") * F.lit(hop).cast("long")
    last = F.col("window") == F.col("wl_n") - 1
    return grid.select(
        *keys, "window", start.alias("start_ms"), F.least(start + size, t).alias("end_ms"),
        F.when(F.col("window") == 0, F.lit(0).cast("long")).otherwise(start + overlap // 2).alias("core_start"), F.when(last, F.least(start + size, t)).otherwise(start + size - overlap // 2).alias("core_end"),
    )


def greedy_spaced(times: list[int], least: int) -> list[int]:
    """Of sorted times those more than ``least`` after the last one taken."""
    out: list[int] = []
    for t in times:
        if not out or t > out[-1] + least:
            out.append(t)
    return out
