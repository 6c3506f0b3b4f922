"""Spans of time and the rows in or outside them."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slice_spans(spans: DataFrame, rows: DataFrame, keys: list[str], time: str, bucket: int) -> DataFrame:
    """Pairs of a span (span_start, span_end) and a row inside it; spans go to every time bucket they touch."""
    s = spans.withColumn("wl_bucket", F.explode(F.sequence(F.floor(F.col("span_start") / bucket), F.floor((F.col("span_end") - 1) / bucket))))
    r = rows.withColumn("wl_bucket", F.floor(F.col(time) / bucket))
    return r.join(s, [*keys, "wl_bucket"]).where((F.col(time) >= F.col("span_start")) & (F.col(time) < F.col("span_end"))).drop("wl_bucket")


def outside_spans(rows: DataFrame, spans: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Rows in no span: a row is inside if the furthest end among spans that have begun lies beyond it."""
    cols = rows.columns
    begun = spans.select(*[(F.col(c) if c in keys else F.lit(None).cast(rows.schema[c].dataType)).alias(c) for c in cols], F.col("span_start").alias("wl_time"), F.lit(0).alias("wl_side"), F.col("span_end").alias("wl_end"))
    here = rows.select(*cols, F.col(time).alias("wl_time"), F.lit(1).alias("wl_side"), F.lit(None).cast("long").alias("wl_end"))
    w = Window.partitionBy(*keys).orderBy("wl_time", "wl_side").rowsBetween(Window.unboundedPreceding, 0)
    both = begun.unionByName(here).withColumn("wl_far", F.max("wl_end").over(w))
    return both.where("wl_side = 1 and (wl_far is null or wl_far <= wl_time)").select(*cols)


def interpolate(df: DataFrame, keys: list[str], order: list[str], at: str, old: str, new: str, most: int) -> DataFrame:
    """Map ``at`` on the line between the anchors (old, new) around it, where both gaps are in (0, most] and their ratio in 0.5..2."""
    w = Window.partitionBy(*keys).orderBy(*order)
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    o0, n0, o1, n1 = F.last(old, True).over(back), F.last(new, True).over(back), F.first(old, True).over(ahead), F.first(new, True).over(ahead)
    x = df.withColumns({"wl_o0": o0, "wl_n0": n0, "wl_do": o1 - o0, "wl_dn": n1 - n0})
    ok = F.expr(f"wl_do > 0 and wl_dn > 0 and wl_do <= {most} and wl_dn <= {most} and wl_dn / wl_do between 0.5 and 2")
    mapped = F.round(F.col("wl_n0") + (F.col(at) - F.col("wl_o0")) * F.col("wl_dn") / F.col("wl_do")).cast("long")
    return x.withColumn("mapped", F.when(ok, mapped)).drop("wl_o0", "wl_n0", "wl_do", "wl_dn")


def first_values(df: DataFrame, keys: list[str], value: str, k: int, name: str) -> DataFrame:
    """The k smallest values of each key as a sorted array (a bounded report); only k rows a key are gathered."""
    top = df.withColumn("wl_k", F.row_number().over(Window.partitionBy(*keys).orderBy(value))).where(F.col("wl_k") <= k)
    return top.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias(name))


def spaced_starts(df: DataFrame, keys: list[str], time: str, least: int) -> DataFrame:
    """Distinct times more than ``least`` after the last one taken; each step depends on the one before, so rows of a timeline stream through in order."""
    from .timeline import greedy_spaced

    times = df.select(*keys, time).distinct()

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        kept = set(greedy_spaced(sorted(pdf[time].tolist()), least))
        return pdf[pdf[time].isin(kept)]

    return times.groupBy(*keys).applyInPandas(take, times.schema)


def covered(start: Column, end: Column, at: Column) -> Column:
    return (at >= start) & (at < end)
