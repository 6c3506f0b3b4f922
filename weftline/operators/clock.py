"""Piecewise clocks between two timelines."""

from __future__ import annotations

from dataclasses import dataclass
from statistics import median

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAP_MS, ORDINARY_GAP_MS, EXTRAPOLATE_MS, RESIDUAL_MS = 180_000, 90_000, 30_000, 2_000


def compatible(gap: Column, jump: Column) -> Column:
    """Whether neighbours this far apart, whose shifts differ by ``jump``, can share one clock."""
    limit = F.when(gap > ORDINARY_GAP_MS, F.lit(1500.0)).otherwise(2000 + F.least(F.lit(2000.0), 0.05 * gap))
    return gap.between(0, GAP_MS) & (F.abs(jump) <= limit)


def fits(gap: float, jump: float) -> bool:
    return 0 <= gap <= GAP_MS and abs(jump) <= (1500 if gap > ORDINARY_GAP_MS else 2000 + min(2000, 0.05 * gap))


def theil_sen(df: DataFrame, keys: list[str], order: list[str], x: str, y: str, points: int = 32, apart: float = 15_000) -> DataFrame:
    """Median slope over pairs of the first ``points`` rows (the operator's sample) at least ``apart``: rate, pairs."""
    p = df.withColumn("wl_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("wl_k") <= points).select(*keys, F.col(x).alias("x"), F.col(y).alias("y"))
    q = p.select(*keys, F.col("x").alias("x2"), F.col("y").alias("y2"))
    pairs = p.join(q, keys).where(F.col("x2") - F.col("x") >= apart)
    return pairs.groupBy(*keys).agg(F.round(F.percentile((F.col("y2") - F.col("y")) / (F.col("x2") - F.col("x")), 0.5), 9).alias("rate"), F.count("*").alias("pairs"))


@dataclass
class Region:
    """target = rate * source + offset for source in [start, end)."""

    rate: float
    offset: float
    start: float
    end: float
    points: list[tuple[float, float]]

    def at(self, t: float) -> float:
        return self.rate * t + self.offset


def robust_line(points: list[tuple[float, float]]) -> tuple[float, float]:
    """Rate and offset: Theil-Sen over evenly taken points, a rate only if it lies in 0.9..1.1 and drifts 1.5 s or more."""
    take = points if len(points) <= 32 else [points[round(k * (len(points) - 1) / 31)] for k in range(32)]
    slopes = [(b[1] - a[1]) / (b[0] - a[0]) for i, a in enumerate(take) for b in take[i + 1 :] if b[0] - a[0] >= 15_000]
    rate = median(slopes) if slopes else 1.0
    if not 0.9 <= rate <= 1.1 or abs(rate - 1) * (points[-1][0] - points[0][0]) < 1500:
        rate = 1.0
    return rate, median(y - rate * x for x, y in points)


def fit_clock(anchors: list[tuple[int, float, float]], least: int = 4) -> list[Region]:
    """Regions from anchors (cue, source, target); empty if fewer than ``least`` cues take part.

    One median anchor per cue; targets that several cues claim are dropped unless
    they share one source, which then counts once; neighbours that fit share a
    region, a single outlier is stepped over; a region is a robust line, points
    over 2 s off it left out; neighbouring regions whose edges agree within 500 ms
    are one; domains reach 30 s beyond their points and meet half way.
    """
    claims: dict[float, set[int]] = {}
    for cue, _, target in anchors:
        claims.setdefault(target, set()).add(cue)
    by_cue: dict[int, list[tuple[float, float]]] = {}
    for cue, source, target in anchors:
        who = claims[target]
        if len(who) > 1 and (len({s for c, s, t in anchors if t == target}) > 1 or cue != min(who)):
            continue
        by_cue.setdefault(cue, []).append((source, target))
    points = sorted((median(s for s, _ in p), median(t - s for s, t in p)) for p in by_cue.values())
    points = [(s, s + d) for s, d in points]
    if len(points) < least:
        return []
    groups: list[list[tuple[float, float]]] = []
    for p in points:
        for back in (1, 2):  # the last point, or the one before it if the last is alone
            if groups and len(groups[-1]) >= back:
                q = groups[-1][-back]
                if fits(p[0] - q[0], (p[1] - p[0]) - (q[1] - q[0])) and (back == 1 or len(groups[-1]) > 2):
                    if back == 2:
                        groups[-1].pop()
                    groups[-1].append(p)
                    break
        else:
            groups.append([p])
    regions = []
    for g in groups:
        if len(g) < 2:
            continue
        rate, offset = robust_line(g)
        for _ in range(2):
            near = [p for p in g if abs(p[1] - rate * p[0] - offset) <= RESIDUAL_MS]
            if len(near) >= 2:
                rate, offset = robust_line(near)
        regions.append(Region(rate, offset, near[0][0] - EXTRAPOLATE_MS, near[-1][0] + EXTRAPOLATE_MS, near))
    if sum(len(r.points) for r in regions) < least:
        return []
    merged: list[Region] = []
    for r in regions:
        if merged:
            a = merged[-1]
            last, first = a.points[-1][0], r.points[0][0]
            if first - last <= GAP_MS and abs(a.at(last) - r.at(last)) <= 500 and abs(a.at(first) - r.at(first)) <= 500:
                both = a.points + r.points
                rate, offset = robust_line(both)
                if sum(abs(y - rate * x - offset) <= RESIDUAL_MS for x, y in both) >= 0.9 * len(both):
                    merged[-1] = Region(rate, offset, a.start, r.end, both)
                    continue
        merged.append(r)
    k = 1
    while k < len(merged):  # targets must go forward; the smaller of two that do not is dropped
        if merged[k].at(merged[k].points[0][0]) <= merged[k - 1].at(merged[k - 1].points[-1][0]):
            del merged[k if len(merged[k].points) <= len(merged[k - 1].points) else k - 1]
            k = max(1, k - 1)
        else:
            k += 1
    for a, b in zip(merged, merged[1:]):
        if a.end > b.start:
            a.end = b.start = (a.points[-1][0] + b.points[0][0]) / 2
    for r in merged:
        r.start = max(0.0, r.start, -r.offset / r.rate)
    return merged


def map_cue(regions: list[Region], start: float, end: float) -> tuple[int, int] | None:
    """Both ends of a cue on the target's clock, if both lie in one region."""
    for r in regions:
        if r.start <= start <= r.end and r.start <= end <= r.end:
            return round(r.at(start)), round(r.at(end))
    return None
