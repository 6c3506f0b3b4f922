"""Aligning one track of cue starts to another: offsets by histogram, splits by hits, a verdict, and votes among tracks.

Times are seconds as floats. A pair of tracks is a unit of work; pairs spread.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

# Hit tolerance, spacing of starts, bin, window, bucket (s); z of the floor; verdict bounds.
TOLERANCE, CLUSTER, BIN, RANGE, BUCKET = 0.35, 0.15, 0.01, 120.0, 120.0
Z, ACCEPT, REFUSE, ALONE = 4.0, 2.5, 1.5, 3.5
SEPARATION, SIDE, GAIN, JUMP_LEAST, JUMP_MOST, MARGIN = 0.5, 12, 0.02, 1.0, 60.0, 0.35
REFINE_SPAN, REFINE_STEP, SNAP_TO_ZERO, SAME_TEMPLATE, UNCHECKED = 0.6, 0.01, 0.35, 0.85, 120.0


def unique_starts(times: np.ndarray) -> np.ndarray:
    """Distinct starts to the millisecond, each more than 0.15 s after the one kept before."""
    out: list[float] = []
    for t in np.unique(np.floor(np.asarray(times, float) * 1000 + 0.5)) / 1000:
        if not out or t > out[-1] + CLUSTER:
            out.append(float(t))
    return np.array(out)


def distances(ref: np.ndarray, times: np.ndarray) -> np.ndarray:
    """From each time to the nearest of ``ref``."""
    if not len(ref):
        return np.full(len(times), np.inf)
    k = np.clip(np.searchsorted(ref, times), 1, max(1, len(ref) - 1))
    return np.minimum(np.abs(times - ref[k - 1]), np.abs(times - ref[np.minimum(k, len(ref) - 1)]))


def hits(ref: np.ndarray, sub: np.ndarray, offset: float) -> np.ndarray:
    return distances(ref, sub + offset) <= TOLERANCE


def chance_rate(ref: np.ndarray) -> float:
    """Share of hits that random times would have."""
    span = ref[-1] - ref[0] if len(ref) > 1 else 0.0
    return 1.0 if span <= 0 else min(1.0, 2 * TOLERANCE * len(ref) / span)


def noise_floor(p: float, n: int) -> float:
    return min(1.0, p + Z * np.sqrt(p * (1 - p) / max(1, n)))


def offset_peaks(ref: np.ndarray, sub: np.ndarray, most: int) -> list[float]:
    """Offsets at the tallest places of the smoothed histogram of differences, half a second apart, each the median of its differences."""
    diff = (ref[:, None] - sub[None, :]).ravel()
    diff = np.sort(diff[np.abs(diff) <= RANGE])
    if not len(diff):
        return []
    half = int(TOLERANCE / BIN)
    count = np.bincount(((diff + RANGE) / BIN).astype(int), minlength=int(2 * RANGE / BIN) + 2)
    c = np.concatenate([[0], np.cumsum(count)])
    k = np.arange(len(count))
    smooth = c[np.minimum(len(count), k + half + 1)] - c[np.maximum(0, k - half)]
    out: list[float] = []
    level = smooth.astype(float)
    while len(out) < most and level.max() > 0:
        at = int(level.argmax())
        end = at
        while end + 1 < len(smooth) and level[end + 1] == level[at]:
            end += 1
        centre = ((at + end) / 2 + 0.5) * BIN - RANGE
        near = diff[np.abs(diff - centre) <= TOLERANCE]
        out.append(float(np.median(near)) if len(near) else centre)
        level[max(0, int((at + end) / 2 - SEPARATION / BIN)) : int((at + end) / 2 + SEPARATION / BIN) + 1] = 0
    return out


def candidates(ref: np.ndarray, sub: np.ndarray) -> list[float]:
    """Six offsets of the whole and two of each 120 s bucket, half a second apart, first come first kept."""
    found = offset_peaks(ref, sub, 6)
    for b in np.unique(np.floor(sub / BUCKET)):
        found += offset_peaks(ref, sub[np.floor(sub / BUCKET) == b], 2)
    out: list[float] = []
    for x in found:
        if all(abs(x - y) > SEPARATION for y in out):
            out.append(x)
    return out


@dataclass
class Fit:
    """Segments (offset, start, end) in indices of the subtitle's starts; breaks in seconds before the last n - 1."""

    segments: list[tuple[float, int, int]] = field(default_factory=list)
    breaks: list[float] = field(default_factory=list)
    score: float = 0.0
    chance: float = 1.0
    floor: float = 1.0
    n: int = 0
    unchecked: float = 0.0

    @property
    def excess(self) -> float:
        return self.score / self.chance if self.chance else 0.0

    def offset_at(self, t: float) -> float:
        k = int(np.searchsorted(self.breaks, t, "right"))
        return self.segments[k][0] if self.segments else 0.0


def best_boundary(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """(hits, place): the first best place to go from one hit row to another, ``SIDE`` cues on either side at least; place -1 if there is no room."""
    n = len(a)
    if n < 2 * SIDE:
        return -1, -1
    left, right = np.concatenate([[0], np.cumsum(a)]), np.concatenate([[0], np.cumsum(b)])
    total = left[SIDE : n - SIDE + 1] + right[n] - right[SIDE : n - SIDE + 1]
    k = int(total.argmax())
    return int(total[k]), k + SIDE


def refine_offset(ref: np.ndarray, sub: np.ndarray, offset: float) -> float:
    """The middle of the best plateau within 0.6 s; under 0.35 s is no shift if that costs no hit."""
    grid = offset + np.arange(-int(REFINE_SPAN / REFINE_STEP), int(REFINE_SPAN / REFINE_STEP) + 1) * REFINE_STEP
    rate = np.array([hits(ref, sub, x).sum() for x in grid])
    at = np.flatnonzero(rate == rate.max())
    runs = np.split(at, np.flatnonzero(np.diff(at) > 1) + 1)
    run = max(runs, key=len)
    best = float(grid[run[0]] + grid[run[-1]]) / 2
    return 0.0 if abs(best) < SNAP_TO_ZERO and hits(ref, sub, 0.0).sum() >= rate.max() else best


def fit(sub: np.ndarray, ref: np.ndarray) -> Fit:
    """Piecewise constant offsets of ``sub`` onto ``ref``: the single best one, split while a split gains two per cent of hits and each side earns its own."""
    sub, ref = unique_starts(sub), unique_starts(ref)
    out = Fit(n=min(len(sub), len(ref)))
    offers = candidates(ref, sub) if len(sub) and len(ref) else []
    if not offers:
        return out
    out.chance = chance_rate(ref)
    table = np.stack([hits(ref, sub, x) for x in offers])
    parts = [(int(table.sum(axis=1).argmax()), 0, len(sub))]
    while True:
        now = sum(int(table[c, a:z].sum()) for c, a, z in parts)
        best = None
        for i, (c, a, z) in enumerate(parts):
            for d in range(len(offers)):
                for pair in ((c, d), (d, c)):
                    if pair[0] == pair[1]:
                        continue
                    got, at = best_boundary(table[pair[0], a:z], table[pair[1], a:z])
                    if at < 0:
                        continue
                    total = now - int(table[c, a:z].sum()) + got
                    if (total - now) / len(sub) >= GAIN and (best is None or total > best[0]) and earns(table, pair, a, a + at, z, offers, out.chance):
                        best = (total, i, pair, a + at)
        if best is None:
            break
        _, i, pair, at = best
        a, z = parts[i][1:]
        parts[i : i + 1] = [(pair[0], a, at), (pair[1], at, z)]
    out.segments = [(refine_offset(ref, sub[a:z], offers[c]), a, z) for c, a, z in parts]
    for (x, a, _), (y, b, z) in zip(out.segments, out.segments[1:]):
        out.breaks.append(break_time(sub, hits(ref, sub[a:z], x), hits(ref, sub[a:z], y), a, b))
    mapped = np.concatenate([hits(ref, sub[a:z], x) for x, a, z in out.segments])
    out.score, out.floor = float(mapped.mean()), noise_floor(out.chance, out.n)
    out.unchecked = longest_unmatched(sub, mapped)
    return out


def earns(table: np.ndarray, pair: tuple[int, int], a: int, at: int, z: int, offers: list[float], chance: float) -> bool:
    """Both sides beat chance 2.5 times, the jump is 1 to 60 s, and the smaller side clearly prefers its own offset."""
    x, y = pair
    jump = abs(offers[x] - offers[y])
    left, right = table[x, a:at].mean(), table[y, at:z].mean()
    if not JUMP_LEAST <= jump <= JUMP_MOST or min(left, right) < ACCEPT * chance:
        return False
    return (left - table[y, a:at].mean() if at - a <= z - at else right - table[x, at:z].mean()) >= MARGIN


def break_time(sub: np.ndarray, left: np.ndarray, right: np.ndarray, a: int, at: int) -> float:
    """Half way over the stretch of boundaries that are as good as the one chosen."""
    l, r = np.concatenate([[0], np.cumsum(left)]), np.concatenate([[0], np.cumsum(right)])
    total = l + r[-1] - r
    lo = hi = at - a
    while lo - 1 > 0 and total[lo - 1] == total[at - a]:
        lo -= 1
    while hi + 1 < len(total) - 1 and total[hi + 1] == total[at - a]:
        hi += 1
    return float(sub[a + max(lo, 1) - 1] + sub[a + min(hi, len(left) - 1)]) / 2


def longest_unmatched(times: np.ndarray, matched: np.ndarray) -> float:
    worst, start = 0.0, None
    for t, m in zip(times, matched, strict=True):
        start = None if m else t if start is None else start
        if start is not None:
            worst = max(worst, float(t - start))
    return worst


def removed_spans(f: Fit) -> list[tuple[float, float]]:
    """Stretches of subtitle time that the reference does not have: where an offset falls."""
    return [(b, b + x - y) for b, (x, *_), (y, *_) in zip(f.breaks, f.segments, f.segments[1:], strict=False) if y < x]


def judge(f: Fit) -> str:
    if f.n < 5:
        return "tooFew"
    if f.floor >= 1:
        return "notMeasurable"
    if f.score <= f.floor:
        return "doesNotHold"
    if f.excess < REFUSE:
        return "weak"
    if f.unchecked >= UNCHECKED:
        return "partialCoverage"
    return "uncertain" if f.excess < ACCEPT else "accepted"


def group_tracks(tracks: list[np.ndarray]) -> list[list[int]]:
    """Tracks of one timing: densest first, each into the first group whose first member it hits, and is hit by, at 85 %."""
    groups: list[list[int]] = []
    for k in sorted(range(len(tracks)), key=lambda k: -len(tracks[k])):
        for g in groups:
            a, b = tracks[g[0]], tracks[k]
            if len(a) and len(b) and hits(a, b, 0.0).mean() >= SAME_TEMPLATE and hits(b, a, 0.0).mean() >= SAME_TEMPLATE:
                g.append(k)
                break
        else:
            groups.append([k])
    return groups


def agree(a: Fit, b: Fit, times: np.ndarray) -> bool:
    near = [abs(a.offset_at(t) - b.offset_at(t)) <= SEPARATION for t in times]
    return bool(len(near)) and sum(near) >= 0.9 * len(near)


def decide(sub: np.ndarray, refs: list[np.ndarray]) -> tuple[str, Fit | None]:
    """("auto", fit) if accepted fits of independent tracks do not conflict and two agree or one is strong; else ("ask" or "none", best)."""
    usable = [unique_starts(r) for r in refs if len(r) >= 5 and len(r) >= 0.2 * len(sub)]
    fits = [fit(sub, usable[g[0]]) for g in group_tracks(usable)]
    good = sorted((f for f in fits if judge(f) == "accepted"), key=lambda f: (-f.score, -f.excess))
    if not good:
        return "none", max(fits, key=lambda f: (f.score, f.excess), default=None)
    best, times = good[0], unique_starts(sub)
    same = [f for f in good if f is best or agree(best, f, times)]
    if len(same) < len(good):
        return "ask", best
    return ("auto" if len(same) >= 2 or best.excess >= ALONE else "ask"), best


def align_tracks(pairs: DataFrame) -> DataFrame:
    """pairs(pair_id, side, start_s) with side "sub" or "ref" into (pair_id, verdict, score, excess, offsets, breaks)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        side = lambda s: np.sort(pdf.loc[pdf["side"] == s, "start_s"].to_numpy(float))
        f = fit(side("sub"), side("ref"))
        return pd.DataFrame([(pdf["pair_id"].iloc[0], judge(f), round(f.score, 9), round(f.excess, 9), [round(x, 3) for x, *_ in f.segments], [round(x, 3) for x in f.breaks])], columns=["pair_id", "verdict", "score", "excess", "offsets", "breaks"])

    return pairs.groupBy("pair_id").applyInPandas(run, "pair_id long, verdict string, score double, excess double, offsets array<double>, breaks array<double>")
