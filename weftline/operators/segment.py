"""Speech segments from levels or probabilities of 32 ms windows, in one pass per file, batch or stream."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Window, threshold, silence that closes, least speech, padding, longest segment, look-back of a forced cut (ms).
WINDOW_MS, THRESHOLD, MIN_SILENCE, MIN_SPEECH, PAD, LONGEST, LOOKBACK = 32, 0.5, 500, 250, 500, 20_000, 5_000


def energy_probabilities(db: np.ndarray, history_s: float = 30.0, margin: float = 12.0, least: float = -55.0, most: float = -30.0, softness: float = 2.0) -> np.ndarray:
    """Logistic of the level over a threshold: 10th percentile (nearest rank) of the last 30 s plus a margin, held in bounds."""
    size, past, out = max(1, int(history_s * 1000 / WINDOW_MS)), deque(), np.zeros(len(db))
    for k, x in enumerate(db):
        past.append(x)
        if len(past) > size:
            past.popleft()
        level = sorted(past)[int(np.floor((len(past) - 1) * 10 / 100 + 0.5))]
        out[k] = 1 / (1 + np.exp(-(x - min(most, max(least, level + margin))) / softness))
    return out


@dataclass
class Segmenter:
    """State of one file between windows; holds at most one open segment's probabilities."""

    open_at: int | None = None  # window of the start
    silent_at: int | None = None
    probs: list[float] = field(default_factory=list)
    at: int = 0
    padded_end: int = 0

    def feed(self, p: float) -> list[tuple[int, int, int, int]]:
        """Take the next window; returns finished (start_ms, end_ms, raw_start_ms, raw_end_ms)."""
        out = []
        if p >= THRESHOLD:
            if self.open_at is None:
                self.open_at, self.probs = self.at, []
            self.silent_at = None
        elif self.open_at is not None and self.silent_at is None:
            self.silent_at = self.at
        if self.open_at is not None:
            self.probs.append(p)
        self.at += 1
        if self.silent_at is not None and (self.at - self.silent_at) * WINDOW_MS >= MIN_SILENCE:
            out += self._emit(self.silent_at, False)
            self.open_at = self.silent_at = None
        elif self.open_at is not None and (self.at - self.open_at) * WINDOW_MS >= LONGEST:
            back = max(1, len(self.probs) - LOOKBACK // WINDOW_MS)
            cut = back + int(np.argmin(self.probs[back:]))
            out += self._emit(self.open_at + cut, True)
            self.open_at, self.probs = self.open_at + cut, self.probs[cut:]
            if self.silent_at is not None:
                self.silent_at = max(self.silent_at, self.open_at)
        return out

    def flush(self) -> list[tuple[int, int, int, int]]:
        out = self._emit(self.silent_at if self.silent_at is not None else self.at, False) if self.open_at is not None else []
        self.open_at = self.silent_at = None
        return out

    def _emit(self, end: int, forced: bool) -> list[tuple[int, int, int, int]]:
        a, z = self.open_at * WINDOW_MS, end * WINDOW_MS
        if z - a < MIN_SPEECH:
            return []
        start = max(self.padded_end, a - PAD)
        stop = z if forced else z + min(PAD, MIN_SILENCE // 2)
        self.padded_end = stop
        return [(start, stop, a, z)]

    def dump(self) -> tuple:
        none = lambda x: -1 if x is None else x
        return none(self.open_at), none(self.silent_at), list(self.probs), self.at, self.padded_end

    @classmethod
    def load(cls, row: tuple) -> Segmenter:
        some = lambda x: None if x < 0 else int(x)
        return cls(some(row[0]), some(row[1]), [float(p) for p in row[2]], int(row[3]), int(row[4]))


def segments(probs) -> list[tuple[int, int, int, int]]:
    """All segments of one file; ends are held to its length."""
    s = Segmenter()
    out = [x for p in probs for x in s.feed(float(p))] + s.flush()
    total = s.at * WINDOW_MS
    return [(a, min(z, total), ra, rz) for a, z, ra, rz in out]


def segment_files(windows: DataFrame) -> DataFrame:
    """windows(file_id, window, prob) into (file_id, start_ms, end_ms, raw_start_ms, raw_end_ms)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = segments(pdf.sort_values("window")["prob"])
        return pd.DataFrame([(pdf["file_id"].iloc[0], *x) for x in got], columns=["file_id", "start_ms", "end_ms", "raw_start_ms", "raw_end_ms"])

    return windows.groupBy("file_id").applyInPandas(run, "file_id long, start_ms long, end_ms long, raw_start_ms long, raw_end_ms long")


def segmenter_for(fixed: Column, material: Column, architecture: Column) -> Column:
    """Which segmenter suits: given spans, else energy for clean speech, else windows for one architecture and a model for others."""
    return F.when(fixed, "fixed").when(material == "clean", "energy").when(architecture == "nemoCtc", "windows").otherwise("model")


def quiet_cuts(db: np.ndarray, frame_ms: int, target_ms: int = 600_000, around_ms: int = 60_000, smooth_ms: int = 400) -> list[int]:
    """Cut places about every ``target_ms`` at the lowest smoothed level within ``around_ms``, the first of equals; each next target counts from the last cut."""
    k = max(1, smooth_ms // frame_ms)
    c = np.concatenate([[0.0], np.cumsum(db, dtype=float)])
    n = len(db)
    lo, hi = np.maximum(0, np.arange(n) - k // 2), np.minimum(n, np.arange(n) + k // 2 + 1)
    level = (c[hi] - c[lo]) / np.maximum(1, hi - lo)
    cuts, at = [], 0
    while at + target_ms < n * frame_ms:
        a, z = max(at // frame_ms + 1, (at + target_ms - around_ms) // frame_ms), min(n, (at + target_ms + around_ms) // frame_ms + 1)
        if z <= a:
            break
        at = (a + int(np.argmin(level[a:z]))) * frame_ms
        cuts.append(at)
    return cuts


def chunk_plan(db: np.ndarray, frame_ms: int, full: Callable[[int, int], bool], target_ms: int = 600_000, around_ms: int = 60_000, least_ms: int = 40_000) -> list[tuple[int, int, int]]:
    """(ordinal, start_ms, end_ms) of chunks in the order they are done. A chunk that proves ``full`` and is ``least_ms`` long or longer is halved at its quietest place within a quarter of its length around the middle; each try takes the next ordinal."""
    edges = [0, *quiet_cuts(db, frame_ms, target_ms, around_ms), len(db) * frame_ms]
    work, out, tries = list(zip(edges, edges[1:]))[::-1], [], 0
    while work:
        a, z = work.pop()
        tries += 1
        cut = quiet_cuts(db[a // frame_ms : z // frame_ms], frame_ms, (z - a) // 2, (z - a) // 4)[:1] if z - a >= least_ms and full(a, z) else []
        if cut:
            work += [(a + cut[0], z), (a, a + cut[0])]
        else:
            out.append((tries, a, z))
    return out


def balanced_groups(weights: list[float], groups: int) -> list[tuple[int, int]]:
    """Contiguous [start, end) ranges of about equal weight, at most ``groups``, none empty."""
    total, out, start, acc = sum(weights), [], 0, 0.0
    for k, w in enumerate(weights):
        acc += w
        left_rows, left_groups = len(weights) - k - 1, groups - len(out) - 1
        if left_groups and (acc >= total * (len(out) + 1) / groups or left_rows <= left_groups):
            out.append((start, k + 1))
            start = k + 1
    if start < len(weights):
        out.append((start, len(weights)))
    return out


def batch_size(lengths: list[int], budget: int, most: int) -> int:
    """How many of the longest-first lengths go into one batch: within the budget of rows times longest, and none under 4/5 of the longest."""
    if not lengths:
        return 0
    n = 1
    while n < min(most, len(lengths)) and (n + 1) * lengths[0] <= budget and 5 * lengths[n] >= 4 * lengths[0]:
        n += 1
    return n


def pack_batches(df: DataFrame, key: str, length: str, tie: str, budget: int, most: int) -> DataFrame:
    """Rows of each key longest first into batches: adds ``batch`` (from 0). The greedy fill depends on the row before, so a key streams through in order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([length, tie], ascending=[False, True])
        sizes, batch, number = [int(x) for x in pdf[length]], [], 0
        at = 0
        while at < len(sizes):
            n = batch_size(sizes[at : at + most], budget, most)
            batch += [number] * n
            at, number = at + n, number + 1
        return pdf.assign(batch=batch)

    from pyspark.sql.types import LongType, StructType

    return df.groupBy(key).applyInPandas(run, StructType([*df.schema.fields]).add("batch", LongType()))
