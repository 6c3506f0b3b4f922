"""Cues against an energy envelope: snap, refine, merge, display margins.

An envelope has one level in dB per 20 ms frame, 0 where nothing is known. Its
quiet and voiced stretches are taken once as runs (numpy); every stage asks the
runs, so a cue costs a binary search and not a scan. All stages read what the
one before, or the cue before, has already moved: that makes a timeline sequential and
timelines the unit of work.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import MERGE_TERMINATORS, SPOKEN  # noqa: F401

FRAME = 20
# Floor blocks in frames, floor margin and bounds in dB, snapping, refining, merging, margins (ms unless said).
FLOOR_BLOCK, FLOOR_SPAN, FLOOR_PERCENT = 250, 750, 10
FLOOR_MARGIN, LEAST_DB, MOST_DB = 16.0, -50.0, -30.0
MAX_GAP, WINDOW, MIN_VALLEY, DISTANCE_PENALTY, TAIL, LEAD, MIN_DURATION, TOKEN_GUARD, CUT_BIAS = 400, 600, 120, 0.5, 80, 40, 500, 1000, 350
EDGE_SHIFT, EDGE_VOICE, EDGE_LEAD, EDGE_TAIL = 600, 60, 150, 80
SHORT, MERGE_CHARS, MERGE_DURATION, MERGE_GAP = 1200, 40, 10_000, 1500
SLOW_CPS, FAST_CPS, HEADS, TAILS, GAP_RATIO, TAIL_CAP, GLUE, SAFETY, MIN_VOICE = 5.5, 7.0, (120, 80, 40), (180, 100, 20), 0.18, 250, 400, 50, 60


@dataclass
class Cue:
    start: int
    end: int
    text: str = ""
    first_token: int | None = None  # from the cue's start
    last_token: int | None = None
    section: int = -1
    norm_start: int = -1
    norm_end: int = -1
    members: tuple[int, ...] = ()

    def from_(self, start: int) -> Cue:
        """The cue begun at ``start``; its tokens stay where they are in time, not before its start."""
        by = start - self.start
        return replace(self, start=start, first_token=None if self.first_token is None else max(0, self.first_token - by), last_token=None if self.last_token is None else max(0, self.last_token - by))


def thresholds(db: np.ndarray) -> np.ndarray:
    """Level under which a frame is quiet: by block of 250, the 10th percentile (nearest rank) of known levels within 750 frames around, plus a margin, held in bounds."""
    out = np.full(len(db), MOST_DB)
    for at in range(0, len(db), FLOOR_BLOCK):
        near = db[max(0, at - FLOOR_SPAN) : at + FLOOR_BLOCK + FLOOR_SPAN]
        near = np.sort(near[near != 0])
        if len(near):
            floor = near[int(np.floor((len(near) - 1) * FLOOR_PERCENT / 100 + 0.5))]
            out[at : at + FLOOR_BLOCK] = min(MOST_DB, max(LEAST_DB, floor + FLOOR_MARGIN))
    return out


class Runs:
    """Maximal runs of frames where a condition holds, as starts and ends."""

    def __init__(self, flag: np.ndarray):
        edge = np.diff(np.concatenate([[0], flag.astype(np.int8), [0]]))
        self.start, self.end, self.flag = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), flag

    def touching(self, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        """Runs that share a frame with [lo, hi), whole."""
        a, b = np.searchsorted(self.end, lo, "right"), np.searchsorted(self.start, hi, "left")
        return self.start[a:b], self.end[a:b]


class Envelope:
    def __init__(self, db: np.ndarray):
        self.n = len(db)
        quiet = (db != 0) & (db < thresholds(db))
        self.quiet, self.voice = Runs(quiet), Runs(~quiet)


def snap(cues: list[Cue], env: Envelope) -> list[Cue]:
    """Move the cut between close neighbours into the best valley near it: score length less half the distance, first best."""
    cues = list(cues)
    for i in range(len(cues) - 1):
        a, b = cues[i], cues[i + 1]
        if not env.n or not 0 <= b.start - a.end <= MAX_GAP:
            continue
        cut = (a.end + b.start) // 2 + CUT_BIAS
        s, e = env.quiet.touching(max(0, int((cut - WINDOW) / FRAME)), min(env.n, int((cut + WINDOW) / FRAME)))
        size = (e - s) * FRAME
        score = np.where(size >= MIN_VALLEY, size - DISTANCE_PENALTY * np.abs((s + e) * FRAME / 2 - cut), -np.inf)
        if not len(score) or score.max() == -np.inf:
            continue
        k = int(score.argmax())
        lo, hi = int(s[k]) * FRAME, int(e[k]) * FRAME
        end = min(lo + TAIL, hi)
        start = max(hi - LEAD, lo, end)
        if end - a.start < MIN_DURATION or b.end - start < MIN_DURATION or (b.first_token is not None and start > b.start + b.first_token + TOKEN_GUARD):
            continue
        cues[i], cues[i + 1] = replace(a, end=end), b.from_(start)
    return cues


def refine(cues: list[Cue], env: Envelope) -> list[Cue]:
    """Draw edges that lie in silence back to voice of 60 ms or more within 600 ms; only inward."""
    out, least, far = [], -(-EDGE_VOICE // FRAME), EDGE_SHIFT // FRAME
    for c in cues:
        at = c.start // FRAME
        if 0 <= at < env.n and env.quiet.flag[at]:
            s, e = env.voice.touching(at, min(env.n, at + far))
            s = s[e - s >= least]
            if len(s):
                start = max(c.start, int(s[0]) * FRAME - EDGE_LEAD)
                if start > c.start and c.end - start >= MIN_DURATION:
                    c = c.from_(start)
        at = (c.end - 1) // FRAME
        if 0 <= at < env.n and env.quiet.flag[at]:
            s, e = env.voice.touching(max(0, at - far + 1), at + 1)
            e = e[e - s >= least]
            if len(e):
                end = min(c.end, int(e[-1]) * FRAME + EDGE_TAIL)
                if end < c.end and end - c.start >= MIN_DURATION and (c.last_token is None or end >= c.start + c.last_token - TOKEN_GUARD):
                    c = replace(c, end=end)
        out.append(c)
    return out


def ends_sentence(text: str) -> bool:
    t = text.rstrip()
    if not t or t[-1] in MERGE_TERMINATORS:
        return True
    return t[-1] in ".．" and not (len(t) > 1 and (t[-2].isascii() and t[-2].isalpha() or "Ａ" <= t[-2] <= "Ｚ" or "ａ" <= t[-2] <= "ｚ"))


def merge(cues: list[Cue]) -> list[Cue]:
    """Join a cue to the group before it while the book text runs on, no sentence has ended, and one of the two is short."""
    groups: list[Cue] = []
    for k, c in enumerate(cues):
        g = groups[-1] if groups else None
        if (
            g and g.section >= 0 and g.section == c.section and g.norm_end == c.norm_start and not ends_sentence(g.text) and 0 <= c.start - g.end <= MERGE_GAP
            and (g.end - g.start < SHORT or c.end - c.start < SHORT) and c.end - g.start <= MERGE_DURATION and len(g.text) + len(c.text) <= MERGE_CHARS
        ):
            groups[-1] = replace(g, end=c.end, text=g.text + c.text, norm_end=c.norm_end, members=(*g.members, k))
        else:
            groups.append(replace(c, members=(k,)))
    return groups


def margins(cues: list[Cue], env: Envelope, spoken) -> list[Cue]:
    """Widen cues around their voice by speaking rate; starts look at the end already widened before, ends at the next start as it came."""
    out: list[Cue] = []
    least = -(-MIN_VOICE // FRAME)
    for i, c in enumerate(cues):
        lo, hi = max(0, c.start // FRAME), min(env.n, c.end // FRAME)
        s, e = env.voice.touching(lo, hi) if hi > lo else (np.zeros(0, int), np.zeros(0, int))
        s, e = np.maximum(s, lo), np.minimum(e, hi)
        long = e - s >= least
        chars = spoken(c.text)
        if long.any() and chars > 0:
            on, off = int(s[long][0]) * FRAME, int(e[long][-1]) * FRAME
            rate = chars / ((off - on) / 1000)
            tier = 2 if rate >= FAST_CPS else 1 if rate >= SLOW_CPS else 0
            start, end = c.start, c.end
            before = out[-1].end if out else None
            if before is None or on - before > GLUE:
                start = min(start, max(on - HEADS[tier], 0 if before is None else before + 1))
            after = cues[i + 1].start if i + 1 < len(cues) else None
            if after is None or after - off > GLUE:
                tail = TAILS[2] if tier == 2 else int(min(TAIL_CAP, max(TAILS[tier], TAIL_CAP if after is None else GAP_RATIO * (after - off - GLUE))) + 0.5)
                end = max(end, off + tail if after is None else min(off + tail, after - SAFETY))
            c = replace(c, start=start, end=end)
        out.append(c)
    return out


def post_process(cues: list[Cue], db: np.ndarray, spoken, stages: str = "snap refine merge margins") -> list[Cue]:
    """The stages asked for, in their order, over one file's cues."""
    env = Envelope(db)
    for name, stage in (("snap", lambda c: snap(c, env)), ("refine", lambda c: refine(c, env)), ("merge", merge), ("margins", lambda c: margins(c, env, spoken))):
        if name in stages.split():
            cues = stage(cues)
    return cues


def post_process_files(cues: DataFrame, energy: DataFrame, stages: str = "snap refine merge margins") -> DataFrame:
    """cues(file_id, idx, start_ms, end_ms, text) and energy(file_id, frame, db) into (file_id, idx, start_ms, end_ms, text, members)."""
    import re

    signs = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), f"[{SPOKEN}]"))

    def run(key, c: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        c = c.sort_values(["start_ms", "idx"])
        db = np.zeros(int(e["frame"].max()) + 1 if len(e) else 0, np.int8)
        db[e["frame"].to_numpy()] = e["db"].to_numpy()
        done = post_process([Cue(int(s), int(z), t or "", None, None, 0, k, k + 1) for k, (s, z, t) in enumerate(zip(c["start_ms"], c["end_ms"], c["text"], strict=True))], db, lambda t: len(signs.findall(t)), stages)
        idx = c["idx"].tolist()
        return pd.DataFrame([(key[0], idx[x.members[0]] if x.members else idx[k], x.start, x.end, x.text, max(1, len(x.members))) for k, x in enumerate(done)], columns=["file_id", "idx", "start_ms", "end_ms", "text", "members"])

    return cues.groupBy("file_id").cogroup(energy.groupBy("file_id")).applyInPandas(run, "file_id long, idx long, start_ms long, end_ms long, text string, members int")


def merge_groups(df: DataFrame, key: str, max_gap: int = MERGE_GAP, max_chars: int = MERGE_CHARS) -> DataFrame:
    """Left fold of cues (idx, start_ms, end_ms, chars, ends) into groups: (key, grp, cues, start_ms, end_ms). The fold runs in the JVM over each timeline's sorted array."""
    item = F.struct(F.col("idx"), F.col("start_ms").cast("long").alias("s"), F.col("end_ms").cast("long").alias("e"), F.col("chars").cast("long").alias("n"), F.col("ends").alias("x"))
    rows = df.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("c"))
    kind = "struct<done:array<struct<cues:bigint,s:bigint,e:bigint>>,cues:bigint,s:bigint,e:bigint,n:bigint,x:boolean>"
    start = F.struct(F.array().cast("array<struct<cues:bigint,s:bigint,e:bigint>>").alias("done"), F.lit(0).cast("long").alias("cues"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("e"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("x")).cast(kind)

    def step(g, c):
        joins = (g["cues"] > 0) & ~g["x"] & (c["s"] - g["e"]).between(0, max_gap) & ((g["e"] - g["s"] < SHORT) | (c["e"] - c["s"] < SHORT)) & (c["e"] - g["s"] <= MERGE_DURATION) & (g["n"] + c["n"] <= max_chars)
        closed = F.when(g["cues"] > 0, F.concat(g["done"], F.array(F.struct(g["cues"].alias("cues"), g["s"].alias("s"), g["e"].alias("e"))))).otherwise(g["done"])
        joined = F.struct(g["done"].alias("done"), (g["cues"] + 1).alias("cues"), g["s"].alias("s"), c["e"].alias("e"), (g["n"] + c["n"]).alias("n"), c["x"].alias("x"))
        fresh = F.struct(closed.alias("done"), F.lit(1).cast("long").alias("cues"), c["s"].alias("s"), c["e"].alias("e"), c["n"].alias("n"), c["x"].alias("x"))
        return F.when(joins, joined).otherwise(fresh).cast(kind)

    done = F.aggregate("c", start, step, lambda g: F.concat(g["done"], F.array(F.struct(g["cues"].alias("cues"), g["s"].alias("s"), g["e"].alias("e")))))
    return rows.select(key, F.posexplode(done).alias("at", "g")).select(key, (F.col("at") + 1).cast("long").alias("grp"), F.col("g.cues").alias("cues"), F.col("g.s").alias("start_ms"), F.col("g.e").alias("end_ms"))
