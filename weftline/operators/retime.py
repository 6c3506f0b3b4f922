"""Retiming subtitles on a transcript of the same speech: anchors by unique text, one chain, gaps between, then a clock."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .book import normalize
from .clock import fit_clock, map_cue
from .matching import monotone_chain, sellers

# Gram length, occurrences that saturate a gram, edit cells, candidates tried, fuzzy lengths, least text of an anchor.
GRAM, SATURATED, CELLS, TRIES, FUZZY, LEAST_ANCHOR = 4, 24, 12_000_000, 6, (12, 320), 6
GAP_MS, RATIOS, EDGE_CHARS, EDGE_EDITS = 120_000, (0.5, 2.0), 12, 0.15


class Timeline:
    """Transcript text end to end, with a time at each character that starts or ends a cue."""

    def __init__(self, cues: list[tuple[int, int, str]]):
        parts, at = [], 0
        self.start_at: dict[int, int] = {}
        self.end_at: dict[int, int] = {}
        for start, end, text in cues:
            t = normalize(text)[0]
            if t:
                self.start_at.setdefault(at, start)
                at += len(t)
                self.end_at[at] = end
                parts.append(t)
        self.text = "".join(parts)
        self.grams: dict[str, list[int]] = {}
        for k in range(len(self.text) - GRAM + 1):
            places = self.grams.setdefault(self.text[k : k + GRAM], [])
            if len(places) <= SATURATED:
                places.append(k)
        self.cells = CELLS

    def find(self, needle: str) -> list[tuple[int, int]]:
        """Spans of the needle, not overlapping: exact ones from its rarest gram win outright; else near ones by votes of grams, none if a seventh place would have to be tried."""
        grams = [(k, self.grams.get(needle[k : k + GRAM], [])) for k in range(len(needle) - GRAM + 1)]
        if not grams:
            return []
        rare = [(len(p), k, p) for k, p in grams if 0 < len(p) <= SATURATED]
        if rare:
            _, k, places = min(rare, key=lambda r: r[:2])
            exact = [(p - k, p - k + len(needle)) for p in places if p >= k and self.text.startswith(needle, p - k)]
            if exact:
                return _apart(exact)
        if not FUZZY[0] <= len(needle) <= FUZZY[1] or any(len(p) > SATURATED for _, p in grams):
            return []
        limit = min(8, int(len(needle) * 0.08))
        votes: dict[int, int] = {}
        for k, places in grams:
            for p in places:
                votes[p - k] = votes.get(p - k, 0) + 1
        found, tried = [], []
        for origin, n in sorted(votes.items(), key=lambda v: (-v[1], v[0])):
            if n < 2:
                break
            if any(abs(origin - t) <= 2 * limit for t in tried):
                continue
            if len(tried) == TRIES:
                return []
            tried.append(origin)
            lo, hi = max(0, origin - limit), min(len(self.text), origin + len(needle) + limit)
            self.cells -= len(needle) * (hi - lo)
            if self.cells < 0:
                return []
            got = sellers(needle, self.text[lo:hi], limit)
            if got:
                found.append((lo + got[0], lo + got[1]))
        return _apart(sorted(found))


def _apart(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in spans:
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


def edge_anchor(needle: str, line: Timeline) -> tuple[str, int] | None:
    """("start" or "end", time) from the needle's first or last 12 characters where they occur once and what is around agrees to 15 % of edits; the start is preferred."""
    if len(needle) < EDGE_CHARS:
        return None
    limit = int(len(needle) * EDGE_EDITS)
    for side in ("start", "end"):
        part = needle[:EDGE_CHARS] if side == "start" else needle[-EDGE_CHARS:]
        at = line.text.find(part)
        if at < 0 or line.text.find(part, at + 1) >= 0:
            continue
        lo, hi = (at, min(len(line.text), at + len(needle) + limit)) if side == "start" else (max(0, at + EDGE_CHARS - len(needle) - limit), at + EDGE_CHARS)
        edge = at if side == "start" else at + EDGE_CHARS
        times = line.start_at if side == "start" else line.end_at
        if edge in times and sellers(needle, line.text[lo:hi], limit):
            return side, times[edge]
    return None


@dataclass
class Retimed:
    cues: list[tuple[int, int]]
    matched: int
    interpolated: int
    clock: bool


def retime(cues: list[tuple[int, int, str]], transcript: list[tuple[int, int, str]]) -> Retimed:
    """New times of ``cues`` in order. Cues whose text is long enough and unique anchor; cues between two anchors join if only one place fits; others go on the line between; a clock over all anchors replaces these where one fits."""
    line = Timeline(transcript)
    norm = [normalize(t)[0] for *_, t in cues]
    count: dict[str, int] = {}
    for t in norm:
        count[t] = count.get(t, 0) + 1
    timed = lambda s: s[0] in line.start_at and s[1] in line.end_at
    spans = []
    options: dict[int, list[tuple[int, int]]] = {}
    for k, t in enumerate(norm):
        if len(t) >= GRAM:
            got = line.find(t)
            if got and all(map(timed, got)):
                options[k] = got
                if len(t) >= LEAST_ANCHOR and count[t] == 1:
                    spans += [(k, a, z) for a, z in got]
    chain = {spans[i][0]: spans[i][1:] for i in monotone_chain(np.array(spans))} if spans else {}
    known = sorted(chain)
    for k, got in options.items():  # several places, but only one between the neighbours
        if k not in chain and len(got) > 1:
            before = max((x for x in known if x < k), default=None)
            after = min((x for x in known if x > k), default=None)
            if before is not None and after is not None:
                fit = [s for s in got if s[0] >= chain[before][1] and s[1] <= chain[after][0]]
                if len(fit) == 1:
                    chain[k] = fit[0]
    new: dict[int, tuple[int, int]] = {k: (line.start_at[a], line.end_at[z]) for k, (a, z) in chain.items()}
    anchors = [(k, float(cues[k][0]), float(s)) for k, (s, _) in new.items()] + [(k, float(cues[k][1]), float(e)) for k, (_, e) in new.items()]
    for k, t in enumerate(norm):
        if k not in new and count[t] == 1 and (e := edge_anchor(t, line)):
            anchors.append((k, float(cues[k][0 if e[0] == "start" else 1]), float(e[1])))
    regions = fit_clock(anchors)
    if regions:
        out = [map_cue(regions, s, e) or (s, e) for s, e, _ in cues]
        return Retimed(out, len(new), 0, True)
    out, between, marks = [], 0, sorted(new)
    for k, (s, e, _) in enumerate(cues):
        if k in new:
            out.append(new[k])
            continue
        a = max((x for x in marks if x < k), default=None)
        b = min((x for x in marks if x > k), default=None)
        if a is not None and b is not None:
            old, to = cues[b][0] - cues[a][0], new[b][0] - new[a][0]
            if 0 < old <= GAP_MS and 0 < to <= GAP_MS and RATIOS[0] <= to / old <= RATIOS[1]:
                at = lambda t: int(new[a][0] + (t - cues[a][0]) * to / old + 0.5)  # noqa: B023, E731
                out.append((at(s), at(e)))
                between += 1
                continue
        out.append((s, e))
    return Retimed(out, len(new), between, False)


def retime_files(cues: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Both (file_id, idx, start_ms, end_ms, text) into (file_id, idx, start_ms, end_ms, matched, clock)."""

    def run(key, c: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        rows = lambda d: [(int(s), int(e), x or "") for s, e, x in zip(d["start_ms"], d["end_ms"], d["text"], strict=True)]
        c, t = c.sort_values(["start_ms", "idx"]), t.sort_values(["start_ms", "idx"])
        got = retime(rows(c), rows(t))
        return pd.DataFrame([(key[0], i, s, e, got.matched, got.clock) for i, (s, e) in zip(c["idx"], got.cues, strict=True)], columns=["file_id", "idx", "start_ms", "end_ms", "matched", "clock"])

    return cues.groupBy("file_id").cogroup(transcripts.groupBy("file_id")).applyInPandas(run, "file_id long, idx long, start_ms long, end_ms long, matched int, clock boolean")
