"""Cues from recognised tokens, and long cues into pieces.

A segment is a dict: start, end, tokens, times (ms on the file's clock), and
raw_start, raw_end (speech without padding), ends (of tokens), file (its number),
continuous (a window of a grid, not of speech) where known. Each cue looks at the
end of the one built before it, so files are the unit of work.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from weftline.functions.text import ABBREVIATIONS, CLOSING, PUNCT_ONLY, TERMINATORS

from .decode import materialize

# Fixed values (ms): lead, sentence gap, least and longest cue, tail; re-split silence, lead, tail.
LEAD, GAP, LEAST, LONGEST, TAIL = 150, 1200, 300, 15_000, 80
RESPLIT_GAP, RESPLIT_LEAD, RESPLIT_TAIL = 680, 120, 400
TOKEN = 40  # a token lasts this long at least
# Long cues: duration, characters, least piece, least pause, lead, edge.
SPLIT_MS, SPLIT_CHARS, LEAST_PIECE, LEAST_PAUSE, SPLIT_LEAD, EDGE = 7000, 40, 4, 350, 100, 300
_MARKS = re.compile(PUNCT_ONLY)


def latin_initial(c: str) -> bool:
    """A to Z and no other capital."""
    return "A" <= c <= "Z"


def ends_sentence(text: str, initial: Callable[[str], bool] = str.isupper) -> bool:
    """``initial`` tells of a single character before a dot whether it is an initial and the dot its own."""
    t = text.rstrip()
    if not t or t[-1] not in TERMINATORS:
        return False
    if t[-1] == ".":
        word = re.split(r"\s", t[:-1])[-1]
        if word and (word.lower() in ABBREVIATIONS or (len(word) == 1 and initial(word))):
            return False
    return True


def only_marks(text: str) -> bool:
    return _MARKS.match(text) is not None


def spoken_chars(text: str) -> int:
    """Characters that are no space, punctuation or symbol."""
    return sum(not c.isspace() and unicodedata.category(c)[0] not in "PS" for c in text)


def sentences(tokens: list[str], times: list[int], gap: int = GAP, initial: Callable[[str], bool] = str.isupper) -> list[tuple[int, int]]:
    """[start, end) of sentences: a long gap starts one, a terminator (with the closing marks behind it) ends one."""
    out, start = [], 0
    for k in range(1, len(tokens)):
        said = materialize(tokens[start:k]).rstrip(CLOSING + " ")
        if times[k] - times[k - 1] > gap or (ends_sentence(said, initial) and tokens[k].strip() not in CLOSING):
            out.append((start, k))
            start = k
    if start < len(tokens):
        out.append((start, len(tokens)))
    return out


def shorter(span: tuple[int, int], times: list[int], longest: int = LONGEST) -> list[tuple[int, int]]:
    """Cut a span that lasts too long at its largest gap in the middle half, the first of equals, again and again."""
    a, z = span
    if z - a < 4 or times[z - 1] - times[a] <= longest:
        return [span]
    lo, hi = a + max(1, (z - a) // 4), z - max(1, (z - a) // 4)
    at = max(range(lo, max(lo + 1, hi)), key=lambda k: (times[k] - times[k - 1], -k))
    return shorter((a, at), times, longest) + shorter((at, z), times, longest)


def _cue(start: int, end: int, text: str, seg: dict, at: slice, offset: int) -> dict:
    """A cue with the places of its tokens from its start, none before it."""
    ends = seg.get("ends")
    return {
        "start": start + offset, "end": end + offset, "text": text, "file": seg.get("file", 0), "tokens": seg["tokens"][at], "offsets": [max(0, t - start) for t in seg["times"][at]],
        "end_offsets": None if ends is None else [max(0, t - start) for t in ends[at]],
    }


def segment_cues(seg: dict, offset: int = 0, initial: Callable[[str], bool] = str.isupper) -> list[dict]:
    """Cues of one segment, none before the end of the one before it; ``offset`` is where its file begins."""
    tokens, times, low, high = seg["tokens"], seg["times"], seg["start"], seg["end"]
    spans = [s for x in sentences(tokens, times, initial=initial) for s in shorter(x, times)]
    out: list[dict] = []
    before = low
    for k, (a, z) in enumerate(spans):
        text = materialize(tokens[a:z]).strip()
        if only_marks(text):
            continue
        opening = low if seg.get("raw_start") is None else seg["raw_start"]
        start = max(before, opening if k == 0 else times[a] - LEAD)
        if k + 1 < len(spans):
            end = times[spans[k + 1][0]] - LEAD
        elif seg.get("raw_end") is None:
            end = high
        else:  # drawn in to where speech ends, but not so far that a short cue flashes by
            end = min(high, max(seg["raw_end"] + TAIL, start + (500 if spoken_chars(text) <= 3 else 800)))
        end = min(high, max(end, times[z - 1] + TOKEN, start + LEAST))
        end = end if end > start else start + TOKEN
        out.append(_cue(start, end, text, seg, slice(a, z), offset))
        before = end
    return out


def _offset(offsets: list[int], file: int) -> int:
    return offsets[file] if file < len(offsets) else 0


def build(segments: list[dict], offsets: list[int] | None = None, initial: Callable[[str], bool] = str.isupper) -> list[dict]:
    """All cues of the files, in order, on one clock (``offsets``: where each file begins); one that reaches into the next ends where that starts."""
    rows = sorted(resplit(segments), key=lambda s: (s.get("file", 0), s["start"]))
    out = [c for s in rows if s["tokens"] for c in segment_cues(s, _offset(offsets or [], s.get("file", 0)), initial)]
    for a, b in zip(out, out[1:]):
        if a["start"] < b["start"] < a["end"]:
            a["end"] = b["start"]
    return out


def one_per_segment(segments: list[dict], offsets: list[int] | None = None) -> list[dict]:
    """One cue for each segment that has text, at the segment's own times, which may overlap."""
    known = lambda s, raw, own: s[own] if s.get(raw) is None else s[raw]
    out = []
    for s in sorted(segments, key=lambda s: (s.get("file", 0), known(s, "raw_start", "start"), known(s, "raw_end", "end"))):
        text = materialize(s["tokens"]).strip()
        if text and not only_marks(text):
            out.append(_cue(known(s, "raw_start", "start"), known(s, "raw_end", "end"), text, s, slice(None), _offset(offsets or [], s.get("file", 0))))
    return out


def resplit(segments: list[dict]) -> list[dict]:
    """Windows marked continuous that touch are one run of tokens, cut anew where tokens lie more than 680 ms apart; other segments stay as they are."""
    if not any(s.get("continuous") for s in segments):
        return segments
    runs: list[list[dict]] = []
    for s in sorted(segments, key=lambda s: (s.get("file", 0), s["start"])):
        last = runs[-1][-1] if runs else None
        if last and s.get("continuous") and last.get("continuous") and last.get("file", 0) == s.get("file", 0) and last["end"] == s["start"]:
            runs[-1].append(s)
        else:
            runs.append([s])
    out: list[dict] = []
    for run in runs:
        if not run[0].get("continuous"):
            out += run
            continue
        file, low, high = run[0].get("file", 0), run[0]["start"], run[-1]["end"]
        tokens, times = [x for s in run for x in s["tokens"]], [t for s in run for t in s["times"]]
        ends = [t for s in run for t in s["ends"]] if all(s.get("ends") is not None for s in run) else None
        edges = [0, *(k for k in range(1, len(times)) if times[k] - times[k - 1] > RESPLIT_GAP), len(times)]
        for a, z in zip(edges, edges[1:]):
            if a == z:
                continue
            start = max(low, times[a] - RESPLIT_LEAD)
            if out and out[-1].get("file", 0) == file:
                start = max(start, out[-1]["end"])
            end = min(high, times[z - 1] + RESPLIT_TAIL, high if z == len(times) else times[z] - RESPLIT_LEAD)
            end = end if end > start else start + TOKEN
            out.append({"file": file, "start": start, "end": end, "raw_start": start, "raw_end": end, "tokens": tokens[a:z], "times": times[a:z], "ends": None if ends is None else ends[a:z]})
    return out


def piece_cuts(text: str, least: int = LEAST_PIECE) -> list[int]:
    """Places after a terminator and the closing marks behind it, so that no piece is shorter than ``least``."""
    cuts, start = [], 0
    for m in re.finditer(f"[{re.escape(TERMINATORS)}]+[{re.escape(CLOSING)}]*", text):
        if m.end() - start >= least and len(text) - m.end() >= least:
            cuts.append(m.end())
            start = m.end()
    return cuts


def split_long(start: int, end: int, text: str, tokens: list[str] | None = None, offsets: list[int] | None = None) -> list[tuple[int, int, str]]:
    """A cue over 7 s or 40 characters into its sentences, or at its longest pause; times from tokens where they spell the text, else in proportion."""
    if end - start <= SPLIT_MS and len(text.strip()) <= SPLIT_CHARS:
        return [(start, end, text)]
    spelt = tokens is not None and offsets is not None and len(tokens) == len(offsets) and "".join(tokens) == text
    cuts = piece_cuts(text)
    at = None
    if spelt:
        begin, place = [], 0
        for t, o in zip(tokens, offsets, strict=True):
            begin += [o] * len(t)
            place += len(t)
        at = lambda c: start + begin[c]
        if not cuts:
            pauses = [(offsets[k] - offsets[k - 1], sum(map(len, tokens[:k]))) for k in range(1, len(tokens))]
            good = [(p, c) for p, c in pauses if p >= LEAST_PAUSE and LEAST_PIECE <= c <= len(text) - LEAST_PIECE]
            if good:
                cuts = [max(good)[1]]  # of equal pauses the last
    if not cuts:
        return [(start, end, text)]
    edges, times = [0, *cuts, len(text)], [start]
    for c in cuts:
        t = at(c) - SPLIT_LEAD if at else start + (end - start) * c // len(text)
        times.append(min(max(t, times[-1] + EDGE), end - EDGE * (len(cuts) - len(times) + 1)))
    times.append(end)
    if any(b <= a for a, b in zip(times, times[1:])):
        times = [start + (end - start) * e // len(text) for e in edges]
    if any(b <= a for a, b in zip(times, times[1:])):
        return [(start, end, text)]
    return [(a, b, text[x:y]) for a, b, x, y in zip(times, times[1:], edges, edges[1:], strict=False)]


def build_files(segments: DataFrame, how: Callable[[list[dict]], list[dict]] = build) -> DataFrame:
    """segments(file_id, start_ms, end_ms, tokens, times, and raw_start_ms, raw_end_ms, ends, continuous where known) into (file_id, idx, start_ms, end_ms, text, offsets)."""
    known = {"raw_start_ms": "raw_start", "raw_end_ms": "raw_end", "ends": "ends", "continuous": "continuous"}
    more = [c for c in known if c in segments.columns]

    def whole(x):
        return None if x is None or (np.isscalar(x) and pd.isna(x)) else [int(y) for y in x] if not np.isscalar(x) else int(x)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [{"start": int(s), "end": int(e), "tokens": list(t), "times": [int(x) for x in m]} for s, e, t, m in zip(pdf["start_ms"], pdf["end_ms"], pdf["tokens"], pdf["times"], strict=True)]
        for c in more:
            for row, x in zip(rows, pdf[c], strict=True):
                row[known[c]] = whole(x)
        key = pdf["file_id"].iloc[0]
        return pd.DataFrame([(key, k, c["start"], c["end"], c["text"], c["offsets"]) for k, c in enumerate(how(rows))], columns=["file_id", "idx", "start_ms", "end_ms", "text", "offsets"])

    return segments.groupBy("file_id").applyInPandas(run, "file_id long, idx long, start_ms long, end_ms long, text string, offsets array<long>")


def split_files(cues: DataFrame) -> DataFrame:
    """cues(file_id, idx, start_ms, end_ms, text) into pieces (file_id, idx, piece, start_ms, end_ms, text); cues do not see each other, so no grouping."""

    def run(batches):
        for b in batches:
            rows = [(f, i, k, *p) for f, i, s, e, t in zip(b["file_id"], b["idx"], b["start_ms"], b["end_ms"], b["text"], strict=True) for k, p in enumerate(split_long(int(s), int(e), t or ""))]
            yield pd.DataFrame(rows, columns=["file_id", "idx", "piece", "start_ms", "end_ms", "text"])

    return cues.select("file_id", "idx", "start_ms", "end_ms", "text").mapInPandas(run, "file_id long, idx long, piece int, start_ms long, end_ms long, text string")
