"""From model outputs to timed text. The model itself is a function given by the caller."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .timeline import run_lengths

_BYTE = re.compile(r"^<0x([0-9A-Fa-f]{2})>$")
_NO_SPACE_BEFORE = re.compile(r"^[\s,.!?;:%)\]}'’”、。！？…」』）]")
_NO_SPACE_SCRIPT = re.compile(r"[฀-๿぀-ヿ㐀-䶿一-鿿豈-﫿]")


def materialize(tokens: list[str]) -> str:
    """Text of word-piece tokens: runs of byte tokens are UTF-8, the mark for a word's start is a space except at the start, before punctuation, and next to scripts without spaces."""
    out, raw = [], bytearray()

    def flush():
        if raw:
            out.append(raw.decode("utf-8", "replace"))
            raw.clear()

    for t in tokens:
        if m := _BYTE.match(t):
            raw.append(int(m[1], 16))
            continue
        flush()
        if t.startswith("▁"):
            word, before = t[1:], "".join(out)[-1:]
            glue = not before or not word or _NO_SPACE_BEFORE.match(word) or _NO_SPACE_SCRIPT.match(word) or _NO_SPACE_SCRIPT.match(before)
            out.append(word if glue else " " + word)
        else:
            out.append(t)
    flush()
    return "".join(out).replace("▁", " ")


def collapse_frames(frames: DataFrame, keys: list[str], frame: str, label: str, special: tuple, frame_ms: int) -> DataFrame:
    """(keys, run, label, start_ms, end_ms) of frame labels: equal neighbours are one, blanks and other specials go."""
    runs = run_lengths(frames, keys, [frame], label, hold=special)
    return runs.select(*keys, "run", label, (F.col("first") * frame_ms).alias("start_ms"), ((F.col("last") + 1) * frame_ms).alias("end_ms"))


def encode_text(texts: DataFrame, key: str, text: str, table: DataFrame) -> DataFrame:
    """(key, at, id) of each character that the token table (id, token, is_special) has; others are skipped."""
    chars = texts.select(key, F.posexplode(F.split(text, "")).alias("at", "token")).where("token <> ''")
    return chars.join(table.where("not is_special").select("id", "token"), "token").select(key, "at", "id")


def forced_align(log_probs: np.ndarray, targets: list[int], blank: int = 0, most_cells: int = 50_000_000) -> list[tuple[int, int, float]] | None:
    """Best path of the targets through frames [n, vocabulary]: (first frame, last frame, mean log-probability) per target; None if they do not fit or the grid is too large.

    States are blanks and targets in turn; staying beats coming from one before, which beats coming from two before.
    """
    n, size = len(log_probs), 2 * len(targets) + 1
    if not targets:
        return []
    if n < len(targets) + sum(a == b for a, b in zip(targets, targets[1:])) or n * size > most_cells:
        return None
    label = np.full(size, blank)
    label[1::2] = targets
    skip = np.zeros(size, bool)
    skip[3::2] = label[3::2] != label[1:-2:2]
    score = np.full(size, -np.inf)
    score[:2] = log_probs[0, label[:2]]
    back = np.zeros((n, size), np.int8)
    for t in range(1, n):
        one, two = np.full(size, -np.inf), np.full(size, -np.inf)
        one[1:], two[2:] = score[:-1], np.where(skip[2:], score[:-2], -np.inf)
        best = np.where(one > score, one, score)
        back[t] = one > score
        back[t][two > best] = 2
        score = np.maximum(best, two) + log_probs[t, label]
    at = size - 1 if score[-1] >= score[-2] else size - 2
    if score[at] == -np.inf:
        return None
    states = [at]
    for t in range(n - 1, 0, -1):
        at -= int(back[t, at])
        states.append(at)
    states = np.array(states[::-1])
    out = []
    for k, target in enumerate(targets):
        where = np.flatnonzero(states == 2 * k + 1)
        out.append((int(where[0]), int(where[-1]), float(log_probs[where, target].mean())))
    return out


def align_utterances(frames: DataFrame, targets: DataFrame, blank: int = 0) -> DataFrame:
    """frames(utterance, frame, logits) and targets(utterance, ids) into (utterance, k, id, first, last, score)."""

    def run(key, f: pd.DataFrame, t: pd.DataFrame) -> pd.DataFrame:
        cols = ["utterance", "k", "id", "first", "last", "score"]
        if not len(f) or not len(t):
            return pd.DataFrame(columns=cols)
        x = np.stack(f.sort_values("frame")["logits"].to_list()).astype(float)
        x -= x.max(axis=1, keepdims=True)
        x -= np.log(np.exp(x).sum(axis=1, keepdims=True))
        ids = [int(i) for i in t["ids"].iloc[0]]
        got = forced_align(x, ids, blank) or []
        return pd.DataFrame([(key[0], k, ids[k], a, z, s) for k, (a, z, s) in enumerate(got)], columns=cols)

    return frames.groupBy("utterance").cogroup(targets.groupBy("utterance")).applyInPandas(run, "utterance long, k int, id int, first int, last int, score double")


def transducer_greedy(encoder: np.ndarray, predict: Callable, join: Callable, blank: int = 0, special: tuple = ()) -> list[tuple[int, int]]:
    """(frame, id) of the frame-synchronous greedy search with at most one symbol a frame; the predictor runs anew only after a symbol."""
    out: list[tuple[int, int]] = []
    state = predict([])
    for t in range(len(encoder)):
        best = int(np.argmax(join(encoder[t], state)))
        if best != blank and best not in special:
            out.append((t, best))
            state = predict([i for _, i in out])
    return out


def spread_characters(tokens: list[str], starts: list[int], ends: list[int]) -> list[tuple[str, int, int]]:
    """(character, start, end): a token's span is shared evenly by its spoken characters; times never go back; punctuation takes the last spoken time."""
    out: list[tuple[str, int, int]] = []
    last = 0
    for token, a, z in zip(tokens, starts, ends, strict=True):
        spoken = [c for c in token if c.isalnum()]
        step, k = (z - a) / max(1, len(spoken)), 0
        for c in token:
            if c.isalnum():
                s, e = max(last, int(a + k * step)), max(last, int(a + (k + 1) * step))
                out.append((c, s, e))
                last, k = e, k + 1
            else:
                out.append((c, last, last))
    return out


def decode_segments(segments: DataFrame, decoder: Callable[[np.ndarray], list[int]], tokens: dict[int, str]) -> DataFrame:
    """segments(file_id, start_ms, features) through a decoder of the caller into text; the decoder is made once per batch of rows, on the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = [decoder(np.asarray(f)) for f in b["features"]]
            yield pd.DataFrame({"file_id": b["file_id"], "start_ms": b["start_ms"], "text": [materialize([tokens[i] for i in x if i in tokens]) for x in ids], "n_tokens": [len(x) for x in ids]})

    return segments.mapInPandas(run, "file_id long, start_ms long, text string, n_tokens int")
