"""Tokens under a cue's text: rebased with merged cues, laid over other text, spread to characters."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_CELLS, LEAST_SAME = 400_000, 0.6


def rebase(members: DataFrame, keys: list[str]) -> DataFrame:
    """members(keys, idx, start_ms, end_ms, tokens, offsets), the cues of groups, into one row a group: tokens in order, offsets from the group's start; null if a member has none. All in the JVM."""
    rows = members.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("idx", "start_ms", "end_ms", "tokens", "offsets"))).alias("m"))
    start = F.array_min(F.col("m.start_ms"))
    whole = F.forall("m", lambda x: x["tokens"].isNotNull() & x["offsets"].isNotNull())
    moved = F.flatten(F.transform("m", lambda x: F.transform(x["offsets"], lambda o: o + x["start_ms"] - start)))
    return rows.select(*keys, start.alias("start_ms"), F.array_max(F.col("m.end_ms")).alias("end_ms"), F.when(whole, F.flatten(F.col("m.tokens"))).alias("tokens"), F.when(whole, moved).alias("offsets"))


def align_positions(a: str, b: str) -> list[int]:
    """For each place of ``a`` (and its end) a place of ``b``: along a cheapest edit path; in proportion if the grid would be too large."""
    if len(a) * len(b) > MAX_CELLS:
        return [k * len(b) // max(1, len(a)) for k in range(len(a) + 1)]
    cost = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    cost[:, 0], cost[0] = np.arange(len(a) + 1), np.arange(len(b) + 1)
    codes = np.array([ord(c) for c in b])
    for i, ch in enumerate(a):
        best = np.minimum(cost[i, :-1] + (codes != ord(ch)), cost[i, 1:] + 1) if len(b) else np.zeros(0, np.int32)
        run = np.concatenate([[cost[i + 1, 0]], best]) - np.arange(len(b) + 1)  # insertions: a running minimum along the row
        cost[i + 1] = np.minimum.accumulate(run) + np.arange(len(b) + 1)
    out, i, j = [0] * (len(a) + 1), len(a), len(b)
    out[i] = j
    while i:
        if j and cost[i, j] == cost[i - 1, j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
        elif cost[i, j] == cost[i - 1, j] + 1:
            i -= 1
        else:
            j -= 1
            continue
        out[i] = j
    return out


def character_times(text: str, tokens: list[str], offsets: list[int], ends: list[int], start: int) -> list[tuple[int, int]] | None:
    """(start, end) of each character of a cue's text from its tokens; None if fewer than 0.6 of them are the same characters."""
    spelt = "".join(tokens)
    if not spelt or not text:
        return None
    times = []
    for t, a, z in zip(tokens, offsets, ends, strict=True):
        times += [(start + a + (z - a) * k // len(t), start + a + (z - a) * (k + 1) // len(t)) for k in range(len(t))]
    at = align_positions(text, spelt)
    same = sum(at[k] < len(spelt) and spelt[at[k]] == c for k, c in enumerate(text))
    if same < LEAST_SAME * len(text):
        return None
    out, floor = [], start
    for k in range(len(text)):
        a, z = times[min(at[k], len(times) - 1)]
        out.append((max(floor, a), max(floor, a, z)))
        floor = out[-1][0]
    return out


def token_places(tokens: list[str], cue: str, book: str) -> list[int]:
    """Place in the book's slice where each token of a cue begins; a token without letters has that of the one before."""
    at = list(range(len(cue) + 1)) if cue == book else align_positions(cue, book)
    out, done = [], 0
    for t in tokens:
        letters = sum(c.isalnum() for c in t)
        out.append(at[min(done, len(cue))] if letters or not out else out[-1])
        done += letters
    return out
