"""Bytes of audio and subtitle files: PCM, WAV, movie boxes, energy frames, and times rewritten in place."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FRAME_MS = 20


class MediaError(ValueError):
    """Bytes that are not what they should be."""


def pcm_to_float(raw: bytes) -> np.ndarray:
    """Little-endian 16-bit samples as floats in [-1, 1)."""
    return np.frombuffer(raw[: len(raw) // 2 * 2], "<i2").astype(np.float32) / 32768


def float_to_wav(wave: np.ndarray, rate: int = 16000) -> bytes:
    """One channel of 16-bit samples, held in range, in a RIFF file."""
    data = np.clip(np.floor(np.asarray(wave, float) * 32768 + 0.5), -32768, 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", len(data)) + data


def boxes(raw: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(kind, first, end) of the boxes of a movie file; sizes of 64 bits and "to the end" included."""
    end = len(raw) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", raw, start)
        head = 8
        if size == 1:
            if start + 16 > end:
                raise MediaError("box is cut")
            size, head = struct.unpack_from(">Q", raw, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise MediaError("box leaves its parent")
        yield kind, start + head, start + size
        start += size


def movie_payload(raw: bytes) -> bytes:
    """Samples of a movie file with exactly one track: what its data boxes hold."""
    top = list(boxes(raw))
    tracks = sum(kind == b"trak" for _, a, z in (b for b in top if b[0] == b"moov") for kind, *_ in boxes(raw, a, z))
    if tracks != 1:
        raise MediaError(f"{tracks} tracks")
    return b"".join(raw[a:z] for kind, a, z in top if kind == b"mdat")


def energy_levels(wave: np.ndarray, rate: int = 16000) -> np.ndarray:
    """One level per 20 ms in dB, -100 to -1."""
    size = rate * FRAME_MS // 1000
    frames = np.asarray(wave, float)[: len(wave) // size * size].reshape(-1, size)
    power = (frames**2).mean(axis=1)
    db = 10 * np.log10(np.maximum(power, 1e-30))
    return np.clip(np.sign(db) * np.floor(np.abs(db) + 0.5), -100, -1).astype(np.int8)


def energy_timeline(files: DataFrame, durations: DataFrame) -> DataFrame:
    """files(book_id, file_id, content) of level bytes and durations(book_id, file_id, ms) into (book_id, frame, db): files end to end at their durations, what a missing file would hold is absent."""
    at = F.coalesce(F.sum(F.expr(f"ms div {FRAME_MS}")).over(Window.partitionBy("book_id").orderBy("file_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    frames = files.select("book_id", "file_id", F.posexplode(F.regexp_extract_all(F.hex("content"), F.lit("(..)"), F.lit(1))).alias("k", "h"))
    db = F.conv("h", 16, 10).cast("int")
    placed = durations.withColumn("wl_at", at).join(frames, ["book_id", "file_id"]).where(F.col("k") < F.expr(f"ms div {FRAME_MS}"))
    return placed.select("book_id", (F.col("wl_at") + F.col("k")).alias("frame"), F.when(db > 127, db - 256).otherwise(db).alias("db"))


def pcm_chunks(files: DataFrame, seconds: int = 600, rate: int = 16000) -> DataFrame:
    """(path, start_sample, samples) of raw 16-bit files, chunk by chunk without gap or overlap."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, raw in zip(b["path"], b["content"], strict=True):
                wave, step = pcm_to_float(bytes(raw)), seconds * rate
                for at in range(0, len(wave), step):
                    yield pd.DataFrame({"path": [path], "start_sample": [at], "samples": [wave[at : at + step]]})

    return files.select("path", "content").mapInPandas(run, "path string, start_sample long, samples array<float>")


def decode_arguments(path: str, start_s: float, seconds: float, rate: int = 16000, pre_roll: float = 2.0) -> list[str]:
    """Arguments of an external decoder for one chunk: a rough seek before the input, the rest exactly after it."""
    rough = max(0.0, start_s - pre_roll)
    seek = ["-ss", f"{rough:.3f}"] if rough > 0 else []
    fine = ["-ss", f"{start_s - rough:.3f}"] if start_s > rough else []
    return ["-nostdin", "-v", "error", *seek, "-i", path, *fine, "-t", f"{seconds:.3f}", "-vn", "-ac", "1", "-ar", str(rate), "-f", "s16le", "-"]


ARROW = re.compile(r"^[ \t]*((?:\d+:)?\d{1,2}:\d{1,2}[.,]\d{1,3})([ \t]*-->[ \t]*)((?:\d+:)?\d{1,2}:\d{1,2}[.,]\d{1,3})")
DIALOGUE = re.compile(r"^(Dialogue|Comment):[ \t]*[^,\n]*,[ \t]*(\d+:\d{1,2}:\d{1,2}\.\d{1,3})([ \t]*,[ \t]*)(\d+:\d{1,2}:\d{1,2}\.\d{1,3})")
STAMP = re.compile(r"^(?:(\d+):)?(\d{1,2}):(\d{1,2})([.,])(\d{1,3})$")


def read_stamp(s: str) -> int:
    h, m, sec, _, f = STAMP.match(s).groups()
    return int(h or 0) * 3_600_000 + int(m) * 60_000 + int(sec) * 1000 + int(f.ljust(3, "0"))


def write_stamp(ms: int, like: str) -> str:
    """In the layout of ``like``, rounded to its digits of fraction."""
    h, m, sec, sign, f = STAMP.match(like).groups()
    unit = 10 ** (3 - len(f))
    ms = (ms + unit // 2) // unit * unit
    hours = f"{ms // 3_600_000:0{len(h or '')}d}:" if h is not None or ms >= 3_600_000 else ""
    return f"{hours}{ms // 60_000 % 60:0{len(m)}d}:{ms // 1000 % 60:0{len(sec)}d}{sign}{ms % 1000 // unit:0{len(f)}d}"


@dataclass
class TimedLine:
    """Where a cue's two stamps stand in a text, and the block of text that is the cue's."""

    start: tuple[int, int]
    end: tuple[int, int]
    block: tuple[int, int]
    start_ms: int
    end_ms: int


def timed_lines(text: str) -> list[TimedLine]:
    """Cues of an SRT, WebVTT or ASS text. With arrows a number line above belongs to the cue, and its block runs through the blank lines behind it, up to the next cue's first line."""
    ass = re.search(r"(?im)^\s*\[events\]", text)
    out: list[TimedLine] = []
    lines, at = [], 0
    for line in text.splitlines(keepends=True):
        lines.append((at, line))
        at += len(line)
    first = []
    for k, (pos, line) in enumerate(lines):
        m = (DIALOGUE if ass else ARROW).match(line)
        if not m or (ass and pos < ass.start()):
            continue
        g = (2, 4) if ass else (1, 3)
        above = not ass and k > 0 and re.match(r"^\s*\d+\s*$", lines[k - 1][1])
        first.append(lines[k - 1][0] if above else pos)
        out.append(TimedLine((pos + m.start(g[0]), pos + m.end(g[0])), (pos + m.start(g[1]), pos + m.end(g[1])), (first[-1], pos + len(line)), read_stamp(m[g[0]]), read_stamp(m[g[1]])))
    if not ass:
        for k, x in enumerate(out):
            x.block = (x.block[0], first[k + 1] if k + 1 < len(out) else len(text))
    return out


def retime_text(text: str, breaks: list[float], offsets: list[float]) -> str:
    """Every stamp moved by the offset (seconds) of its place; all else stays as it was to the byte. Cues inside a stretch that the target does not have, or that would end at or before 0, go with their block."""
    if all(o == 0 for o in offsets):
        return text
    out, at = [], 0
    gone = [(b, b + x - y) for b, x, y in zip(breaks, offsets, offsets[1:]) if y < x]
    lines = timed_lines(text)
    if any(a.block[1] > b.block[0] for a, b in zip(lines, lines[1:])):
        return text  # blocks that overlap cannot be told apart
    for x in lines:
        shift = int(offsets[int(np.searchsorted(breaks, x.start_ms / 1000, "right"))] * 1000)
        if any(a <= x.start_ms / 1000 < z for a, z in gone) or x.end_ms + shift <= 0:
            out.append(text[at : x.block[0]])
            at = x.block[1]
            continue
        out += [text[at : x.start[0]], write_stamp(max(0, x.start_ms + shift), text[slice(*x.start)]), text[x.start[1] : x.end[0]], write_stamp(x.end_ms + shift, text[slice(*x.end)])]
        at = x.end[1]
    out.append(text[at:])
    return "".join(out)


def retime_bytes(raw: bytes, breaks: list[float], offsets: list[float]) -> bytes:
    """As ``retime_text`` on bytes: UTF-16 by its mark, anything else byte for byte."""
    for mark, name in ((b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be")):
        if raw.startswith(mark):
            return mark + retime_text(raw[2:].decode(name), breaks, offsets).encode(name)
    return retime_text(raw.decode("latin-1"), breaks, offsets).encode("latin-1")


def retime_files(files: DataFrame) -> DataFrame:
    """(path, content, breaks, offsets) into (path, content) with the times moved."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"path": b["path"], "content": [retime_bytes(bytes(c), list(k), list(o)) for c, k, o in zip(b["content"], b["breaks"], b["offsets"], strict=True)]})

    return files.select("path", "content", "breaks", "offsets").mapInPandas(run, "path string, content binary")


def alignable_starts(lines: DataFrame) -> DataFrame:
    """(keys..., start_s) of timed lines that count as evidence: 250 ms or more, and text that shows."""
    shown: Column = F.trim(F.regexp_replace("text", r"\{[^}]*\}|<[^>]*>|\\[Nnh]", ""))
    return lines.where((F.col("end_ms") - F.col("start_ms") >= 250) & (shown != "")).withColumn("start_s", F.col("start_ms") / 1000)
