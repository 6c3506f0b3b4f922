"""Numbers in arrays: argmax, normalising, levels in decibels, log-sum-exp, spectra."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax(v: Column) -> Column:
    """Place of the largest value, the first of equals, from 0; null for an empty array."""
    return F.when(F.size(v) > 0, F.array_position(v, F.array_max(v)) - 1)


def _sum(v: Column, f) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + f(x.cast("double")))


def normalize_wave(v: Column) -> Column:
    """(x - mean) / sqrt(population variance + 1e-5)."""
    mean = _sum(v, lambda x: x) / F.size(v)
    var = _sum(v, lambda x: x * x) / F.size(v) - mean * mean
    return F.transform(F.transform(v, lambda x: x.cast("double") - mean), lambda x: x / F.sqrt(F.greatest(var, F.lit(0.0)) + 1e-5))


def window_db(v: Column) -> Column:
    """20 log10 of the root mean square, not under -100."""
    rms = F.sqrt(_sum(v, lambda x: x * x) / F.size(v))
    return F.when(rms > 0, F.greatest(F.lit(-100.0), 20 * F.log10(rms))).otherwise(-100.0)


def frame_db(v: Column) -> Column:
    """10 log10 of the mean square, rounded and held in -100..-1."""
    power = _sum(v, lambda x: x * x) / F.size(v)
    return F.when(power > 0, F.least(F.lit(-1.0), F.greatest(F.lit(-100.0), F.round(10 * F.log10(power))))).otherwise(-100.0).cast("int")


def log_sum_exp(v: Column) -> Column:
    """Stable log of the sum of exponentials."""
    top = F.array_max(v).cast("double")
    return top + F.log(F.aggregate(v, F.lit(0.0), lambda acc, x: acc + F.exp(x.cast("double") - top)))


def noise_floor(p: Column, n: Column) -> Column:
    """p + 4 standard errors, at most 1."""
    return F.least(F.lit(1.0), p + 4 * F.sqrt(p * (1 - p) / n))


def mel_points(bins: int, low: float, high: float, scale: str) -> np.ndarray:
    """Edges of mel filters in Hz: ``kaldi`` (1127 ln(1 + f / 700)) or ``slaney`` (linear to 1 kHz, then logarithmic)."""
    if scale == "kaldi":
        to, back = lambda f: 1127 * np.log1p(f / 700), lambda m: 700 * np.expm1(m / 1127)
    else:
        step = np.log(6.4) / 27
        to = lambda f: np.where(f < 1000, f * 3 / 200, 15 + np.log(np.maximum(f, 1e-9) / 1000) / step)
        back = lambda m: np.where(m < 15, m * 200 / 3, 1000 * np.exp((m - 15) * step))
    return back(np.linspace(to(np.float64(low)), to(np.float64(high)), bins + 2))


def filterbank(wave: np.ndarray, rate: int = 16000) -> np.ndarray:
    """[frames, 80] log mel energies: 25 ms frames every 10 ms with edges reflected, mean removed, pre-emphasis 0.97, Povey window, 512 points, 20 Hz to 400 Hz under half the rate."""
    size, hop, points, bins = rate * 25 // 1000, rate // 100, 512, 80
    n = (len(wave) + hop // 2) // hop
    if not n:
        return np.zeros((0, bins), np.float32)
    at = np.arange(n)[:, None] * hop + hop // 2 - size // 2 + np.arange(size)[None, :]
    period = 2 * len(wave)
    at = np.mod(at, period)
    at = np.where(at >= len(wave), period - 1 - at, at)
    frames = wave[at].astype(np.float64)
    frames -= frames.mean(axis=1, keepdims=True)
    frames = np.concatenate([frames[:, :1] * (1 - 0.97), frames[:, 1:] - 0.97 * frames[:, :-1]], axis=1)
    frames *= (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / (size - 1))) ** 0.85
    power = np.abs(np.fft.rfft(frames, points)) ** 2
    mel = lambda f: 1127 * np.log1p(f / 700)
    edge = np.linspace(mel(20.0), mel(rate / 2 - 400.0), bins + 2)
    m = mel(np.arange(points // 2 + 1) * rate / points)
    up, down = (m[None, :] - edge[:-2, None]) / (edge[1:-1] - edge[:-2])[:, None], (edge[2:, None] - m[None, :]) / (edge[2:] - edge[1:-1])[:, None]
    bank = np.maximum(0, np.minimum(up, down))
    bank[:, -1] = 0
    return np.log(np.maximum(power @ bank.T, np.finfo(np.float32).eps)).astype(np.float32)


def normalized_mel(wave: np.ndarray, rate: int = 16000, bins: int = 80) -> np.ndarray:
    """[bins, frames]: pre-emphasis over the wave, centred 25 ms Hann frames in 512 points, area-normalised Slaney mel, log(e + 2**-24), each bin to mean 0 and sample deviation 1."""
    size, hop, points = rate * 25 // 1000, rate // 100, 512
    x = np.concatenate([wave[:1], wave[1:] - 0.97 * wave[:-1]]).astype(np.float64)
    n = len(x) // hop
    window = np.zeros(points)
    window[(points - size) // 2 : (points + size) // 2] = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(size) / (size - 1))
    padded = np.pad(x, points // 2)
    frames = padded[np.arange(n)[:, None] * hop + np.arange(points)[None, :]] * window
    power = np.abs(np.fft.rfft(frames, points)) ** 2
    edge = mel_points(bins, 0.0, rate / 2, "slaney")
    f = np.arange(points // 2 + 1) * rate / points
    bank = np.maximum(0, np.minimum((f - edge[:-2, None]) / (edge[1:-1] - edge[:-2])[:, None], (edge[2:, None] - f) / (edge[2:] - edge[1:-1])[:, None]))
    bank *= (2 / (edge[2:] - edge[:-2]))[:, None]
    out = np.log(power @ bank.T + 2.0**-24).T
    if n > 1:
        out = (out - out.mean(axis=1, keepdims=True)) / (out.std(axis=1, ddof=1, keepdims=True) + 1e-5)
    return out.astype(np.float32)
