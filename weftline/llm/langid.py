"""Language identification by spans.

1. The script of each word, from code point ranges, narrows the languages that
   it can be in to those whose training text uses that script.
2. Each word gets one score per language: the sum of log-probabilities of its
   bytes' n-grams (word edges included) under that language.
3. Viterbi over the words of a text, with a penalty for each change of language,
   labels spans. The language with most letters in its spans is the text's.

Most texts are in one language. For these the path is known without the dynamic
programme: leaving the best language pays at least one penalty, so if no run of
words gains as much elsewhere, the constant path is the best one.

A letter is a code point of a Unicode category L; its script is told by the first
word of its Unicode name. Digits, marks, signs and punctuation are no letters.

Nulls and odd cases: a null text or one without a letter is ``und`` with score 0
and no spans; with nothing to learn from, everything is ``und``; languages tie by
name; rows without doc_id are not learned from; rows that repeat id and language
are learned from once, with the least of their texts; repeated rows are labelled
each. Empty input, empty result.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import code_points, flat_text, fold, small_batches, steps, word_hashes, words

BITS = 15
NGRAMS = (1, 2, 3, 4)
#: Scripts that words are told apart by, as the first word of their letters' Unicode names; all others are one more.
SCRIPTS = (
    "LATIN GREEK CYRILLIC ARMENIAN HEBREW ARABIC SYRIAC THAANA DEVANAGARI BENGALI GURMUKHI GUJARATI ORIYA TAMIL TELUGU KANNADA MALAYALAM SINHALA THAI LAO TIBETAN MYANMAR "
    "GEORGIAN HANGUL ETHIOPIC CHEROKEE CANADIAN KHMER MONGOLIAN HIRAGANA KATAKANA BOPOMOFO CJK YI JAVANESE TIFINAGH NKO"
).split()
_BIT = np.array([0, *(1 << k for k in range(len(SCRIPTS) + 1))], np.uint64)


@functools.cache
def script_table() -> np.ndarray:
    """By code point: 0 if it is no letter, else one more than the place of its script in SCRIPTS."""
    place, out = {name: k + 1 for k, name in enumerate(SCRIPTS)}, np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] == "L":
            name = unicodedata.name(chr(c), "").replace("FULLWIDTH ", "").replace("HALFWIDTH ", "")
            out[c] = place.get(re.split("[ -]", name)[0], len(SCRIPTS) + 1)
    return out


def letter_scripts(buf: np.ndarray, table: np.ndarray) -> np.ndarray:
    """At the first byte of each letter its entry in the table, 0 elsewhere (whole characters of UTF-8)."""
    at, points = code_points(buf)
    if at is None:
        return table[points]
    out = np.zeros(len(buf), np.uint8)
    out[at] = table[points]
    return out


def _slots(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slots of all n-grams of the words, edges marked by a space, and each word's first slot.

    The words are laid out as " word word word "; n-grams that would cross from
    one word into the next are left to slot 0, whose weight is 0.
    """
    size = ends - starts + 1  # with the space before
    at = np.cumsum(size) - size
    flat = np.full(int(size.sum()) + 5, 32, np.uint8)
    ink = np.ones(len(flat), bool)
    ink[at] = False
    ink[-5:] = False
    src = np.ones(len(buf), bool)
    if len(starts):
        mark = np.zeros(len(buf) + 1, np.int8)
        mark[starts] += 1
        np.subtract.at(mark, ends, 1)
        src = np.cumsum(mark[:-1], dtype=np.int8).astype(bool)
    low = buf[src]
    low = np.where((low >= 65) & (low <= 90), low + 32, low)
    flat[ink] = low
    n = len(flat) - 5
    word_end = np.repeat(at + size, size)  # the space after the word
    pos = np.arange(n)
    out = np.zeros((n, len(NGRAMS)), np.int64)
    x = np.zeros(n, np.uint32)
    for k, g in enumerate(NGRAMS):
        x = x | (flat[g - 1 : n + g - 1].astype(np.uint32) << np.uint32(8 * (g - 1)))
        y = (x + np.uint32(g)) * np.uint32(2654435761)
        y ^= y >> np.uint32(15)
        y *= np.uint32(2246822519)
        out[:, k] = np.where(pos + g <= word_end + 1, (y >> np.uint32(32 - BITS)).astype(np.int64) + 1 + (k << BITS), 0)
    return out, at


@dataclass
class LanguageModel:
    langs: list[str]
    weight: np.ndarray  # [slots, languages], log-probabilities; row 0 is 0
    scripts: np.ndarray  # [languages] mask of scripts seen
    table: np.ndarray  # scripts of code points
    penalty: float = 12.0
    impossible: float = -1e4

    def word_scores(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        slots, at = _slots(buf, starts, ends)
        total = self.weight[slots[:, 0]]
        for k in range(1, slots.shape[1]):
            total += self.weight[slots[:, k]]
        scores = np.add.reduceat(total, at, axis=0) if len(at) else total
        mask = np.bitwise_or.reduceat(np.append(_BIT[letter_scripts(buf, self.table)], np.uint64(0)), np.stack([starts, ends], 1).ravel())[::2] if len(starts) else np.zeros(0, np.uint64)
        fits = (mask[:, None] & self.scripts[None, :]) != 0
        fits |= ~fits.any(axis=1, keepdims=True)  # a script no language was seen with tells nothing
        return np.where(fits, scores, scores + self.impossible)


def viterbi(scores: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word, for all texts at once (word range of text d: first[d]:first[d+1])."""
    n_lang = scores.shape[1]
    path = np.zeros(len(scores), np.int64)
    hard = []
    for d in range(len(first) - 1):
        s = scores[first[d] : first[d + 1]]
        if not len(s):
            continue
        best = int(s.sum(axis=0).argmax())
        if n_lang > 1:
            c = np.concatenate([[0.0], np.cumsum((np.delete(s, best, 1) - s[:, best : best + 1]).max(axis=1))])
            if (c - np.minimum.accumulate(c)).max() >= penalty:
                hard.append(d)
                continue
        path[first[d] : first[d + 1]] = best
    if not hard:
        return path
    hard = np.array(hard)
    size = first[hard + 1] - first[hard]
    order = np.argsort(-size, kind="stable")
    at, size = first[hard][order], size[order]
    back = np.zeros(scores.shape, np.int16)
    stay = np.arange(n_lang)
    v = scores[at].astype(np.float64)
    live = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")  # texts with more than t words
    for t in range(1, int(size[0])):
        a = live[t]
        u = v[:a]
        top = u.argmax(axis=1)
        jump = u.max(axis=1)[:, None] - penalty
        back[at[:a] + t] = np.where(jump > u, top[:, None], stay)
        v[:a] = np.maximum(u, jump) + scores[at[:a] + t]
    now = v.argmax(axis=1)
    for t in range(int(size[0]) - 1, -1, -1):
        a = live[t]
        w = at[:a] + t
        path[w] = now[:a]
        now[:a] = back[w, now[:a]]
    return path


def train(rows: list[tuple[str, str]], penalty: float = 12.0) -> LanguageModel:
    """Add-half n-gram log-probabilities by language, a table for each n."""
    langs = sorted({lang for _, lang in rows})
    counts = np.zeros((len(NGRAMS) << BITS, len(langs)))
    scripts, table = np.zeros((len(langs), len(_BIT)), np.int64), script_table()
    for text, lang in rows:
        buf = np.frombuffer(text.encode(), np.uint8)
        starts, ends, _ = words(buf, np.array([0, len(buf)]))
        k = langs.index(lang)
        slots, _ = _slots(buf, starts, ends)
        counts[:, k] += np.bincount(slots.ravel(), minlength=len(counts) + 1)[1:]
        scripts[k] += np.bincount(letter_scripts(buf, table), minlength=len(_BIT))
    w = np.zeros((len(counts) + 1, len(langs)), np.float32)
    for k in range(len(NGRAMS)):
        part = counts[k << BITS : (k + 1) << BITS] + 0.5
        w[1 + (k << BITS) : 1 + ((k + 1) << BITS)] = np.log(part / part.sum(axis=0)) / len(NGRAMS)
    scripts[:, 0] = 0
    seen = scripts > 0.001 * np.maximum(1, scripts.sum(axis=1, keepdims=True))
    return LanguageModel(langs, w, np.where(seen, _BIT, np.uint64(0)).sum(axis=1, dtype=np.uint64), table, penalty)


def fit_languages(documents: DataFrame, max_rows: int = 1500, penalty: float = 12.0) -> LanguageModel:
    """Learn from at most ``max_rows`` ids with a language, outside the held-out fold, taken by a hash of their id."""
    rows = documents.select("doc_id", "text", "lang").where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", 4) != 2))
    picked = rows.select("doc_id", "lang").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "lang").limit(max_rows)
    texts = rows.join(F.broadcast(picked), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).toArrow()
    return train(list(zip(texts["text"].to_pylist(), texts["lang"].to_pylist(), strict=True)), penalty)


SPANS = "doc_id long, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>"


def label_languages(documents: DataFrame, model: LanguageModel) -> DataFrame:
    """Per row: doc_id, lang_pred, score (share of letters in that language's spans), spans in bytes of UTF-8."""
    spark = documents.sparkSession
    small_batches(spark, 4000)  # the dynamic programme runs over many texts at once
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            buf, offs = flat_text(b.column(1))
            got = [label(m, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in steps(offs, 16 << 20)]
            lang, score, spans = (sum((g[k] for g in got), []) for k in range(3))
            yield pa.RecordBatch.from_pydict(
                {"doc_id": b.column(0), "lang_pred": pa.array(lang, pa.string()), "score": pa.array(score, pa.float64()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))}
            )

    return documents.select("doc_id", "text").mapInArrow(run, SPANS)


def label(m: LanguageModel, buf: np.ndarray, offs: np.ndarray) -> tuple[list, list, list]:
    """Languages, scores and spans of some texts."""
    starts, ends, first = words(buf, offs)
    letters = np.concatenate([[0], np.cumsum(letter_scripts(buf, m.table) != 0)])
    weight = letters[ends] - letters[starts]
    if m.langs:
        scores = _scores(m, buf, starts, ends)
        path = viterbi(scores, first, m.penalty)
    lang, score, spans = [], [], []
    for d in range(len(offs) - 1):
        a, z = first[d], first[d + 1]
        if not m.langs or not weight[a:z].any():
            lang.append("und"), score.append(0.0), spans.append([])
            continue
        p = path[a:z]
        share = np.bincount(p, weights=weight[a:z], minlength=len(m.langs))
        k = int(share.argmax())
        lang.append(m.langs[k]), score.append(float(share[k] / share.sum()))
        cut = np.flatnonzero(np.diff(p)) + 1
        lo, hi = np.append(0, cut), np.append(cut, z - a)
        spans.append([{"start": int(starts[a + x] - offs[d]), "end": int(ends[a + y - 1] - offs[d]), "lang": m.langs[int(p[x])]} for x, y in zip(lo, hi, strict=True)])
    return lang, score, spans


def _scores(m: LanguageModel, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Scores of all words; each distinct word is scored once."""
    ids = np.concatenate([np.zeros(0, np.uint64)] + [word_hashes(buf[starts[p] : ends[q - 1]], starts[p:q] - starts[p], ends[p:q] - starts[p]) for p, q in _word_steps(starts, ends)])
    _, one, every = np.unique(ids, return_index=True, return_inverse=True)
    one_starts, one_ends = starts[one], ends[one]
    size = one_ends - one_starts
    at = np.cumsum(size + 1) - size - 1
    flat = np.full(int((size + 1).sum()), 32, np.uint8)
    put = np.arange(int(size.sum())) + np.repeat(np.arange(len(one)), size)
    flat[put] = buf[put + np.repeat(one_starts - at, size)]
    parts = [m.word_scores(flat[at[p] : at[q - 1] + size[q - 1]], at[p:q] - at[p], at[p:q] + size[p:q] - at[p]) for p, q in _word_steps(at, at + size)]
    return np.concatenate([np.zeros((0, len(m.langs)), np.float32), *parts])[every]


def _word_steps(starts: np.ndarray, ends: np.ndarray, limit: int = 1 << 18) -> Iterator[tuple[int, int]]:
    p = 0
    while p < len(starts):
        q = max(p + 1, int(np.searchsorted(ends, starts[p] + limit, "right")))
        yield p, q
        p = q
