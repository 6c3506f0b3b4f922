"""BPE encoding and decoding with the vocabulary file of a public tokenizer.

A word keeps its parts and the ranks of adjacent pairs in two short contiguous
arrays: scan for the smallest rank, join that pair by deleting one boundary,
refresh the two neighbouring ranks, until no pair has a rank. The arrays of many
words of about one length are the rows of a matrix and take their steps together.
Words of more than ``LONG`` parts take the same merges in the same order from a
heap, in n log n.

The file's own rules come first: special tokens are cut out of the raw text;
what is between is put in NFC, white space folded, lower-cased, cut into words.
None of these look past white space, so results are kept by the pieces between
ASCII white space, in a table with a bounded number of entries.

Nulls and odd cases: a null or empty text has no tokens and decodes to "";
repeated rows are encoded each; a null doc_id is kept; a character whose byte has
no token is dropped, as the file has no unknown token. Empty input, empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

from .common import small_batches, trimmed

LONG = 200
NONE = (1 << 31) - 1


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if printable in Latin-1, else the next free one from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(free)) for b in range(256)]


class PairRanks:
    """Ranks of pairs of ids for whole arrays: open addressing, no empty probe is longer than the longest run."""

    def __init__(self, pairs: dict[int, int]):
        self.bits = max(4, (len(pairs) * 4).bit_length())
        keys = np.full(1 << self.bits, -1, np.int64)
        rank = np.full(1 << self.bits, NONE, np.int32)
        todo_k, todo_r = np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int32)
        self.keys, self.rank, self.probes = keys, rank, 0
        at = self._slot(todo_k)
        while len(todo_k):
            self.probes += 1
            free = np.flatnonzero(keys[at] == -1)
            _, first = np.unique(at[free], return_index=True)
            took = np.zeros(len(at), bool)
            took[free[first]] = True
            keys[at[took]], rank[at[took]] = todo_k[took], todo_r[took]
            todo_k, todo_r, at = todo_k[~took], todo_r[~took], (at[~took] + 1) & (len(keys) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.int64) << 32) | b
        at = self._slot(key)
        out = np.where(self.keys[at] == key, self.rank[at], NONE)
        left = np.flatnonzero((out == NONE) & (self.keys[at] != -1))
        for _ in range(self.probes - 1):
            if not len(left):
                break
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            k = self.keys[at[left]]
            hit = k == key[left]
            out[left[hit]] = self.rank[at[left[hit]]]
            left = left[~hit & (k != -1)]
        return out


class WordBPE:
    """Tokenizer of the kind "BPE with word ends"; the file says its vocabulary, merges, words and special tokens."""

    def __init__(self, path: str, most: int = 200_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t.encode() for t, i in (self.vocab | self.special).items()}
        end = model["end_of_word_suffix"] or ""
        self.pairs: dict[int, int] = {}
        joined = []
        for k, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs.setdefault(self.vocab[a] << 32 | self.vocab[b], k)
            joined.append(self.vocab[a + b])
        self.ranks, self.joined = PairRanks(self.pairs), np.array(joined, np.int32)
        self.inner = np.array([self.vocab.get(c, -1) for c in byte_letters()], np.int32)
        self.last = np.array([self.vocab.get(c + end, -1) for c in byte_letters()], np.int32)
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word = regex.compile(split)
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.most = most
        self.words: dict[str, bytes] = {}
        self.pieces: dict[bytes, bytes] = {}

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words end to end, where each word's ids begin, and the end), many words at a time: row by row the parts of a word and the ranks of its neighbours."""
        raw = [w.encode() for w in words]
        size = np.array([len(x) for x in raw], np.int64)
        end = np.cumsum(size)
        flat = np.frombuffer(b"".join(raw), np.uint8)
        ids = self.inner[flat]
        ids[end - 1] = self.last[flat[end - 1]]
        if (ids < 0).any():  # bytes without a token are dropped
            keep = ids >= 0
            end = np.cumsum(keep)[end - 1]
            size, ids = np.diff(end, prepend=0), ids[keep]
        start = end - size
        out = np.zeros_like(ids)  # a word's result is never longer than its start
        left = np.zeros(len(words), np.int64)
        for low, high in ((0, 8), (8, 16), (16, 32), (32, 64), (64, LONG)):
            rows = np.flatnonzero((size > low) & (size <= high))
            for group in np.array_split(rows, len(rows) * high // 500_000 + 1):
                if len(group):
                    self._merge_rows(ids, start[group], size[group], high, group, out, left)
        for k in np.flatnonzero(size > LONG):
            got = self._merge_long(ids[start[k] : end[k]].tolist())
            out[start[k] : start[k] + len(got)], left[k] = got, len(got)
        first = np.concatenate([[0], np.cumsum(left)])
        pick = np.arange(first[-1]) + np.repeat(start - first[:-1], left)
        return out[pick], first

    def _merge_rows(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray, width: int, group: np.ndarray, out: np.ndarray, left: np.ndarray) -> None:
        place = np.arange(width + 1)
        there = place < size[:, None]
        ids = np.where(there, flat[np.minimum(start[:, None] + place, len(flat) - 1)], -1).astype(np.int32)
        ranks = np.full((len(group), width), NONE, np.int32)
        pair = there[:, 1:]
        ranks[pair] = self.ranks(ids[:, :-1][pair], ids[:, 1:][pair])
        row, col, size = np.arange(len(group)), np.arange(width), size.copy()
        while len(row):
            i = ranks.argmin(axis=1)
            low = ranks[np.arange(len(row)), i]
            done = low == NONE
            if done.any():
                n = size[done]
                at = np.repeat(start[row[done]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                out[at] = ids[done][place < n[:, None]]
                left[group[row[done]]] = n
                go = ~done
                row, ids, ranks, size, i, low = row[go], ids[go], ranks[go], size[go], i[go], low[go]
                if not len(row):
                    return
            n = np.arange(len(row))
            ids[n, i] = new = self.joined[low]
            after = col >= i[:, None]  # the boundary behind place i goes; what follows moves up
            ranks[:, :-1] = np.where(after[:, :-1], ranks[:, 1:], ranks[:, :-1])
            ranks[:, -1] = NONE
            ids[:, 1:-1] = np.where(after[:, :-1], ids[:, 2:], ids[:, 1:-1])
            ids[:, -1] = -1
            size = size - 1
            k = np.flatnonzero(i > 0)
            ranks[k, i[k] - 1] = self.ranks(ids[k, i[k] - 1], new[k])
            k = np.flatnonzero(i + 1 < size)
            ranks[k, i[k]] = self.ranks(new[k], ids[k, i[k] + 1])

    def _merge_long(self, ids: list[int]) -> np.ndarray:
        n, get = len(ids), self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 32 | ids[i + 1], NONE)) < NONE]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue  # one of the two has gone into another part
            ids[i], ids[j], after[i] = int(self.joined[r]), -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (q := get(ids[k] << 32 | ids[after[k]], NONE)) < NONE:
                    heapq.heappush(heap, (q, k, ids[k], ids[after[k]]))
        return np.array([i for i in ids if i >= 0], np.int32)

    def _parts(self, piece: bytes) -> list[str]:
        """Words and special tokens of what stands between white space."""
        text = piece.decode()
        if text.isascii() and "<" not in text:
            return self.word.findall(text.lower())
        out: list[str] = []
        for part in self.cut.split(text) if "<" in text else (text,):
            if part in self.special:
                out.append(part)
            else:
                out += self.word.findall(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
        return out

    def learn(self, pieces: set[bytes]) -> None:
        """Put pieces into the table, which starts afresh when full."""
        if len(self.pieces) + len(pieces) > self.most:
            self.pieces.clear(), self.words.clear()
        if not self.words:
            self.words |= {t: i.to_bytes(4, "little") for t, i in self.special.items()}
        parts = {p: self._parts(p) for p in pieces}
        new = list({w for x in parts.values() for w in x} - self.words.keys())
        if new:
            ids, first = self.merge(new)
            raw = ids.astype("<i4").tobytes()
            for w, a, z in zip(new, first.tolist(), first[1:].tolist()):
                self.words[w] = raw[4 * a : 4 * z]
        known = self.words
        for p, x in parts.items():
            self.pieces[p] = known[x[0]] if len(x) == 1 else b"".join([known[w] for w in x])

    def encode_ids(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, little-endian, 32 bits each."""
        known = self.pieces
        lists = [t.split() for t in texts]
        new = {p for x in lists for p in x if p not in known}
        if len(new) + len(known) > self.most:  # as if the table had been empty
            new = {p for x in lists for p in x}
        self.learn(new)
        return [b"".join([known[p] for p in x]) for x in lists]

    def encode_texts(self, texts: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Ids and the text that they decode to."""
        return [(x, self.decode(np.frombuffer(x, "<i4"))) for x in self.encode_ids(texts)]

    def decode(self, ids: np.ndarray) -> bytes:
        """Tokens of the ids joined by spaces, as the file names no decoder; an id that the file lacks is a KeyError."""
        return b" ".join([self.names[i] for i in ids.tolist()])


_loaded: dict[str, WordBPE] = {}


def tokenizer(path: str) -> WordBPE:
    """One per worker process."""
    if path not in _loaded:
        _loaded[path] = WordBPE(path)
    return _loaded[path]


def encode_documents(documents: DataFrame, path: str, ids: bool = True, digests: bool = False, text: str = "text") -> DataFrame:
    """All columns of ``documents`` (or only doc_id without ``ids``) and n_tokens, token_ids (with ``ids``),
    ids_sha256 and decoded_sha256, the digest of the text that the ids decode to (with ``digests``).

    ``path`` is read on each machine that runs tasks.
    """
    small_batches(documents.sparkSession)
    df = documents if ids else documents.select("doc_id", text)
    made = ("n_tokens", "token_ids", "ids_sha256", "decoded_sha256")
    at, keep = df.columns.index(text), [c for c in df.columns if c not in made] if ids else ["doc_id"]
    places = [df.columns.index(c) for c in keep]
    schema = df.select(*keep).schema.add("n_tokens", "long")
    if ids:
        schema = schema.add("token_ids", ArrayType(IntegerType()))
    if digests:
        schema = schema.add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        sha = hashlib.sha256
        for b in batches:
            got = bpe.encode_ids([t.encode() if t else b"" for t in b.column(at).to_pylist()])
            out = [b.column(k) for k in places] + [pa.array([len(x) // 4 for x in got], pa.int64())]
            if ids:
                offs = [0]
                for x in got:
                    offs.append(offs[-1] + len(x) // 4)
                flat = pa.Array.from_buffers(pa.int32(), offs[-1], [None, pa.py_buffer(b"".join(got))])
                out.append(pa.ListArray.from_arrays(pa.array(offs, pa.int32()), flat))
            if digests:
                out += [pa.array([sha(x).hexdigest() for x in got], pa.string()), pa.array([sha(bpe.decode(np.frombuffer(x, "<i4"))).hexdigest() for x in got], pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return df.mapInArrow(trimmed(run), schema)


def decode_documents(encoded: DataFrame, path: str, ids: str = "token_ids") -> DataFrame:
    """doc_id and decoded, the text of the ids; null ids decode to ""."""
    small_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for b in batches:
            texts = [bpe.decode(np.array(x or [], np.int32)).decode() for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    return encoded.select("doc_id", ids).mapInArrow(trimmed(run), "doc_id long, decoded string")
