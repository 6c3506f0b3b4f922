"""Language-model scoring by context-tree weighting, beside a unigram base.

A byte is eight binary decisions. Each decision (the bits so far) has its own
tree of contexts: the last 0, 1, ... ``depth`` bytes themselves. Every node keeps
zeros and ones over all learning texts and a Krichevsky-Trofimov estimate; the
weighted probability of a node mixes its own estimate, one half, with that of
its children, down to ``depth``. A text's score is the sum over its bytes and a
byte 0 that ends it; before its first byte a text has seen bytes 27.

A cell is a context of ``depth`` bytes and the byte after it, exact in one 64-bit
number (``depth`` 2 to 6). Cells are counted sparsely, by a shuffle, so their
number grows with the corpus, and so do the nodes. Nodes of two and more bytes
are weighed in the partition that holds all contexts ending in the same two
bytes; of those above, 256 * 511 sums go to the driver, at any size. A task holds
the cells of one such ending. Cells that only texts not learned from have are
counted as zero, so every byte of every text finds its cell.

Words and cells are looked up alike. The most frequent, ``HEAD`` words and
``CELL_HEAD`` cells at most, are broadcast and looked up in place; all others
(a few per cent of occurrences) are joined. Words are grouped by a 64-bit hash.

Nulls and odd cases: a null or empty text is only its end; with no learning
texts all counts are 0 (base: log10(1/1) per token; model: 1/2 per decision);
a null doc_id counts as empty text in the fold rule; repeated rows count and are
scored each. Empty input, empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, flat_text, fold, mix, small_batches, steps, word_hashes, words

HEAD = 1 << 18
CELL_HEAD = 1 << 20
DEPTH, WIDTH = 3, 256
TOP = 2  # bytes of context that place a node in a partition
END = np.uint64(1)  # the hash of the end token; a word takes this value once in 2**64
CLASS = np.arange(WIDTH)  # what a byte is as context: itself
START = 27


def cells(buf: np.ndarray, offs: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The cell of every byte of the texts and their ends, the nearest byte of context highest, the byte itself lowest; and the first index of each text."""
    n = len(offs) - 1
    at = offs + np.arange(n + 1)  # one end byte after each text
    flat = np.zeros(len(buf) + n, np.uint8)
    ink = np.ones(len(flat), bool)
    ink[at[1:] - 1] = False
    flat[ink] = buf
    out = flat.astype(np.int64)
    for d in range(1, depth + 1):
        back = np.full(len(flat), START, np.int64)
        back[d:] = flat[:-d] if d < len(flat) else 0
        for k in range(d):  # the first d bytes of a text see what stands for its start
            p = at[:-1] + k
            back[p[p < at[1:]]] = START
        out += back << 8 * (depth - d + 1)
    return out, at


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series from 8 on, the recurrence below."""
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift[low] += np.log(y[low])
        y[low] += 1
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def kt_block(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    out = np.zeros(zeros.shape)
    some = (zeros + ones) > 0
    a, b = zeros[some].astype(float), ones[some].astype(float)
    out[some] = log_gamma(a + 0.5) + log_gamma(b + 0.5) - np.log(np.pi) - log_gamma(a + b + 1)
    return out


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    k, c = np.concatenate([np.zeros(0, np.int64), *keys]), np.concatenate([np.zeros(0, np.int64), *counts])
    if not len(k):
        return k, c
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    return k[first], np.add.reduceat(c, first)


def mixed(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log weighted probability, weight of the own estimate, own estimate of a one) of nodes from the logs of their children."""
    mine = np.log(0.5) + kt_block(zeros, ones)
    total = np.logaddexp(mine, np.log(0.5) + below)
    return total, np.exp(mine - total), (ones + 0.5) / (zeros + ones + 1)


def weigh_block(keys: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of whole endings of ``TOP`` bytes, cells sorted: the probability of each cell's eight bits, mixed from
    ``depth`` up to ``TOP`` bytes (float32 [cells, 8]), and what the nodes above need: slots and values to sum.

    Slot of (last byte, bits so far): last byte * 512 + bits so far after a leading 1, for the log
    probabilities; last byte * 512 + 256 + byte for the counts.
    """
    p = np.empty((len(keys), 8))
    sub, n, home = keys, counts, np.arange(len(keys))  # cells of depth d, and the one of each cell
    logs: list = [None] * 8  # by bits known: (first cell of each node, log probability of each)
    slots, sums = [], []
    for d in range(depth, TOP - 1, -1):
        if d < depth:
            short = (sub >> 16 << 8) | (sub & 255)  # the farthest byte goes
            sub, up = np.unique(short, return_inverse=True)
            n = np.bincount(up, n, len(sub)).astype(np.int64)
            home = up[home]
        for level in range(8):
            node = sub >> 8 - level
            new = np.append(True, node[1:] != node[:-1])
            first, place = np.flatnonzero(new), np.cumsum(new) - 1
            bit = sub >> 7 - level & 1
            ones = np.add.reduceat(n * bit, first)
            zeros = np.add.reduceat(n, first) - ones
            if d == depth:
                log, own = kt_block(zeros, ones), (ones + 0.5) / (zeros + ones + 1)
                p[:, level] = np.where(bit == 1, own[place], 1 - own[place])
            else:
                kids, log = logs[level]
                log, share, own = mixed(zeros, ones, np.bincount(place[up[kids]], log, len(first)))
                seen, at = bit[home] == 1, place[home]
                p[:, level] = share[at] * np.where(seen, own[at], 1 - own[at]) + (1 - share[at]) * p[:, level]
            logs[level] = first, log
    for level, (first, log) in enumerate(logs):
        slots.append((sub[first] >> 8 * TOP) * 512 + (1 << level | (sub[first] & 255) >> 8 - level)), sums.append(log)
    slots.append((sub >> 8 * TOP) * 512 + 256 + (sub & 255)), sums.append(n)
    slots, sums = np.concatenate(slots), np.concatenate(sums).astype(float)
    u, at = np.unique(slots, return_inverse=True)
    return p.astype(np.float32), u, np.bincount(at, sums)


def bit_counts(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Zeros and ones at each of the 256 bit prefixes (0 is unused) from counts of bytes in the last axis."""
    heap = np.zeros((*counts.shape[:-1], 512), counts.dtype)
    heap[..., 256:] = counts
    for p in range(255, 0, -1):
        heap[..., p] = heap[..., 2 * p] + heap[..., 2 * p + 1]
    return heap[..., 0:512:2], heap[..., 1:512:2]


def weigh_top(sums: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(weight, own estimate of a one) of the nodes of one byte [256, 256] and of none [256], from the summed slots."""
    sums = sums.reshape(WIDTH, 2, 256)
    counts, below = sums[:, 1].astype(np.int64), sums[:, 0]
    log, *one = mixed(*bit_counts(counts), below)
    _, *none = mixed(*bit_counts(counts.sum(axis=0)), log.sum(axis=0))
    return [tuple(one), tuple(none)]


def whole_endings(batches: Iterator[pa.RecordBatch], depth: int, least: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(keys, counts) of sorted rows in blocks that hold whole endings."""
    keys, counts, held = [], [], 0

    for b in batches:
        k, c = b.column(0).to_numpy(), b.column(1).to_numpy()
        if not len(k):
            continue
        keys.append(k), counts.append(c)
        held += len(k)
        if held >= least:
            k, c = np.concatenate(keys), np.concatenate(counts)
            ending = k >> 8 * (depth - TOP + 1)
            cut = int(np.searchsorted(ending, ending[-1]))
            if cut:
                yield k[:cut], c[:cut]
            keys, counts, held = [k[cut:]], [c[cut:]], len(k) - cut
    if held:
        yield np.concatenate(keys), np.concatenate(counts)


class Places:
    """Where numbers stand in an array of distinct ones, for whole arrays: open addressing."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, (len(keys) * 4).bit_length())
        self.keys, self.place, self.probes = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32), 0
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            self.probes += 1
            free = np.flatnonzero(self.keys[at] == -1)
            _, first = np.unique(at[free], return_index=True)
            took = np.zeros(len(at), bool)
            took[free[first]] = True
            self.keys[at[took]], self.place[at[took]] = keys[todo[took]], todo[took]
            todo, at = todo[~took], (at[~took] + 1) & (len(self.keys) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (mix(key.view(np.uint64)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, key: np.ndarray) -> np.ndarray:
        """The place of each key, -1 where there is none."""
        at = self._slot(key)
        there = self.keys[at]
        out = np.where(there == key, self.place[at], -1)
        left = np.flatnonzero((there != key) & (there != -1))
        for _ in range(self.probes - 1):
            if not len(left):
                break
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            k = self.keys[at[left]]
            hit = k == key[left]
            out[left[hit]] = self.place[at[left[hit]]]
            left = left[~hit & (k != -1)]
        return out


@dataclass
class Model:
    cells: np.ndarray  # the most frequent cells
    cell_log: np.ndarray  # log10 P
    head: np.ndarray  # sorted hashes of the most frequent words
    head_log: np.ndarray  # log10(count + 1)


_places: list[tuple[Model, Places]] = []  # of the last model this worker process met


def count_corpus(documents: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(kind, key, n): kind 0 words and ends by hash, kind 1 cells, over learned rows; cells of other rows count 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, held = [], [], 0
        for b in batches:
            buf, offs = flat_text(b.column(0))
            learned = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            hashes = []
            for i, j in steps(offs):
                bb, o = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                at, first = cells(bb, o, depth)
                mine = np.repeat(learned[i:j], np.diff(first))
                u, c = np.unique(at[mine], return_counts=True)
                rest = np.unique(at[~mine])
                keys += [u, rest]
                counts += [c, np.zeros(len(rest), np.int64)]
                held += len(u) + len(rest)
                if held > 1 << 21:
                    k, c = summed(keys, counts)
                    keys, counts, held = [k], [c], len(k)
                    if held > 1 << 20:
                        yield from _parts(1, k, c)
                        keys, counts, held = [], [], 0
                s, e, w = words(bb, o)
                h = word_hashes(bb, s, e)
                hashes.append(h[np.repeat(learned[i:j], np.diff(w))])
            u, c = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]), return_counts=True)
            yield _rows(0, u.view(np.int64), c)
            if learned.any():
                yield _rows(0, np.array([END]).view(np.int64), np.array([learned.sum()]))
        yield from _parts(1, *summed(keys, counts))

    return documents.select("text", "learned").mapInArrow(run, "kind tinyint, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _parts(kind: int, key: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(key), 1 << 18):
        yield _rows(kind, key[k : k + (1 << 18)], n[k : k + (1 << 18)])


def _rows(kind: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int8)), pa.array(key.astype(np.int64)), pa.array(n.astype(np.int64))], names=["kind", "key", "n"])


def weigh(counts: DataFrame, depth: int, scratch: Scratch) -> DataFrame:
    """(key, n, log): log10 P(byte | context) of every cell."""
    spark = counts.sparkSession

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, c in whole_endings(batches, depth):
            p, slots, sums = weigh_block(k, c, depth)
            for x in range(0, len(k), 1 << 16):
                q = p[x : x + (1 << 16)]
                yield pa.RecordBatch.from_pydict({
                    "kind": pa.array(np.ones(len(q), np.int8)), "key": pa.array(k[x : x + (1 << 16)]), "n": pa.array(c[x : x + (1 << 16)]), "value": pa.nulls(len(q), pa.float64()),
                    "bits": pa.array([r.tobytes() for r in q], pa.binary()),
                })
            yield pa.RecordBatch.from_pydict({"kind": pa.array(np.zeros(len(slots), np.int8)), "key": pa.array(slots), "n": pa.nulls(len(slots), pa.int64()), "value": pa.array(sums), "bits": pa.nulls(len(slots), pa.binary())})

    ending = F.shiftright("key", 8 * (depth - TOP + 1))
    tree = counts.where("kind = 1").select("key", "n").repartition(ending).sortWithinPartitions("key").mapInArrow(up, "kind tinyint, key long, n long, value double, bits binary")
    tree = scratch.keep(tree, "tree")
    sums = np.zeros(WIDTH * 512)
    top = tree.where("kind = 0").groupBy("key").agg(F.sum("value").alias("value")).toArrow()
    sums[top["key"].to_numpy()] = top["value"].to_numpy()
    shared = spark.sparkContext.broadcast(weigh_top(sums))

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (share1, own1), (share0, own0) = shared.value
        for b in batches:
            k = b.column(0).to_numpy()
            p = np.frombuffer(b"".join(b.column(2).to_pylist()), np.float32).reshape(-1, 8).astype(float)
            last, byte, log = k >> 8 * depth, k & 255, np.zeros(len(k))
            for level in range(8):
                q, seen = 1 << level | byte >> 8 - level, (byte >> 7 - level & 1) == 1
                x = p[:, level]
                for share, own in ((share1[last, q], own1[last, q]), (share0[q], own0[q])):
                    x = share * np.where(seen, own, 1 - own) + (1 - share) * x
                log += np.log10(x)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(log)], names=["key", "n", "log"])

    return scratch.keep(tree.where("kind = 1").select("key", "n", "bits").mapInArrow(down, "key long, n long, log double"), "cells")


def frequent(sizes: list[tuple[int, int]], most: int) -> int:
    """The least size class that, with all above it, has at most ``most`` members, from (class, members) of all."""
    floor, held = 1 << 20, 0
    for size, k in sorted(sizes, reverse=True):
        if held + k > most:
            break
        floor, held = size, held + k
    return floor


def tally(keys: np.ndarray, owner: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys of each row, how often each, and where the keys of the rows i..j end."""
    order = np.lexsort((keys, owner))
    owner, keys = owner[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    new = np.flatnonzero(new)
    return keys[new], np.diff(np.append(new, len(keys))), np.searchsorted(owner[new], np.arange(i, j), "right")


def score_texts(documents: DataFrame, learn, name: str = "lm", depth: int = DEPTH) -> DataFrame:
    """Score every row of ``documents``; rows where the condition ``learn`` holds are learned from.

    Returns doc_id, learned, n_tokens, n_known, train_tokens, base_score, score
    (log10 probabilities) and bits_per_byte (the code length).
    """
    if not TOP <= depth <= 6:
        raise ValueError("depth is 2 to 6")
    spark = documents.sparkSession
    small_batches(spark, 4000)
    scratch = Scratch(spark, name)
    docs = documents.select("doc_id", "text", F.coalesce(learn, F.lit(False)).alias("learned"))
    counts = scratch.keep(count_corpus(docs, depth), "counts")
    tree = weigh(counts, depth, scratch).withColumn("size", F.floor(F.log2(F.col("n") + 1) * 8))
    cell_floor = frequent([(r["size"], r["k"]) for r in tree.groupBy("size").agg(F.count("*").alias("k")).collect()], CELL_HEAD)
    near = tree.where(F.col("size") >= cell_floor).select("key", "log").toArrow()
    vocab = counts.where("kind = 0").select("key", "n", F.floor(F.log2("n") * 8).alias("size"))
    sizes = [(r["size"], r["k"], r["s"]) for r in vocab.groupBy("size").agg(F.count("*").alias("k"), F.sum("n").alias("s")).collect()]
    total, distinct = sum(s for *_, s in sizes), sum(k for _, k, _ in sizes)
    floor = frequent([x[:2] for x in sizes], HEAD)
    head = vocab.where(F.col("size") >= floor).select("key", "n").toArrow()
    keys, logs = head["key"].to_numpy().view(np.uint64), np.log10(head["n"].to_numpy() + 1.0)
    order = np.argsort(keys)
    shared = spark.sparkContext.broadcast(Model(near["key"].to_numpy(), near["log"].to_numpy(), keys[order], logs[order]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, row = shared.value, TaskContext.get().partitionId() << 36
        if not _places or _places[0][0] is not m:
            _places[:] = [(m, Places(m.cells))]
        find = _places[0][1]
        for b in batches:
            buf, offs = flat_text(b.column(1))
            n = len(b)
            lm, known, base, size = np.zeros(n), np.zeros(n, np.int64), np.zeros(n), np.zeros(n, np.int64)
            lists: dict[str, list] = {"": [], "cell_": []}
            for i, j in steps(offs):
                bb, o = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                at, first = cells(bb, o, depth)
                p = find(at)
                hit = p >= 0
                lm[i:j] = np.add.reduceat(np.where(hit, m.cell_log[p], 0.0) if len(m.cells) else np.zeros(len(at)), first[:-1])
                lists["cell_"].append(tally(at[~hit], np.repeat(np.arange(i, j), np.diff(first))[~hit], i, j))
                s, e, w = words(bb, o)
                # the end token stands after the words of each text
                h = np.insert(word_hashes(bb, s, e), w[1:], END)
                w = w + np.arange(j - i + 1)
                size[i:j] = np.diff(w)
                p = np.minimum(np.searchsorted(m.head, h), max(0, len(m.head) - 1))
                hit = m.head[p] == h if len(m.head) else np.zeros(len(h), bool)
                known[i:j] = np.add.reduceat(hit.astype(np.int64), w[:-1])
                base[i:j] = np.add.reduceat(np.where(hit, m.head_log[p], 0.0) if len(m.head) else np.zeros(len(h)), w[:-1])
                lists[""].append(tally(h[~hit].view(np.int64), np.repeat(np.arange(i, j), np.diff(w))[~hit], i, j))
            cols = {"row": pa.array(row + np.arange(n)), "doc_id": b.column(0), "learned": b.column(2), "n_tokens": pa.array(size), "known": pa.array(known), "base": pa.array(base), "score": pa.array(lm), "bytes": pa.array(np.diff(offs))}
            for kind, got in lists.items():
                ends = [np.zeros(1, np.int64)]
                for *_, z in got:
                    ends.append(z + ends[-1][-1])
                ends = pa.array(np.concatenate(ends).astype(np.int32))
                for label, k in (("rest", 0), ("times", 1)):
                    cols[kind + label] = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *(x[k] for x in got)])))
            yield pa.RecordBatch.from_pydict(cols)
            row += n

    schema = "row long, doc_id long, learned boolean, n_tokens long, known long, base double, score double, bytes long, rest array<long>, times array<long>, cell_rest array<long>, cell_times array<long>"
    scored = scratch.keep(docs.mapInArrow(run, schema), "scored")
    pairs = lambda a, b: scored.select("row", F.explode(F.arrays_zip(a, b)).alias("x")).select("row", F.col(f"x.{a}").alias("key"), F.col(f"x.{b}").alias("t"))
    rare = vocab.where(F.col("size") < floor).select("key", "n")
    tail = pairs("rest", "times").join(rare, "key", "left").select("row", F.when(F.col("n").isNotNull(), F.col("t")).otherwise(0).alias("known"), (F.col("t") * F.log10(F.coalesce("n", F.lit(0)) + 1)).alias("base"), F.lit(0.0).alias("lm"))
    far = tree.where(F.col("size") < cell_floor).select("key", "log")
    tail = tail.unionByName(pairs("cell_rest", "cell_times").join(far, "key").select("row", F.lit(0).cast("long").alias("known"), F.lit(0.0).alias("base"), (F.col("t") * F.col("log")).alias("lm")))
    tail = tail.groupBy("row").agg(F.sum("known").alias("tail_known"), F.sum("base").alias("tail_base"), F.sum("lm").alias("tail_lm"))
    log_all = float(np.log10(total + distinct + 1))
    score = F.col("score") + F.coalesce("tail_lm", F.lit(0.0))
    result = scored.drop("rest", "times", "cell_rest", "cell_times").join(tail, "row", "left").select(
        "doc_id", "learned", "n_tokens",
        (F.col("known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("tail_base", F.lit(0.0)) - F.col("n_tokens") * log_all).alias("base_score"), score.alias("score"),
        (-score / float(np.log10(2)) / F.greatest("bytes", F.lit(1))).alias("bits_per_byte"),
    )
    result = scratch.keep(result, "result")
    scratch.drop("counts", "tree", "cells", "scored")
    return result
