"""Shared ground of the text operators: scratch tables in the cluster's shared
folder, flat byte views of Arrow text columns, vectorised words and hashes.

Every operator here selects the columns it names before anything else, so extra
columns of its input, whatever they are called, never reach it.
"""

from __future__ import annotations

import ctypes
import hashlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that vectorised code works on at once (temporaries are 8 times that).
STEP_BYTES = 1 << 18
#: Rows of a batch sent to Python; with the mean text of a few KB a batch is a few MB.
BATCH_ROWS = 1000


_libc = None
try:  # glibc gives arrays of some MB back to the system at each turn; asking for them again costs more than the arithmetic
    _libc = ctypes.CDLL("libc.so.6")
    _libc.mallopt(-3, 32 << 20), _libc.mallopt(-1, 32 << 20)
except OSError:
    pass


def give_back() -> None:
    """Return memory that is no longer used to the system."""
    pa.default_memory_pool().release_unused()
    if _libc:
        _libc.malloc_trim(0)


def trimmed(run):
    """A function over batches that gives memory back when a task has ended: worker processes are kept for the tasks to come."""

    def go(batches):
        yield from run(batches)
        give_back()

    return go


class Scratch:
    """Tables written for one call in the folder that all machines share.

    The folder is the session's ``spark.checkpoint.dir``, or else the context's
    checkpoint folder. Where neither is set, a local master gets a temporary folder
    and any other raises: a folder of one machine would lose data on a cluster. A
    table is a cut in the lineage: a lost executor costs a reread, never a
    recomputation of what came before.

    With a ``folder`` of the caller's the tables go there and stay: a call that was
    cut short is resumed by the same call with the same folder and input, which
    takes every table that is complete as it is.
    """

    def __init__(self, spark: SparkSession, name: str, folder: str | None = None):
        self.spark, self.resumes = spark, folder is not None
        if folder:
            self.root = folder.rstrip("/")
            return
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
            base = "file://" + tempfile.mkdtemp(prefix="weftline-")
        self.root = f"{base.rstrip('/')}/weftline-{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        if not (self.resumes and self._is_there(f"{name}/_SUCCESS")):
            df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def _file(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _is_there(self, name: str) -> bool:
        path, files = self._file(name)
        return files.exists(path)

    def drop(self, *names: str) -> None:
        """Delete tables, but for those in a folder of the caller's."""
        for name in names if not self.resumes else ():
            path, files = self._file(name)
            files.delete(path, True)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Batches for Python are limited by rows; texts are long, so few rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % n


def flat_text(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column in UTF-8; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    col = col.cast(pa.large_binary())
    _, off, data = col.buffers()
    offs = np.frombuffer(off, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offs[0] : offs[-1]], offs - offs[0]


def steps(offs: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of whole documents of about ``limit`` bytes; one longer document is a run alone."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_M1, _M2, _GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection that spreads every bit."""
    x = x ^ (x >> _S30)
    x *= _M1
    x ^= x >> _S27
    x *= _M2
    x ^= x >> _S31
    return x


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Of a block of eight bytes the first n, by n.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
#: A word of more bytes is hashed alone.
LONG_WORD = 512


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and, for each document, the index of its first word (and the total).

    A word is a maximal run without U+0009..U+000D and U+0020 inside one document.
    """
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    ink = (buf != 32) & ((buf - np.uint8(9)) > 4)
    edge = np.zeros(len(buf) + 1, bool)
    edge[offs] = True
    first = ink.copy()
    first[1:] &= ~ink[:-1] | edge[1:-1]
    last = ink.copy()
    last[:-1] &= ~ink[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word, A-Z lower-cased first if asked: its blocks of eight bytes are mixed in one after the other."""
    size = ends - starts
    if not len(starts):
        return np.zeros(0, np.uint64)
    flat = np.zeros(len(buf) + 8, np.uint8)
    flat[: len(buf)] = _LOWER[buf] if lower else buf
    eight = np.ndarray((len(buf) + 1,), "<u8", flat, strides=(1,))  # the eight bytes from each place on
    h = mix((size.astype(np.uint64) + np.uint64(1)) * _GOLD)
    live, at, left = slice(None), starts, size
    while True:
        h[live] = mix(h[live] ^ (eight[at] & _FIRST[np.minimum(left, 8)]))
        more = np.flatnonzero((left > 8) & (left + (at - starts[live]) <= LONG_WORD))
        if not len(more):
            break
        live = more if isinstance(live, slice) else live[more]
        at, left = at[more] + 8, left[more] - 8
    for k in np.flatnonzero(size > LONG_WORD):
        h[k] = int.from_bytes(hashlib.blake2b(flat[starts[k] : ends[k]], digest_size=8).digest(), "little")
    return h


def code_points(buf: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
    """(first bytes, code points) of the characters of whole texts in UTF-8; first bytes is None if every byte is one."""
    wide = np.zeros(len(buf) + 3, np.uint32)
    wide[: len(buf)] = buf
    if not (buf >= 0x80).any():
        return None, wide[: len(buf)]
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    out = wide[at]
    high = np.flatnonzero(out >= 0xC0)
    first = at[high]
    a, b, c, d = wide[first], wide[first + 1] & 63, wide[first + 2] & 63, wide[first + 3] & 63
    out[high] = np.where(a < 0xE0, (a & 31) << 6 | b, np.where(a < 0xF0, (a & 15) << 12 | b << 6 | c, (a & 7) << 18 | b << 12 | c << 6 | d))
    return at, out


#: Slots of the filter that spares rows a shuffle; a broadcast of it holds this many numbers at most.
SLOTS = 1 << 18


def drop_rows(rows: DataFrame, dropped: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` without those whose keys are in ``dropped`` (a kept table, few against ``rows``).

    Rows whose key hashes to a slot without dropped keys pass straight through;
    only the others are shuffled. Rows with a null key stay.
    """
    slot = F.pmod(F.xxhash64(*keys), F.lit(SLOTS)).alias("wl_slot")
    slots = F.broadcast(dropped.select(slot).distinct())
    marked = rows.withColumn("wl_slot", slot)
    clear = marked.join(slots, "wl_slot", "left_anti").drop("wl_slot")
    other = marked.join(slots, "wl_slot", "left_semi").join(dropped.select(*keys).distinct(), keys, "left_anti").drop("wl_slot")
    return clear.unionByName(other.select(*clear.columns))
