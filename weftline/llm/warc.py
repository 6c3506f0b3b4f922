"""WARC archives with a two-level capture index.

Writing: one WARC/1.1 record per page, each its own gzip member, in files of
bounded size. Of pages with one payload, that with the largest page_id is the
response; others are revisit records that keep its HTTP header, its digest and
name the response. Payloads are grouped by digest in a join that Spark can split,
so a payload that a third of all pages share is no task of its own.

Index: a line per record, ``surt page time-free json``, sorted by reversed-host URL
key and cut into gzip blocks of ``BLOCK_LINES`` lines (level one). A sparse
directory per shard keeps each block's first key, offset and length (level two);
the shard table, a row per sorted partition, is all that is broadcast.

Reading: sorted keys are looked up by binary search in the shard table, in one
shard's directory and in one unpacked block; then records are read by range, in
order of file and offset.

Files go to the shared folder through pyarrow's file systems under names of their
own per attempt; only files that a finished task reports are ever read, so lost
executors and repeated tasks leave no wrong record.

Nulls and odd cases: a null html is an empty payload; a null url has key "-"; a
null page_id is a response only where no equal payload has an id, and comes back
as null; rows that repeat the largest page_id are all responses; repeated rows
come back each. Empty input, empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLOTS, Scratch, small_batches

BLOCK_LINES = 500
#: Captures that one task looks up or reads; a few lines of index stand for much payload, so sizes of index rows do not tell.
TASK_CAPTURES = 4000
FILE_BYTES = 256 << 20
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"


def surt(url: str | None) -> str:
    """``https://www.Example.com:443/a?b#c`` -> ``com,example,www)/a?b``."""
    if url is None:
        return "-"
    scheme, sep, rest = url.partition("://")
    if not sep:
        scheme, rest = "", url
    rest = rest.partition("#")[0]
    cut = min((k for k in (rest.find("/"), rest.find("?")) if k >= 0), default=len(rest))
    host, path = rest[:cut].rpartition("@")[2].lower(), rest[cut:] or "/"
    name, colon, port = host.partition(":")
    if colon and (port in ("", "80", "443")):
        host = name
    name, colon, port = host.partition(":")
    out = ",".join(reversed(name.split("."))) + colon + port + ")" + path
    return "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in out)


def capture_key(url: str | None, page_id: int | None) -> str:
    return f"{surt(url)} {'-' if page_id is None else f'{page_id + (1 << 63):020d}'}"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One record; a revisit (``refers_to`` given) leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    uri = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "urn:x-none:")
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{'none' if page_id is None else page_id}>", f"WARC-Target-URI: {uri}",
        f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers (lower-case names), HTTP header and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    out = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    body = rest[: int(out["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    return {"version": lines[0], "headers": out, "http": http.decode(), "payload": payload}


def _zip(data: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _unzip(data: bytes) -> bytes:
    return zlib.decompress(data, 31)


class Folder:
    """Files under one URI of any file system that pyarrow knows."""

    def __init__(self, uri: str):
        self.fs, self.root = pafs.FileSystem.from_uri(uri)

    def create(self, name: str):
        self.fs.create_dir(self.root, recursive=True)
        return self.fs.open_output_stream(f"{self.root}/{name}", compression=None)

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        with self.fs.open_input_file(f"{self.root}/{name}") as f:
            f.seek(offset)
            return f.read(length) if length is not None else f.read()

    def open(self, name: str):
        return self.fs.open_input_file(f"{self.root}/{name}")


def write_archive(pages: DataFrame, folder: str) -> DataFrame:
    """Write records of pages(page_id, url, html, refers_to) and return (key, file, offset, length); evaluate it once and keep it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, name, at = None, "", 0
        place = Folder(folder)
        try:
            for b in batches:
                keys, files, offs, sizes = [], [], [], []
                for page_id, url, html, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if out is None or at >= FILE_BYTES:
                        if out:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = place.create(name)
                    z = _zip(record(page_id, url, (html or "").encode(), refers))
                    out.write(z)
                    keys.append(capture_key(url, page_id)), files.append(name), offs.append(at), sizes.append(len(z))
                    at += len(z)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(files, pa.string()), pa.array(offs, pa.int64()), pa.array(sizes, pa.int64())], names=["key", "file", "offset", "length"])
        finally:
            if out:
                out.close()

    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "key string, file string, offset long, length long")


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Sort captures into shards of compressed blocks with a directory each; (first_key, shard, blocks, lines) per shard. Evaluate once and keep."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, name = Folder(folder), uuid.uuid4().hex
        out, directory, lines, total, at = None, [], [], 0, 0

        def flush():
            nonlocal at
            z = _zip("".join(x + "\n" for x in lines).encode())
            out.write(z)
            directory.append(f"{lines[0].rpartition(' ')[0]}\t{at}\t{len(z)}")
            at += len(z)
            lines.clear()

        for b in batches:
            for key, file, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                out = out or place.create(f"{name}.idx")
                lines.append(key + " " + json.dumps({"f": file, "o": offset, "n": length}, separators=(",", ":")))
                total += 1
                if len(lines) == BLOCK_LINES:
                    flush()
        if out:
            if lines:
                flush()
            out.close()
            with place.create(f"{name}.dir") as d:
                d.write("\n".join(directory).encode())
            yield pa.RecordBatch.from_arrays([pa.array([directory[0].split("\t")[0]]), pa.array([name]), pa.array([len(directory)], pa.int64()), pa.array([total], pa.int64())], names=["first_key", "shard", "blocks", "lines"])

    ranged = captures.select("key", "file", "offset", "length").repartitionByRange("key").sortWithinPartitions("key", "file", "offset")
    return ranged.mapInArrow(run, "first_key string, shard string, blocks long, lines long")


class Index:
    """Lookups through shard table, directory and block; keeps one shard's directory and one block, as keys come sorted."""

    def __init__(self, shards: list[tuple[str, str]], folder: str):
        self.shards = sorted((k.encode(), s) for k, s in shards)
        self.first = [k for k, _ in self.shards]
        self.place, self.shard, self.block = Folder(folder), None, None

    def _directory(self, shard: str) -> None:
        if self.shard != shard:
            rows = [x.split("\t") for x in self.place.read(f"{shard}.dir").decode().split("\n")]
            self.shard, self.block = shard, None
            self.keys, self.spans = [r[0].encode() for r in rows], [(int(r[1]), int(r[2])) for r in rows]

    def _block(self, k: int) -> None:
        if self.block != k:
            lines = _unzip(self.place.read(f"{self.shard}.idx", *self.spans[k])).decode().split("\n")[:-1]
            parts = [x.rpartition(" ") for x in lines]
            self.block, self.line_keys, self.values = k, [p[0].encode() for p in parts], [p[2] for p in parts]

    def find(self, key: str) -> list[dict]:
        """All captures of the key, in index order."""
        k = key.encode()
        at = bisect_right(self.first, k) - 1
        if at < 0:
            return []
        self._directory(self.shards[at][1])
        found, b = [], max(0, bisect_left(self.keys, k) - 1)  # equal keys may start in the block before
        while b < len(self.keys) and self.keys[b] <= k:
            self._block(b)
            lo, hi = bisect_left(self.line_keys, k), bisect_right(self.line_keys, k)
            found += [json.loads(v) for v in self.values[lo:hi]]
            if hi < len(self.line_keys):
                break
            b += 1
        return found


def look_up(keys: DataFrame, shards: list[tuple[str, str]], folder: str, tasks: int) -> DataFrame:
    """(key, file, offset, length) for distinct keys; a key without captures has no row."""
    shared = keys.sparkSession.sparkContext.broadcast(shards)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(shared.value, folder)
        for b in batches:
            rows = [(k, x["f"], x["o"], x["n"]) for k in b.column(0).to_pylist() for x in index.find(k)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["key", "file", "offset", "length"])

    return keys.select("key").distinct().repartitionByRange(tasks, "key").sortWithinPartitions("key").mapInArrow(run, "key string, file string, offset long, length long")


def fetch(captures: DataFrame, folder: str, tasks: int) -> DataFrame:
    """Records by range reads: page_id, payload_bytes, payload_digest, record_type, refers_to, url. A response whose payload does not have its digest is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, name, f = Folder(folder), None, None
        for b in batches:
            rows = []
            for file, offset, length in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if file != name:
                    if f:
                        f.close()
                    name, f = file, place.open(file)
                f.seek(offset)
                got = parse(_unzip(f.read(length)))
                head = got["headers"]
                kind, digest = head["warc-type"], head["warc-payload-digest"].partition(":")[2]
                page, refers = (head[h][12:-1] if h in head else "none" for h in ("warc-record-id", "warc-refers-to"))
                if kind == "response":
                    size = len(got["payload"])
                    if base32_sha1(got["payload"]) != digest:
                        raise ValueError(f"{file}:{offset}: the payload does not have its digest")
                else:
                    size = int(got["http"].rpartition("Content-Length: ")[2])
                rows.append((None if page == "none" else int(page), size, digest, kind, None if refers == "none" else int(refers), head["warc-target-uri"]))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])
        if f:
            f.close()

    ranged = captures.select("file", "offset", "length").repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return ranged.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def with_revisits(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """pages(page_id, url, html) and refers_to: the largest page_id of an equal payload, where that is another row's. Only pages that may have a repeated payload are shuffled."""
    rows = pages.select("page_id", "url", "html", F.sha1(F.coalesce("html", F.lit(""))).alias("digest"))
    shared = scratch.keep(rows.groupBy("digest").agg(F.max("page_id").alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n"), "shared")
    marked = rows.withColumn("wl_slot", F.pmod(F.xxhash64("digest"), F.lit(SLOTS)))
    slots = F.broadcast(shared.select(F.pmod(F.xxhash64("digest"), F.lit(SLOTS)).alias("wl_slot")).distinct())  # SLOTS rows at most
    alone = marked.join(slots, "wl_slot", "left_anti").withColumn("kept", F.col("page_id"))
    others = marked.join(slots, "wl_slot", "left_semi").join(shared, "digest", "left").withColumn("kept", F.coalesce("kept", "page_id"))
    known = F.when(~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept"))
    return alone.select("page_id", "url", "html", "kept").unionByName(others.select("page_id", "url", "html", "kept")).select("page_id", "url", "html", known.alias("refers_to"))


def archive_and_read(pages: DataFrame, name: str = "warc") -> DataFrame:
    """Write an archive and its index from pages(page_id, url, html), look every page up, return what was read back."""
    spark = pages.sparkSession
    small_batches(spark)
    scratch = Scratch(spark, name)
    data, index = scratch.path("archive"), scratch.path("index")
    captures = scratch.keep(write_archive(with_revisits(pages, scratch), data), "captures")
    shards = scratch.keep(write_index(captures, index), "shards")
    table = [(r["first_key"], r["shard"]) for r in shards.select("first_key", "shard").collect()]
    tasks = 1 + (shards.agg(F.sum("lines")).first()[0] or 0) // TASK_CAPTURES

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([capture_key(u, p) for p, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)], pa.string())], names=["key"])

    keys = pages.select("page_id", "url").mapInArrow(keyed, "key string")
    return fetch(look_up(keys, table, index, tasks), data, tasks)
