"""Books and web pages as sections of text with ruby."""

from __future__ import annotations

import io
import posixpath
import re
import stat
import zipfile
from collections.abc import Iterator
from html.entities import html5
from html.parser import HTMLParser
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame

# Elements that end a line, and those whose text is not read.
BLOCK = frozenset("address article aside blockquote body br dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main ol p pre section table td th tr ul".split())
SILENT = frozenset(("rt", "rp", "script", "style", "noscript", "nav", "head", "title"))
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_OPEN = re.compile(r"&([A-Za-z][A-Za-z0-9]*;|#[0-9]+;|#[xX][0-9A-Fa-f]+;)?")
# Limits of a book: bytes of the file, entries, bytes of a chapter and of all chapters.
MAX_FILE, MAX_ENTRIES, MAX_CHAPTER, MAX_TOTAL = 64 << 20, 10_000, 4 << 20, 32 << 20


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.size, self.rubies = 0, []
        self.stack: list[tuple[str, bool]] = []
        self.hidden = 0
        self.ruby_at, self.reading, self.in_rt = None, [], 0

    def _write(self, s: str) -> None:
        self.parts.append(s)
        self.size += len(s)

    def _line(self) -> None:
        if self.size and not self.parts[-1].endswith("\n"):
            self._write("\n")

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "ruby" and not self.hidden:
            self.ruby_at, self.reading = self.size, []
        if tag == "rt" and self.ruby_at is not None:
            self.in_rt += 1
        if tag in BLOCK and not self.hidden:
            self._line()
        if tag not in VOID:
            quiet = tag in SILENT or "hidden" in a or a.get("aria-hidden") == "true"
            self.stack.append((tag, quiet))
            self.hidden += quiet

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCK and not self.hidden:
            self._line()

    def handle_endtag(self, tag):
        if not any(t == tag for t, _ in self.stack):
            return
        while self.stack:
            t, quiet = self.stack.pop()
            self.hidden -= quiet
            if t == "rt" and self.in_rt:
                self.in_rt -= 1
                reading = "".join(self.reading).strip()
                if reading and self.ruby_at is not None and self.size > self.ruby_at:
                    self.rubies.append((self.ruby_at, self.size, reading))
                self.ruby_at, self.reading = self.size, []
            if t == "ruby":
                self.ruby_at = None
            if t in BLOCK and not self.hidden:
                self._line()
            if t == tag:
                break

    def handle_data(self, data):
        if self.in_rt:
            self.reading.append(data)
        elif not self.hidden:
            self._write(data)


def section_of_html(html: str | None, closed: bool = False) -> tuple[str, list[tuple[int, int, str]]]:
    """Text of a page and its ruby as (start, end, reading); with ``closed`` only references that end in a semicolon are read, as in XML."""
    r = _Reader()
    html = html or ""
    r.feed(_OPEN.sub(lambda m: m[0] if m[1] and (m[1][0] == "#" or m[1] in html5) else "&amp;" + m[0][1:], html) if closed else html)
    r.close()
    return "".join(r.parts), r.rubies


def sections_of_html(df: DataFrame, key: str, html: str, closed: bool = False) -> DataFrame:
    """(key, text, rubies) of pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [section_of_html(x if isinstance(x, str) else None, closed) for x in b[html]]
            yield pd.DataFrame({key: b[key], "text": [t for t, _ in got], "rubies": [[{"start": s, "end": e, "reading": x} for s, e, x in r] for _, r in got]})

    return df.select(key, html).mapInPandas(run, f"{key} long, text string, rubies array<struct<start:int,end:int,reading:string>>")


class BookError(ValueError):
    """A file that is no acceptable book."""


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _safe(path: str) -> str:
    p = posixpath.normpath(unquote(path))
    if p.startswith(("/", "..")) or "\\" in p or re.match(r"^[A-Za-z]:", p):
        raise BookError(f"path leaves the book: {path}")
    return p


def read_book(content: bytes) -> list[tuple[int, str, str, list[tuple[int, int, str]]]]:
    """(index, href, text, rubies) of an EPUB's linear XHTML chapters in reading order, each once."""
    if len(content) > MAX_FILE:
        raise BookError("file too large")
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise BookError("not a zip file") from e
    infos = z.infolist()
    names = [_safe(i.filename) for i in infos]
    if len(infos) > MAX_ENTRIES or len(set(names)) < len(names):
        raise BookError("too many or repeated entries")
    if any(i.flag_bits & 1 or stat.S_ISLNK(i.external_attr >> 16) for i in infos):
        raise BookError("encrypted entry or link")
    by_name = dict(zip(names, infos, strict=True))

    def read(name: str, most: int) -> bytes:
        if name not in by_name:
            raise BookError(f"missing: {name}")
        if by_name[name].file_size > most:
            raise BookError(f"too large: {name}")
        return z.read(by_name[name])  # checks length and CRC

    root = ElementTree.fromstring(read("META-INF/container.xml", MAX_CHAPTER))
    opf = next((e.get("full-path") for e in root.iter() if _local(e.tag) == "rootfile"), None)
    if not opf:
        raise BookError("no package document")
    opf = _safe(opf)
    package = ElementTree.fromstring(read(opf, MAX_CHAPTER))
    items = {e.get("id"): e for e in package.iter() if _local(e.tag) == "item"}
    out, seen, total = [], set(), 0
    for ref in (e for e in package.iter() if _local(e.tag) == "itemref"):
        item = items.get(ref.get("idref"))
        if item is None or ref.get("linear") == "no" or item.get("media-type") != "application/xhtml+xml" or "nav" in (item.get("properties") or "").split():
            continue
        href = _safe(posixpath.join(posixpath.dirname(opf), item.get("href").partition("#")[0]))
        if href in seen:
            continue
        seen.add(href)
        data = read(href, MAX_CHAPTER)
        total += len(data)
        if total > MAX_TOTAL:
            raise BookError("chapters too large")
        text, rubies = section_of_html(data.decode("utf-8-sig", "replace"))
        out.append((len(out), href, text, rubies))
    return out


def read_books(files: DataFrame, key: str = "path", content: str = "content") -> DataFrame:
    """(key, idx, href, text, rubies, fault) of files as ``spark.read.format("binaryFile")`` gives them; a bad book is one row with its fault."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, c in zip(b[key], b[content], strict=True):
                try:
                    rows += [(k, i, h, t, [{"start": s, "end": e, "reading": x} for s, e, x in r], None) for i, h, t, r in read_book(bytes(c))]
                except (BookError, ElementTree.ParseError, zipfile.BadZipFile) as e:
                    rows.append((k, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=[key, "idx", "href", "text", "rubies", "fault"])

    return files.select(key, content).mapInPandas(run, f"{key} string, idx int, href string, text string, rubies array<struct<start:int,end:int,reading:string>>, fault string")
