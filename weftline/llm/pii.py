"""Personal data: patterns propose spans, checksums confirm them, context words adjust the score.

Two groups of kinds. *Base* kinds (email, ip, card, phone) are taken as leftmost
non-overlapping matches of a fixed pattern, confirmed by a fixed test (parts at
most 255; 14 to 19 digits passing Luhn; 10 to 15 digits); a match that fails is
dropped and not tried again. Their spans always stay, with a score. *Further*
kinds (iban by mod 97, ssn by its forbidden ranges, card13 by Luhn, localphone, and
secrets: accesskey by its form, secret, a value given to a name like password or
token, by its digits and entropy) stay if their score, after words nearby have moved it, reaches the threshold. A
localphone that is part of a phone is that phone and no span of its own. An iban
may be followed by capital words; a match that fails is tried again without them.

Offsets are code points, ends exclusive. All patterns run in time linear in the
text: none can start inside a run that an earlier start has already refused.

Nulls and odd cases: a null text counts as empty and has no spans; repeated rows
are searched each; a null doc_id is kept. Empty input, empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import small_batches

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "card13", "localphone", "accesskey", "secret")

_AFTER_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_LOCALPHONE = re.compile(r"(?<![0-9+(.-])\(?[0-9]{3,4}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])")
_ACCESSKEY = re.compile(r"(?<![A-Za-z0-9])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])")
_SECRET = re.compile(r"(?<![A-Za-z])(?:password|passwd|pwd|secret|token|api[_-]?key)[\"']?\x20{0,2}[:=]\x20{0,2}[\"']?([A-Za-z0-9+/_.~=-]{8,}+)", re.IGNORECASE)
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\W\d_]+")

# Characters of an iban by country.
IBAN_CHARS = {
    c: n
    for n, countries in (
        (15, "NO"), (16, "BE"), (18, "DK FI FO GL NL"), (19, "MK SI"), (20, "AT BA EE KZ LT LU XK"), (21, "CH HR LI LV"), (22, "BG BH CR DE GB GE IE ME RS"), (23, "AE GI IL IQ"),
        (24, "AD CZ ES MD PK RO SA SE SK TN VG"), (25, "PT"), (26, "IS TR"), (27, "FR GR IT MC MR SM"), (28, "AL AZ BY CY DO GT HU LB PL"), (29, "BR EG PS QA UA"), (30, "JO KW MU"), (31, "MT"),
    )
    for c in countries.split()
}
START = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4, "card13": 0.4, "localphone": 0.4, "accesskey": 0.9, "secret": 0.8}
# Whole words, all within WINDOW characters of a span, that speak for the kind, by kind.
FOR = {
    "email": ("mail", "email", "contact", "write", "correo", "kontakt"),
    "ip": ("ip", "address", "server", "host", "dirección", "adresse"),
    "card": ("card", "visa", "credit", "payment", "karte", "tarjeta", "carte"),
    "phone": ("phone", "telephone", "call", "tel", "mobile", "cell", "fax", "telefon", "teléfono", "téléphone"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "ssn": ("ssn", "social", "security"),
    "card13": ("card", "visa", "credit", "payment", "karte", "tarjeta", "carte"),
    "localphone": ("phone", "telephone", "call", "tel", "mobile", "cell", "fax", "telefon", "teléfono", "téléphone"),
}
FOR |= {k: ("key", "access", "aws", "credential", "credentials", "login", "passwort", "contraseña") for k in ("accesskey", "secret")}
AGAINST = ("version", "isbn", "order", "page", "figure", "example")
WINDOW, LIFT, DROP, THRESHOLD = 40, 0.35, 0.25, 0.7
#: Least entropy of a secret, in bits a character.
RANDOM = 2.5


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    s = iban.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def entropy(value: str) -> float:
    """Bits a character, by the value's own characters."""
    return -sum(n / len(value) * math.log2(n / len(value)) for n in Counter(value).values())


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """Of each match the confirmed beginning that ends with it or before a space: one of the country's length, else the longest. Where there is none the search goes on behind its first letter."""
    m = _IBAN.search(text)
    while m:
        a, z = m.span()
        good = []
        while z > a:
            if mod97(text[a:z]):
                good.append(z)
            z = text.rfind(" ", a, z)
        if good:
            z = next((z for z in good if z - a - text.count(" ", a, z) == IBAN_CHARS.get(m[0][:2])), good[0])
            yield a, z
        m = _IBAN.search(text, z if good else a + 1)


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """An address starts where the run of local characters before its @ starts, or where the last one ended."""
    floor = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _AFTER_AT.match(text, at)):
            yield start, m.end()
            floor = m.end()
        else:
            floor = at  # nothing before this @ can reach past it
        at = text.find("@", at + 1)


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of confirmed base spans, unsorted."""
    out = []
    if "@" in text:
        out += [(a, "email", z) for a, z in _emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            out += [(m.start(), "ip", m.end()) for m in _IP.finditer(text) if all(len(g.lstrip("0")) < 4 and int(g.lstrip("0") or 0) <= 255 for g in m.groups())]
        out += [(m.start(), "card", m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [(m.start(), "phone", m.end()) for m in _PHONE.finditer(text) if 10 <= len(_digits(m[0])) <= 15]
    return out


def more_spans(text: str) -> list[tuple[int, str, int]]:
    out = []
    if _DIGIT.search(text):
        out += [(a, "iban", z) for a, z in _ibans(text)]
        if "-" in text:
            out += [(m.start(), "ssn", m.end()) for m in _SSN.finditer(text) if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000"]
        out += [(m.start(), "card13", m.end()) for m in _CARD.finditer(text) if 13 <= m.end() - m.start() <= 25 and len(d := _digits(m[0])) == 13 and luhn(d)]
        out += [(m.start(), "localphone", m.end()) for m in _LOCALPHONE.finditer(text)]
        if "=" in text or ":" in text:
            out += [(m.start(1), "secret", m.end(1)) for m in _SECRET.finditer(text) if _DIGIT.search(m[1]) and entropy(m[1]) >= RANDOM]
    if "IA" in text:
        out += [(m.start(), "accesskey", m.end()) for m in _ACCESSKEY.finditer(text)]
    return out


def near_words(text: str, start: int, end: int) -> set[str]:
    """The lower-cased words that lie whole within WINDOW characters before or behind a span."""
    low, high = max(0, start - WINDOW), end + WINDOW
    out = {m[0].lower() for m in _WORD.finditer(text, low, start) if m.start() > low or low == 0 or not _WORD.match(text[low - 1])}
    return out | {m[0].lower() for m in _WORD.finditer(text, end, high) if m.end() < high or not _WORD.match(text[high : high + 1])}


def score(text: str, start: int, kind: str, end: int) -> float:
    near = near_words(text, start, end)
    s = START[kind]
    if not near.isdisjoint(FOR[kind]):
        s += LIFT
    if not near.isdisjoint(AGAINST):
        s -= DROP
    return round(min(1.0, max(0.0, s)), 6)


def _inside(spans: list[tuple[int, int]], x: tuple[int, str, int]) -> bool:
    """Whether one of the spans, sorted and apart, covers x."""
    k = bisect_right(spans, (x[0], len(spans) and spans[-1][1])) - 1
    return k >= 0 and x[2] <= spans[k][1]


def find_spans(text: str) -> list[tuple[int, str, int, float]]:
    """(start, kind, end, score): all base spans and the further ones that reach the threshold, by start, then kind as listed."""
    out = [(*x, score(text, *x)) for x in base_spans(text)]
    phones = sorted((a, z) for a, k, z, _ in out if k == "phone")
    out += [(*x, s) for x in more_spans(text) if not (x[1] == "localphone" and _inside(phones, x)) and (s := score(text, *x)) >= THRESHOLD]
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[1]), x[2]))


def _line(spans) -> str:
    return ",".join(f"{k}:{a}:{z}" for a, k, z, *_ in spans)


SCHEMA = (
    "doc_id long, n_email long, n_ip long, n_card long, n_phone long, n_spans long, base_sha256 string, spans string, scores string, "
    "found array<struct<kind:string,start:int,end:int,score:double>>"
)


def find_personal_data(documents: DataFrame) -> DataFrame:
    """Per row: counts of base kinds and of all spans, digest of base spans, all spans and their scores as text and, in ``found``, as rows."""
    small_batches(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [find_spans(t) if t else [] for t in b.column(1).to_pylist()]
            base = [[x for x in r if x[1] in BASE] for r in rows]
            cols = {"doc_id": b.column(0)}
            for kind in BASE:
                cols[f"n_{kind}"] = pa.array([sum(x[1] == kind for x in r) for r in base], pa.int64())
            cols["n_spans"] = pa.array([len(r) for r in rows], pa.int64())
            cols["base_sha256"] = pa.array([hashlib.sha256(_line(r).encode()).hexdigest() for r in base], pa.string())
            cols["spans"] = pa.array([_line(r) for r in rows], pa.string())
            cols["scores"] = pa.array([",".join(f"{x[3]:.2f}" for x in r) for r in rows], pa.string())
            cols["found"] = pa.array(
                [[{"kind": k, "start": a, "end": z, "score": s} for a, k, z, s in r] for r in rows],
                pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])),
            )
            yield pa.RecordBatch.from_pydict(cols)

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)
