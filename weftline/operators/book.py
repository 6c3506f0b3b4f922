"""Cues matched to a book: reading track, gaps filled between matches, cues cut anew at the book's sentences."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame

from weftline.functions.text import CLOSING, FOLD_FROM, FOLD_TO, KEEP, TERMINATORS

from .matching import LARGEST, cursor_match

# Similarity of a filled cue and of a cut anew, length of a slight cue, length ratios, region and work limits.
SIMILAR, ANCHOR, SLIGHT, RATIOS, MAX_REGION, MAX_WORK = 0.45, 0.5, 2, (0.3, 2.5), 4000, 10_000_000
NEAR = 1e-9
LEAD, LEAST, FRAME, MAX_CELLS, DENSITY = 150, 300, 40, 400_000, 2.0
# Starting the walk: cues looked at, their least length, places each, share of the text that must remain, reach of support.
PROBE, PROBE_CHARS, PLACES, REMAIN, REACH = 24, 6, 8, 0.5, 3000

_FOLD = dict(zip(FOLD_FROM, FOLD_TO, strict=True))


def _keep_pattern():
    import re

    return re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), f"[{KEEP}]"))


_KEEP = _keep_pattern()


def normalize(text: str) -> tuple[str, list[int]]:
    """Speech characters folded, and the place of each in the text."""
    out, at = [], []
    for k, c in enumerate(text):
        if _KEEP.match(c):
            out.append(_FOLD.get(c, c))
            at.append(k)
    return "".join(out), at


@dataclass(frozen=True)
class Match:
    start: int
    end: int
    score: float


class Book:
    """Sections end to end, normalised, with the way back to section and source text; with rubies (start, end, reading) of each section a second track that has readings for their bases."""

    def __init__(self, sections: list[str], rubies: list[list[tuple[int, int, str]]] | None = None):
        parts = [normalize(s) for s in sections]
        self.sections, self.places = sections, [p for _, p in parts]
        self.starts, at = [], 0
        for t, _ in parts:
            self.starts.append(at)
            at += len(t)
        self.text = "".join(t for t, _ in parts)
        spans = [(base + bisect_left(p, a), base + bisect_left(p, z), r) for base, p, own in zip(self.starts, self.places, rubies or [[]] * len(sections), strict=True) for a, z, r in own]
        self.reading = reading_track(self.text, spans) if any(z > a and normalize(r)[0] for a, z, r in spans) else None

    def section_of(self, at: int) -> int:
        """The last section that starts at or before; empty ones are passed over."""
        return max(0, bisect_right(self.starts, at) - 1)

    def source(self, m: Match) -> str:
        """The book's own words of a match, widened to opening marks before and sentence ends and closing marks behind."""
        s = self.section_of(m.start)
        text, at = self.sections[s], self.places[s]
        a, z = m.start - self.starts[s], min(m.end - self.starts[s], len(at))
        if z <= a:
            return ""
        lo, hi = at[a], at[z - 1] + 1
        while lo > 0 and text[lo - 1] in "「『（(【〔《〈“‘":
            lo -= 1
        while hi < len(text) and text[hi] in TERMINATORS + CLOSING + "、，,;；:：—…":
            hi += 1
        return " ".join(text[lo:hi].split())


def reading_track(text: str, rubies: list[tuple[int, int, str]]) -> tuple[str, list[int], list[int]]:
    """Normalised text with readings put for their bases: (track, place in the base text of each character, place in the track of each base character); overlapping rubies after the first are left out."""
    track, place, back, at, last = [], [], [], 0, -1
    spans = []
    for a, z, reading in sorted(rubies):
        if a > last and z > a and normalize(reading)[0]:
            spans.append((a, z, normalize(reading)[0]))
            last = z - 1
    for a, z, reading in [*spans, (len(text), len(text), "")]:
        for k in range(at, a):
            back.append(len(track))
            track.append(text[k]), place.append(k)
        for k in range(a, z):
            back.append(len(track))
        for k, c in enumerate(reading):
            track.append(c), place.append(a + k * (z - a) // len(reading))
        at = z
    back.append(len(track))
    return "".join(track), place, back


def find_start(texts: list[str], book: str) -> int:
    """Where the walk starts: of the places of the first long cues, the earliest with most different cues in the 3000 characters after it."""
    total = sum(map(len, texts))
    found = []
    for k, t in enumerate([t for t in texts if len(t) >= PROBE_CHARS][:PROBE]):
        at = -1
        for _ in range(PLACES):
            at = book.find(t, at + 1)
            if at < 0:
                break
            if len(book) - at >= REMAIN * total:
                found.append((at, k))
    best = max(((len({c for q, c in found if p <= q <= p + REACH}), -p) for p, _ in found), default=(0, 0))
    return -best[1]


def _match_norm(norm: list[str], book: Book, start: int, window: int, threshold: float = 0.8) -> list[Match | None]:
    return [m and Match(*m) for m in cursor_match(norm, book.text, start, window, threshold, reading=book.reading)]


def match_book(texts: list[str], book: Book, window: int = 200, threshold: float = 0.8) -> list[Match | None]:
    norm = [normalize(t)[0] for t in texts]
    return _match_norm(norm, book, find_start(norm, book.text), window, threshold)


def match_probed(texts: list[str], book: Book, windows: tuple[int, ...] = (50, 200, LARGEST)) -> tuple[int, dict[int, float], list[Match | None]]:
    """(best window, share matched by window, matches by the best window); of equal shares the smallest, and 200 if nothing matches."""
    norm = [normalize(t)[0] for t in texts]
    start = find_start(norm, book.text)
    found = {w: _match_norm(norm, book, start, w) for w in windows}
    rates = {w: sum(m is not None for m in found[w]) / max(1, len(texts)) for w in windows}
    top = max(rates.values())
    best = min(w for w, r in rates.items() if r >= top - 1e-9) if top > 0 else 200
    return best, rates, found[best] if best in found else _match_norm(norm, book, start, best)


def probe_windows(texts: list[str], book: Book, windows: tuple[int, ...] = (50, 200, LARGEST)) -> tuple[int, dict[int, float]]:
    """(best window, share matched by window); of equal shares the smallest, and 200 if nothing matches."""
    return match_probed(texts, book, windows)[:2]


def _rank(n: int, size: int) -> tuple[bool, int]:
    """Of spans that are as good: not longer than the needle first, then nearest to its length."""
    return size > n, abs(size - n)


def span_ends(needle: str, hay: str) -> tuple[list[int], list[int]]:
    """For each end in ``hay`` (0 to its length) the least edits of a span that ends there, and where it starts."""
    n = len(needle)
    cost, start = [n], [0]
    row, from_ = list(range(n + 1)), [0] * (n + 1)  # edits and starts of the last column, for each length of the needle
    for j, ch in enumerate(hay, 1):
        edits, at = 0, j
        diagonal, diagonal_at = row[0], from_[0]
        from_[0] = j
        ideal = j
        for i, want in enumerate(needle, 1):
            up, up_at = row[i], from_[i]
            ideal -= 1
            edits += 1
            # of as few edits the smallest start from which the span is not longer than the needle, else the largest
            if up + 1 < edits:
                edits, at = up + 1, up_at
            elif up + 1 == edits and at != up_at:
                low, high = (at, up_at) if at < up_at else (up_at, at)
                at = low if low >= ideal else high
            c = diagonal if want == ch else diagonal + 1
            if c < edits:
                edits, at = c, diagonal_at
            elif c == edits and at != diagonal_at:
                low, high = (at, diagonal_at) if at < diagonal_at else (diagonal_at, at)
                at = low if low >= ideal else high
            row[i], from_[i] = edits, at
            diagonal, diagonal_at = up, up_at
        cost.append(edits), start.append(at)
    return cost, start


def _better(like: float, rank: tuple, best: tuple | None) -> bool:
    return best is None or like > best[0] + NEAR or (like > best[0] - NEAR and rank < best[1])


def best_end(needle: str, hay: str, ends: tuple[list[int], list[int]], lo: int, hi: int) -> Match | None:
    """The stretch of hay[lo:hi] most like the needle, with lengths from half to twice its own; ``ends`` are those of hay[lo:]. First the best end, then, for it, the best start."""
    return _best_of(needle, hay, ((lo + j, ends[0][j], lo + ends[1][j]) for j in range(max(1, -(-len(needle) // 2)), hi - lo + 1)), lo)


def _best_of(needle: str, hay: str, spans: Iterable[tuple[int, int, int]], lo: int) -> Match | None:
    """The best of spans (end, edits, start) in order of their ends, with the best start from lo on for its end."""
    n = len(needle)
    least, best = max(1, -(-n // 2)), None
    for end, edits, start in spans:
        size = end - start
        if least <= size <= 2 * n and _better(like := 1 - edits / max(n, size), rank := _rank(n, size), best):
            best = (like, rank, end)
    if best is None:
        return None
    end, best = best[2], None
    for size, edits in enumerate(suffix_costs(needle, hay[max(lo, end - 2 * n) : end])):
        if size >= least and _better(like := 1 - edits / max(n, size), rank := _rank(n, size), best):
            best = (like, rank, end - size)
    return Match(best[2], end, best[0])


def suffix_costs(needle: str, text: str) -> list[int]:
    """Edits from the needle to each suffix of the text, by the suffix's length."""
    return _column_costs(needle[::-1], text[::-1], 1)


def end_costs(needle: str, hay: str) -> list[int]:
    """For each end in ``hay`` the least edits of a span that ends there, as ``span_ends`` gives them."""
    return _column_costs(needle, hay, 0)


def _column_costs(needle: str, text: str, skip: int) -> list[int]:
    """Edits from the needle to each prefix of the text, where a letter of the text before the first of the needle costs ``skip`` (0 or 1)."""
    n, score, out = len(needle), len(needle), [len(needle)]
    if not n:
        return [skip * k for k in range(len(text) + 1)]
    full, top, eq = (1 << n) - 1, 1 << (n - 1), {}
    for i, x in enumerate(needle):
        eq[x] = eq.get(x, 0) | 1 << i
    plus, minus = full, 0  # bits: where a column of edits goes up and down (Myers)
    for y in text:
        same = eq.get(y, 0)
        vertical = same | minus
        across = (((same & plus) + plus) ^ plus) | same
        up, down = minus | (full & ~(across | plus)), plus & across
        score += 1 if up & top else -1 if down & top else 0
        out.append(score)
        up, down = (up << 1 | skip) & full, down << 1 & full
        plus, minus = down | (full & ~(vertical | up)), up & vertical
    return out


def best_span(needle: str, hay: str) -> tuple[int, int, float]:
    """The stretch of ``hay`` most like the needle: (start, end, similarity); nothing is (0, 0, 0)."""
    if not needle or not hay:
        return 0, 0, 0.0
    m = _best_of(needle, hay, _likely_spans(needle, hay), 0)
    return (m.start, m.end, m.score) if m else (0, 0, 0.0)


def _likely_spans(needle: str, hay: str) -> Iterator[tuple[int, int, int]]:
    """(end, least edits, start) of all ends in ``hay`` that can be the best.

    A span of c edits has a likeness of n / (n + c) at most, and where the least
    c of all leaves half the needle, there is one of 1 - c / n. Starts are only
    counted for ends that can reach that, each from 2n + 1 letters before, as no
    span of least edits is longer than 2n.
    """
    n, costs = len(needle), end_costs(needle, hay)
    least = min(costs)
    most = n * n // (n - least) - n if least <= n // 2 else n
    pieces: list[list[int]] = []
    for j, c in enumerate(costs):
        if c <= most:
            lo = max(0, j - 2 * n - 1)
            if pieces and lo <= pieces[-1][1]:
                pieces[-1][1] = j
            else:
                pieces.append([lo, j])
    for lo, hi in pieces:
        starts = span_ends(needle, hay[lo:hi])[1]
        yield from ((j, costs[j], lo + starts[j - lo]) for j in range(lo, hi + 1) if costs[j] <= most)


def edit_cost(a: str, b: str) -> int:
    return suffix_costs(a, b)[-1]


def likeness(a: str, b: str) -> float:
    return 1 - edit_cost(a, b) / max(len(a), len(b), 1)


def tied_shrinks(needle: str, text: str, at_end: bool) -> list[int]:
    """How many characters a span can give up at one side without costing an edit more, none first; half the needle's length stays."""
    cost, most = edit_cost(needle, text), len(text) - max(1, -(-len(needle) // 2))
    return [0, *(k for k in range(1, most + 1) if edit_cost(needle, text[: len(text) - k] if at_end else text[k:]) <= cost)]


class GapFiller:
    """Cues without a place between cues with one, placed in the book's text between these.

    Of the cues matched before, *fixed* ones (exact and longer than two letters)
    never move, *soft* ones (inexact) may be cut anew between what the first pass
    found around them, and *slight* ones (two letters at most) may move or go.
    ``limits`` (region, work) leave runs open that lie in more text or would cost
    more in all; without them every run is filled.
    """

    def __init__(self, texts: list[str], book: Book, matches: list[Match | None], limits: tuple[int, int] | None = None):
        self.norm, self.text, self.limits = [normalize(t)[0] for t in texts], book.text, limits
        self.first, self.out, self.work = list(matches), list(matches), 0
        n = len(matches)
        self.after, self.until = [0] * n, [len(book.text)] * n  # what the first pass found around each cue
        for k in range(1, n):
            self.after[k] = matches[k - 1].end if matches[k - 1] else self.after[k - 1]
            self.until[-k - 1] = matches[-k].start if matches[-k] else self.until[-k]

    def kind(self, k: int) -> str | None:
        m = self.first[k]
        return None if m is None else "slight" if len(self.norm[k]) <= SLIGHT else "fixed" if m.score >= 1 else "soft"

    def placed(self, k: int, step: int) -> int | None:
        """The nearest placed cue before or behind."""
        k += step
        while 0 <= k < len(self.out):
            if self.out[k]:
                return k
            k += step
        return None

    def fill(self) -> list[Match | None]:
        k, n = 0, len(self.out)
        while k < n:
            if self.out[k]:
                k += 1
                continue
            end = k
            while end < n and not self.out[end]:
                end += 1
            if k > 0 and end < n and self.cut_anew(k - 1, end):
                at = k
                while at < end:  # what is still open shares the text between its neighbours
                    z = at
                    while z < end and not self.out[z]:
                        z += 1
                    a, b = self.placed(at, -1), self.placed(z - 1, 1)
                    if z > at and a is not None and b is not None:
                        for i, m in proportional(range(a + 1, b), self.norm, self.text, self.out[a].end, self.out[b].start).items():
                            self.out[i] = m
                    at = max(z, at + 1)
            k = end
        return self.out

    def cut_anew(self, left: int, right: int) -> bool:
        """Lay the cues left..right over the text between their neighbours, long ones first, and keep that if it gains; False if the limits leave the run out."""
        out, norm = self.out, self.norm
        while left > 0 and out[left - 1] and len(norm[left]) <= SLIGHT:
            left -= 1
        while right + 1 < len(out) and out[right + 1] and len(norm[right]) <= SLIGHT:
            right += 1
        first, last = out[left].start, out[right].end
        a, b = self.placed(left, -1), self.placed(right, 1)
        lo, hi = first if a is None else min(first, out[a].end), last if b is None else max(last, out[b].start)
        cost = (hi - lo) * (right - left + 1)
        if hi <= lo:
            return True
        if self.limits and (hi - lo > self.limits[0] or self.work + cost > self.limits[1]):
            return False  # a run that is left out costs nothing
        self.work += cost
        run = range(left, right + 1)
        got = {k: out[k] for k in run if self.kind(k) == "fixed"}
        for k in sorted(run, key=lambda k: (-len(norm[k]), k)):
            if k in got:
                continue
            needed = k in (left, right) or self.kind(k) == "soft"
            m = self.find(k, got, lo, hi) if norm[k] else None
            if m and m.score >= (ANCHOR if needed else SIMILAR):
                got[k] = m
            elif needed and (norm[k] or k in (left, right)):
                return True
        for k in run:
            if k not in got and norm[k]:
                self.negotiate(k, got)
        for k in run:
            if k not in got:
                a = max(x for x in got if x < k)
                b = min(x for x in got if x > k)
                if a == k - 1:
                    got |= proportional(range(k, b), norm, self.text, got[a].end, got[b].start)
        if all(self.kind(k) != "soft" or (k in got and got[k].score >= ANCHOR - NEAR and self.after[k] <= got[k].start and got[k].end <= self.until[k]) for k in run):
            gained, lost = sum(not out[k] for k in got), sum(bool(out[k]) for k in run if k not in got)
            inside = got[left].start >= first and got[right].end <= last
            if gained > lost or (lost == 0 and inside):
                for k in run:
                    out[k] = got.get(k)
        return True

    def find(self, k: int, got: dict[int, Match], lo: int, hi: int) -> Match | None:
        lo = next((got[x].end for x in sorted(got, reverse=True) if x < k), lo)
        hi = next((got[x].start for x in sorted(got) if x > k), hi)
        if self.kind(k) == "soft":
            lo, hi = max(lo, self.after[k]), min(hi, self.until[k])
        s, e, like = best_span(self.norm[k], self.text[lo:hi]) if hi > lo else (0, 0, 0.0)
        return Match(lo + s, lo + e, like) if e > s else None

    def negotiate(self, k: int, got: dict[int, Match]) -> None:
        """Place a cue that found no room in what its placed neighbours can give up at no cost: the likest, then the one that takes least."""
        left, right = max(x for x in got if x < k), min(x for x in got if x > k)
        a, b, needle = got[left], got[right], self.norm[k]
        give_a = [0] if self.kind(left) == "fixed" else tied_shrinks(self.norm[left], self.text[a.start : a.end], True)
        give_b = [0] if self.kind(right) == "fixed" else tied_shrinks(self.norm[right], self.text[b.start : b.end], False)
        best = None
        for x in give_a:
            lo, most = a.end - x, b.start + give_b[-1]
            if most <= lo:
                continue
            ends = span_ends(needle, self.text[lo:most])
            for y in give_b:
                hi = b.start + y
                if not x + y or hi <= lo:
                    continue
                m = best_end(needle, self.text, ends, lo, hi)
                if m is None or m.score < SIMILAR:
                    if not plausible(len(needle), hi - lo):
                        continue
                    m = Match(lo, hi, likeness(needle, self.text[lo:hi]))
                if best is None or m.score > best[0].score + NEAR or (m.score > best[0].score - NEAR and x + y < best[1] + best[2]):
                    best = (m, x, y)
        if best:
            m, x, y = best
            got[k] = m
            got[left] = Match(a.start, a.end - x, likeness(self.norm[left], self.text[a.start : a.end - x]))
            got[right] = Match(b.start + y, b.end, likeness(self.norm[right], self.text[b.start + y : b.end]))


def plausible(letters: int, room: int) -> bool:
    return letters > 0 and RATIOS[0] - NEAR <= room / letters <= RATIOS[1] + NEAR


def proportional(run: range, norm: list[str], text: str, lo: int, hi: int) -> dict[int, Match]:
    """Cues of a run share text[lo:hi] by their lengths, where that is about as long as they are; the last takes what is left."""
    total, room, out = sum(len(norm[k]) for k in run), hi - lo, {}
    if room <= 0 or not plausible(total, room):
        return out
    at = used = 0
    for k in run:
        used += len(norm[k])
        end = room if k == run[-1] else (2 * room * used + total) // (2 * total)
        if norm[k] and end > at:
            out[k] = Match(lo + at, lo + end, likeness(norm[k], text[lo + at : lo + end]))
            at = end
    return out


def fill_gaps(texts: list[str], book: Book, matches: list[Match | None], limits: tuple[int, int] | None = (MAX_REGION, MAX_WORK)) -> list[Match | None]:
    """Matches with the gaps between them filled; runs at either end of the cues stay open, as do runs beyond the limits where there are any."""
    return GapFiller(texts, book, matches, limits).fill() if book.text else list(matches)


@dataclass(frozen=True)
class BookCue:
    start: int
    end: int
    text: str
    match: Match | None
    times: tuple[int, ...] = ()  # per normalised character of the match, on the file's clock


def sentence_places(book: Book) -> set[int]:
    """Normalised places before which the book ends a sentence (a terminator or a line break stands between the two characters) or starts a section."""
    out = set(book.starts)
    for base, text, at in zip(book.starts, book.sections, book.places, strict=True):
        for k in range(1, len(at)):
            between = text[at[k - 1] + 1 : at[k]]
            if "\n" in between or any(c in TERMINATORS for c in between):
                out.add(base + k)
    return out


def _spread(start: int, end: int, n: int) -> tuple[int, ...]:
    return tuple(start + (end - start) * k // n for k in range(n))


def close_gaps(cues: list[BookCue], book: Book) -> list[BookCue]:
    """Book text that no cue claims goes to the cues around or between it, as long as nobody has to speak at twice the usual rate.

    Between neighbours the gap is cut at its first sentence place; between cues
    with unmatched ones in the middle, these share it by duration, the last taking
    what rounding leaves.
    """
    out, stops = list(cues), sentence_places(book)
    ok = lambda c: c.match is not None and len(c.times) == c.match.end - c.match.start
    rates = sorted((c.match.end - c.match.start) / max(1, c.end - c.start) for c in out if ok(c))
    if not rates:
        return out
    ceiling = DENSITY * rates[len(rates) // 2]
    fast = lambda chars, c: chars > ceiling * max(1, c.end - c.start)
    known = [k for k, c in enumerate(out) if ok(c)]
    for i, j in zip(known, known[1:]):
        a, b = out[i].match.end, out[j].match.start
        if b <= a or book.section_of(out[i].match.start) != book.section_of(out[j].match.end - 1) or out[j].start < out[i].end:
            continue
        between = out[i + 1 : j]
        if not between:
            cut = next((s for s in sorted(stops) if a <= s <= b), None)
            if cut is None:
                continue
            if cut > a and not fast(cut - out[i].match.start, out[i]):
                c = out[i]
                out[i] = replace(c, match=replace(c.match, end=cut), times=c.times + _spread(max(c.times[-1], c.start), max(c.end, c.times[-1]), cut - a))
            if cut < b and not fast(out[j].match.end - cut, out[j]):
                c = out[j]
                out[j] = replace(c, match=replace(c.match, start=cut), times=_spread(c.start, max(c.start, c.times[0]), b - cut) + c.times)
        elif all(c.match is None for c in between) and all(x.end <= y.start for x, y in zip([out[i], *between], [*between, out[j]])):
            total = sum(c.end - c.start for c in between)
            if total <= 0 or b - a > ceiling * total:
                continue
            done, at = 0, a
            for k, c in enumerate(between, i + 1):
                done += c.end - c.start
                end = b if k == j - 1 else a + (b - a) * done // total
                if end > at:
                    out[k] = replace(c, match=Match(at, end, 0.0), times=_spread(c.start, c.end, end - at))
                at = end
    return out


def resegment(cues: list[BookCue], book: Book) -> list[BookCue]:
    """Runs of cues that follow each other in the book, cut where the book's sentences end and no longer where they do not.

    New edges take their time from the characters' times (start 150 ms ahead of
    the first, end before the next one's lead, 300 ms at least); an old edge that
    stays keeps its own. A cue whose match is empty has no words: it cuts no run in
    two and gives no edge, but as the last of a run its end is the run's.
    """
    stops, out, k = sentence_places(book), [], 0
    while k < len(cues):
        z = k + 1
        ok = lambda c: c.match is not None and len(c.times) == c.match.end - c.match.start
        while z < len(cues) and ok(cues[z - 1]) and ok(cues[z]) and cues[z].match.start == cues[z - 1].match.end and cues[z].start >= cues[z - 1].start:
            z += 1
        run = cues[k:z]
        k = z
        if not all(map(ok, run)):
            out += run
            continue
        lo, hi = run[0].match.start, run[-1].match.end
        spoken = [c for c in run if c.times]
        edges = [lo, *sorted(s for s in stops if lo < s < hi), hi]
        if not spoken or edges == [lo, *(c.match.end for c in run)]:
            out += run
            continue
        times = [t for c in run for t in c.times]
        old_start, old_end = {c.match.start: c.start for c in spoken}, {c.match.end: c.end for c in spoken}
        floor = 0
        for a, b in zip(edges, edges[1:]):
            start = max(floor, old_start.get(a, times[a - lo] - LEAD))
            end = old_end.get(b, times[b - lo] - LEAD if b < hi else run[-1].end)
            end = max(end, times[b - lo - 1] + FRAME, start + LEAST, run[-1].end if b == hi else 0)
            m = Match(a, b, 1.0)
            out.append(replace(run[0], start=start, end=end, text=book.source(m), match=m, times=tuple(times[a - lo : b - lo])))
            floor = end
    return out


def align_books(cues: DataFrame, sections: DataFrame, window: int | None = None) -> DataFrame:
    """cues(book_id, idx, text) and sections(book_id, idx, text, and rubies where known) into (book_id, idx, section, norm_start, norm_end, score, book_text); unmatched cues have nulls. Gaps are filled whole, however long."""

    def run(key, c: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        cols = ["book_id", "idx", "section", "norm_start", "norm_end", "score", "book_text"]
        c = c.sort_values("idx")
        s = s.sort_values("idx")
        rubies = [[(r["start"], r["end"], r["reading"]) for r in (x if x is not None else ())] for x in s["rubies"]] if "rubies" in s else None
        book = Book([t or "" for t in s["text"]], rubies)
        texts = [t or "" for t in c["text"]]
        got = fill_gaps(texts, book, match_book(texts, book, window) if window else match_probed(texts, book)[2], limits=None)
        rows = [(key[0], i, *((book.section_of(m.start), m.start, m.end, m.score, book.source(m)) if m else (None,) * 5)) for i, m in zip(c["idx"], got, strict=True)]
        return pd.DataFrame(rows, columns=cols)

    # a number of its own: by their size, which says nothing of the work, Spark would deal all books to a few tasks
    tasks = max(1, int(cues.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cues, sections = cues.repartition(tasks, "book_id"), sections.repartition(tasks, "book_id")
    return cues.groupBy("book_id").cogroup(sections.groupBy("book_id")).applyInPandas(run, "book_id long, idx long, section int, norm_start int, norm_end int, score double, book_text string")
