"""Sequential operators: by hand, against plain versions, and by what must always hold."""

import io
import random
import re
import zipfile

import numpy as np
import pytest

from weftline.functions import signal as S
from weftline.operators import book as B
from weftline.operators import clock, cuebuild, decode, matching, post, reference, retime, segment, timeline
from weftline.sources import books, media
from weftline.streaming import sessions

# -- matching


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_sellers_finds_the_nearest_substring():
    rnd = random.Random(1)
    for _ in range(300):
        hay, needle = ("".join(rnd.choice("abc") for _ in range(n)) for n in (rnd.randrange(1, 14), rnd.randrange(1, 6)))
        best = min(edits(needle, hay[i:j]) for i in range(len(hay) + 1) for j in range(i, len(hay) + 1))
        got = matching.sellers(needle, hay, 3)
        if got is None:
            assert best > 3 or best == len(needle)  # an occurrence ends at a character
        else:
            assert got[2] == edits(needle, hay[got[0] : got[1]]) and (got[2] == best or best == len(needle))


def test_sliding_dice():
    assert matching.sliding_dice("hello world", "xx hello world yy", 0, 17) == (1.0, 3, 11)
    score, start, size = matching.sliding_dice("hello wurld", "xx hello world yy", 0, 17)
    assert 0.7 < score < 1 and start == 3
    assert matching.sliding_dice("ab", "zzabzz", 0, 6)[:2] == (1.0, 2)


def test_cursor_never_goes_back():
    rnd = random.Random(2)
    text = "".join(rnd.choice("abcdefgh") for _ in range(3000))
    cues = [text[k : k + 20] for k in range(0, 2800, 25)]
    cues[5] = "zzzzzzzzzzzz"
    got = matching.cursor_match(cues, text)
    assert got[5] is None and all(m for k, m in enumerate(got) if k != 5)
    ends = [m[1] for m in got if m]
    assert ends == sorted(ends)


def test_cursor_jumps_after_misses():
    rnd = random.Random(3)
    text = "".join(rnd.choice("abcdefgh") for _ in range(6000))
    cues = ["qqqqqqqq"] * 20 + [text[5000:5020]]
    assert matching.cursor_match(cues, text)[-1] == (5000, 5020, 1.0)


def test_a_cue_longer_than_the_window_is_not_compared():
    rnd = random.Random(5)
    text = "".join(rnd.choice("abcdefgh") for _ in range(3000))
    assert matching.cursor_match([text[:51]], text, window=50) == [None] and matching.cursor_match([text[:51]], text, window=51) == [(0, 51, 1.0)]
    assert matching.cursor_match([text[:400], text[400:900]], text) == [(0, 400, 1.0), (400, 900, 1.0)]
    assert matching.cursor_match([text[1:401]], text) == [None]


def test_chain_is_heaviest():
    rnd = random.Random(4)
    for _ in range(150):
        spans = [(rnd.randrange(6), a := rnd.randrange(40), a + rnd.randrange(1, 12)) for _ in range(rnd.randrange(1, 9))]
        best = 0
        for mask in range(1 << len(spans)):
            pick = sorted(spans[k] for k in range(len(spans)) if mask >> k & 1)
            if all(a[0] < b[0] and a[2] <= b[1] for a, b in zip(pick, pick[1:])):
                best = max(best, sum(z - a for _, a, z in pick))
        chain = [spans[k] for k in matching.monotone_chain(np.array(spans))]
        assert sum(z - a for _, a, z in chain) == best
        assert all(a[0] < b[0] and a[2] <= b[1] for a, b in zip(chain, chain[1:]))


# -- post-processing


def envelope(*parts):
    return np.concatenate([np.full(n // 20, db, np.int8) for db, n in parts])


def test_snap_moves_the_cut_into_the_valley():
    db = envelope((-20, 2300), (-65, 300), (-20, 2400))
    a, b = post.snap([post.Cue(0, 2000), post.Cue(2100, 5000)], post.Envelope(db))
    assert (a.end, b.start) == (2380, 2560)


def test_unknown_levels_are_not_quiet():
    cues = [post.Cue(0, 2000), post.Cue(2100, 5000)]
    assert post.snap(cues, post.Envelope(np.zeros(250, np.int8))) == cues


def test_refine_only_draws_in():
    db = envelope((-65, 400), (-20, 2000), (-65, 600))
    (c,) = post.refine([post.Cue(0, 2900)], post.Envelope(db))
    assert (c.start, c.end) == (250, 2480)


def test_merge_needs_every_rule():
    def pair(**change):
        a = post.Cue(0, 900, "one", section=0, norm_start=0, norm_end=3)
        b = post.Cue(1000, 1900, "two", section=0, norm_start=3, norm_end=6)
        return post.merge([a, post.replace(b, **change)])

    assert len(pair()) == 1 and pair()[0].text == "onetwo" and pair()[0].members == (0, 1)
    for change in ({"section": 1}, {"norm_start": 4}, {"start": 2600, "end": 2900}, {"text": "x" * 40}):
        assert len(pair(**change)) == 2
    assert len(post.merge([post.Cue(0, 900, "one.", section=0, norm_start=0, norm_end=3), post.Cue(1000, 1900, "two", section=0, norm_start=3, norm_end=6)])) == 1  # a dot after a letter may be an abbreviation's
    assert len(post.merge([post.Cue(0, 900, "終。", section=0, norm_start=0, norm_end=3), post.Cue(1000, 1900, "two", section=0, norm_start=3, norm_end=6)])) == 2


def test_margins_widen_only():
    rnd = random.Random(6)
    db = np.array([rnd.choice([-20, -65, 0]) for _ in range(2000)], np.int8)
    cues, at = [], 0
    for _ in range(30):
        at += rnd.randrange(0, 900)
        cues.append(post.Cue(at, at + rnd.randrange(300, 1500), "abcdef" * rnd.randrange(4)))
        at = cues[-1].end
    out = post.margins(cues, post.Envelope(db), lambda t: len(t))
    for a, b in zip(cues, out):
        assert b.start <= a.start and b.end >= a.end
    for a, b in zip(out, out[1:]):
        assert b.start > a.end or b.start == cues[out.index(b)].start


# -- segments


@pytest.mark.parametrize("seed", range(6))
def test_segments_keep_their_rules(seed):
    rnd = random.Random(seed)
    probs = [p for _ in range(60) for p in [rnd.choice([0.05, 0.95])] * rnd.randrange(1, 60)]
    out = segment.segments(probs)
    for (a, z, ra, rz), nxt in zip(out, [*out[1:], None]):
        assert a <= ra < rz and rz - ra >= 250 and rz - ra <= 20_000 + 32
        assert nxt is None or nxt[0] >= z
    s, fed = segment.Segmenter(), []
    for k, p in enumerate(probs):  # state written down and read again at each window
        if k % 7 == 0:
            s = segment.Segmenter.load(s.dump())
        fed += s.feed(p)
    assert [x[2:] for x in fed + s.flush()] == [x[2:] for x in out]


def test_quiet_cuts_and_groups():
    db = np.full(3000, -20.0)
    db[1490:1520] = -60
    assert 29_800 <= segment.quiet_cuts(db, 20, 30_000, 5_000)[0] <= 30_400
    rnd = random.Random(1)
    for _ in range(100):
        w = [rnd.randrange(1, 50) for _ in range(rnd.randrange(1, 30))]
        n = rnd.randrange(1, 8)
        got = segment.balanced_groups(w, n)
        assert got[0][0] == 0 and got[-1][1] == len(w) and all(a[1] == b[0] for a, b in zip(got, got[1:])) and len(got) <= n and all(a < b for a, b in got)


def test_batches():
    assert segment.batch_size([100, 90, 80, 79], 1000, 8) == 3
    assert segment.batch_size([100, 100, 100], 200, 8) == 2 and segment.batch_size([5], 1, 1) == 1 and segment.batch_size([], 1, 1) == 0


# -- decoding


def test_forced_alignment_is_best():
    rng = np.random.default_rng(0)
    for _ in range(20):
        x = rng.normal(size=(7, 4))
        x -= np.log(np.exp(x).sum(axis=1, keepdims=True))
        targets = [1, 1, 3]
        best = -np.inf

        def walk(t, state, score):
            nonlocal best
            label = 0 if state % 2 == 0 else targets[state // 2]
            score += x[t, label]
            if t == 6:
                if state >= 5:
                    best = max(best, score)
                return
            walk(t + 1, state, score)
            if state + 1 < 7:
                walk(t + 1, state + 1, score)
            if state % 2 == 1 and state + 2 < 7 and targets[state // 2] != targets[state // 2 + 1]:
                walk(t + 1, state + 2, score)

        walk(0, 0, 0.0)
        walk(0, 1, 0.0)
        got = decode.forced_align(x, targets)
        labels = np.zeros(7, int)
        for k, (a, z, _) in enumerate(got):
            labels[a : z + 1] = targets[k]
        assert x[np.arange(7), labels].sum() == pytest.approx(best)
    assert decode.forced_align(x[:3], [1, 1, 3]) is None


def test_materialize():
    assert decode.materialize(["▁Hello", "▁wor", "ld", "▁."]) == "Hello world."
    assert decode.materialize(["<0xE3>", "<0x81>", "<0x82>", "▁x"]) == "あx"


def test_transducer_and_characters():
    enc = np.eye(4)[[0, 1, 1, 0, 2]]
    got = decode.transducer_greedy(enc, lambda ids: len(ids), lambda e, s: e)
    assert got == [(1, 1), (2, 1), (4, 2)]
    chars = decode.spread_characters(["ab", "."], [0, 200], [200, 300])
    assert chars == [("a", 0, 100), ("b", 100, 200), (".", 200, 200)]


# -- cues


def test_sentences_and_abbreviations():
    words = "▁Mr. ▁Smith ▁left. ▁He ▁ran.".split(" ")
    assert cuebuild.sentences(words, [0, 300, 600, 900, 1200]) == [(0, 3), (3, 5)]
    assert cuebuild.sentences(["a", "b"], [0, 2000]) == [(0, 1), (1, 2)]


def test_long_cues_split_well():
    rnd = random.Random(9)
    for _ in range(3000):
        text = "".join(rnd.choice("あいうえお、。！abc ") for _ in range(rnd.randrange(1, 120)))
        start, end = 1000, 1000 + rnd.randrange(200, 20_000)
        tokens = list(text) if rnd.random() < 0.5 else None
        offsets = sorted(rnd.randrange(0, end - start) for _ in text) if tokens else None
        got = cuebuild.split_long(start, end, text, tokens, offsets)
        assert "".join(t for *_, t in got) == text and got[0][0] == start and got[-1][1] == end
        assert all(a < b for a, b, _ in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:]))


def test_built_cues_do_not_overlap():
    rnd = random.Random(10)
    segs, at = [], 0
    for _ in range(40):
        n = rnd.randrange(1, 40)
        times = sorted(at + 200 + rnd.randrange(0, n * 300) for _ in range(n))
        segs.append({"start": at, "end": times[-1] + 400, "tokens": [rnd.choice(["▁a", "b", ".", "▁long", "。"]) for _ in range(n)], "times": times})
        at = segs[-1]["end"] + rnd.randrange(0, 800)
    out = cuebuild.build(segs)
    assert out and all(c["end"] > c["start"] for c in out) and all(a["end"] <= b["start"] for a, b in zip(out, out[1:]))
    again = cuebuild.resplit([s | {"continuous": True} for s in segs])
    assert sum(len(s["tokens"]) for s in again) == sum(len(s["tokens"]) for s in segs)


def _segment(start, end, words, times, **more):
    return {"start": start, "end": end, "tokens": words, "times": times, **more}


def test_cues_of_one_segment():
    plain = _segment(1000, 3000, list("今日は。"), [1300, 1600, 1900, 2200])
    assert [(c["start"], c["end"], c["offsets"]) for c in cuebuild.build([plain])] == [(1000, 3000, [300, 600, 900, 1200])]
    raw = _segment(1000, 4000, list("はい。行く。"), [1400, 1600, 1800, 2900, 3100, 3300], raw_start=1500, raw_end=3700, ends=[1500, 1700, 1900, 3000, 3200, 3400])
    a, b = cuebuild.build([raw])
    assert (a["start"], a["end"], a["offsets"], a["end_offsets"]) == (1500, 2750, [0, 100, 300], [0, 200, 400])
    assert (b["start"], b["end"], b["text"]) == (2750, 3780, "行く。")
    short = _segment(1000, 4000, list("うん"), [1100, 1200], raw_start=1000, raw_end=1200)
    longer = _segment(1000, 4000, list("うんうんうん"), [1100 + 10 * k for k in range(6)], raw_start=1000, raw_end=1200)
    assert cuebuild.build([short])[0]["end"] == 1500 and cuebuild.build([longer])[0]["end"] == 1800
    assert cuebuild.build([short | {"end": 1300}])[0]["end"] == 1300
    assert cuebuild.build([_segment(0, 900, ["。", "！"], [100, 200])]) == []
    assert [c["text"] for c in cuebuild.build([_segment(0, 900, ["♪"], [100])])] == ["♪"]
    assert cuebuild.one_per_segment([_segment(90, 900, ["a"], [100], raw_start=0, raw_end=800)])[0]["start"] == 0


def test_files_have_clocks_of_their_own():
    segs = [_segment(0, 900, ["b"], [100], file=1), _segment(0, 900, ["a"], [100]), _segment(800, 1500, ["c"], [900])]
    assert [(c["text"], c["start"], c["end"]) for c in cuebuild.build(segs, [0, 5000])] == [("a", 0, 800), ("c", 800, 1500), ("b", 5000, 5900)]
    assert [(c["start"], c["end"]) for c in cuebuild.one_per_segment(segs, [0, 5000])] == [(0, 900), (800, 1500), (5000, 5900)]


def test_only_windows_of_a_grid_are_cut_anew():
    plain = [_segment(0, 4000, ["a", "b"], [500, 2500])]
    assert cuebuild.resplit(plain) is plain
    grid = [_segment(0, 2000, ["a", "b"], [100, 1900], continuous=True), _segment(2000, 4000, ["c"], [2300], continuous=True), _segment(4500, 6000, ["d"], [4600], continuous=True), _segment(6000, 9000, ["e", "f"], [6100, 8000])]
    got = cuebuild.resplit(grid)
    assert [(s["start"], s["end"], s["tokens"]) for s in got] == [(0, 500, ["a"]), (1780, 2700, ["b", "c"]), (4500, 5000, ["d"]), (6000, 9000, ["e", "f"])]
    assert [s.get("raw_start") for s in got] == [0, 1780, 4500, None]


# -- books


def test_a_gap_that_is_left_out_costs_nothing():
    """One gap far too long, then one that can be filled."""
    rnd = random.Random(3)
    text = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    a, b, c, d, e, long = text(30), text(30), text(30), text(30), text(30), text(60_000)
    own = B.Book([a + long + b + c + d + e])
    cues = [a, *[text(12) for _ in range(200)], b, c, d, e]
    at = [30 + len(long) + 30 * k for k in range(5)]
    first = [B.Match(0, 30, 1.0), *[None] * 200, B.Match(at[0], at[1], 1.0), B.Match(at[1], at[2], 1.0), None, B.Match(at[3], at[4], 1.0)]
    got = B.fill_gaps(cues, own, first)
    assert got[203] == B.Match(at[2], at[3], 1.0) and got[1:201] == [None] * 200


def test_inexact_and_slight_matches_are_cut_anew():
    """A soft match gives up what a cue beside it needs, a slight one in the wrong place moves; fixed ones and limits between them stay."""
    own = B.Book(["abcdefghij klmnopqrst uvwxyz0123 ou 456789abcd"])
    cues = ["abcdefghij", "klmnopqrsx", "uvwxyz01", "456789abcd"]
    first = [B.Match(0, 10, 1.0), B.Match(10, 24, 0.8), None, B.Match(32, 42, 1.0)]
    got = B.fill_gaps(cues, own, first)
    assert got[0] == first[0] and got[3] == first[3] and got[1].end <= got[2].start and got[1].start == 10 and got[2].start == 20 and got[2].score == 1.0
    slight = B.fill_gaps(["abcdefghij", "ou", "uvwxyz0123", "456789abcd"], own, [B.Match(0, 10, 1.0), B.Match(11, 13, 0.5), None, B.Match(32, 42, 1.0)])
    assert slight[2] == B.Match(20, 30, 1.0)
    assert B.fill_gaps(cues, own, [None, None, first[0], None]) == [None, None, first[0], None]


def test_reading_track_maps_back():
    track, place, back = B.reading_track("漢字です", [(0, 2, "かんじ")])
    assert track == "かんじです" and place == [0, 0, 1, 2, 3] and back == [0, 0, 3, 4, 5]


def test_readings_match_where_letters_do_not(spark):
    cues = spark.createDataFrame([(1, 0, "かんじをよむ人"), (1, 1, "つぎの文です")], "book_id long, idx long, text string")
    sections = spark.createDataFrame([(1, 0, "「漢字」を読む人。次の文です。", [(1, 3, "かんじ"), (5, 6, "よ"), (9, 10, "つぎ")])], "book_id long, idx long, text string, rubies array<struct<start:int,end:int,reading:string>>")
    got = {r["idx"]: (r["norm_start"], r["norm_end"], r["book_text"]) for r in B.align_books(cues, sections, 200).collect()}
    assert got == {0: (0, 6, "「漢字」を読む人。"), 1: (6, 11, "次の文です。")}
    assert B.Book(["漢字"], [[(0, 2, " ")]]).reading is None


def test_gaps_are_filled_between_matches():
    rnd = random.Random(12)
    words = ["".join(rnd.choice("abcdefghijk") for _ in range(rnd.randrange(3, 9))) for _ in range(400)]
    sections = [" ".join(words[k : k + 100]) + "." for k in range(0, 400, 100)]
    cues = [" ".join(words[k : k + 5]) for k in range(0, 400, 5)]
    cues[10] = "".join(c if k % 3 else "z" for k, c in enumerate(cues[10]))
    book = B.Book(sections)
    first = B.match_book(cues, book)
    got = B.fill_gaps(cues, book, first)
    assert first[10] is None and got[10] is not None and all(a == b for a, b in zip(first, got) if a)
    assert all(a.end <= b.start for a, b in zip(got, got[1:]) if a and b)
    assert B.probe_windows(cues, book)[0] in (50, 200, 350)


def test_resegment_cuts_at_sentences():
    book = B.Book(["One two three. Four five six seven."])
    n = B.normalize("One two three. Four five six seven.")[0]
    cut = n.index("four") + 4
    cues = [B.BookCue(0, 1700, "One two three. Four", B.Match(0, cut, 1.0), tuple(range(0, cut * 100, 100))), B.BookCue(1700, 3200, "five six seven.", B.Match(cut, len(n), 1.0), tuple(range(1700, 1700 + (len(n) - cut) * 100, 100)))]
    got = B.resegment(cues, book)
    assert [c.text for c in got] == ["One two three.", "Four five six seven."] and got[0].end <= got[1].start + 150


def test_gaps_are_closed_within_the_rate():
    text = "One two three. Four five six seven. Eight nine ten."
    book, n = B.Book([text]), B.normalize(text)[0]
    cue = lambda a, z, s, e: B.BookCue(s, e, "", B.Match(a, z, 1.0), tuple(range(s, s + z - a)))
    four, eight = n.index("four"), n.index("eight")
    got = B.close_gaps([cue(0, four - 3, 0, 1000), cue(four + 4, eight, 1000, 2000), cue(eight, len(n), 2000, 3000)], book)
    assert got[0].match.end == four and got[1].match.start == four and all(len(c.times) == c.match.end - c.match.start for c in got)
    got = B.close_gaps([cue(0, four, 0, 1000), B.BookCue(1000, 2000, "x", None), cue(eight, len(n), 2000, 3000)], book)
    assert got[1].match == B.Match(four, eight, 0.0)
    got = B.close_gaps([cue(0, four, 0, 1000), B.BookCue(1000, 1005, "x", None), cue(eight, len(n), 2000, 3000)], book)
    assert got[1].match is None  # nobody speaks that fast


def test_neighbours_give_up_what_costs_nothing():
    assert B.tied_shrinks("abcd", "abcdxy", True) == [4, 3, 2, 1] and B.tied_shrinks("abcd", "abcd", True) == []
    text = "abcdefgh" + "mnopq" + "uvwxyz"
    got = B.negotiate([0, 1], ["abcdefgh", "mnopq"], {0: B.Match(0, 13, 0.6)}, text, 0, 13)
    assert got[1] == B.Match(8, 13, 1.0) and got[0].end == 8


# -- retiming


def test_clock_and_retiming():
    rnd = random.Random(13)
    texts = ["".join(rnd.choice("abcdefghijklmnop") for _ in range(20)) for _ in range(40)]
    subs = [(k * 3000, k * 3000 + 2000, t) for k, t in enumerate(texts)]
    speech = [(s + 5000, e + 5000, t) for s, e, t in subs]
    got = retime.retime(subs, speech)
    assert got.clock and got.matched == 40 and all(abs(a - (s + 5000)) <= 1 for (a, _), (s, _, _) in zip(got.cues, subs))
    drift = clock.fit_clock([(k, k * 20_000.0, k * 20_000 * 1.02 + 700) for k in range(50)])
    assert len(drift) == 1 and drift[0].rate == pytest.approx(1.02)
    cut = clock.fit_clock([(k, k * 5000.0, k * 5000.0 + (0 if k < 20 else 30_000)) for k in range(40)])
    assert len(cut) == 2 and cut[1].offset - cut[0].offset == pytest.approx(30_000)
    assert clock.fit_clock([(0, 0.0, 0.0)]) == []


# -- reference tracks


def track(seed=1, n=400):
    rnd, t, out = random.Random(seed), 10.0, []
    for _ in range(n):
        out.append(t)
        t += rnd.uniform(1.5, 6)
    return np.array(out)


def test_reference_fit_shift_and_cut():
    ref = track()
    rnd = random.Random(5)
    sub = np.array([t - 7 + rnd.uniform(-0.12, 0.12) for t in ref if rnd.random() < 0.8])
    f = reference.fit(sub, ref)
    assert reference.judge(f) == "accepted" and len(f.segments) == 1 and abs(f.segments[0][0] - 7) < 0.2
    cut = np.concatenate([ref[:200] - 3, ref[200:] + 12])
    f = reference.fit(cut, ref)
    assert [round(x) for x, *_ in f.segments] == [3, -12] and abs(f.breaks[0] - (ref[200] + 5)) < 12
    assert reference.judge(reference.fit(track(7), ref)) != "accepted"
    assert reference.decide(sub, [ref, track(8)])[0] in ("auto", "ask")
    assert reference.group_tracks([ref, ref + 0.1, track(9)]) in ([[0, 1], [2]], [[2], [0, 1]])


def test_unique_starts():
    assert reference.unique_starts(np.array([1.0, 1.1, 1.2, 1.0004, 3])).tolist() == [1.0, 1.2, 3.0]
    assert timeline.greedy_spaced([0, 5, 9, 12], 6) == [0, 9]


# -- sources


def test_html_sections():
    text, rubies = books.section_of_html("<html><head><title>x</title></head><body><p>A<ruby>漢<rt>かん</rt></ruby>B</p><nav>no</nav><div hidden>no</div><p>C<br>D</p><script>no</script></body></html>")
    assert text.strip() == "A漢B\nC\nD" and rubies == [(text.index("漢"), text.index("漢") + 1, "かん")]


def book_bytes(extra=()):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:x"><rootfiles><rootfile full-path="o/p.opf"/></rootfiles></container>')
        z.writestr("o/p.opf", '<package xmlns="u"><manifest><item id="a" href="a.xhtml" media-type="application/xhtml+xml"/><item id="b" href="b.xhtml" media-type="application/xhtml+xml"/><item id="n" href="n.xhtml" properties="nav" media-type="application/xhtml+xml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/><itemref idref="n"/><itemref idref="a"/></spine></package>')
        for n in "abn":
            z.writestr(f"o/{n}.xhtml", f"<p>{n}</p>")
        for n in extra:
            z.writestr(n, "x")
    return out.getvalue()


def test_books():
    assert [(h, t.strip()) for _, h, t, _ in books.read_book(book_bytes())] == [("o/b.xhtml", "b"), ("o/a.xhtml", "a")]
    with pytest.raises(books.BookError):
        books.read_book(book_bytes(["../x"]))
    with pytest.raises(books.BookError):
        books.read_book(b"no")


def test_books_in_spark(spark):
    got = books.read_books(spark.createDataFrame([("good", bytearray(book_bytes())), ("bad", bytearray(b"x"))], "path string, content binary")).collect()
    assert sorted((r["path"], r["fault"] is None) for r in got) == [("bad", False), ("good", True), ("good", True)]


def test_media():
    wave = np.sin(np.arange(16000) / 10).astype(np.float32) * 0.5
    raw = media.float_to_wav(wave)
    assert raw[:4] == b"RIFF" and np.abs(media.pcm_to_float(raw[44:]) - wave).max() < 1e-4
    box = lambda kind, data: (len(data) + 8).to_bytes(4, "big") + kind + data
    assert media.movie_payload(box(b"ftyp", b"x") + box(b"moov", box(b"trak", b"")) + box(b"mdat", b"abc")) == b"abc"
    with pytest.raises(media.MediaError):
        media.movie_payload(box(b"moov", box(b"trak", b"") * 2))
    assert media.energy_levels(wave)[0] == round(10 * np.log10((wave[:320] ** 2).mean()))
    assert media.decode_arguments("f", 10, 5)[4:8] == ["8.000", "-i", "f", "-ss"]


def test_rewritten_times_keep_all_else():
    srt = "1\r\n00:00:01,000 --> 00:00:02,000\r\nA --> b\r\n\r\n2\r\n00:01:00,5 --> 00:01:02,25 X1:0\r\nB\r\n"
    assert media.retime_text(srt, [], [0.0]) == srt
    out = media.retime_text(srt, [], [1.5])
    assert out == srt.replace("00:00:01,000 --> 00:00:02,000", "00:00:02,500 --> 00:00:03,500").replace("00:01:00,5 --> 00:01:02,25", "00:01:02,0 --> 00:01:03,75")
    assert media.retime_text(media.retime_text(srt, [], [2.0]), [], [-2.0]) == srt
    assert "A --> b" not in media.retime_text(srt, [], [-5.0])
    ass = "[Events]\nFormat: Layer, Start, End, Text\nDialogue: 0,0:00:01.00,0:00:02.00,Hi, there\n"
    assert "0:00:02.50,0:00:03.50,Hi, there" in media.retime_text(ass, [], [1.5])
    assert media.retime_bytes(b"\xff\xfe" + srt.encode("utf-16-le"), [], [1.5]) == b"\xff\xfe" + out.encode("utf-16-le")


def test_energy_timeline(spark):
    files = spark.createDataFrame([(1, 0, bytearray([236, 0, 156])), (1, 2, bytearray([255]))], "book_id long, file_id long, content binary")
    dur = spark.createDataFrame([(1, 0, 40), (1, 1, 60), (1, 2, 20)], "book_id long, file_id long, ms long")
    assert sorted((r["frame"], r["db"]) for r in media.energy_timeline(files, dur).collect()) == [(0, -20), (1, 0), (5, -1)]


# -- signal


def test_features():
    wave = np.sin(np.arange(16000) * 0.3).astype(np.float32)
    f = S.filterbank(wave)
    assert f.shape == (100, 80) and np.isfinite(f).all()
    m = S.normalized_mel(wave + np.random.default_rng(0).normal(size=16000).astype(np.float32))
    assert m.shape == (80, 100) and np.abs(m.mean(axis=1)).max() < 1e-4 and np.allclose(m.std(axis=1, ddof=1), 1, atol=1e-3)
    peak = f.mean(axis=0).argmax()
    assert abs(S.mel_points(80, 20, 7600, "kaldi")[peak + 1] - 0.3 * 16000 / 2 / np.pi) < 60


# -- streaming


def test_stream_equals_batch(spark, tmp_path):
    rnd = random.Random(3)
    rows, files = [], {}
    for f in range(3):
        p = [x for _ in range(20) for x in [rnd.choice([0.1, 0.9])] * rnd.randrange(5, 40)]
        files[f] = p
        rows += [(f, k, x, k == len(p) - 1) for k, x in enumerate(p)]
    schema = "file_id long, window long, prob double, last boolean"
    parts = [[r for r in rows if r[1] // 200 == b] for b in range(4)] + [[r for r in rows if r[1] >= 800], rows[:5]]
    done = str(tmp_path / "in")
    out = None
    for part in parts[:-1]:  # each restart of the stream sees one more file
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(done)
        out = sessions.run_available(sessions.stream_segments(spark.readStream.schema(schema).parquet(done)), spark, str(tmp_path / "out"), str(tmp_path / "state"))
    got = sorted((r["file_id"], r["raw_start_ms"], r["raw_end_ms"]) for r in out.collect())
    assert got == sorted((f, a, z) for f, p in files.items() for _, _, a, z in segment.segments(p))


def test_frames_fed_again_count_once(spark, tmp_path):
    for k, v in ((0, 5), (1, 7)):
        spark.createDataFrame([(1, 0, v), (1, k + 1, v)], "file_id long, frame long, db int").write.mode("append").parquet(str(tmp_path / "in"))
        sessions.upsert_frames(spark.readStream.schema("file_id long, frame long, db int").parquet(str(tmp_path / "in")), spark, str(tmp_path / "out"), str(tmp_path / "state"), ["file_id", "frame"])
    got = sorted((r["frame"], r["db"]) for r in sessions.latest_frames(spark, str(tmp_path / "out"), ["file_id", "frame"], "db").collect())
    assert got == [(0, 7), (1, 5), (2, 7)]


# -- tokens


def test_align_positions_and_character_times():
    from weftline.operators import tokens

    assert tokens.align_positions("abc", "abc") == [0, 1, 2, 3]
    at = tokens.align_positions("abxc", "abc")
    assert at[0] == 0 and at[1] == 1 and at[4] == 3 and at == sorted(at)
    rnd = random.Random(2)
    for _ in range(200):
        a, b = ("".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 9))) for _ in range(2))
        at = tokens.align_positions(a, b)
        assert at == sorted(at) and at[-1] == len(b) and len(at) == len(a) + 1
    assert tokens.character_times("ab。", ["ab", "。"], [0, 200], [200, 240], 1000) == [(1000, 1100), (1100, 1200), (1200, 1240)]
    assert tokens.character_times("xyz", ["ab"], [0], [10], 0) is None
    assert tokens.token_places(["ab", ",", "c"], "abc", "abc") == [0, 0, 2]


def test_exact_passages_of_any_length(spark):
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 4)))
    texts = [(i, " ".join(word() for _ in range(rnd.randrange(0, 40)))) for i in range(60)]
    items = [(j, " ".join(texts[rnd.randrange(60)][1].split()[:n])) for j, n in enumerate([1, 2, 3, 5, 6, 7, 9, 12] * 2)]
    items = [(j, t) for j, t in items if t]
    got = sorted((r["item_id"], r["doc_id"], r["at"]) for r in matching.exact_passages(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(texts, "doc_id long, text string")).collect())
    assert got == sorted((j, i, t.find(u)) for j, u in items for i, t in texts if u in t)


@pytest.mark.parametrize("most", [2, 0])
def test_exact_passages_broadcast_no_texts(spark, monkeypatch, most):
    monkeypatch.setattr(matching, "ITEMS_MB", most)
    line = "one two three four five six seven"
    texts = [(1, f"{line} and {line}"), (1, f"so {line}"), (2, "one two three"), (3, None), (4, line[2:])]
    items = spark.createDataFrame([(5, line[1:-1]), (6, "three")], "item_id long, text string")
    df = matching.exact_passages(items, spark.createDataFrame(texts, "doc_id long, text string"))
    assert sorted(map(tuple, df.collect())) == [(5, 1, 1), (5, 1, 4), (6, 1, 8), (6, 1, 11), (6, 2, 8), (6, 4, 6)]
    sides = re.findall(r"BroadcastHashJoin.*?Build(Left|Right)", df._jdf.queryExecution().executedPlan().toString())
    assert bool(sides) == bool(most) and "ResolvedHint" not in df._jdf.queryExecution().optimizedPlan().toString()
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") >= 4 if most else plan.count("strategy=merge") >= 5


def test_pairs_of_names_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(matching, "PIECE", 7)
    monkeypatch.setattr(matching, "TASK_PAIRS", 100)
    rnd = random.Random(3)
    rows = [(rnd.choice("xy"), k, rnd.choice(["", "ab", "abc", "b", None])) for k in range(60)] + [(None, 99, "ab"), (None, 100, "ab"), ("x", None, "ab"), ("y", 5, "b")]
    df = matching.name_pairs(spark.createDataFrame(rows, "g string, k long, n string"), ["g"], "k", "n")
    want = [(a, b, None if m is None or n is None else B.edit_cost(m, n)) for g, a, m in rows for h, b, n in rows if g and g == h and a is not None and b is not None and a < b]
    order = lambda r: (r[0], r[1], r[2] is None, r[2] or 0)
    assert sorted(((r["a"], r["b"], r["edits"]) for r in df.collect()), key=order) == sorted(want, key=order)
    assert df.rdd.getNumPartitions() > 10


def test_initials_of_other_alphabets():
    assert not cuebuild.ends_sentence("by Í.") and cuebuild.ends_sentence("by Í.", cuebuild.latin_initial)
    assert not cuebuild.ends_sentence("by J.", cuebuild.latin_initial) and not cuebuild.ends_sentence("Dr.", cuebuild.latin_initial)
    seg = [{"start": 0, "end": 3000, "tokens": ["▁by", "▁Í.", "▁So"], "times": [200, 500, 800]}]
    assert [c["text"] for c in cuebuild.build(seg)] == ["by Í. So"]
    assert [c["text"] for c in cuebuild.build(seg, initial=cuebuild.latin_initial)] == ["by Í.", "So"]


def test_references_without_a_semicolon():
    page = "<p>a&amp;&amp b &copy; &copy &#65; &#65 &x; c&amp</p>"
    assert books.section_of_html(page)[0] == "a&& b © © A A &x; c&\n"
    assert books.section_of_html(page, closed=True)[0] == "a&&amp b © &copy A &#65 &x; c&amp\n"


def test_cues_without_letters_cut_no_run():
    book = B.Book(["Aa bb. Cc dd. Ee ff."])
    cue = lambda at, z, k: B.BookCue(k * 2000, k * 2000 + 1800, "", B.Match(at, z, 1.0), tuple(k * 2000 + 1800 * j // max(1, z - at) for j in range(z - at)))
    got = B.resegment([cue(0, 6, 0), cue(6, 6, 1), cue(6, 12, 2), cue(12, 12, 3)], book)
    assert [(c.match.start, c.match.end, c.start, c.end) for c in got] == [(0, 4, 0, 1050), (4, 8, 1050, 4450), (8, 12, 4450, 7800)]
    got = B.resegment([cue(0, 4, 0), cue(4, 4, 1), cue(4, 12, 2)], book)
    assert [(c.match.start, c.match.end, c.start, c.end) for c in got] == [(0, 4, 0, 1800), (4, 8, 4000, 4750), (8, 12, 4750, 5800)]


def plain_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return row


def test_less_work_for_books_gives_the_same():
    rnd = random.Random(11)
    word = lambda n: "".join(rnd.choice("abc") for _ in range(rnd.randrange(n)))
    for _ in range(800):
        a, b = word(14), word(40)
        assert B.suffix_costs(a, b) == plain_edits(a[::-1], b[::-1])
        if a:
            full, cut = matching.sliding_dice(a, b, 0, len(b)), matching.sliding_dice(a, b, 0, len(b), 0.8)
            assert cut == full if full[0] >= 0.8 else cut[0] < 0.8
        for j, (edits, at) in enumerate(zip(*B.span_ends(a, b), strict=True)):
            spans = [plain_edits(a, b[k:j])[-1] for k in range(j + 1)]
            assert edits == min(spans) == spans[at]
    texts = [word(30) for _ in range(30)]
    book = B.Book(["".join(texts)])
    best, rates, got = B.match_probed(texts, book)
    assert (best, rates) == B.probe_windows(texts, book) and got == B.match_book(texts, book, best)


def test_books_are_dealt_to_as_many_tasks_as_set(spark):
    df = B.align_books(spark.createDataFrame([(1, 1, "one two three")], "book_id long, idx long, text string"), spark.createDataFrame([(1, 1, "one two three.")], "book_id long, idx long, text string"))
    plan = len(df.collect()) == 1 and df._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "AQEShuffleRead" not in plan


def test_likely_ends_give_the_nearest_stretch():
    rnd = random.Random(21)
    for _ in range(3000):
        letters = "abcdefgh"[: rnd.randrange(1, 9)]
        word = lambda n: "".join(rnd.choice(letters) for _ in range(rnd.randrange(n)))
        a, b = word(12), word(90)
        if rnd.randrange(2):
            b += "".join(c if rnd.randrange(5) else rnd.choice(letters) for c in a) + word(90)
        ends = B.span_ends(a, b)
        full = B.best_end(a, b, ends, 0, len(b)) if a and b else None
        assert B.end_costs(a, b) == ends[0] and B.best_span(a, b) == ((full.start, full.end, full.score) if full else (0, 0, 0.0))


def misheard(n):
    """A book of n sentences and its cues, of which only the first and the last are heard without a fault."""
    rnd = random.Random(5)
    parts = ["".join(rnd.choice("abcdefghijklm") for _ in range(rnd.randrange(25, 100))) for _ in range(n)]
    return parts, [parts[0], *("".join("z" if k % 4 == 1 else c for k, c in enumerate(p)) for p in parts[1:-1]), parts[-1]]


def test_long_gaps_are_filled_in_books(spark):
    parts, cues = misheard(200)
    assert sum(map(len, parts)) > 3 * B.MAX_REGION
    cues = spark.createDataFrame([(1, k, c) for k, c in enumerate(cues)], "book_id long, idx long, text string")
    got = B.align_books(cues, spark.createDataFrame([(1, k, p + ". ") for k, p in enumerate(parts)], "book_id long, idx long, text string")).collect()
    assert [(r["section"], r["book_text"]) for r in sorted(got, key=lambda r: r["idx"])] == [(k, p + ".") for k, p in enumerate(parts)]


def test_gaps_of_much_work_are_filled_without_limits():
    parts, cues = misheard(12)
    book, at = B.Book(parts * 2), sum(map(len, parts))
    first = [B.Match(0, len(parts[0]), 1.0), *[None] * 10, B.Match(at - len(parts[-1]), at, 1.0)]
    first += [B.Match(m.start + at, m.end + at, 1.0) if m else None for m in first]
    assert B.fill_gaps(cues * 2, book, first, (10_000, 12 * at)) != (whole := B.fill_gaps(cues * 2, book, first, None)) and all(whole)
    assert [book.text[m.start : m.end] for m in whole] == parts * 2
