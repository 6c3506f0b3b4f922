"""Registered queries over whole texts and all rows, against plain versions."""

import random
from collections import Counter

import duckdb
import pytest

from weftline.operators import retime
from weftline.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def got(spark, name):
    return QUERIES[name](spark, SF).collect()


def read(columns, name):
    return duckdb.sql(f"SELECT {columns} FROM '{SF}/{name}.parquet'").fetchall()


def test_dice_of_whole_items(spark):
    items = {i: Counter(t.lower()[k : k + 2] for k in range(len(t) - 1)) for i, t in read("item_id, text", "benchmark")}
    want = {}
    for a in items:
        for b in items:
            n = items[a].total() + items[b].total()
            if a < b and 2 * (shared := (items[a] & items[b]).total()) >= 0.5 * n:
                want[a, b] = shared, pytest.approx(2 * shared / n)
    assert {(r["a"], r["b"]): (r["shared"], r["dice"]) for r in got(spark, "passage_dice")} == want


def test_speaker_cues_of_whole_turns(spark):
    rows = [(c, t * 5000 + 500, t * 5000 + 2500, f"{c}:S0{t % 2}", x.replace("[", "").replace("]", "").strip(" ")) for c, t, x in read("conv_id, turn, text", "conversations")]
    assert sorted(map(tuple, got(spark, "speaker_cues"))) == sorted(r for r in rows if r[4])
    assert max(len(r[4]) for r in rows) > 40


def test_scripts_of_whole_turns(spark):
    rows = got(spark, "ass_events")
    want = [(c, "{\\i1}" + x.replace("\r\n", " ").replace("\r", " ").replace("\n", " ")) for c, _, x in read("conv_id, turn, text", "conversations")]
    assert sorted((r["conv_id"], r["text"]) for r in rows) == sorted(want) and max(len(x) for _, x in want) > 65


def test_files_of_whole_documents(spark):
    rows = {r["doc_id"]: r for r in got(spark, "file_charsets")}
    docs = read("doc_id, text", "documents")
    assert len(rows) == len(docs)
    for i, t in docs:
        raw = t.encode(("utf-16-le", "utf-16-be", "latin-1")[i % 3], "replace")
        pairs = [raw[k : k + 2] for k in range(0, min(len(raw), 64) - 1, 2)]
        high, low = sum(p[1] == 0 != p[0] for p in pairs), sum(p[0] == 0 != p[1] for p in pairs)
        want = "UTF-16LE" if high and high * 2 >= len(pairs) else "UTF-16BE" if low and low * 2 >= len(pairs) else "ISO-8859-1"
        if raw[:2] not in (b"\xff\xfe", b"\xfe\xff"):
            same = raw.decode({"UTF-16LE": "utf-16-le", "UTF-16BE": "utf-16-be", "ISO-8859-1": "latin-1"}[want], "replace") == (t if i % 3 < 2 else raw.decode("latin-1"))
            assert (rows[i]["charset"], rows[i]["same"]) == (want, same)


def test_every_cue_is_rebased(spark):
    rows = got(spark, "token_rebase")
    assert sum(len(r["tokens"].split()) for r in rows) == 2 * read("count(*)", "events")[0][0]
    events = read("user_id, event_id, epoch_us(ts) // 1000, event_type", "events")
    groups = {}
    for u, e, s, kind in events:
        groups.setdefault((u, e // 10), []).append((e, s, kind))
    for r in rows:
        m = sorted(groups.pop((r["file_id"], r["grp"])))
        first = min(s for _, s, _ in m)
        assert r["start_ms"] == first and r["tokens"] == " ".join(f"{k} x" for *_, k in m)
        assert r["offsets"] == " ".join(f"{s - first} {s - first + 100}" for _, s, _ in m)
    assert not groups


def test_retiming_is_given_whole_turns(spark, monkeypatch):
    monkeypatch.setattr(retime, "retime_files", lambda cues, spoken: cues.select("file_id", "idx", "text").join(spoken.select("file_id", "idx", "text"), ["file_id", "idx", "text"]))
    assert sorted(map(tuple, got(spark, "retime_on_speech"))) == sorted(read("conv_id, turn, text", "conversations"))


def test_retiming_matches_plain_calls(spark):
    turns = {}
    for c, t, x in read("conv_id, turn, text", "conversations"):
        turns.setdefault(c, []).append((t, x))
    rows = {(r["file_id"], r["idx"]): r for r in got(spark, "retime_on_speech")}
    assert len(rows) == sum(map(len, turns.values()))
    for c in sorted(turns)[:12]:
        mine = sorted(turns[c])
        want = retime.retime([(t * 8000, t * 8000 + 4000, x) for t, x in mine], [(t * 8000 + 5000, t * 8000 + 9000, x) for t, x in mine])
        for (t, _), (s, e) in zip(mine, want.cues, strict=True):
            r = rows[c, t]
            assert (r["start_ms"], r["end_ms"], r["matched"], r["clock"]) == (s, e, want.matched, want.clock)


@pytest.mark.parametrize("name", ["book_walk", "book_resegment"])
def test_words_without_letters(spark, tmp_path, name):
    turns = [(7, 1, "àà éé íí óó one two. Three"), (7, 2, "íí."), (7, 3, "four. five six seven óó. éé"), (7, 4, ""), (7, 5, "ñ"), (8, 1, None), (8, 2, "óó. íí íí. éé ñ."), (8, 4, "end.")]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    got = QUERIES[name](spark, str(tmp_path))
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = duckdb.sql(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)


@pytest.mark.parametrize("letters", [51, 201, 351, 900])
def test_words_longer_than_a_window(spark, tmp_path, letters):
    """One four in a book has a letter more than a window of the walk, or far more, in the middle, at the end or twice."""
    rnd = random.Random(letters)
    long = " ".join("".join(rnd.choice("abcdefgh") for _ in range((letters + k) // 4)) for k in range(4))
    turns = [(7, 0, "one."), (7, 1, f"{long}. two three four five six seven eight"), (8, 0, "one."), (8, 1, f"two three four five. {long}"), (8, 2, ""), (9, 0, "one."), (9, 1, f"{long} {long} two")]
    spark.createDataFrame(turns, "conv_id long, turn long, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    got = QUERIES["book_walk"](spark, str(tmp_path))
    duckdb.sql(f"CREATE OR REPLACE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = duckdb.sql(f"SELECT {', '.join(got.columns)} FROM ({ORACLES['book_walk']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and max(r[4] - r[3] for r in want) == letters
