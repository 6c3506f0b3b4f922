"""Text operators on small fixtures: brute force, round trips, SQL, and odd rows."""

import hashlib
import itertools
import json
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline.llm import bpe, chat, decon, dedup, langid, lm, neardup, pii, quality, queries, warc
from weftline.llm.common import Scratch, drop_rows, flat_text, fold, steps, word_hashes, words

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{k % 997}" for k in range(30_000))


def docs_of(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one two"), (5, "one two"), (5, "one two"), (None, "one two"), (None, None), (6, LONG), (7, LONG + " tail"), (8, "ÄÖ ß 日本語 🙂 \x1c\x85"), (9, "a" * 50_000)]


def odd(spark):
    """Odd rows, with extra columns that are named like the operators' own."""
    return docs_of(spark, ODD).withColumns({"score": F.lit(1), "kept": F.lit("x"), "n": F.lit(2), "digest": F.lit(3), "at": F.lit(0), "words": F.lit("q"), "rep": F.lit(1), "key": F.lit(2)})


def word_list(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


# -- common


def test_words_and_hashes_by_hand():
    texts = ["Foo bar  baz", "", " \t", "foo", None, "x\ny"]
    buf, offs = flat_text(pa.array(texts))
    s, e, first = words(buf, offs)
    got = [[bytes(buf[s[k] : e[k]]).decode() for k in range(first[d], first[d + 1])] for d in range(len(texts))]
    assert got == [re.findall(r"\S+", t or "") for t in texts]
    h = word_hashes(buf, s, e)
    assert h[0] == h[3] and len(set(h.tolist())) == 5
    assert [x for i, j in steps(offs, 5) for x in range(i, j)] == list(range(len(texts)))


def test_sliced_arrow_columns():
    col = pa.array(["aa", "b", None, "cc"]).slice(1)
    buf, offs = flat_text(col)
    assert bytes(buf) == b"bcc" and offs.tolist() == [0, 1, 1, 3]


def test_drop_rows(spark):
    rows = docs_of(spark, ODD)
    gone = Scratch(spark, "t").keep(spark.createDataFrame([(5,), (6,)], "doc_id long"), "gone")
    kept = [r["doc_id"] for r in drop_rows(rows, gone, ["doc_id"]).collect()]
    assert Counter(kept) == Counter(i for i, _ in ODD if i not in (5, 6))


# -- 1 archives


def test_surt():
    assert warc.surt("https://www.Example.com:443/a?b#c") == "com,example,www)/a?b"
    assert warc.surt(None) == "-" and warc.surt("http://a.b:8080") == "b,a:8080)/" and warc.surt("http://a.b/x y") == "b,a)/x%20y"


def test_record_round_trip():
    got = warc.parse(warc.record(7, "http://a.b/", b"x\r\n\r\ny", None))
    assert got["payload"] == b"x\r\n\r\ny" and got["headers"]["warc-type"] == "response"
    got = warc.parse(warc.record(8, None, b"abc", 7))
    assert got["payload"] == b"" and got["headers"]["warc-refers-to"] == "<urn:x-page:7>" and "Content-Length: 3" in got["http"]


def test_archive_odd_rows(spark, monkeypatch):
    rows = [(1, "http://a.b/1", "same"), (2, "http://a.b/2", "same"), (3, None, None), (4, "http://a.b/4", ""), (None, "http://a.b/n", "same"), (5, "http://a.b/5", "own"), (5, "http://a.b/5", "own"), (6, "http://x/" + "p" * 3000, "é" * 9000), (-9, "no scheme", "neg")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("file", F.lit(1))
    got = sorted(map(tuple, warc.archive_and_read(pages).drop("url").collect()), key=str)
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", -99), -99 if i is None else i)
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        keep = top[h or ""]
        want.append((i, len(p), warc.base32_sha1(p), "response" if i == keep else "revisit", None if i == keep else keep))
    assert got == sorted(want, key=str)
    assert warc.archive_and_read(pages.limit(0)).count() == 0


def test_index_blocks(spark, monkeypatch):
    scratch = Scratch(spark, "idx")
    rows = [(warc.capture_key(f"http://h{k % 7}.x/{k % 40}", k), "f", k, 1) for k in range(2300)] + [("same key", "f", k, 2) for k in range(1200)]
    caps = spark.createDataFrame(rows, "key string, file string, offset long, length long")
    shards = [(r[0], r[1]) for r in scratch.keep(warc.write_index(caps, scratch.path("i")), "s").select("first_key", "shard").collect()]
    index = warc.Index(shards, scratch.path("i"))
    for key, _, offset, _ in rows[::97]:
        hits = [x["o"] for x in index.find(key)]
        assert hits == ([offset] if key != "same key" else list(range(1200)))
    assert index.find("zzz") == [] and index.find("") == []


# -- 2 chat


def fold_by_hand(events):
    """Plain replay of one conversation's log."""
    state = {}
    for e in sorted(events, key=lambda e: (e["seq"], e["message"], e["kind"], e["role"], e["text"])):
        if e["kind"] == "regenerate":
            state = {m: v for m, v in state.items() if m < e["message"]}
            state[e["message"]] = (e["role"], "")
        elif e["kind"] == "edit":
            state[e["message"]] = (e["role"], e["text"])
        else:
            state[e["message"]] = (e["role"], state.get(e["message"], ("", ""))[1] + e["text"])
    return state


def test_fold_matches_replay(spark):
    rnd = random.Random(3)
    log = [{"conv_id": c, "seq": s, "message": rnd.randrange(4), "kind": rnd.choice(["delta"] * 5 + ["edit", "regenerate"]), "role": rnd.choice(["user", "assistant"]), "text": rnd.choice("abcdef")} for c in range(60) for s in range(rnd.randrange(12))]
    got = {}
    for r in chat.fold_log(spark.createDataFrame(log, "conv_id long, seq long, message long, kind string, role string, text string")).collect():
        got.setdefault(r["conv_id"], {})[r["message"]] = (r["role"], r["text"])
    for c in range(60):
        want = fold_by_hand([e for e in log if e["conv_id"] == c])
        # a message that a regenerate left without later events stays, empty
        assert got.get(c, {}) == want, c


def test_render_round_trip(spark):
    texts = ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\|x", "", None, "%0A%25<\n", "a\n\nb", "🙂é", "x" * 5000, "$1 \\ |"]
    rows = [(c, t, r, x) for c, t, r, x in itertools.chain(((k, 0, "user", x) for k, x in enumerate(texts)), ((k, 1, "assistant", x) for k, x in enumerate(texts)), [(50, 0, "rö<|%\nle", "x"), (50, None, None, None), (None, 1, "assistant", "n"), (51, 1, "assistant", "dup"), (51, 1, "assistant", "dup")])]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("message", F.lit("clash"))
    out = chat.render(chat.fold_log(chat.turns_to_log(turns)))
    read = {r["conv_id"]: r for r in chat.read_back(out).collect()}
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        assert [(t["role"], t["text"]) for t in read[c]["turns"]] == [(r[2] or "", r[3] or "") for r in mine]
        assert read[c]["loss_texts"] == [r[3] or "" for r in mine if r[2] == "assistant"]
    assert chat.digest(chat.read_back(chat.render(chat.fold_log(chat.turns_to_log(turns.limit(0)))))).count() == 0


# -- 3 quality


def test_quality_learns(spark):
    d, lab = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    rows = d.select("doc_id", "text").join(lab, "doc_id").collect()
    model = quality.train([r["text"] for r in rows if r["doc_id"] % 4], np.array([r["quality"] for r in rows if r["doc_id"] % 4]))
    held = [r for r in rows if r["doc_id"] % 4 == 0]
    s = model.score(*flat_text(pa.array([r["text"] for r in held])))
    assert np.mean((s >= 0.7) == np.array([r["quality"] == 1 for r in held])) > 0.9


def test_quality_blocks_agree_with_one_by_one():
    texts = [t or "" for _, t in ODD]
    model = quality.train(["good text here", "BAD!! BAD!!"] * 5, np.array([1, 0] * 5))
    whole = model.score(*flat_text(pa.array(texts)))
    for t, s in zip(texts, whole, strict=True):
        ids, share = quality.features(t)
        assert s == pytest.approx(1 / (1 + math.exp(-(float(model.weight[ids] @ share) + model.bias))), abs=1e-5)


def test_quality_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1, 0), (5, 0, 0), (5, None, 0), (None, 1, 1), (8, 1, 0)], "doc_id long, quality int, toxic int")
    out = quality.score_quality(odd(spark), quality.fit_quality(odd(spark), labels)).collect()
    assert len(out) == len(ODD) and all(0 <= r["score"] <= 1 for r in out)
    none = quality.fit_quality(odd(spark), labels.limit(0))
    assert {r["score"] for r in quality.score_quality(odd(spark), none).collect()} == {0.5}
    assert quality.score_quality(odd(spark).limit(0), none).count() == 0


# -- 4 personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_by_hand(t):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, t):
            d = "".join(c for c in m[0] if c in "0123456789")
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (14 <= len(d) <= 19 and pii.luhn(d)) or kind == "phone" and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def test_base_spans_match_plain_patterns():
    rnd = random.Random(5)
    for _ in range(8000):
        t = "".join(rnd.choice("a1.@-+ 2.3(5%94é") for _ in range(rnd.randint(0, 60)))
        assert sorted(pii.base_spans(t)) == base_by_hand(t), t
    for t in ("4111 1111 1111 1111", "+44 20 7946 0958", "x@y.z@w.v", "1.2.3.4.5.6.7.8", "999.1.1.1", "00000001.2.3.4"):
        assert sorted(pii.base_spans(t)) == base_by_hand(t)


def test_long_runs_are_quick():
    for t in ("a" * 300_000, "1" * 300_000, "+1" * 100_000, "1." * 150_000, "a." * 150_000 + "@", "1 " * 150_000):
        pii.find_spans(t)


def test_validators_and_context():
    kinds = lambda t: [x[1] for x in pii.find_spans(t)]
    assert kinds("IBAN GB82 WEST 1234 5698 7654 32") == ["iban"] and kinds("IBAN GB82 WEST 1234 5698 7654 33") == []
    assert kinds("my ssn is 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == [] and kinds("ssn 000-45-6789") == []


def test_every_further_kind_can_stay():
    found = lambda t: [(k, t[a:z]) for a, k, z, _ in pii.find_spans(t)]
    assert found("call my mobile phone 415-555-2671") == [("localphone", "415-555-2671")] and found("part 415-555-2671") == []
    assert found("call (415) 555-2671 now") == [("localphone", "(415) 555-2671")] and found("order page: call 415-555-2671") == []
    assert found("my phone is +1 415-555-2671") == [("phone", "+1 415-555-2671")]
    assert found("my ssn is 123-45-6789") == [("ssn", "123-45-6789")] and found("visa card 4222222222222") == [("card13", "4222222222222")]
    iban = "ES91 2100 0418 4502 0005 1332"
    for tail in ("", " BIC CAIXESBB", " BANK", " AND 1234", ".", " X"):
        assert found(f"account {iban}{tail}") == [("iban", iban)], tail
    assert found(f"AB12 CDEF GHIJ {iban}") == [("iban", iban)]
    pii.find_spans("AB12 CDEF " * 30_000)


def test_secrets():
    found = lambda t: [(k, t[a:z]) for a, k, z, _ in pii.find_spans(t)]
    key, value = "AKIA" + "Q7ZK2M4PX9LT3W8B", "69760a67bd64a3a7e9ecd68a"
    assert found(f"use {key} for it") == [("accesskey", key)] and found(f"x{key}") == [] and found(f"{key}7") == []
    for t in (f"password={value} and", f'token = "{value}" x', f"API_KEY: '{value}'", f"my Secret:{value}"):
        assert found(t) == [("secret", value)], t
    for t in ("password=password", "token: 11111111", "secret = aaaaaaaa1", "the password is long", "pwd=a1b2", f"mytoken={value}", "password example: page1page"):
        assert found(t) == [], t
    assert pii.entropy("ab") == 1 and pii.entropy("aaaa") == 0
    for t in ("password=" * 30_000, "token=" + "a1" * 200_000, "IA" * 200_000):
        pii.find_spans(t)


def test_pii_odd_rows(spark):
    out = pii.find_personal_data(odd(spark)).collect()
    assert len(out) == len(ODD) and {r["spans"] for r in out} == {""}
    assert pii.find_personal_data(odd(spark).limit(0)).count() == 0


# -- 5 near copies


def sets_by_hand(rows):
    out = {}
    for i, t in rows:
        w = word_list(t)
        out[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def components_by_hand(sets):
    name = {i: i for i in sets}

    def find(x):
        while name[x] != x:
            x = name[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            name[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_superminhash_estimates():
    rng = np.random.default_rng(1)
    errors = []
    for n, shared in ((600, 500), (40, 36), (3, 2), (70_000, 60_000)):
        x = rng.integers(0, 2**63, 2 * n - shared).astype(np.uint64)
        for _ in range(1 if n > 1000 else 30):
            x = neardup.mix(x + np.uint64(1))
            s = neardup.superminhash([x[:n], x[n - shared :]])
            errors.append((s[0] == s[1]).mean() - shared / (2 * n - shared))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06
    assert (neardup.superminhash([np.zeros(0, np.uint64)]) == np.iinfo(np.uint64).max).all()


def test_superminhash_by_hand():
    """The same ranks, one element at a time, without early stopping."""
    rng = np.random.default_rng(2)
    e = rng.integers(0, 2**63, 9).astype(np.uint64)
    want = [2**64 - 1] * 16
    for x in e:
        order = list(range(16))
        for j in range(16):
            r = int(neardup.mix(np.array([x]) + neardup._STEP[j])[0])
            k = j + ((r & 0xFFFFFF) * (16 - j) >> 24)
            order[j], order[k] = order[k], order[j]
            want[order[j]] = min(want[order[j]], r >> 8 | j << 56)
    assert neardup.superminhash([e], 16)[0].tolist() == want


def near_rows(seed=4, groups=12):
    rnd = random.Random(seed)
    rows, i = [], 0
    for g in range(groups):
        base = [f"t{rnd.randrange(4000)}" for _ in range(rnd.choice([3, 6, 30, 120]))]
        for _ in range(rnd.choice([1, 2, 5, 40 if g == 0 else 3])):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 4])):
                w[rnd.randrange(len(w))] = f"z{rnd.randrange(9999)}"
            rows.append((i, (" " if rnd.random() < 0.5 else "\n").join(w).title()))
            i += 1
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [256, 8])
def test_near_duplicates_match_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rows = near_rows()
    sets = sets_by_hand(rows)
    want = components_by_hand(sets)
    got = {r["doc_id"]: r for r in neardup.near_duplicates(docs_of(spark, rows)).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(got[i]["n_shingles"] == len(sets[i]) and got[i]["kept"] == (want[i] == i) for i in sets)


def loose_family(n, seed=11, length=60, edits=(1, 9)):
    """Copies of one text with a different number of words changed, so that many link only by way of others, and texts half like it that share band keys."""
    rnd = random.Random(seed)
    base = [f"b{k}" for k in range(length)]
    rows = []
    for i in range(n):
        w = list(base)
        at = rnd.randrange(length)
        for k in range(rnd.randint(*edits)):  # a run of changed words leaves most shingles
            w[(at + k) % length] = f"x{i}.{k}"
        if i % 9 == 0:
            w[length // 2 :] = [f"y{i}.{k}" for k in range(length // 2)]
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("percent", [75, 60, 100])
def test_large_group_matches_all_pairs(spark, monkeypatch, percent):
    """A group of many blocks, with strays in several slices of distance."""
    monkeypatch.setattr(neardup, "BLOCK", 8)
    rows = loose_family(150)
    sets = sets_by_hand(rows)
    name = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((name[a], name[b]))
            name = {i: x if c == y else c for i, c in name.items()}
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs_of(spark, rows), percent).collect()}
    assert got == name


def test_rows_grow_with_a_family_not_with_its_square(spark, monkeypatch):
    """Rows sent to verification and links of families of 300 and 1,200 copies around one text."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    sizes = {}
    keep = Scratch.keep

    def counted(self, df, name):
        out = keep(self, df, name)
        if name.endswith("dealt") or name in ("first", "second"):
            sizes[name] = sizes.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(Scratch, "keep", counted)
    seen = []
    for n in (300, 1200):
        sizes.clear()
        got = neardup.near_duplicates(docs_of(spark, loose_family(n, length=200, edits=(1, 14))).where("doc_id % 9 <> 0")).select("component_id").distinct().count()
        assert got == 1
        seen.append(dict(sizes))
    for name, few in seen[0].items():
        assert seen[1][name] <= 6 * few + 50, seen


def test_equal_rows_and_large_family(spark):
    rows = [(k, "the same text of some seven words") for k in range(5000)] + [(10_000 + k, " ".join([f"w{j}" for j in range(60)] + [f"own{k}"])) for k in range(3000)] + [(7, "")] * 50 + [(8, "one two three four five six")] * 500
    got = neardup.near_duplicates(docs_of(spark, rows)).groupBy("component_id").count().collect()
    # the ids 7 and 8 have other texts too: those of 8 fall to the class of 0
    assert {r["component_id"]: r["count"] for r in got} == {0: 5500, 7: 50, 10_000: 3000}


def test_shared_ids_are_one_name(spark):
    x, y, z = ("alpha beta gamma delta epsilon zeta", "one two three four five six", "other words that nobody else has here")
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(docs_of(spark, [(3, y), (5, y), (5, x), (9, x), (11, z), (11, z), (12, None)])).collect()]
    assert sorted(got) == [(3, 3, True), (5, 3, False), (5, 3, False), (9, 3, False), (11, 11, True), (11, 11, True), (12, 12, True)]


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") % 2] for k in range(n))


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096])
def test_long_words_that_defeat_polynomials(spark, n):
    word = thue_morse(n)
    other = word.translate(str.maketrans("ab", "ba"))
    buf, offs = flat_text(pa.array([word, other]))
    h = word_hashes(buf, *words(buf, offs)[:2])
    assert h[0] != h[1]
    rows = [(1, f"{word} b c d e"), (2, f"{other} b c d e"), (3, f"{word.upper()} b  c d e")]
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(docs_of(spark, rows)).collect()} == {1: 1, 2: 2, 3: 1}


def test_word_hashes_do_not_depend_on_place():
    rnd = random.Random(1)
    some = ["".join(rnd.choice("abcd") for _ in range(n)) for n in (1, 7, 8, 9, 15, 16, 17, 511, 512, 513, 700)] + ["a", "b", "ab", "ba"]
    buf, offs = flat_text(pa.array([" ".join(some), "  ".join(reversed(some)), *some, "".join(some)]))
    s, e, _ = words(buf, offs)
    h = word_hashes(buf, s, e)
    by = {}
    for a, z, x in zip(s.tolist(), e.tolist(), h.tolist(), strict=True):
        by.setdefault(bytes(buf[a:z]), set()).add(x)
    assert all(len(x) == 1 for x in by.values()) and len(set().union(*by.values())) == len(by)


def test_exact_counts_by_hand():
    rnd = random.Random(9)
    texts = [" ".join(rnd.choice("abcdE") for _ in range(rnd.randrange(0, 60))) for _ in range(30)]
    sets = sets_by_hand(list(enumerate(texts)))
    sets = {i: s if len(texts[i].split()) >= 5 else set() for i, s in sets.items()}
    for cells in (neardup.CELLS, 64):
        neardup.CELLS, old = cells, neardup.CELLS
        got = neardup.common_counts(*neardup.exact_sets([t.encode() for t in texts]), len(texts))
        neardup.CELLS = old
        assert got.tolist() == [[len(sets[i] & sets[j]) for j in sets] for i in sets]


def test_near_copies_by_row(spark):
    """Rows go by place, not by id: repeated and null ids lose no text and keep no copy."""
    a = " ".join(f"w{k}" for k in range(40))
    rows = [(5, a), (5, a + " x"), (5, "another text of six words here"), (None, a + " y"), (None, "something else that has some words"), (3, a + " z"), (6, ""), (6, None), (None, "")]
    placed = dedup.located(docs_of(spark, rows), Scratch(spark, "t"))
    gone = neardup.near_copies(placed, ("wl_file", "wl_row"))
    left = [(r["doc_id"], r["text"]) for r in drop_rows(placed, gone, ["wl_file", "wl_row"]).collect()]
    assert sorted(left, key=str) == sorted([rows[2], rows[4], rows[5], rows[6], rows[7], rows[8]], key=str)
    assert neardup.near_copies(placed.limit(0), ("wl_file", "wl_row")).count() == 0


def test_near_duplicates_odd_rows(spark):
    out = neardup.near_duplicates(odd(spark)).collect()
    assert len(out) == len(ODD)
    got = {(r["doc_id"], r["n_shingles"] > 0): (r["component_id"], r["kept"]) for r in out}
    assert got[(1, False)] == (1, True) and got[(5, True)] == (4, False) and got[(None, True)] == (None, True) and got[(7, True)] == (6, False)
    assert neardup.near_duplicates(odd(spark).limit(0)).count() == 0


def test_components_of_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(1000, 1001), (5, 5)], "a long, b long")
    got = {r["id"]: r["component"] for r in neardup.components(links, Scratch(spark, "cc"), "c").collect()}
    assert got == {k: 0 for k in range(301)} | {1000: 1000, 1001: 1000}


# -- 6 language model


def ctw_by_hand(train, depth=3):
    """Counts in dictionaries and probabilities by the recursion itself."""
    counts = {}
    for text in train:
        raw = text.encode() + b"\0"
        past = [27] * depth
        for byte in raw:
            for d in range(depth + 1):
                node = 1
                for k in range(7, -1, -1):
                    bit = byte >> k & 1
                    counts.setdefault((node, tuple(past[:d])), [0, 0])[bit] += 1
                    node = node * 2 + bit
            past = [int(lm.CLASS[byte]), *past][:depth]

    def log_kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.log(math.pi) - math.lgamma(a + b + 1)

    weights = {}

    def log_pw(node, ctx):
        if (node, ctx) not in counts:
            return 0.0
        if (node, ctx) not in weights:
            own = log_kt(*counts[node, ctx])
            weights[node, ctx] = own if len(ctx) == depth else np.logaddexp(math.log(0.5) + own, math.log(0.5) + sum(log_pw(node, (*ctx, c)) for c in range(lm.WIDTH)))
        return weights[node, ctx]

    def one(node, past):
        p = None
        for d in range(depth, -1, -1):
            ctx = tuple(past[:d])
            a, b = counts.get((node, ctx), (0, 0))
            own = (b + 0.5) / (a + b + 1)
            if p is None:
                p = own
            else:
                share = math.exp(math.log(0.5) + log_kt(a, b) - log_pw(node, ctx)) if (node, ctx) in counts else 0.5
                p = share * own + (1 - share) * p
        return p

    def score(text):
        total, past = 0.0, [27] * depth
        for byte in text.encode() + b"\0":
            node = 1
            for k in range(7, -1, -1):
                bit = byte >> k & 1
                p = one(node, past)
                total += math.log10(p if bit else 1 - p)
                node = node * 2 + bit
            past = [int(lm.CLASS[byte]), *past][:depth]
        return total

    return score


def test_model_matches_recursion_and_base_counts(spark):
    rows = [(k, t) for k, t in enumerate(["abra cadabra", "Abra Ca, 12!", "", None, "été déjà", "zzz new words", "abra abra abra", "cadabra\nx", "q"] * 2)]
    out = {r["doc_id"]: r for r in lm.score_texts(docs_of(spark, rows), fold("doc_id", 7) != 2).collect()}
    learn = [t or "" for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2]
    score = ctw_by_hand(learn)
    c = Counter(w for t in learn for w in [*word_list(t), None])
    total = sum(c.values())
    for i, t in rows:
        w = [*word_list(t), None]
        r = out[i]
        assert r["score"] == pytest.approx(score(t or ""), rel=1e-5) and r["train_tokens"] == total and r["n_tokens"] == len(w)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (total + len(c) + 1)) for x in w)) and r["n_known"] == sum(c[x] > 0 for x in w)


@pytest.mark.parametrize("head", [1 << 20, 30])
def test_contexts_are_bytes(spark, monkeypatch, head):
    """Texts that differ in a letter beyond ASCII only are told apart, at depth 5, with cells broadcast or joined."""
    monkeypatch.setattr(lm, "CELL_HEAD", head)
    rows = [(k, t) for k, t in enumerate(["кот кот", "\u0431к \u0431к", "漢字漢字", "1212", "кит", ""] * 2)]
    out = {r["doc_id"]: r["score"] for r in lm.score_texts(docs_of(spark, rows), F.col("doc_id") < 4, depth=5).collect()}
    score = ctw_by_hand([t for k, t in rows if k < 4], 5)
    for i, t in rows:
        assert out[i] == pytest.approx(score(t), rel=1e-5)


def test_cells_grow_with_the_corpus(spark):
    n = [lm.count_corpus(docs_of(spark, [(i, t)]).withColumn("learned", F.lit(True)), 5).where("kind = 1").count() for i, t in enumerate(["чашка", "чашка и блюдце 漢字 12"])]
    assert n == [len("чашка".encode()) + 1, len("чашка и блюдце 漢字 12".encode()) + 1]


def test_small_head_changes_nothing(spark, monkeypatch):
    d = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    learn = fold("doc_id", 7) != 2
    a = {r["doc_id"]: r for r in lm.score_texts(d, learn).collect()}
    monkeypatch.setattr(lm, "HEAD", 40)
    for r in lm.score_texts(d, learn).collect():
        assert r["n_known"] == a[r["doc_id"]]["n_known"] and r["base_score"] == pytest.approx(a[r["doc_id"]]["base_score"])


def test_model_odd_rows(spark):
    out = lm.score_texts(odd(spark), fold("doc_id", 7) != 2).collect()
    assert len(out) == len(ODD) and all(r["score"] < 0 for r in out)
    nothing = lm.score_texts(odd(spark), F.lit(False)).collect()
    assert {r["base_score"] for r in nothing} == {0.0} and {r["train_tokens"] for r in nothing} == {0}
    assert lm.score_texts(odd(spark).limit(0), F.lit(True)).count() == 0


# -- 7 exact copies


def copies_by_hand(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    return {t: (max((i for i in g if i is not None), default=None), len(g)) for t, g in groups.items()}


@pytest.mark.parametrize("files", [1000, 1])
def test_exact_copies(spark, files):
    rows, _ = dedup.exact_duplicates(odd(spark).repartition(3), files_per_batch=files)
    out = rows.collect()
    want = copies_by_hand(ODD)
    by_digest = {hashlib.sha256(t.encode()).digest(): v for t, v in want.items()}
    assert len(out) == len(ODD)
    for r in out:
        assert (r["keep"]["doc_id"], r["group_size"]) == by_digest[bytes(r["digest"])]
    assert sum(r["kept"] for r in out) == len(want)
    assert dedup.exact_duplicates(odd(spark).limit(0))[0].count() == 0


def test_a_broken_run_is_resumed(spark, monkeypatch, tmp_path):
    """A stream that fails in its second micro-batch goes on from there when called again with its folder."""
    docs = docs_of(spark, [(k, f"text {k % 40}") for k in range(200)]).repartition(4)
    folder, real, seen = f"file://{tmp_path}/state", dedup.stream_groups, []

    def broken(path, schema, scratch, files):
        write = scratch.spark.createDataFrame([], schema).write.__class__.parquet

        def put(self, out, *a, **k):
            if "batch=" in out:
                seen.append(out.rpartition("=")[2])
                if len(seen) == 3:  # the empty one, the first, the second
                    raise OSError("lost")
            return write(self, out, *a, **k)

        monkeypatch.setattr("pyspark.sql.readwriter.DataFrameWriter.parquet", put)
        return real(path, schema, scratch, files)

    monkeypatch.setattr(dedup, "stream_groups", broken)
    with pytest.raises(Exception, match="lost"):
        dedup.exact_duplicates(docs, files_per_batch=1, folder=folder)
    first = list(seen)
    rows, _ = dedup.exact_duplicates(docs, files_per_batch=1, folder=folder)
    out = {r["doc_id"]: (r["keep"]["doc_id"], r["group_size"], r["kept"]) for r in rows.collect()}
    assert out == {k: (160 + k % 40, 5, k >= 160) for k in range(200)}
    assert first == ["-1", "0", "1"] and "0" not in seen[len(first) :] and "1" in seen[len(first) :]


def test_digest_collisions_are_told_apart(spark, monkeypatch):
    """With a digest of one byte, groups still are those of equal bytes."""
    monkeypatch.setattr(dedup.F, "sha2", lambda c, n, f=F.sha2: F.substring(f(c, n), 1, 2))
    data = [(k, f"text {k % 600}") for k in range(1500)] + [(2000, None), (2001, "")]
    rows, _ = dedup.exact_duplicates(docs_of(spark, data))
    want = copies_by_hand(data)
    got = {r["doc_id"]: (r["keep"]["doc_id"], r["group_size"], r["kept"]) for r in rows.collect()}
    assert got == {i: (*want[t or ""], want[t or ""][0] == i) for i, t in data}


# -- 8 languages


def viterbi_by_hand(s, penalty):
    v, back = s[0].astype(float), []
    for t in range(1, len(s)):
        new, b = [], []
        for k in range(s.shape[1]):
            o = [v[j] - (penalty if j != k else 0) for j in range(s.shape[1])]
            b.append(int(np.argmax(o))), new.append(max(o) + s[t, k])
        v, back = np.array(new), [*back, b]
    path = [int(v.argmax())]
    for b in reversed(back):
        path.append(b[path[-1]])
    return path[::-1], v.max()


def value(s, path, penalty):
    return sum(s[t, k] for t, k in enumerate(path)) - penalty * sum(a != b for a, b in itertools.pairwise(path))


def test_viterbi_is_best():
    rng = np.random.default_rng(0)
    sizes = [0, 1, 2, 9, 40, 40, 0, 25]
    first = np.concatenate([[0], np.cumsum(sizes)])
    for scale in (0.1, 1, 5):
        s = (rng.normal(size=(first[-1], 3)) * scale).astype(np.float32)
        path = langid.viterbi(s, first, 2.0)
        for d, n in enumerate(sizes):
            if n:
                a, z = first[d], first[d + 1]
                assert value(s[a:z], path[a:z], 2.0) == pytest.approx(viterbi_by_hand(s[a:z], 2.0)[1], abs=1e-4)


def test_language_accuracy_and_spans(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit_languages(d)
    got = {r["doc_id"]: r for r in langid.label_languages(d, model).collect()}
    held = [r for r in d.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert np.mean([got[r["doc_id"]]["lang_pred"] == r["lang"] for r in held]) > 0.97
    texts = {lang: next(r["text"] for r in held if r["lang"] == lang and len(r["text"]) > 900)[:800] for lang in ("en", "de")}
    mixed = texts["en"] + "\n" + texts["de"]
    spans = langid.label(model, *flat_text(pa.array([mixed])))[2][0]
    assert spans[0]["lang"] == "en" and spans[-1]["lang"] == "de" and abs(spans[-1]["start"] - 800) < 120


def test_scripts_narrow(spark):
    model = langid.train([("the cat sat on the mat", "en"), ("кот сидит на ковре", "ru"), ("le chat est là", "fr")] * 3)
    lang, score, _ = langid.label(model, *flat_text(pa.array(["щука", "12 34", "", None, "mat", "漢字", "é"])))
    assert lang[0] == "ru" and lang[1:4] == ["und"] * 3 and lang[4] == "en" and lang[5] != "und" and score[0] == 1.0


def test_languages_odd_rows(spark):
    d = odd(spark).withColumn("lang", F.when(F.col("doc_id") > 4, "en"))
    out = langid.label_languages(d, langid.fit_languages(d)).collect()
    assert len(out) == len(ODD) and [r["lang_pred"] for r in out][:3] == ["und"] * 3
    none = langid.fit_languages(d.limit(0))
    assert {r["lang_pred"] for r in langid.label_languages(d, none).collect()} == {"und"}


# -- 9 leaks


def leaks_by_hand(docs, items):
    out = {}
    for (i, t), (j, u) in itertools.product(docs, items):
        w, x = (t or "").lower().split(), (u or "").lower().split()
        if len(x) < 6:
            if x and w == x:
                out[i, j] = len(x)
            continue
        best = 0
        for shift in range(-len(x), len(w) + 1):
            run = 0
            for k, word in enumerate(x):
                run = max(0, run + (1 if 0 <= k + shift < len(w) and w[k + shift] == word else -decon.PENALTY))
                best = max(best, run)
        if best >= min(decon.MIN_SCORE, max(6, len(x) / 2)):
            out[i, j] = best
    return out


@pytest.mark.parametrize("block_words", [100_000, 40])
def test_leaks_match_all_overlays(spark, block_words):
    rnd = random.Random(8)
    word = lambda: f"v{rnd.randrange(300)}"
    items = [(k, " ".join(word() for _ in range(rnd.choice([4, 6, 8, 15, 40])))) for k in range(12)] + [(90, None), (91, "")]
    docs = []
    for i in range(60):
        w = [word() for _ in range(rnd.randrange(0, 80))]
        if i % 2:
            x = items[rnd.randrange(12)][1].split()
            x = x[rnd.randrange(0, 4) :]
            x = [word() if rnd.random() < 0.08 else t for t in x]
            at = rnd.randrange(len(w) + 1)
            w[at:at] = x
        docs.append((i, " ".join(w).upper()))
    docs += [(100, None), (101, ""), (102, items[4][1]), (102, items[4][1])]
    pattern = "1111101" + "01111101" * 6  # agrees and not, so that masks without care have no hit
    long = [word() for _ in pattern]
    items += [(92, " ".join(long)), (93, "just four words here"), (94, "solo"), (94, "solo")]
    docs += [(103, " ".join(w if c == "1" else "other" for w, c in zip(long, pattern, strict=True))), (104, "Just  FOUR words\there"), (105, "just four words here too"), (106, "solo"), (None, "solo")]
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in decon.contaminated(docs_of(spark, docs).withColumn("seed", F.lit(1)), spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(0)), block_words=block_words).collect()}
    want = leaks_by_hand(docs, items)
    assert got == want and (103, 92) in want and (None, 94) in want


def test_no_run_that_reaches_the_score_avoids_all_masks():
    """The best score of a run over all strings of agreements without a hit, by their last positions; before a run nothing agrees."""
    n = decon.SPAN - 1
    need = [sum(1 << mask[-1] - o for o in mask) for mask in decon.MASKS]
    best = {0: 0}
    while True:
        new = dict(best)
        for s, v in best.items():
            for agrees in (0, 1):
                w = s << 1 | agrees
                if any(w & x == x for x in need):
                    continue
                run = v + (1 if agrees else -decon.PENALTY)
                if run > 0 and run > new.get(w & (1 << n) - 1, 0):
                    new[w & (1 << n) - 1] = run
        if new == best:
            break
        best = new
        assert max(best.values()) < decon.LEAST
    assert max(best.values()) == decon.LEAST - 1


def test_leaks_by_row(spark):
    """Rows named by other columns: repeats of an id and null ids are told apart."""
    item = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([("f", 1, None, f"x {item}"), ("f", 2, 5, item), ("f", 3, 5, "clean"), (None, 4, None, None)], "file string, n long, doc_id long, text string")
    got = decon.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string"), row=("file", "n"))
    assert sorted(map(tuple, got.collect())) == [("f", 1, 1, 11, 11), ("f", 2, 1, 11, 11)]


def test_leaks_empty(spark):
    b = spark.createDataFrame([], "item_id long, text string")
    assert decon.contaminated(odd(spark), b).count() == 0
    some = spark.createDataFrame([(1, LONG)], "item_id long, text string")
    assert {r["doc_id"] for r in decon.contaminated(odd(spark), some).collect()} == {6, 7}
    assert decon.contaminated(odd(spark).limit(0), some).count() == 0


# -- 10 tokens


def reference_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path())


STRANGE = ["", " ", "İstanbul ΣΑΣ ὈΔΥΣΣΕΎΣ", "don't I'LL we've 'S", "a<|endoftext|>b <|startoftext|><|startoftext|>", "été é", "x\x1cy\x85z\xa0w　v", "日本語 テスト 한국어 🙂👍🏽 ½ Ⅷ ３", "a" * 3000, "the" * 500 + " " + "!?" * 400, "\x00\x01 ﻿ ​.", "<|endoftext", "1234 12a3", "ẞİ"]


@pytest.mark.parametrize("most", [500_000, 30])
def test_tokens_match_the_library(most):
    t, own = reference_tokenizer(), bpe.WordBPE(queries.tokenizer_path(), most)
    texts = STRANGE + [r[0] for r in duckdb.sql(f"SELECT text FROM '{SF}/documents.parquet' LIMIT 60").fetchall()]
    for at in range(0, len(texts), 9):
        for s, (ids, decoded) in zip(texts[at : at + 9], own.encode_texts([x.encode() for x in texts[at : at + 9]]), strict=True):
            want = t.encode(s, add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == want, s
            assert decoded.decode() == t.decode(want, skip_special_tokens=False), s


def test_full_table_and_batches_of_one():
    whole, own = bpe.WordBPE(queries.tokenizer_path()), bpe.WordBPE(queries.tokenizer_path(), 4)
    for x in (b"one two three", b"two four five six", b"six seven", b"a b c d e f", b"f a g"):
        assert own.encode_texts([x]) == whole.encode_texts([x])


def test_tokens_odd_rows(spark):
    out = bpe.encode_documents(odd(spark), queries.tokenizer_path(), digests=True).collect()
    t = reference_tokenizer()
    assert len(out) == len(ODD)
    for r, (i, text) in zip(out, ODD, strict=True):
        want = t.encode(text or "", add_special_tokens=False).ids
        assert r["doc_id"] == i and r["token_ids"] == want and r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
    assert bpe.encode_documents(odd(spark).limit(0), queries.tokenizer_path()).count() == 0


def test_ids_decode_like_the_library(spark):
    t = reference_tokenizer()
    rows = list(enumerate([*STRANGE, None]))
    encoded = bpe.encode_documents(docs_of(spark, rows), queries.tokenizer_path(), digests=True)
    got = {r["doc_id"]: r["decoded"] for r in bpe.decode_documents(encoded, queries.tokenizer_path()).collect()}
    want = {i: t.decode(t.encode(x or "", add_special_tokens=False).ids, skip_special_tokens=False) for i, x in rows}
    assert got == want
    assert {r["doc_id"]: r["decoded_sha256"] for r in encoded.collect()} == {i: hashlib.sha256(x.encode()).hexdigest() for i, x in want.items()}


# -- queries and pipeline


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    for t in ("documents", "pages", "conversations", "labels", "benchmark"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = duckdb.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF)
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)
    assert sorted(tuple(map(str, r)) for r in got.select(*cols).collect()) == sorted(tuple(map(str, r)) for r in want.select(', '.join(cols)).fetchall())


def test_pipeline_goes_by_rows(spark, tmp_path):
    """Nulls, repeats and shared ids: no clean text is lost, no copy or leak stays; an empty table gives an empty result."""
    import pyarrow.parquet as pq

    import corpus_pipeline

    rnd = random.Random(2)
    clean = [" ".join(f"word{rnd.randrange(900)}" for _ in range(60)) for _ in range(6)]
    item = " ".join(f"item{k}" for k in range(15))
    rows = [(1, clean[0]), (1, clean[1]), (2, clean[0]), (None, clean[2]), (None, clean[3] + " " + item), (None, clean[2] + " more"), (3, clean[4]), (3, clean[4]), (3, clean[4] + " x"), (4, None), (None, None), (5, clean[5])]
    monkey = corpus_pipeline.STAGES[0]
    corpus_pipeline.STAGES[0] = ("quality", lambda spark, docs, sf_dir: docs)
    try:
        for name, table in (("some", rows), ("none", [])):
            folder = tmp_path / name
            folder.mkdir()
            pq.write_table(pa.table({"doc_id": pa.array([i for i, _ in table], pa.int64()), "text": pa.array([t for _, t in table], pa.string()), "lang": pa.array(["en"] * len(table), pa.string()), "source": pa.array(["s"] * len(table), pa.string()), "n_chars": pa.array([0] * len(table), pa.int64())}), folder / "documents.parquet")
            pq.write_table(pa.table({"item_id": pa.array([1], pa.int64()), "text": [item]}), folder / "benchmark.parquet")
            pq.write_table(pa.table({"doc_id": pa.array([], pa.int64()), "quality": pa.array([], pa.int32())}), folder / "labels.parquet")
            out = corpus_pipeline.run(spark, str(folder)).collect()
            digest = lambda x: hashlib.sha256(reference_tokenizer().decode(reference_tokenizer().encode(x, add_special_tokens=False).ids, skip_special_tokens=False).encode()).hexdigest()  # noqa: E731, B023
            kept = sorted(((r["doc_id"], r["decoded_sha256"]) for r in out), key=str)
            # of equal texts the row with the largest id stays, of near copies that with the smallest, null last
            want = [(1, clean[1]), (2, clean[0]), (3, clean[4]), (4, ""), (5, clean[5])]
            if name == "none":
                assert kept == []
                continue
            assert {(i, h) for i, h in kept if i is not None} in ({(i, digest(x)) for i, x in want}, {(i, digest(x)) for i, x in want[:2] + [(3, clean[4] + " x")] + want[3:]})
            assert [h for i, h in kept if i is None] in ([digest(clean[2])], [digest(clean[2] + " more")])
    finally:
        corpus_pipeline.STAGES[0] = monkey


def test_pipeline_against_plain_version(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit_quality(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    rows = [x for x, s in zip(rows, model.score(*flat_text(pa.array([t for _, t in rows]))), strict=True) if s >= 0.7]
    best = {}
    for i, t in rows:
        best[t] = max(best.get(t, -1), i)
    rows = [(i, t) for i, t in rows if best[t] == i]
    name = components_by_hand(sets_by_hand(rows))
    rows = [(i, t) for i, t in rows if name[i] == i]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(i, t) for i, t in rows if not any(u in t for _, u in items)]
    t = reference_tokenizer()
    want = {i: t.encode(x, add_special_tokens=False).ids for i, x in rows}
    out = corpus_pipeline.run(spark, SF).collect()
    got = {r["doc_id"]: r["token_ids"] for r in out}
    assert got == want
    assert all(r["decoded_sha256"] == hashlib.sha256(t.decode(r["token_ids"], skip_special_tokens=False).encode()).hexdigest() for r in out)
    assert json.dumps([n for n, _ in corpus_pipeline.STAGES]) == '["quality", "exact_dedup", "near_dedup", "decontaminate", "bpe"]'
