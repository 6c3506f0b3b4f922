"""The queries that SQL cannot say, whole, on a small table with odd rows, against plain versions."""

import hashlib
import math
import random
import unicodedata
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from weftline.llm import langid, pii, quality, queries
from weftline.llm.common import code_points, word_hashes

from .test_llm import base_by_hand, ctw_by_hand, reference_tokenizer, viterbi_by_hand, word_list

WORDS = {
    "en": "the cat sat on a mat and then went home to see who had called".split(),
    "de": "die Katze saß auf der Matte und ging dann nach Hause für größere Fische".split(),
    "ru": "кот сидел на ковре и потом пошёл домой чтобы поесть рыбу".split(),
}
ODD = [
    (None, None, None), (None, "the cat went home", "en"), (900, None, "en"), (901, "", "de"), (902, " \t\n", "en"), (903, "× ÷ ÷", "en"), (904, "٣٤٥ १२३", None), (905, "。。。 ² ½ Ⅷ", "de"), (906, "ª", "en"),
    (907, "mail a.b@c.de call +49 30 1234567 now ssn 123-45-6789", "en"), (908, "visa 4111 1111 1111 1111 ip 10.0.0.1 und 999.1.1.1", "de"), (908, "visa 4111 1111 1111 1111 ip 10.0.0.1 und 999.1.1.1", "de"),
    (909, "my phone 212-555-1234", "en"), (910, "hotel border 212-555-1234 antisocial 123-45-6789", "en"), (911, "IBAN GB82 WEST 1234 5698 7654 32 BANK", "en"), (912, "the cat кот сидел на ковре и потом пошёл домой", "ru"),
    (913, "漢字 かな 한글 ქართული ไทย tiếng Việt", None), (914, "w" * 3000, "en"),
]


def crc(i, n):
    return zlib.crc32(("" if i is None else str(i)).encode()) % n


@pytest.fixture(scope="module")
def table(tmp_path_factory):
    """(folder, rows): documents with labels; good texts are fluent, bad ones repeat and shout."""
    rnd, rows, labels = random.Random(6), list(ODD), []
    for i in range(160):
        lang = rnd.choice(list(WORDS))
        w = [rnd.choice(WORDS[lang]) for _ in range(rnd.randrange(8, 40))]
        if i % 2:
            w = [x.upper() + "!!" for x in w[:6] for _ in range(3)]
        rows.append((i, " ".join(w), lang if i % 7 else None))
        labels.append((i, 1 - i % 2))
    rnd.shuffle(rows)
    labels += [(3, 0), (3, 0), (None, 1), (5000, 1), (12, None)]
    folder = tmp_path_factory.mktemp("sf")
    ids = [r[0] for r in rows]
    pq.write_table(pa.table({"doc_id": pa.array(ids, pa.int64()), "text": [r[1] for r in rows], "lang": [r[2] for r in rows], "source": ["s"] * len(rows), "score": [1] * len(rows)}), folder / "documents.parquet")
    pq.write_table(pa.table({"doc_id": pa.array([x for x, _ in labels], pa.int64()), "quality": pa.array([y for _, y in labels], pa.int32()), "toxic": pa.array([0] * len(labels), pa.int32())}), folder / "labels.parquet")
    return str(folder), rows, labels


def by_row(got, rows):
    """The result's rows beside the table's, both in one order (equal keys have equal results)."""
    key = lambda i: (i is not None, i or 0)
    got, rows = sorted(got, key=lambda r: key(r["doc_id"])), sorted(rows, key=lambda r: key(r[0]))
    assert [r["doc_id"] for r in got] == [r[0] for r in rows]
    return [(g, r) for g, r in zip(got, rows, strict=True) if r[0] is not None]


# -- 3


def grams_by_hand(text):
    """Slots of all words and character n-grams of a text, repeats and all."""
    out = []
    for n in (2, 3, 4):
        for k in range(len(text) - n + 1):
            x = 0
            for c in text[k : k + n]:
                x = (x * 0x9E3779B1 + ord(c)) % 2**32
            x = x * 2654435761 % 2**32
            x ^= x >> 15
            x = x * 2246822519 % 2**32
            out.append((x >> 32 - quality.BITS) + ((n - 1) << quality.BITS))
    last = None
    for w in (x for x in text.replace("\t", " ").replace("\n", " ").split(" ") if x):
        b = np.frombuffer(w.encode(), np.uint8)
        out.append(int(word_hashes(b, np.array([0]), np.array([len(b)]), lower=False)[0]) >> 64 - quality.BITS)
        if w == last:
            out.append(quality.REPEAT)
        last = w
    return Counter(out)


def train_by_hand(texts, y, dim=16, epochs=5, rate=0.5, seed=7):
    """The same steps with one feature at a time."""
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / dim, 1 / dim, (quality.SIZE, dim)).astype(np.float32).astype(float)
    out, bias = np.zeros((dim, 2)), np.zeros(2)
    docs = [grams_by_hand(t) for t in texts]
    at = 0
    for _ in range(epochs):
        for d in rng.permutation(len(docs)):
            lr, at = rate * (1 - at / max(1, epochs * len(docs))), at + 1
            total = max(1, sum(docs[d].values()))
            h = sum((c / total * emb[f] for f, c in docs[d].items()), np.zeros(dim))
            p = np.exp(h @ out + bias)
            p /= p.sum()
            p[y[d]] -= 1
            back = out @ p
            out, bias = out - lr * np.outer(h, p), bias - lr * 0.1 * p
            norm = sum((c / total) ** 2 for c in docs[d].values())
            for f, c in docs[d].items():
                emb[f] = emb[f] - c / total * lr / norm * back
    return emb @ (out[:, 1] - out[:, 0]), bias[1] - bias[0]


def test_quality_query(spark, table):
    folder, rows, labels = table
    known = sorted({(i, y) for i, y in labels if i is not None and y is not None and crc(i, 4) != 2})
    text = {}
    for i, t, _ in rows:
        text[i] = min(text.get(i, t or ""), t or "")
    known = [(text[i], y) for i, y in known if i in text]
    weight, bias = train_by_hand([t for t, _ in known], [y for _, y in known])
    hits = 0
    for g, (i, t, _) in by_row(queries.QUERIES["op3_quality"](spark, folder).collect(), rows):
        c = grams_by_hand(t or "")
        z = sum(n * weight[f] for f, n in c.items()) / max(1, sum(c.values())) + bias
        assert g["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=2e-3), (i, t)
        assert g["held_out"] == (crc(i, 4) == 2) and g["predicted"] == int(g["score"] >= 0.7)
        hits += i < 160 and crc(i, 4) == 2 and g["predicted"] == 1 - i % 2
    assert hits >= 0.9 * sum(crc(i, 4) == 2 for i in range(160))


def test_characters():
    for t in ("", "abc", "é", "a漢🙂z", "٣٤٥", "tiếng Việt ½"):
        at, points = code_points(np.frombuffer(t.encode(), np.uint8))
        assert points.tolist() == [ord(c) for c in t]
        assert at is None or at.tolist() == [len(t[:k].encode()) for k in range(len(t))]


# -- 4

EXPECT = {
    907: [("email", "a.b@c.de"), ("phone", "+49 30 1234567"), ("ssn", "123-45-6789")], 908: [("card", "4111 1111 1111 1111"), ("ip", "10.0.0.1")], 909: [("localphone", "212-555-1234")], 910: [], 911: [("iban", "GB82 WEST 1234 5698 7654 32")],
}


def test_pii_query(spark, table):
    folder, rows, _ = table
    order = list(PLAIN := ("email", "ip", "card", "phone"))
    for g, (i, t, _) in by_row(queries.QUERIES["op4_pii"](spark, folder).collect(), rows):
        base = sorted(base_by_hand(t or ""), key=lambda x: (x[0], order.index(x[1])))
        assert [g[f"n_{k}"] for k in PLAIN] == [sum(x[1] == k for x in base) for k in PLAIN]
        assert g["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{z}" for a, k, z in base).encode()).hexdigest()
        spans = [x.split(":") for x in g["spans"].split(",") if x]
        assert {f"{k}:{a}:{z}" for a, k, z in base} <= set(g["spans"].split(",")) | {""} and g["n_spans"] == len(spans) == len([s for s in g["scores"].split(",") if s])
        if i in EXPECT:
            assert [(k, t[int(a) : int(z)]) for k, a, z in spans] == EXPECT[i]
    ends = {"ssn": ("social", "antisocial"), "localphone": ("call", "recall"), "card13": ("visa", "visage")}
    sample = {"ssn": "123-45-6789", "localphone": "212-555-1234", "card13": "4222222222222"}
    for kind, (word, inside) in ends.items():
        assert [x[1] for x in pii.find_spans(f"{word} {sample[kind]}")] == [kind] and pii.find_spans(f"{inside} {sample[kind]}") == []
    assert pii.near_words("a " * 30 + "border 1", 67, 68) == {"a", "border"} and pii.near_words("x" + "order " + "-" * 34 + "1", 41, 42) == set()


# -- 6


def test_lm_query(spark, table):
    folder, rows, _ = table
    learn = [t or "" for i, t, _ in rows if crc(i, 7) != 2]
    score = ctw_by_hand(learn, 5)
    c = Counter(w for t in learn for w in [*word_list(t), None])
    total = sum(c.values())
    got = by_row(queries.QUERIES["op6_lm"](spark, folder).collect(), rows)
    for g, (i, t, _) in got:
        w = [*word_list(t), None]
        assert g["held_out"] == (crc(i, 7) == 2) and (g["n_tokens"], g["n_known"], g["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), total)
        assert g["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (total + len(c) + 1)) for x in w))
        assert g["score"] == pytest.approx(score(t or ""), rel=1e-4)
        assert g["bits_per_byte"] == pytest.approx(-g["score"] / math.log10(2) / max(1, len((t or "").encode())))


# -- 8


def word_grams(word):
    """Slots of a word's n-grams of bytes, edges marked by a space, by n."""
    raw = b" " + bytes(b + 32 if 65 <= b <= 90 else b for b in word.encode()) + b" "
    for k, n in enumerate(langid.NGRAMS):
        for p in range(len(raw) - 1):
            if p + n <= len(raw):
                x = (int.from_bytes(raw[p : p + n], "little") + n) * 2654435761 % 2**32
                x ^= x >> 15
                yield k, (x * 2246822519 % 2**32) >> 32 - langid.BITS


def script(c):
    if unicodedata.category(c)[0] != "L":
        return None
    name = unicodedata.name(c).replace("FULLWIDTH ", "").replace("HALFWIDTH ", "").replace("-", " ").split(" ")[0]
    return name if name in langid.SCRIPTS else "other"


def test_language_query(spark, table):
    folder, rows, _ = table
    text = {}
    for i, t, lang in rows:
        if i is not None and t is not None and lang is not None and crc(i, 4) != 2:
            text[i, lang] = min(text.get((i, lang), t), t)
    langs = sorted({lang for _, lang in text})
    counts, seen = {g: [Counter() for _ in langid.NGRAMS] for g in langs}, {g: Counter() for g in langs}
    for (_, lang), t in text.items():
        for w in word_list_raw(t):
            for k, x in word_grams(w):
                counts[lang][k][x] += 1
        seen[lang].update(s for c in t if (s := script(c)))
    size = 1 << langid.BITS
    sums = {g: [sum(c.values()) + size / 2 for c in counts[g]] for g in langs}
    has = {g: {s for s, n in seen[g].items() if n > 0.001 * sum(seen[g].values())} for g in langs}
    wrong = 0
    for r, (i, t, lang) in by_row(queries.QUERIES["op8_langid"](spark, folder).collect(), rows):
        assert r["held_out"] == (crc(i, 4) == 2)
        words = word_list_raw(t or "")
        letters = [sum(script(c) is not None for c in w) for w in words]
        if not any(letters):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0), (i, t)
            continue
        scores = []
        for w in words:
            s = np.array([sum(math.log((counts[g][k][x] + 0.5) / sums[g][k]) for k, x in word_grams(w)) / len(langid.NGRAMS) for g in langs])
            mine = {script(c) for c in w} - {None}
            fits = np.array([bool(mine & has[g]) for g in langs])
            scores.append(s + (~fits * langid.LanguageModel.impossible if fits.any() else 0))
        path = viterbi_by_hand(np.array(scores), 12.0)[0]
        share = [sum(n for p, n in zip(path, letters, strict=True) if p == k) for k in range(len(langs))]
        assert r["lang_pred"] == langs[int(np.argmax(share))] and r["score"] == pytest.approx(max(share) / sum(share)), (i, t)
        wrong += i < 160 and lang is not None and r["lang_pred"] != lang
    assert wrong <= 3


def word_list_raw(t):
    out = [t]
    for c in " \t\n\x0b\x0c\r":
        out = [x for y in out for x in y.split(c)]
    return [x for x in out if x]


def test_more_languages_than_a_byte_counts():
    rng = np.random.default_rng(0)
    s = rng.normal(size=(40, 300)).astype(np.float32)
    path = langid.viterbi(s, np.array([0, 40]), 0.5)
    assert path.tolist() == viterbi_by_hand(s, 0.5)[0]


def test_repeated_rows_are_learned_from_once(spark):
    """What goes to the driver is bounded by max_rows, however often a row is repeated."""
    sent = []
    old = langid.train
    langid.train = lambda rows, penalty=12.0: sent.append(rows) or old(rows, penalty)
    try:
        d = spark.createDataFrame([(1, "the cat", "en")] * 300 + [(k, f"text {k}", "en") for k in range(3, 9)], "doc_id long, text string, lang string")
        langid.fit_languages(d, max_rows=5)
    finally:
        langid.train = old
    assert len(sent[0]) == 5


# -- 10


def test_bpe_query(spark, table):
    folder, rows, _ = table
    t = reference_tokenizer()
    for g, (_, text, _) in by_row(queries.QUERIES["op10_bpe"](spark, folder).collect(), rows):
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert g["n_tokens"] == len(ids) and g["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert g["decoded_sha256"] == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
