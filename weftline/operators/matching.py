"""Finding one text in another."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate
from operator import sub

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import similarity

GRAM = 4
#: Items too short to seed that are compared with all texts at a time.
SHORT = 500
#: Most text of items that is broadcast.
ITEMS_MB = 2
#: Rows of a piece of a group of names, and pairs of rows that a task looks at.
PIECE, TASK_PAIRS = 1000, 4_000_000
#: The largest window of a walk along a book.
LARGEST = 350


def _words(text: str):
    return F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")


def _grams(df: DataFrame, key: str, n: int = GRAM, keep: Sequence[str] = ()) -> DataFrame:
    """(key, at, gram, and the columns to keep) of all word n-grams, as 64-bit hashes; words are laid beside themselves so that rows stay small."""
    w = df.select(key, *keep, _words("text").alias("w"))
    shifted = F.arrays_zip(*(F.slice("w", k + 1, F.size("w")).alias(f"w{k}") for k in range(n)))
    rows = w.select(key, *keep, F.posexplode(shifted).alias("at", "x")).where(F.col("x").getField(f"w{n - 1}").isNotNull())
    return rows.select(key, *keep, "at", F.xxhash64(*(F.col("x").getField(f"w{k}") for k in range(n))).alias("gram"))


def gram_votes(items: DataFrame, texts: DataFrame, least: int = 2) -> DataFrame:
    """Items seeded into texts by an inverted index of word 4-grams: the most votes that one origin (place in the text of the item's start) gets."""
    hits = _grams(texts, "doc_id").withColumnRenamed("at", "doc_at").join(_grams(items, "item_id").withColumnRenamed("at", "item_at"), "gram")
    votes = hits.groupBy("item_id", "doc_id", (F.col("doc_at") - F.col("item_at")).alias("origin")).agg(F.count("*").alias("votes")).where(F.col("votes") >= least)
    return votes.groupBy("item_id", "doc_id").agg(F.max("votes").alias("votes"))


def exact_passages(items: DataFrame, texts: DataFrame) -> DataFrame:
    """(item_id, doc_id, at): the first place where an item stands in a text, in code points.

    Candidates come from an equi-join on the item's rarest inner word 4-gram
    (words at the item's edges may be cut in the text), then the strings decide.
    Items of at most ``ITEMS_MB`` in all are broadcast and decided where the text
    is read; beyond that every join is a shuffle. Texts are never broadcast.
    Items of fewer than six words are too short to seed; they are a query set put
    to all texts in blocks of about ``SHORT`` dealt by hash, each block a broadcast.
    """
    sized = items.select("item_id", F.col("text").alias("item"), F.size(_words("text")).alias("n"))
    few, size = sized.agg(F.sum(F.when(F.col("n") < 6, 1).otherwise(0)), F.sum(F.octet_length("item"))).first()
    small = (size or 0) <= ITEMS_MB << 20
    side = (lambda df: df.hint("broadcast")) if small else (lambda df: df.hint("merge"))
    grams = _grams(texts, "doc_id").select("doc_id", "gram")
    inner = _grams(items, "item_id").withColumn("last", F.max("at").over(Window.partitionBy("item_id"))).where("at > 0 and at < last")
    counts = grams.join(side(inner.select("gram").distinct()), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    seeds = counts.join(side(inner), "gram").groupBy("item_id").agg(F.min(F.struct("n", "at", "gram")).alias("s")).select("item_id", F.col("s.gram").alias("gram"))
    if small:  # the text goes along with its grams as far as the join and no further
        seeds = seeds.join(side(items.select("item_id", F.col("text").alias("item"))), "item_id")
        rows = texts.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))  # texts of one doc_id stay apart
        long = _grams(rows, "doc_id", keep=["row", "text"]).join(side(seeds), "gram").where(F.expr("contains(text, item)"))
        both = long.select("row", "item_id", "doc_id", _place().alias("at")).distinct().drop("row")
    else:
        pairs = grams.join(side(seeds), "gram").select("doc_id", "item_id").distinct()
        long = pairs.join(side(items.select("item_id", F.col("text").alias("item"))), "item_id").join(side(texts.select("doc_id", "text")), "doc_id")
        both = long.select("item_id", "doc_id", _place().alias("at"))
    blocks = -(-(few or 0) // SHORT)
    short = sized.where("n < 6").drop("n")
    for k in range(blocks):
        block = F.broadcast(short.where(F.pmod(F.xxhash64("item_id", "item"), F.lit(blocks)) == k))
        both = both.unionByName(texts.select("doc_id", "text").join(block, F.expr("contains(text, item)")).select("item_id", "doc_id", _place().alias("at")))
    return both.where("at >= 0")


def _place():
    return (F.expr("instr(text, item)") - 1).cast("long")


def bigram_dice(items: DataFrame, key: str, text: str, least: float) -> DataFrame:
    """Pairs (a, b) whose character bigrams overlap: shared count and Dice of the multisets, at least ``least``."""
    grams = items.select(key, F.explode(F.when(F.length(text) > 1, F.transform(F.sequence(F.lit(1), F.length(text) - 1), lambda i: F.substr(F.col(text), i, F.lit(2))))).alias("g"))
    c = grams.groupBy(key, "g").agg(F.count("*").alias("n"))
    total = c.groupBy(key).agg(F.sum("n").alias("total"))
    c = c.join(total, key)
    x, y = c.select(F.col(key).alias("a"), "g", F.col("n").alias("na"), F.col("total").alias("ta")), c.select(F.col(key).alias("b"), "g", F.col("n").alias("nb"), F.col("total").alias("tb"))
    pairs = x.join(y, "g").where("a < b").groupBy("a", "b", "ta", "tb").agg(F.sum(F.least("na", "nb")).alias("shared"))
    return pairs.where(F.col("shared") * 2 >= least * (F.col("ta") + F.col("tb"))).select("a", "b", "shared", F.round(2 * F.col("shared") / (F.col("ta") + F.col("tb")), 9).alias("dice"))


def name_pairs(rows: DataFrame, group: Sequence[str], key: str, name: str) -> DataFrame:
    """(a, b, edits, similarity) of all pairs of rows of one group, a < b by key.

    Names that are equal are compared once: a group is cut into pieces of about
    ``PIECE`` rows, each piece with its names and their keys, and pieces are joined,
    not rows. As pairs outgrow the rows by far, pieces are dealt to tasks by the
    number of pairs, which the size of the rows does not tell.
    """
    group = [F.col(g).alias(f"group_{k}") for k, g in enumerate(group)]
    rows = rows.select(*group, F.col(key).alias("key"), F.col(name).alias("name"))
    group = [f"group_{k}" for k in range(len(group))]
    sizes = rows.dropna(subset=group).groupBy(*group).agg(F.count("*").alias("size"))
    pairs = sizes.agg(F.sum(F.col("size").cast("double") * F.col("size"))).first()[0] or 0
    piece = F.pmod(F.xxhash64("key"), F.ceil(F.col("size") / PIECE)).alias("piece")
    named = rows.join(sizes, group).select(*group, piece, "name", "key").groupBy(*group, "piece", "name").agg(F.collect_list("key").alias("keys"))
    pieces = named.groupBy(*group, "piece").agg(F.collect_list(F.struct("name", "keys")).alias("names"))
    side = lambda x: pieces.select(*group, F.col("piece").alias(f"{x}_piece"), F.col("names").alias(f"{x}_names"))
    both = side("a").join(side("b").hint("merge"), group).repartition(int(pairs // TASK_PAIRS) + 1, *group, "a_piece", "b_piece")
    names = both.select(F.explode("a_names").alias("a"), "b_names").select("a", F.explode("b_names").alias("b"))
    x, y = F.col("a.name"), F.col("b.name")
    alike = names.select(F.col("a.keys").alias("a_keys"), F.col("b.keys").alias("b_keys"), F.levenshtein(x, y).alias("edits"), similarity(x, y).alias("similarity"))
    keys = alike.select(F.explode("a_keys").alias("a"), "b_keys", "edits", "similarity").select("a", F.explode("b_keys").alias("b"), "edits", "similarity")
    return keys.where("a < b")


def sellers(needle: str, hay: str, limit: int) -> tuple[int, int, int] | None:
    """(start, end, edits) of the approximate occurrence with fewest edits, at most ``limit``: the first end, then the latest start."""
    if not needle:
        return None
    cost, start = list(range(len(needle) + 1)), [0] * (len(needle) + 1)
    best = None
    for j, ch in enumerate(hay):
        new, at = [0], [j + 1]
        for i, want in enumerate(needle):
            options = ((cost[i] + (want != ch), start[i]), (cost[i + 1] + 1, start[i + 1]), (new[i] + 1, at[i]))
            c, s = min(options, key=lambda o: (o[0], -o[1]))
            new.append(c), at.append(s)
        cost, start = new, at
        if cost[-1] <= limit and (best is None or cost[-1] < best[2]):
            best = (start[-1], j + 1, cost[-1])
    return best


def sliding_dice(needle: str, hay: str, first: int, last: int, floor: float = 0.0) -> tuple[float, int, int]:
    """Best (score, start, length) of bigram Dice over windows of hay[first:last] as long as the needle, one less, one more; single characters if under five. First best wins; 1.0 stops.

    Windows before the first and behind the last that can reach ``floor`` are passed over: a window's grams that the needle has at all, however often, are no fewer than those shared.
    """
    n = 1 if len(needle) < 5 else 2
    grams = lambda s: [s[k : k + n] for k in range(len(s) - n + 1)]
    want: dict[str, int] = {}
    for g in grams(needle):
        want[g] = want.get(g, 0) + 1
    total = len(needle) - n + 1
    best = (0.0, first, 0)
    mine = grams(hay[first:last])
    seen = [0, *accumulate(map(want.__contains__, mine))]
    for size in (len(needle), len(needle) - 1, len(needle) + 1):
        m = size - n + 1
        if m <= 0 or first + size > last:
            continue
        near = [k for k, most in enumerate(map(sub, seen[m:], seen)) if 2 * most >= (floor - 2e-9) * (total + m)]
        if not near:
            continue
        at = near[0]
        have: dict[str, int] = {}
        shared = 0
        for k, g in enumerate(mine[at : near[-1] + m], at):
            have[g] = have.get(g, 0) + 1
            shared += have[g] <= want.get(g, 0)
            if k >= at + m:
                old = mine[k - m]
                shared -= have[old] <= want.get(old, 0)
                have[old] -= 1
            if k >= at + m - 1:
                score = 2 * shared / (total + m)
                if score > best[0] + 1e-9:
                    best = (score, first + k - m + 1, size)
                    if score >= 1:
                        return best
    return best


def cursor_match(texts: list[str], book: str, start: int = 0, window: int = 200, threshold: float = 0.8, misses_allowed: int = 20, least: int = 6, reading: tuple[str, list[int], list[int]] | None = None) -> list[tuple[int, int, float] | None]:
    """Cues matched along a book by a cursor that never goes back: exact within the window first, then the best Dice, with a jump after many misses.

    A cue that the window does not hold is not compared, so that a larger window
    gains by it; one that not even ``LARGEST`` holds matches exactly at the cursor.
    ``reading`` is a second track (its text, its places in the book, and the
    book's places in it) tried where the book's own letters do not match.
    """
    cursor, misses = start, 0
    out: list[tuple[int, int, float] | None] = []
    for t in texts:
        if not t:
            out.append(None)
            continue
        hit = None
        if misses >= misses_allowed and len(t) >= least and (p := book.find(t, cursor)) >= 0:
            cursor, misses = p, 0
        end = min(cursor + window, len(book))
        if end - cursor >= len(t):
            p = book.find(t, cursor, end)
            if p >= 0 and (len(t) > 2 or p <= cursor + 16):
                hit = (p, p + len(t), 1.0)
        elif len(t) > max(window, LARGEST) and book.startswith(t, cursor):
            hit = (cursor, cursor + len(t), 1.0)
        if hit is None and reading and len(t) >= least:
            track, place, back = reading
            a, z = back[cursor], back[end]
            p = track.find(t, a, z)
            if p >= 0:
                hit = (place[p], place[p + len(t) - 1] + 1, 1.0)
        if hit is None and least <= len(t) <= window:
            score, p, size = sliding_dice(t, book, cursor, end, threshold)
            if score >= threshold:
                hit = (p, p + size, score)
        if hit:
            cursor, misses = hit[1], 0
        else:
            misses += 1
        out.append(hit)
    return out


def monotone_chain(spans: np.ndarray, cap: int = 80) -> list[int]:
    """Indices of the heaviest chain of spans (cue, start, end), strictly ordered in both, weight min(length, cap); the earlier of equals."""
    order = sorted(range(len(spans)), key=lambda k: (spans[k][0], spans[k][1], spans[k][2]))
    ends = sorted({int(spans[k][2]) for k in order})
    rank = {e: k + 1 for k, e in enumerate(ends)}
    tree: list[tuple[int, int]] = [(0, -1)] * (len(ends) + 1)
    before, total = [-1] * len(spans), [0] * len(spans)
    k = 0
    while k < len(order):
        same = [x for x in order[k:] if spans[x][0] == spans[order[k]][0]]
        for x in same:
            best, at = (0, -1), int(np.searchsorted(ends, spans[x][1], "right"))
            while at:
                if tree[at][0] > best[0]:
                    best = tree[at]
                at -= at & -at
            before[x], total[x] = best[1], best[0] + min(int(spans[x][2] - spans[x][1]), cap)
        for x in same:  # spans of one cue do not chain with each other
            at = rank[int(spans[x][2])]
            while at <= len(ends):
                if total[x] > tree[at][0]:
                    tree[at] = (total[x], x)
                at += at & -at
        k += len(same)
    if not total:
        return []
    at = int(np.argmax(total))
    chain = []
    while at >= 0:
        chain.append(at)
        at = before[at]
    return chain[::-1]
