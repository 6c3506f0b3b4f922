"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

A mask looks at some of the words after a position and ignores the others, so a
substituted word under a gap does not stop a hit. Hashes under each mask of all
positions of the test items meet those of all positions of all texts. Around a
hit, item and text are laid over each other on that diagonal and the best run is
scored: +1 for a word that agrees, -``PENALTY`` for one that does not. A text is
contaminated by an item if the score reaches ``MIN_SCORE`` or, for a short item,
half its words (six at least). The three masks miss nothing: no run that avoids
them all scores more than 5, however long (a test walks all such runs).

An item of fewer than six words cannot reach a score of six; it contaminates the
texts whose whole sequence of words equals its own, with its words as the score.

The test side is what is broadcast, in blocks of about ``block_words`` words dealt
by hash: however large the benchmark, a broadcast has three seeds a word, and the
texts are passed once per block. (A shuffle of all seeds of all texts, 16 times the
text, costs more than a pass until a benchmark has some ten million words.) Of the
texts only hits (row, item, diagonal) are shuffled, and then those texts that have
one, for verification on their words.

Words are maximal runs without white space (U+0009..U+000D, U+0020), lower-cased.

Nulls and odd cases: a null, empty or blank text or item matches nothing; items
that repeat id and text are one; rows that share the columns that name a row
(``row``: doc_id unless told otherwise) are one result each; a null doc_id or
item_id comes back as null. Empty input, empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SLOTS, Scratch

MASKS = ((0, 1, 3, 4, 5), (0, 2, 4, 5, 7), (0, 4, 5, 6, 7))
SPAN = 1 + max(mask[-1] for mask in MASKS)
PENALTY, MIN_SCORE, LEAST = 2, 10, 6
BLOCK_WORDS = 100_000


def tokens(text: Column, most: int = -1) -> Column:
    """The words of a text; with ``most``, cut at so many parts."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[\x09-\x0D\x20]+", most), "")


def places(rows: DataFrame, key: tuple[str, ...], text: str) -> DataFrame:
    """(key, at, seed) of all positions and masks that fit there.

    The words, as hashes, are laid beside themselves shifted by one, two, ... and
    taken apart into rows, so each row holds the words after its position and no
    more, and the hashes are compiled code.
    """
    hashed = rows.select(*key, F.transform(tokens(F.col(text)), lambda w: F.xxhash64(w)).alias("words"))
    shifted = F.arrays_zip(*(F.slice("words", k + 1, F.size("words")).alias(f"w{k}") for k in range(SPAN)))
    rows = hashed.select(*key, F.posexplode(shifted).alias("at", "w"))
    each = [F.when(F.col("w").getField(f"w{mask[-1]}").isNotNull(), F.xxhash64(F.lit(k), *(F.col("w").getField(f"w{o}") for o in mask))) for k, mask in enumerate(MASKS)]
    return rows.select(*key, "at", F.explode(F.array(*each)).alias("seed")).where("seed is not null")


def contaminated(documents: DataFrame, benchmark: DataFrame, min_score: int = MIN_SCORE, block_words: int = BLOCK_WORDS, name: str = "decon", row: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``row`` columns, item_id, score (of the best run), item_words: one row per pair that matches."""
    scratch = Scratch(documents.sparkSession, name)
    named = [f"wl_{k}" for k in range(len(row))]
    docs = documents.select(*(F.col(c).alias(n) for c, n in zip(row, named, strict=True)), "text")
    items = benchmark.select("item_id", "text").distinct().withColumn("item", tokens(F.col("text"))).withColumn("item_words", F.size("item")).where("item_words > 0")
    items = scratch.keep(items.withColumn("item_row", F.xxhash64("item_id", "text")), "items")
    long, short = items.where(F.col("item_words") >= LEAST), items.where(F.col("item_words") < LEAST)
    n_words, n_short = items.agg(F.sum(F.when(F.col("item_words") >= LEAST, F.col("item_words"))), F.count(F.when(F.col("item_words") < LEAST, 1))).first()
    found = whole_items(docs if n_short else docs.limit(0), named, short)
    blocks = -(-(n_words or 0) // block_words)
    probes, hits = places(docs, tuple(named), "text"), None
    for k in range(blocks):
        table = places(long.where(F.pmod(F.xxhash64("item_row"), F.lit(blocks)) == k), ("item_row",), "text").withColumnRenamed("at", "item_at")
        got = probes.join(F.broadcast(table), "seed").select(*named, "item_row", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
        hits = got if hits is None else hits.unionByName(got)
    if hits is not None:
        hits = scratch.keep(hits, "hits")
        # texts without a hit stop at a broadcast of SLOTS numbers at most
        slot = F.pmod(F.xxhash64(*named), F.lit(SLOTS)).alias("wl_slot")
        some = docs.withColumn("wl_slot", slot).join(F.broadcast(hits.select(slot).distinct()), "wl_slot", "left_semi").drop("wl_slot")
        texts = some.select(*(F.col(n).alias(f"{n}_of") for n in named), tokens(F.col("text")).alias("words"))
        near = hits.join(long.select("item_row", "item_id", "item", "item_words"), "item_row")
        # a hot text has one row here and its hits few; the side of texts is the larger one
        here = F.lit(True)
        for n in named:
            here = here & F.col(n).eqNullSafe(F.col(f"{n}_of"))
        scored = near.join(texts, here).select(*named, "item_id", "item_words", best_run("item", "words", "shift").alias("score"))
        found = found.unionByName(scored.where(F.col("score") >= needed(min_score)))
    found = found.groupBy(*named, "item_id").agg(F.max("score").cast("long").alias("score"), F.max("item_words").cast("long").alias("item_words"))
    return found.withColumnsRenamed(dict(zip(named, row, strict=True)))


def whole_items(docs: DataFrame, named: list[str], items: DataFrame) -> DataFrame:
    """Texts whose whole sequence of words is that of an item of fewer than LEAST words."""
    few = docs.select(*named, tokens(F.col("text"), LEAST + 2).alias("item")).where(F.size("item").between(1, LEAST - 1))
    return few.join(items.select("item_id", "item", "item_words"), "item").select(*named, "item_id", "item_words", F.col("item_words").alias("score"))


def needed(min_score: int) -> Column:
    return F.least(F.lit(float(min_score)), F.greatest(F.lit(float(LEAST)), F.col("item_words") / 2))


def best_run(item: str, words: str, shift: str) -> Column:
    """The best score of a run of the item laid over the text at ``shift``."""
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, j: Column) -> Column:
        same = F.coalesce(F.get(item, j) == F.get(words, j + F.col(shift)), F.lit(False))
        run = F.greatest(F.lit(0), acc["run"] + F.when(same, 1).otherwise(-PENALTY))
        return F.struct(run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    return F.aggregate(F.sequence(F.lit(0), F.size(item) - 1), start, step)["best"]
