"""Near-duplicate classes: SuperMinHash, banding, verification, union-find.

1. Every text: the number of its distinct shingles of five words, a digest of its
   word sequence (BLAKE2b, 128 bits), and a SuperMinHash signature of 128 places
   folded into 32 band keys. Each element of a set has a permutation of the places
   and a rank at each; the rank at step j of the permutation is j plus a fraction,
   so a place takes the least rank and the work stops once no later step can lower
   any place.
2. Texts with one digest are one *class* and go on as one. Classes that share a band
   key are *mates*; a pair over the threshold shares none with probability
   (1 - 0.75**4)**32 = 5e-6. Each band key has a *pivot*, the class with most mates
   in all its bands, and is compared with it. The classes that have one pivot are
   its *group*; two mates are always in a common group.
3. A group of at most ``BLOCK`` classes is one unit: all its pairs are verified. A
   larger one is dealt into units of ``BLOCK``, each with the pivot, so this step
   ships a text once per pivot. Links make components.
4. Of the larger groups, classes that are still outside their pivot's component meet
   the others. Jaccard distance is a metric, so two classes whose distances to the
   pivot differ by more than the threshold allows cannot be linked: a group is cut
   into slices of distance to its pivot, slices into blocks of ``BLOCK``, and pairs
   of blocks of near slices are units, but for pairs of blocks that both are in the
   pivot's component. So every pair of mates in different components is verified;
   a family of copies around one text costs rows in proportion to its size.
5. Verification is exact: words of a unit are numbered, shingles are numbered from
   them, all pairs are counted as products of incidence matrices, and a unit emits
   only links that join something, fewer than its classes.

Links hold when 100 * |A and B| >= percent * |A or B|.

Nulls and odd cases: a null, empty or blank text has an empty set and is linked
with nothing; fewer than five words make one shingle of the whole sequence, which
only an equal sequence shares; in ``near_duplicates`` rows that share a doc_id are
one name, so their classes fall together, and a row without doc_id is not linked:
component_id null, kept true. ``near_rows`` goes by rows, whatever their doc_id:
repeats of it and nulls are rows like others. Repeated rows are one class. Classes
are named by 64-bit hashes of (doc_id, text) of one of their rows; of n linked
classes two share a name with probability n**2 / 2**65. Empty input, empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from .common import Scratch, flat_text, mix, small_batches, steps, trimmed, word_hashes, words

PLACES, ROWS = 128, 4
BANDS = PLACES // ROWS
#: Classes of a unit of verification (of each of two blocks, in step 4).
BLOCK = 128
#: Slices of distance that make up the greatest distance of a link.
SLICES = 4
#: Slots of the filter that keeps texts outside families from being shuffled; at most so many numbers are broadcast.
SLOTS = 1 << 18
#: Elements that one step of the signature works on.
CHUNK = 1 << 16
#: Cells of the incidence matrix that verification holds at once.
CELLS = 1 << 21

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.arange(1, 257, dtype=np.uint64) * _GOLD
_MUL = mix(np.arange(11, 16, dtype=np.uint64)) | np.uint64(1)


def shingles(buf: np.ndarray, offs: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, a 128-bit digest of each word sequence (two columns), and numbers of words."""
    starts, ends, first = words(buf, offs)
    w = word_hashes(buf, starts, ends)
    n = np.diff(first)
    raw = buf.tobytes()
    digest = b"".join(hashlib.blake2b(b" ".join(raw[a:z].lower().split()), digest_size=16).digest() for a, z in zip(offs[:-1].tolist(), offs[1:].tolist()))
    digest = np.frombuffer(digest, "<u8").reshape(-1, 2)
    five = np.zeros(max(0, len(w) - 4), np.uint64)
    for k in range(5):
        five += w[k : len(w) - 4 + k if len(w) > 4 else 0] * _MUL[k]
    five = mix(five)
    sets = []
    for d in range(len(n)):
        a, z = first[d], first[d + 1]
        if z - a >= 5:
            x = five[a : z - 4]
            x.sort()
            new = np.ones(len(x), bool)
            new[1:] = x[1:] != x[:-1]
            sets.append(x[new])
        else:
            sets.append(digest[d : d + 1, 0].copy() if z > a else np.zeros(0, np.uint64))
    return sets, digest, n


def superminhash(sets: list[np.ndarray], places: int = PLACES) -> np.ndarray:
    """Signatures [sets, places]: step of the permutation in the top byte, the fraction below. All ones if the set is empty.

    Elements of many sets take step j of their permutations together; a set is
    done once each of its places holds a rank of at most j.
    """
    sig = np.full((len(sets), places), np.iinfo(np.uint64).max, np.uint64)
    i = 0
    size = np.array([len(s) for s in sets])
    while i < len(sets):
        j = i + 1
        room = CHUNK - size[i]
        while j < len(sets) and room >= size[j]:
            room -= size[j]
            j += 1
        for a in range(0, max(1, int(size[i])), CHUNK) if j == i + 1 else (0,):  # one large set goes in parts
            part = [sets[i][a : a + CHUNK]] if j == i + 1 else sets[i:j]
            _signatures(part, sig[i:j])
        i = j
    return sig


def _signatures(sets: list[np.ndarray], sig: np.ndarray) -> None:
    places = sig.shape[1]
    e = np.concatenate(sets)
    home = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.tile(np.arange(places, dtype=np.uint8), (len(e), 1))
    row = np.arange(len(e))
    flat = sig.reshape(-1)
    for j in range(places):
        if not len(e):
            return
        r = mix(e + _STEP[j])
        k = j + ((r & np.uint64(0xFFFFFF)).astype(np.int64) * (places - j) >> 24)
        place = order[row, k]
        order[row, k] = order[row, j]
        np.minimum.at(flat, home * places + place, (r >> np.uint64(8)) | (np.uint64(j) << np.uint64(56)))
        if j + 1 < places:
            open_ = (sig >= (np.uint64(j + 1) << np.uint64(56))).any(axis=1)
            if not open_.all():
                go = open_[home]
                e, home, row = e[go], home[go], row[go]


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One key per band; the band's number is part of it."""
    b = sig.reshape(len(sig), -1, ROWS)
    h = (np.arange(b.shape[1], dtype=np.uint64) + np.uint64(1)) * _GOLD
    h = np.broadcast_to(h, b.shape[:2]).copy()
    for k in range(ROWS):
        h = mix(h + b[:, :, k] * _MUL[k])
    return h


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first column is the text; the others go through. Bands only where another sequence can share a shingle: from five words on."""
    for b in batches:
        buf, offs = flat_text(b.column(0))
        for i, j in steps(offs):
            sets, digest, size = shingles(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            long = size >= 5
            keys = band_keys(superminhash([s if x else s[:0] for s, x in zip(sets, long, strict=True)]))
            ends = np.concatenate([[0], np.cumsum(long * BANDS)]).astype(np.int32)
            bands = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.view(np.int64)[long].ravel()))
            n = np.array([len(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays(
                [*(c.slice(i, j - i) for c in b.columns[1:]), pa.array(n), pa.array(digest[:, 0].astype(np.int64)), pa.array(digest[:, 1].astype(np.int64)), bands],
                names=[*b.schema.names[1:], "n_shingles", "d0", "d1", "bands"],
            )


def exact_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, shingle) of the distinct shingles of all texts, numbered by the words themselves; texts of fewer than five words have none."""
    number: dict[bytes, int] = {}
    ids = [np.array([number.setdefault(w, len(number)) for w in t.lower().split()], np.int64) for t in texts]

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (b.max(initial=0) + 1) + b, return_inverse=True)[1] if len(a) else a

    flat = np.concatenate([np.zeros(0, np.int64), *ids])
    two = joined(flat[:-1], flat[1:])
    four = joined(two[:-2], two[2:])
    five = joined(four[:-1], flat[4:])
    size = np.array([len(x) for x in ids], np.int64)
    home, place = np.repeat(np.arange(len(ids)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
    inside = np.flatnonzero(place + 5 <= size[home])
    most = five.max(initial=0) + 1
    both = np.unique(home[inside] * most + five[inside])
    return both // most, both % most


def common_counts(home: np.ndarray, shingle: np.ndarray, n: int) -> np.ndarray:
    """[n, n] sizes of all intersections (a float32 product is exact: a chunk has fewer than 2**24 shingles)."""
    out = np.diag(np.bincount(home, minlength=n)).astype(np.int64)
    _, at, times = np.unique(shingle, return_inverse=True, return_counts=True)
    home, at = home[times[at] > 1], (np.cumsum(times > 1) - 1)[at[times[at] > 1]]  # shingles of one text only are counted
    order = np.argsort(at, kind="stable")
    home, at = home[order], at[order]
    np.fill_diagonal(out, np.diag(out) - np.bincount(home, minlength=n))
    width = max(1, CELLS // n)
    for low in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        a, z = np.searchsorted(at, [low, low + width])
        m = np.zeros((n, min(width, int(at[-1]) + 1 - low)), np.float32)
        m[home[a:z], at[a:z] - low] = 1
        out += (m @ m.T).astype(np.int64)
    return out


def slice_of(both: np.ndarray, either: np.ndarray, percent: int) -> np.ndarray:
    """The slice of a distance 1 - both / either: slice k is above k and up to k + 1 parts of ``SLICES`` of the greatest distance of a link; 0 too is in the first."""
    if percent >= 100:
        return (both < either).astype(np.int64)
    return np.maximum(0, -(-SLICES * 100 * (either - both) // (either * (100 - percent))) - 1)


def _verify(percent: int):
    """Units, rows of a unit together and its pivot first, into links that join something: (a, b); and for ``large`` groups (p, key, slice) of each class."""

    def unit(p: int, large: bool, roots: list[int], keys: list[int], texts: list[bytes]) -> pa.RecordBatch:
        n = len(keys)
        both = common_counts(*exact_sets(texts), n)
        size = np.diag(both)
        either = size[:, None] + size[None, :] - both
        name = {r: r for r in roots}

        def find(x: int) -> int:
            while name[x] != x:
                name[x] = x = name[name[x]]
            return x

        a, b = [], []
        open_ = len(name) - 1
        for x, y in np.argwhere(np.triu((100 * both >= percent * either) & (both > 0), 1)).tolist():
            if not open_:
                break
            fx, fy = find(roots[x]), find(roots[y])
            if fx != fy:
                name[max(fx, fy)] = min(fx, fy)
                a.append(keys[x]), b.append(keys[y])
                open_ -= 1
        far = slice_of(both[0, 1:], either[0, 1:], percent) if large else np.zeros(0, np.int64)
        k, m = len(a), len(far)
        return pa.RecordBatch.from_arrays(
            [pa.array([*a, *[None] * m], pa.int64()), pa.array([*b, *[None] * m], pa.int64()), pa.array([*[None] * k, *[p] * m], pa.int64()), pa.array([*[None] * k, *(keys[1:] if m else [])], pa.int64()), pa.array([*[None] * k, *far.tolist()], pa.int32())],
            names=["a", "b", "p", "key", "slice"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for p, u, large, root, key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (p, u) != now:
                    if len(rows) > 1:
                        yield unit(now[0], *_columns(rows))
                    now, rows = (p, u), []
                rows.append((large, root, key, text))
        if len(rows) > 1:
            yield unit(now[0], *_columns(rows))

    return run


def _columns(rows: list[tuple]) -> tuple:
    large, roots, keys, texts = zip(*rows, strict=True)
    return large[0], list(roots), list(keys), list(texts)


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component): the smallest id reachable over ``links(a, b)``; ids without links are absent.

    Ids are put in a random order (xxhash64 of a long is one to one), in which runs
    of falling neighbours are short. Each turn every id takes the name of its least
    neighbour, or that one's; edges are renamed, and those inside one name go. The
    edges left shrink by a factor with each turn. Tables that others are joined to by
    a name are written first, so that Spark can split the rows of a hot name.
    """
    links = links.where("a <> b").select("a", "b")
    x, y = F.xxhash64("a"), F.xxhash64("b")
    edges = scratch.keep(links.select(F.least(x, y).alias("x"), F.greatest(x, y).alias("y")).distinct(), f"{name}-edges0")
    ids = links.select("a").unionByName(links.select(F.col("b").alias("a"))).distinct()
    named = ids.select(F.col("a").alias("id"), F.xxhash64("a").alias("now"))
    turn = 0
    while edges.limit(1).count():
        turn += 1
        near = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).groupBy("x").agg(F.min("y").alias("y"))
        near = scratch.keep(near.select("x", F.least("x", "y").alias("up")), f"{name}-near{turn}")
        above = near.select(F.col("x").alias("up"), F.col("up").alias("top"))  # a name is an end of an edge too, so it has a row
        up = scratch.keep(near.join(above, "up").select("x", "top"), f"{name}-up{turn}")
        other = up.select(F.col("x").alias("y"), F.col("top").alias("end"))
        less = edges.join(up, "x").join(other, "y").where("top <> end").select(F.least("top", "end").alias("x"), F.greatest("top", "end").alias("y")).distinct()
        edges = scratch.keep(less, f"{name}-edges{turn}")
        scratch.drop(f"{name}-edges{turn - 1}", f"{name}-near{turn}")
        named = named.join(up, named.now == up.x, "left").select("id", F.coalesce("top", "now").alias("now"))
    least = scratch.keep(named.groupBy("now").agg(F.min("id").alias("component")), f"{name}-least")
    out = scratch.keep(named.join(least, "now").select("id", "component"), f"{name}-components")
    scratch.drop(*(f"{name}-up{k + 1}" for k in range(turn)), f"{name}-edges{turn}", f"{name}-least")
    return out


def near_classes(rows: DataFrame, percent: int, scratch: Scratch, extra: tuple[str, ...] = (), where: str = "true") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(signed, classes, named) of rows with doc_id, text and ``extra`` columns; only rows that satisfy ``where`` make classes.

    signed: a row per row: doc_id, extra, n_shingles, d0 and d1 (the digest); classes: d0, d1, key, least_id (smallest
    doc_id), n (rows); named: id, component over the keys of classes that have links.
    """
    small_batches(rows.sparkSession)
    key = F.xxhash64("doc_id", "text").alias("wl_key")
    passed = rows.select("text", "doc_id", key, *extra)
    schema = passed.drop("text").schema.add("n_shingles", "long").add("d0", "long").add("d1", "long").add("bands", ArrayType(LongType()))
    signed = scratch.keep(passed.mapInArrow(trimmed(_sign), schema), "signed")
    entering = signed.where(f"n_shingles > 0 and ({where})")
    classes = entering.groupBy("d0", "d1").agg(F.min("wl_key").alias("key"), F.min("doc_id").alias("least_id"), F.count("*").alias("n"), F.first("bands").alias("bands"))
    classes = scratch.keep(classes, "classes")

    band = classes.where("size(bands) > 0").select("key", F.explode("bands").alias("band"))
    shared = band.groupBy("band").agg(F.count("*").alias("n"), F.min("key").alias("low"), F.max("key").alias("high")).where("low <> high").select("band", "n")
    mates = scratch.keep(band.join(shared, "band"), "mates")
    ranked = mates.join(mates.groupBy("key").agg(F.sum("n").alias("rank")), "key").select("band", "key", "rank")
    pivots = scratch.keep(ranked.groupBy("band").agg(F.max(F.struct("rank", "key"))["key"].alias("p")), "pivots")
    ties = scratch.keep(mates.join(pivots, "band").where("key <> p").select("p", "key").distinct(), "ties")

    sizes = ties.groupBy("p").agg(F.count("*").alias("n"))
    large = scratch.keep(sizes.where(F.col("n") >= BLOCK).select("p", F.ceil(F.col("n") / (BLOCK - 1)).cast("int").alias("units")), "large")
    units = F.coalesce("units", F.lit(1))
    members = ties.join(large, "p", "left").select("p", F.pmod("key", units).cast("string").alias("unit"), F.lit(1).alias("side"), F.col("units").isNotNull().alias("large"), F.col("key").alias("root"), "key")
    heads = sizes.select("p").join(large, "p", "left").select("p", F.explode(F.transform(F.sequence(F.lit(0), units - 1), lambda k: k.cast("string"))).alias("unit"), F.lit(0).alias("side"), F.col("units").isNotNull().alias("large"), F.col("p").alias("root"), F.col("p").alias("key"))

    def verified(dealt: DataFrame, name: str) -> DataFrame:
        dealt = scratch.keep(dealt, f"{name}-dealt")
        # texts that take no part stop at a broadcast of SLOTS numbers at most; repeated rows are one
        slots = F.broadcast(dealt.select(F.pmod("key", F.lit(SLOTS)).alias("slot")).distinct())
        texts = rows.select(key.alias("key"), F.col("text").cast("binary").alias("body")).withColumn("slot", F.pmod("key", F.lit(SLOTS))).join(slots, "slot", "left_semi")
        texts = texts.groupBy("key").agg(F.first("body").alias("body"))
        sent = dealt.join(texts, "key").repartition("p", "unit").sortWithinPartitions("p", "unit", "side", "key")
        return scratch.keep(sent.select("p", "unit", "large", "root", "key", "body").mapInArrow(trimmed(_verify(percent)), "a long, b long, p long, key long, slice int"), name)

    first = verified(members.unionByName(heads), "first")
    links = first.where("a is not null").select("a", "b")
    named = components(links, scratch, "first")

    if not large.limit(1).count():
        scratch.drop("mates", "pivots", "ties", "large", "first-dealt", "first")
        return signed, classes.drop("bands"), named
    # larger groups: who is where, and who is not yet with the pivot
    stars = first.where("p is not null").select("p", "key", "slice").unionByName(large.select("p", F.col("p").alias("key"), F.lit(0).alias("slice")))
    stars = scratch.keep(stars.join(named, stars.key == named.id, "left").select("p", "key", "slice", F.coalesce("component", "key").alias("root")), "stars")
    homes = stars.where("p = key").select("p", F.col("root").alias("home"))
    stars = scratch.keep(stars.join(homes, "p").select("p", "key", "slice", "root", (F.col("root") != F.col("home")).alias("stray")), "strays")
    if stars.where("stray").limit(1).count():
        cells = stars.groupBy("p", "slice", "stray").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        cells = cells.groupBy("p").agg(F.collect_list(F.struct("slice", "stray", "blocks")).alias("cells"))  # a few slices a group
        cells = scratch.keep(cells.where(F.exists("cells", lambda c: c["stray"])), "cells")
        code = lambda at, stray, block: (F.lit(2) * at + stray.cast("int")).cast("long") * F.lit(1 << 40) + block
        mine = F.filter("cells", lambda c: (c["slice"] == F.col("slice")) & (c["stray"] == F.col("stray")))[0]["blocks"]
        near = F.filter("cells", lambda c: (F.abs(c["slice"] - F.col("slice")) <= SLICES) & (c["stray"] | F.col("stray")))
        others = F.flatten(F.transform(near, lambda c: F.transform(F.sequence(F.lit(0), c["blocks"] - 1), lambda k: code(c["slice"], c["stray"], k))))
        met = stars.join(cells, "p").select("p", "root", "key", code(F.col("slice"), F.col("stray"), F.pmod("key", mine)).alias("own"), F.explode(others).alias("other"))
        dealt = met.select("p", F.concat_ws("-", F.least("own", "other"), F.greatest("own", "other")).alias("unit"), (F.col("own") > F.col("other")).cast("int").alias("side"), F.lit(False).alias("large"), "root", "key")
        more = verified(dealt, "second").select("a", "b")
        if more.limit(1).count():
            named = components(links.unionByName(more), scratch, "second")
    scratch.drop("mates", "pivots", "ties", "large", "first-dealt", "second-dealt", "stars", "strays", "cells", "first", "second")
    return signed, classes.drop("bands"), named


def near_duplicates(documents: DataFrame, percent: int = 75, name: str = "neardup") -> DataFrame:
    """One row per row of ``documents``: doc_id, n_shingles, component_id, kept."""
    scratch = Scratch(documents.sparkSession, name)
    signed, classes, named = near_classes(documents.select("doc_id", "text"), percent, scratch, where="doc_id is not null")
    own = signed.where("doc_id is not null and n_shingles > 0").select("doc_id", "d0", "d1")
    several = own.groupBy("doc_id").agg(F.min("d0").alias("low"), F.max("d0").alias("high")).where("low <> high").select("doc_id")
    if several.limit(1).count():  # an id of different texts ties them
        keyed = scratch.keep(own.join(several, "doc_id").distinct().join(classes, ["d0", "d1"]).select("doc_id", "key"), "keyed")
        ties = keyed.join(keyed.groupBy("doc_id").agg(F.min("key").alias("low")), "doc_id").select(F.col("key").alias("a"), F.col("low").alias("b"))
        named = components(ties.unionByName(named.select(F.col("id").alias("a"), F.col("component").alias("b"))), scratch, "ids")
    linked = named.join(classes, named.id == classes.key).select("key", "component", "least_id")
    lowest = scratch.keep(linked.groupBy("component").agg(F.min("least_id").alias("component_id")), "lowest")
    linked = linked.join(lowest, "component").select("key", "component_id")
    each = classes.join(linked, "key", "left").select("d0", "d1", F.coalesce("component_id", "least_id").alias("component_id"))
    rows = signed.select("doc_id", "n_shingles", "d0", "d1").join(each, ["d0", "d1"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    rows = rows.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))
    result = scratch.keep(rows, "result")
    scratch.drop("signed", "classes", "keyed", "lowest", *(f"{k}-components" for k in ("first", "second", "ids")))
    return result


def near_copies(documents: DataFrame, row: tuple[str, ...], percent: int = 75, name: str = "neardup") -> DataFrame:
    """The ``row`` columns, which name a row and are not null, of all rows but one of each component: the row with the smallest doc_id (null last), then ``row``, is left out."""
    scratch = Scratch(documents.sparkSession, name)
    signed, classes, named = near_classes(documents.select("doc_id", "text", *row), percent, scratch, extra=row)
    groups = classes.join(named, classes.key == named.id, "left").where("n > 1 or component is not null").select("d0", "d1", F.coalesce("component", "key").alias("component"))
    which = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *row).alias("which")
    rows = scratch.keep(signed.where("n_shingles > 0").join(groups, ["d0", "d1"]).select("component", which), "rows")
    first = rows.groupBy("component").agg(F.min("which").alias("which")).select(*(F.col("which").getField(c).alias(c) for c in row))
    # a row's name is no hot key, as a component would be
    gone = scratch.keep(rows.select(*(F.col("which").getField(c).alias(c) for c in row)).join(first, list(row), "left_anti"), "gone")
    scratch.drop("signed", "classes", "rows", "first-components", "second-components")
    return gone
