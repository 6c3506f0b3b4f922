"""Queries over bytes of sound, groups by weight, and characters' times."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import decode, segment, tokens
from weftline.sources import media

from .base import cues, query, table


@query(
    "segmenter_choice",
    """SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'fixed' WHEN event_id % 3 = 0 THEN 'energy' WHEN event_id % 2 = 0 THEN 'windows' ELSE 'model' END AS segmenter FROM events""",
)
def segmenter_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id")
    kind = segment.segmenter_for(F.col("event_id") % 7 == 0, F.when(F.col("event_id") % 3 == 0, "clean").otherwise("mixed"), F.when(F.col("event_id") % 2 == 0, "nemoCtc").otherwise("transducer"))
    return e.select("event_id", kind.alias("segmenter"))


@query(
    "balanced_groups",
    """WITH RECURSIVE o AS (SELECT l_orderkey % 200 AS shard, CAST(l_quantity AS BIGINT) AS w, row_number() OVER (PARTITION BY l_orderkey % 200 ORDER BY l_orderkey, l_linenumber, l_quantity) - 1 AS k FROM lineitem),
    t AS (SELECT shard, sum(w) AS total, count(*) AS n FROM o GROUP BY shard),
    p AS (SELECT shard, k, sum(w) OVER (PARTITION BY shard ORDER BY k) AS acc FROM o),
    r AS (
        SELECT shard, CAST(-1 AS BIGINT) AS k, 0 AS done, CAST(0 AS BIGINT) AS first, CAST(NULL AS BIGINT) AS closed FROM t
        UNION ALL SELECT r.shard, p.k, CASE WHEN j THEN r.done + 1 ELSE r.done END, CASE WHEN j THEN p.k + 1 ELSE r.first END, CASE WHEN j THEN r.first END
        FROM r JOIN p ON p.shard = r.shard AND p.k = r.k + 1 JOIN t ON t.shard = r.shard, LATERAL (SELECT r.done < 4 AND (p.acc * 5 >= t.total * (r.done + 1) OR t.n - p.k - 1 <= 4 - r.done) AS j)),
    e AS (SELECT shard, closed AS first, k + 1 AS past FROM r WHERE closed IS NOT NULL UNION ALL SELECT r.shard, r.first, t.n FROM r JOIN t USING (shard) WHERE r.k = t.n - 1 AND r.first < t.n)
    SELECT shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY first) - 1 AS INTEGER) AS grp, first AS first_row, past AS past_row FROM e""",
)
def balanced_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines of each shard in five contiguous groups of about equal quantity."""
    li = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 200).alias("shard"), "l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("w"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w = pdf.sort_values(["l_orderkey", "l_linenumber", "w"])["w"].tolist()
        return pd.DataFrame([(pdf["shard"].iloc[0], g, a, z) for g, (a, z) in enumerate(segment.balanced_groups(w, 5))], columns=["shard", "grp", "first_row", "past_row"])

    return li.groupBy("shard").applyInPandas(run, "shard long, grp int, first_row long, past_row long")


@query(
    "decode_arguments",
    """SELECT event_id, '-nostdin -v error ' || CASE WHEN s > 2 THEN printf('-ss %.3f ', s - 2) ELSE '' END || '-i file' || event_id || '.mp3 ' || CASE WHEN s > 0 THEN printf('-ss %.3f ', least(s, 2.0)) ELSE '' END
    || '-t 600.000 -vn -ac 1 -ar 16000 -f s16le -' AS args FROM (SELECT event_id, (event_id % 9) * 0.75 AS s FROM events)""",
)
def decode_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches):
        for b in batches:
            yield pd.DataFrame({"event_id": b["event_id"], "args": [" ".join(media.decode_arguments(f"file{i}.mp3", i % 9 * 0.75, 600.0)) for i in b["event_id"]]})

    return table(spark, sf_dir, "events").select("event_id").mapInPandas(run, "event_id long, args string")


_WAVES = "w AS (SELECT vec_id // 40 AS wave, list(x ORDER BY vec_id, i) AS x FROM (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings) GROUP BY 1)"


def _waves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waves made of 40 vectors each."""
    e = table(spark, sf_dir, "embeddings").groupBy(F.expr("vec_id div 40").alias("wave"))
    return e.agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"])).alias("samples"))


@query(
    "wave_files",
    f"""WITH {_WAVES}, q AS (SELECT wave, list_transform(x, lambda v: CAST(least(32767, greatest(-32768, floor(CAST(v AS DOUBLE) * 32768 + 0.5))) AS BIGINT)) AS q FROM w)
    SELECT wave, 44 + 2 * len(q) AS bytes, md5(array_to_string(q, ',')) AS samples_md5, CAST(list_sum(q) AS BIGINT) AS sample_sum FROM q""",
)
def wave_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Waves written as files, that put into a movie's data box, taken out and read back."""

    def run(batches):
        for b in batches:
            rows = []
            for k, s in zip(b["wave"], b["samples"], strict=True):
                wav = media.float_to_wav(np.asarray(s, np.float32))
                box = lambda kind, body: (len(body) + 8).to_bytes(4, "big") + kind + body
                movie = box(b"ftyp", b"qt  ") + box(b"moov", box(b"trak", b"")) + box(b"mdat", wav[44:])
                q = (media.pcm_to_float(media.movie_payload(movie)).astype(float) * 32768).astype(np.int64)
                rows.append((k, len(wav), hashlib.md5(",".join(map(str, q)).encode()).hexdigest(), int(q.sum())))
            yield pd.DataFrame(rows, columns=["wave", "bytes", "samples_md5", "sample_sum"])

    return _waves(spark, sf_dir).mapInPandas(run, "wave long, bytes long, samples_md5 string, sample_sum long")


@query(
    "character_spread",
    r"""WITH t AS (SELECT conv_id, turn, unnest(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) AS w, unnest(range(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')))) AS i FROM conversations),
    c AS (SELECT conv_id, turn, i, length(regexp_replace(w, '[^\p{L}\p{N}]', '', 'g')) AS n, unnest(string_split(w, '')) AS c, unnest(range(length(w))) AS k FROM t),
    s AS (SELECT *, regexp_full_match(c, '[\p{L}\p{N}]') AS spoken FROM c),
    p AS (SELECT *, sum(CAST(spoken AS INTEGER)) OVER (PARTITION BY conv_id, turn, i ORDER BY k) AS j FROM s),
    b AS (SELECT *, CASE WHEN spoken THEN CAST(trunc(i * 300 + (j - 1) * (250 / greatest(1, n))) AS BIGINT) END AS a, CASE WHEN spoken THEN CAST(trunc(i * 300 + j * (250 / greatest(1, n))) AS BIGINT) END AS z FROM p),
    f AS (SELECT *, coalesce(max(z) OVER (PARTITION BY conv_id, turn ORDER BY i, k), 0) AS last FROM b)
    SELECT conv_id, turn, count(*) AS chars, md5(string_agg(c || ':' || CASE WHEN spoken THEN a ELSE last END || '-' || last, ',' ORDER BY i, k)) AS spread_md5 FROM f GROUP BY conv_id, turn""",
)
def character_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters of each turn's words, a word every 300 ms that lasts 250 ms."""

    def run(batches):
        for b in batches:
            rows = []
            for conv, turn, words in zip(b["conv_id"], b["turn"], b["words"], strict=True):
                at = [k * 300 for k in range(len(words))]
                got = decode.spread_characters(list(words), at, [a + 250 for a in at])
                if got:
                    rows.append((conv, turn, len(got), hashlib.md5(",".join(f"{c}:{a}-{z}" for c, a, z in got).encode()).hexdigest()))
            yield pd.DataFrame(rows, columns=["conv_id", "turn", "chars", "spread_md5"])

    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.filter(F.split("text", r"\s+"), lambda x: x != "").alias("words"))
    return t.mapInPandas(run, "conv_id long, turn long, chars long, spread_md5 string")


@query(
    "cue_characters",
    """CUES SELECT file_id, idx, array_to_string(list_transform(range(length(label)), lambda k: CASE WHEN k < p THEN start_ms + 600 * k // p ELSE start_ms + 600 + 900 * (k - p) // (length(label) - p) END), ',') AS starts, start_ms + 1500 AS last_end,
        '0,' || p AS token_places FROM (SELECT *, length(kind) AS p FROM cues)""",
)
def cue_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of each character of a label of two tokens, the kind in 600 ms and the number in 900, and where the tokens begin in the same text."""

    def run(batches):
        for b in batches:
            rows = []
            for f, i, start, kind, label in zip(b["file_id"], b["idx"], b["start_ms"], b["kind"], b["label"], strict=True):
                parts = [kind, label[len(kind) :]]
                got = tokens.character_times(label, parts, [0, 600], [600, 1500], start)
                rows.append((f, i, ",".join(str(a) for a, _ in got), got[-1][1], ",".join(map(str, tokens.token_places([kind, " " + label[len(kind) + 1 :]], label, label)))))
            yield pd.DataFrame(rows, columns=["file_id", "idx", "starts", "last_end", "token_places"])

    return cues(spark, sf_dir).select("file_id", "idx", "start_ms", "kind", "label").mapInPandas(run, "file_id long, idx long, starts string, last_end long, token_places string")
