"""Queries over jobs, manifests and tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import jobs as J
from weftline.operators import tokens as TK
from weftline.sources import formats as FM

from .base import cues, query, table


@query("job_identities", "SELECT doc_id, sha1(source || chr(10) || CAST(n_chars AS VARCHAR) || chr(10) || lang) AS job_id, sha256(encode(lang) || '\\x00'::BLOB || encode(text)) AS cache_key FROM documents")
def job_identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", J.job_id(F.col("source"), F.col("n_chars"), F.col("lang")).alias("job_id"), J.content_key(F.col("lang"), F.col("text").cast("binary")).alias("cache_key"))


@query(
    "job_progress",
    """CUES WITH p AS (SELECT file_id, sum(end_ms - start_ms) AS done, 2 * sum(end_ms - start_ms) + any_value(file_id % 3) * 1000 AS total, count(*) * 17 AS wall FROM cues GROUP BY file_id)
    SELECT file_id, round(least(1.0, done / total), 9) AS fraction, round(done / wall, 6) AS rtf, CAST(round(wall * (total - done) / done) AS BIGINT) AS eta_ms FROM p""",
)
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.sum(F.col("end_ms") - F.col("start_ms"))
    p = cues(spark, sf_dir).groupBy("file_id").agg(d.alias("done"), (2 * d + F.col("file_id") % 3 * 1000).alias("total"), (F.count("*") * 17).alias("wall"))
    done, total, wall = F.col("done"), F.col("total"), F.col("wall")
    return p.select("file_id", F.round(J.fraction(done, total), 9).alias("fraction"), F.round(J.real_time_factor(done, wall), 6).alias("rtf"), J.remaining_ms(done, total, wall).alias("eta_ms"))


@query("resume_state", "SELECT o_orderkey, o_orderkey % 4 <> 0 AND o_orderkey % 7 <> 0 AND o_totalprice >= 50000 AS resumes FROM orders")
def resume_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    ok = J.may_resume(F.when(k % 4 == 0, 2).otherwise(3), F.col("o_orderstatus"), F.when(k % 7 == 0, "a").otherwise("b"), F.lit(3), F.col("o_orderstatus"), F.lit("b"), J.is_truncated(F.col("o_totalprice"), F.lit(53000)))
    return table(spark, sf_dir, "orders").select("o_orderkey", ok.alias("resumes"))


@query("device_choice", "SELECT CAST(s_suppkey AS INTEGER) AS \"index\", s_name AS name, CAST(floor(abs(s_acctbal)) AS BIGINT) AS memory_mb, CAST((s_nationkey % 9) || '.5' AS DOUBLE) AS capability FROM supplier WHERE floor(abs(s_acctbal)) >= 2000 AND CAST((s_nationkey % 9) || '.5' AS DOUBLE) >= 3 ORDER BY 3 DESC, 1 LIMIT 1")
def device_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat_ws(", ", F.col("s_suppkey").cast("string"), "s_name", F.format_string("%d MiB", F.floor(F.abs("s_acctbal"))), F.concat((F.col("s_nationkey") % 9).cast("string"), F.lit(".5")))
    return J.best_device(J.devices(table(spark, sf_dir, "supplier").select(line.alias("value"))), 2000, 3.0)


@query(
    "token_rebase",
    """CUES WITH m AS (SELECT file_id, idx // 10 AS grp, idx, start_ms, end_ms, [kind, 'x'] AS tokens, [0, 100] AS offsets FROM cues),
    g AS (SELECT file_id, grp, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM m GROUP BY ALL),
    t AS (SELECT m.file_id, m.grp, m.idx, unnest(tokens) AS tok, unnest(offsets) + m.start_ms - g.start_ms AS off, generate_subscripts(tokens, 1) AS k FROM m JOIN g USING (file_id, grp))
    SELECT file_id, grp, any_value(g.start_ms) AS start_ms, any_value(g.end_ms) AS end_ms, string_agg(tok, ' ' ORDER BY idx, k) AS tokens, string_agg(off, ' ' ORDER BY idx, k) AS offsets FROM t JOIN g USING (file_id, grp) GROUP BY ALL""",
)
def token_rebase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every cue in its group of ten."""
    m = cues(spark, sf_dir).select("file_id", F.expr("idx div 10").alias("grp"), "idx", "start_ms", "end_ms", F.array("kind", F.lit("x")).alias("tokens"), F.array(F.lit(0).cast("long"), F.lit(100).cast("long")).alias("offsets"))
    return TK.rebase(m, ["file_id", "grp"]).select("file_id", "grp", "start_ms", "end_ms", F.array_join("tokens", " ").alias("tokens"), F.array_join(F.col("offsets").cast("array<string>"), " ").alias("offsets"))


@query("attach_tokens", "WITH c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id, turn, CASE WHEN conv_id % 3 <> 0 THEN 't' || k END AS token FROM c")
def attach_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third conversation's sidecar lacks a line, so none of its cues gets tokens."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    k = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    side = c.withColumn("line", k).where((F.col("conv_id") % 3 > 0) | (F.col("line") > 1)).select("conv_id", "line", F.array(F.concat(F.lit("t"), F.col("line").cast("string"))).alias("t"), F.array(F.lit(0)).alias("o"), F.array(F.lit(40)).alias("e"))
    return FM.attach_tokens(c, side, ["conv_id"], ["turn"], "line").select("conv_id", "turn", F.get("t", F.lit(0)).alias("token"))


@query(
    "registry_packs",
    """SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'ctc' ELSE 'transducer' END AS architecture, CAST(p_size * 1000 + CASE WHEN p_partkey % 3 = 0 THEN 7 ELSE 0 END AS BIGINT) AS total_bytes, CASE WHEN p_partkey % 2 = 0 AND p_partkey % 5 <> 0 THEN 'no blank token' END AS fault FROM part""",
)
def registry_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifests written per brand, half as bare lists, and read with defaults and totals of required files."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    pack = F.struct(
        k.cast("string").alias("id"), F.when(k % 2 == 0, "ctc").alias("architecture"), F.array("p_type").alias("languages"), F.when((k % 2 == 0) & (k % 5 == 0), "<blk>").alias("blankToken"),
        F.array(F.struct(F.lit("a").alias("name"), (F.col("p_size") * 1000).cast("long").alias("bytes"), F.lit(True).alias("required")), F.struct(F.lit("b").alias("name"), F.lit(7).cast("long").alias("bytes"), (k % 3 == 0).alias("required"))).alias("files"),
    )
    packs = p.groupBy("p_brand").agg(F.collect_list(pack).alias("packs"))
    text = F.when(F.length("p_brand") % 2 == 0, F.to_json("packs")).otherwise(F.to_json(F.struct("packs")))
    return FM.model_registry(packs.select(text.alias("text"))).select(F.col("id").cast("long").alias("id"), "architecture", "total_bytes", "fault")


@query("token_tables", "SELECT CAST(p_partkey AS INTEGER) AS id, CASE WHEN p_partkey % 50 = 0 THEN '<blk>' WHEN p_partkey % 7 = 0 THEN '<0x4A>' ELSE p_name END AS token, p_partkey % 50 = 0 AS is_special, CASE WHEN p_partkey % 50 <> 0 AND p_partkey % 7 = 0 THEN 74 END AS byte_value FROM part")
def token_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    token = F.when(k % 50 == 0, "<blk>").when(k % 7 == 0, "<0x4A>").otherwise(F.col("p_name"))
    return FM.token_table(table(spark, sf_dir, "part").select(F.concat(token, F.when(k % 2 == 0, "\t").otherwise(" "), k.cast("string")).alias("value")))


@query("file_charsets", """
    WITH d AS (SELECT doc_id, doc_id % 3 AS k, coalesce(text, '') AS t FROM documents),
    u AS (SELECT *, flatten(list_transform(string_split(left(t, 32), ''), lambda c: CASE WHEN unicode(c) > 65535 THEN [55296 + (unicode(c) - 65536) // 1024, 56320 + (unicode(c) - 65536) % 1024] WHEN c = '' THEN [] ELSE [unicode(c)] END))[:32] AS units FROM d),
    n AS (SELECT *, len(units) AS n, len(list_filter(units, lambda x: x < 256 AND x > 0)) AS narrow, len(list_filter(units, lambda x: x >= 256 AND x % 256 = 0)) AS wide FROM u),
    c AS (SELECT *, CASE WHEN k = 2 THEN 'ISO-8859-1' WHEN CASE k WHEN 0 THEN narrow ELSE wide END > 0 AND CASE k WHEN 0 THEN narrow ELSE wide END * 2 >= n THEN 'UTF-16LE'
        WHEN CASE k WHEN 1 THEN narrow ELSE wide END > 0 AND CASE k WHEN 1 THEN narrow ELSE wide END * 2 >= n THEN 'UTF-16BE' ELSE 'ISO-8859-1' END AS charset FROM n)
    SELECT doc_id, charset, k = 2 OR t = '' OR charset = CASE k WHEN 0 THEN 'UTF-16LE' ELSE 'UTF-16BE' END AS same FROM c""")
def file_charsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts of all rows as files in three encodings; Latin-1 files have ``?`` for what that cannot say."""
    k, text = F.col("doc_id") % 3, F.coalesce("text", F.lit(""))
    latin = F.regexp_replace(text, r"[^\x00-\xFF]", "?")
    raw = F.when(k == 0, F.encode(text, "UTF-16LE")).when(k == 1, F.encode(text, "UTF-16BE")).otherwise(F.encode(latin, "ISO-8859-1"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(k < 2, text).otherwise(latin).alias("text"), raw.alias("raw"))
    return d.select("doc_id", FM.sniff_charset(F.col("raw")).alias("charset"), (FM.decode_file(F.col("raw")) == F.col("text")).alias("same"))
