"""Queries over ordered timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftline.operators import timeline as TL

from .base import cues, query, table

HOUR = 3_600_000


@query(
    "cue_sessions",
    f"""CUES WITH g AS (SELECT file_id, start_ms, idx, CASE WHEN start_ms - lag(start_ms) OVER w > {6 * HOUR} OR lag(start_ms) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM cues WINDOW w AS (PARTITION BY file_id ORDER BY start_ms, idx)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY file_id ORDER BY start_ms, idx ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT file_id, CAST(session AS BIGINT) AS session, min(start_ms) AS start_ms, max(start_ms) AS end_ms, count(*) AS n FROM s GROUP BY ALL""",
)
def cue_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TL.sessions(cues(spark, sf_dir), ["file_id"], "start_ms", 6 * HOUR, "idx")


@query("file_offsets", "CUES WITH d AS (SELECT file_id, max(end_ms) - min(start_ms) AS duration FROM cues GROUP BY ALL) SELECT file_id, duration, CAST(coalesce(sum(duration) OVER (ORDER BY file_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_at FROM d")
def file_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = cues(spark, sf_dir).groupBy("file_id").agg((F.max("end_ms") - F.min("start_ms")).alias("duration"))
    one = files.withColumn("book", F.lit(0))  # the files of one book are few; books are what spreads
    return TL.prefix_sum(one, ["book"], ["file_id"], "duration", "start_at").drop("book")


def _per_file(s: DataFrame) -> W:
    return W.partitionBy("file_id").orderBy("start_ms", "idx")


@query("valid_spans", "CUES SELECT file_id, idx, start_ms, end_ms FROM cues WHERE start_ms >= 0 AND end_ms > start_ms AND end_ms - start_ms <= 2000")
def valid_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cues(spark, sf_dir).where("start_ms >= 0 and end_ms > start_ms and end_ms - start_ms <= 2000").select("file_id", "idx", "start_ms", "end_ms")


@query("overlap_trim", "CUES SELECT file_id, idx, start_ms, least(end_ms, coalesce(lead(start_ms) OVER (PARTITION BY file_id ORDER BY start_ms, idx), end_ms)) AS end_ms FROM cues")
def overlap_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues(spark, sf_dir)
    return c.select("file_id", "idx", "start_ms", F.least("end_ms", F.coalesce(F.lead("start_ms").over(_per_file(c)), "end_ms")).alias("end_ms"))


@query(
    "overlap_conflicts",
    """CUES WITH m AS (SELECT *, CASE WHEN idx % 7 = 0 THEN start_ms - 900000 ELSE start_ms END AS new_start FROM cues),
    w AS (SELECT file_id, idx, start_ms < lag(end_ms) OVER k AS was, new_start < lag(new_start + end_ms - start_ms) OVER k AS now, new_start < lag(new_start) OVER k AS reversed FROM m WINDOW k AS (PARTITION BY file_id ORDER BY start_ms, idx))
    SELECT file_id, idx, now AND NOT was AS introduced, reversed FROM w WHERE now OR reversed""",
)
def overlap_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues(spark, sf_dir).withColumn("new_start", F.when(F.col("idx") % 7 == 0, F.col("start_ms") - 900000).otherwise(F.col("start_ms")))
    w = _per_file(c)
    new_end = F.col("new_start") + F.col("end_ms") - F.col("start_ms")
    c = c.select("file_id", "idx", (F.col("start_ms") < F.lag("end_ms").over(w)).alias("was"), (F.col("new_start") < F.lag(new_end).over(w)).alias("now"), (F.col("new_start") < F.lag("new_start").over(w)).alias("reversed"))
    return c.where("now or reversed").select("file_id", "idx", F.expr("now and not was").alias("introduced"), "reversed")


@query("tumbling_buckets", f"CUES SELECT file_id, CAST(floor(start_ms / {24 * HOUR}) AS BIGINT) AS bucket, count(*) AS n, count(*) FILTER (value >= 10) AS hits, round(avg(CASE WHEN value >= 10 THEN 1.0 ELSE 0.0 END), 9) AS rate FROM cues GROUP BY ALL")
def tumbling_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.col("value") >= 10
    return cues(spark, sf_dir).groupBy("file_id", F.floor(F.col("start_ms") / (24 * HOUR)).alias("bucket")).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"), F.round(F.avg(F.when(hit, 1.0).otherwise(0.0)), 9).alias("rate"))


@query(
    "sliding_windows",
    """CUES WITH f AS (SELECT file_id, 1000 * (count(*) * 3 + file_id % 17) AS total FROM cues GROUP BY file_id),
    n AS (SELECT *, 1 + greatest(0, CAST(ceil((total - 15000 - 1500) / 12000.0) AS BIGINT)) AS n FROM f),
    w AS (SELECT *, unnest(range(n)) AS k FROM n)
    SELECT file_id, CAST(k AS INTEGER) AS "window", k * 12000 AS start_ms, least(k * 12000 + 15000, total) AS end_ms, CASE WHEN k = 0 THEN 0 ELSE k * 12000 + 1500 END AS core_start,
        CASE WHEN k = n - 1 THEN least(k * 12000 + 15000, total) ELSE k * 12000 + 13500 END AS core_end FROM w""",
)
def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = cues(spark, sf_dir).groupBy("file_id").agg((1000 * (F.count("*") * 3 + F.col("file_id") % 17)).alias("total"))
    return TL.sliding_windows(files, ["file_id"], "total", 15000, 3000)


@query(
    "core_tokens",
    """CUES SELECT file_id, idx, CAST(floor(start_ms / 12000) AS BIGINT) AS "window" FROM cues WHERE start_ms % 12000 >= 1500 AND start_ms % 12000 < 10500""",
)
def core_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("start_ms") % 12000
    return cues(spark, sf_dir).where((at >= 1500) & (at < 10500)).select("file_id", "idx", F.floor(F.col("start_ms") / 12000).alias("window"))


@query(
    "fixed_spans",
    """CUES WITH s AS (SELECT file_id, idx AS span, start_ms, greatest(end_ms, start_ms + 1500) AS end_ms FROM cues WHERE idx % 20 = 0)
    SELECT s.file_id, span, count(*) AS n, min(c.start_ms) AS first_ms FROM s JOIN cues c ON c.file_id = s.file_id AND c.start_ms >= s.start_ms AND c.start_ms < s.end_ms GROUP BY ALL""",
)
def fixed_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.operators.spans import slice_spans

    c = cues(spark, sf_dir)
    spans = c.where("idx % 20 = 0").select("file_id", F.col("idx").alias("span"), F.col("start_ms").alias("span_start"), F.greatest(F.col("end_ms"), F.col("start_ms") + 1500).alias("span_end"))
    return slice_spans(spans, c.select("file_id", "start_ms"), ["file_id"], "start_ms", 60_000).groupBy("file_id", "span").agg(F.count("*").alias("n"), F.min("start_ms").alias("first_ms"))


@query(
    "asof_section",
    """CUES WITH b AS (SELECT file_id, start_ms AS at, idx AS section FROM (SELECT *, row_number() OVER (PARTITION BY file_id, start_ms // 86400000 ORDER BY start_ms, idx) AS k FROM cues) WHERE k = 1)
    SELECT c.file_id, c.idx, b.section FROM cues c ASOF LEFT JOIN b ON c.file_id = b.file_id AND c.start_ms >= b.at""",
)
def asof_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues(spark, sf_dir)
    day = W.partitionBy("file_id", F.floor(F.col("start_ms") / 86_400_000)).orderBy("start_ms", "idx")
    first = c.withColumn("k", F.row_number().over(day)).where("k = 1").select("file_id", F.col("start_ms").alias("at"), F.col("idx").alias("section"))
    return TL.asof_last(c.select("file_id", "idx", "start_ms"), first, ["file_id"], "start_ms", "at", "section", "section").drop("start_ms")


@query(
    "nearest_hits",
    """CUES WITH s AS (SELECT file_id, idx, start_ms FROM cues WHERE kind = 'click'), r AS (SELECT file_id, start_ms AS t FROM cues WHERE kind = 'view')
    SELECT s.file_id, s.idx, min(abs(r.t - s.start_ms)) AS distance, coalesce(min(abs(r.t - s.start_ms)) <= 3600000, false) AS hit FROM s LEFT JOIN r USING (file_id) GROUP BY ALL""",
)
def nearest_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues(spark, sf_dir)
    near = TL.nearest(c.where("kind = 'click'").select("file_id", "idx", "start_ms"), c.where("kind = 'view'").select("file_id", F.col("start_ms").alias("t")), ["file_id"], "start_ms", "t")
    return near.select("file_id", "idx", "distance", F.coalesce(F.col("distance") <= HOUR, F.lit(False)).alias("hit"))


@query(
    "match_rate",
    """CUES WITH s AS (SELECT file_id, idx, start_ms FROM cues WHERE kind = 'click'), r AS (SELECT file_id, start_ms AS t FROM cues WHERE kind = 'view'),
    d AS (SELECT s.file_id, s.idx, min(abs(r.t - s.start_ms)) AS d FROM s LEFT JOIN r USING (file_id) GROUP BY ALL)
    SELECT file_id, round(avg(CASE WHEN d <= 3600000 THEN 1.0 ELSE 0.0 END), 9) AS rate, least(1.0, 2 * 3600000.0 * count(*) / 2592000000) AS chance FROM d GROUP BY ALL""",
)
def match_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_hits(spark, sf_dir).groupBy("file_id").agg(F.round(F.avg(F.when(F.col("hit"), 1.0).otherwise(0.0)), 9).alias("rate"), F.least(F.lit(1.0), F.lit(2 * 3600000.0) * F.count("*") / 2592000000).alias("chance"))


DIFFS = """CUES WITH r AS (SELECT file_id, start_ms AS t FROM cues WHERE kind = 'view'), s AS (SELECT file_id, start_ms AS u FROM cues WHERE kind = 'click'),
    d AS (SELECT file_id, t - u AS diff FROM r JOIN s USING (file_id) WHERE abs(t - u) <= 7200000)"""


def _diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues(spark, sf_dir)
    r, s = c.where("kind = 'view'").select("file_id", F.col("start_ms").alias("t")), c.where("kind = 'click'").select("file_id", F.col("start_ms").alias("u"))
    return TL.range_join(r, s, ["file_id"], "t", "u", 2 * HOUR).select("file_id", (F.col("t") - F.col("u")).alias("diff"))


@query("range_diffs", DIFFS + " SELECT file_id, count(*) AS pairs, min(diff) AS least, max(diff) AS most FROM d GROUP BY ALL")
def range_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _diffs(spark, sf_dir).groupBy("file_id").agg(F.count("*").alias("pairs"), F.min("diff").alias("least"), F.max("diff").alias("most"))


@query(
    "offset_histogram",
    DIFFS + """, h AS (SELECT CAST(floor(diff / 600000) AS BIGINT) AS bin, count(*) AS n FROM d GROUP BY ALL), g AS (SELECT unnest(range(-12, 13)) AS bin)
    SELECT g.bin, CAST(coalesce(n, 0) AS BIGINT) AS n, CAST(sum(coalesce(n, 0)) OVER (ORDER BY g.bin ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS smooth FROM g LEFT JOIN h USING (bin)""",
)
def offset_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _diffs(spark, sf_dir).groupBy(F.floor(F.col("diff") / 600000).alias("bin")).agg(F.count("*").alias("n"))
    dense = spark.range(-12, 13).select(F.col("id").alias("bin")).join(h, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))
    return dense.withColumn("smooth", F.sum("n").over(W.orderBy("bin").rowsBetween(-1, 1)))  # as many rows as bins, whatever the input


@query(
    "start_cluster",
    """CUES WITH p AS (SELECT file_id, idx, start_ms FROM cues WHERE kind = 'purchase' OR kind = 'click'),
    v AS (SELECT a.file_id, a.idx, a.start_ms, count(DISTINCT b.idx) AS support FROM p a JOIN p b ON a.file_id = b.file_id AND b.start_ms BETWEEN a.start_ms AND a.start_ms + 7200000 GROUP BY ALL)
    SELECT file_id, min(start_ms) AS start_ms, support FROM v WHERE support = (SELECT max(support) FROM v w WHERE w.file_id = v.file_id) GROUP BY ALL""",
)
def start_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = cues(spark, sf_dir).where("kind in ('purchase', 'click')").select("file_id", "idx", "start_ms")
    pairs = TL.range_join(p, p.select("file_id", F.col("idx").alias("other"), F.col("start_ms").alias("t")), ["file_id"], "start_ms", "t", 2 * HOUR).where("t >= start_ms")
    votes = pairs.groupBy("file_id", "idx", "start_ms").agg(F.count_distinct("other").alias("support"))
    best = votes.groupBy("file_id").agg(F.max(F.struct("support", (-F.col("start_ms")).alias("neg"))).alias("b"))
    return best.select("file_id", (-F.col("b.neg")).alias("start_ms"), F.col("b.support").alias("support"))


@query(
    "nearest_rank_floor",
    """CUES WITH r AS (SELECT file_id, value, row_number() OVER (PARTITION BY file_id ORDER BY value) AS k, count(*) OVER (PARTITION BY file_id) AS n FROM cues WHERE value IS NOT NULL)
    SELECT file_id, value AS floor_value FROM r WHERE k = round((n - 1) * 10 / 100) + 1""",
)
def nearest_rank_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TL.nearest_rank(cues(spark, sf_dir), ["file_id"], "value", 10, "floor_value")


@query("upper_medians", "CUES WITH r AS (SELECT file_id, value, row_number() OVER (PARTITION BY file_id ORDER BY value) AS k, count(*) OVER (PARTITION BY file_id) AS n FROM cues WHERE value IS NOT NULL) SELECT file_id, value AS median FROM r WHERE k = n // 2 + 1")
def upper_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TL.upper_median(cues(spark, sf_dir), ["file_id"], "value", "median")


@query("anchor_medians", "CUES SELECT file_id, label, quantile_cont(start_ms, 0.5) AS source, quantile_cont(end_ms - start_ms, 0.5) AS shift FROM cues GROUP BY ALL")
def anchor_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cues(spark, sf_dir).groupBy("file_id", "label").agg(F.percentile("start_ms", 0.5).alias("source"), F.percentile(F.col("end_ms") - F.col("start_ms"), 0.5).alias("shift"))


@query(
    "match_stats",
    """CUES SELECT file_id, count(*) AS input, count(*) FILTER (value >= 20) AS matched, count(*) FILTER (value >= 10 AND value < 20) AS interpolated, count(*) FILTER (value < 10) AS unchanged,
    round(count(*) FILTER (value >= 20) / count(*), 9) AS rate, list_sort(list(idx) FILTER (value < 10))[1:10] AS first_unchanged FROM cues GROUP BY ALL""",
)
def match_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.operators.spans import first_values

    c = cues(spark, sf_dir)
    v = F.col("value")
    stats = c.groupBy("file_id").agg(
        F.count("*").alias("input"), F.count_if(v >= 20).alias("matched"), F.count_if((v >= 10) & (v < 20)).alias("interpolated"), F.count_if(v < 10).alias("unchanged"), F.round(F.count_if(v >= 20) / F.count("*"), 9).alias("rate")
    )
    return stats.join(first_values(c.where(v < 10), ["file_id"], "idx", 10, "first_unchanged"), "file_id", "left")


@query(
    "longest_unchecked",
    """CUES WITH f AS (SELECT *, value >= 15 AS ok, row_number() OVER (PARTITION BY file_id ORDER BY start_ms, idx) - row_number() OVER (PARTITION BY file_id, value >= 15 ORDER BY start_ms, idx) AS g FROM cues),
    r AS (SELECT file_id, g, max(start_ms) - min(start_ms) AS span FROM f WHERE NOT ok GROUP BY ALL) SELECT file_id, max(span) AS longest FROM r GROUP BY ALL""",
)
def longest_unchecked(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = TL.run_lengths(cues(spark, sf_dir).withColumn("ok", F.col("value") >= 15), ["file_id"], ["start_ms", "idx"], "ok").where("not ok")
    return runs.groupBy("file_id").agg(F.max(F.col("last") - F.col("first")).alias("longest"))


@query("job_totals", "CUES SELECT file_id, sum(end_ms - start_ms)::BIGINT AS speech_ms, max(end_ms) AS max_end, count(*) AS segments, round(sum(end_ms - start_ms) / nullif(max(end_ms) - min(start_ms), 0), 12) AS fraction, max(end_ms) < min(start_ms) + 2592000000 - 3000 AS truncated FROM cues GROUP BY ALL")
def job_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("end_ms") - F.col("start_ms")
    return cues(spark, sf_dir).groupBy("file_id").agg(
        F.sum(d).alias("speech_ms"), F.max("end_ms").alias("max_end"), F.count("*").alias("segments"),
        F.round(F.sum(d) / F.nullif(F.max("end_ms") - F.min("start_ms"), F.lit(0)), 12).alias("fraction"), (F.max("end_ms") < F.min("start_ms") + F.lit(2592000000 - 3000)).alias("truncated"),
    )


@query("decode_stats", "SELECT l_returnflag, count(*) AS batches, CAST(sum(l_quantity) AS BIGINT) AS frames, CAST(sum(ceil(l_quantity / 16) * 16) AS BIGINT) AS padded, round(sum(ceil(l_quantity / 16) * 16) / sum(l_quantity), 9) AS padding_ratio FROM lineitem GROUP BY ALL")
def decode_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, p = F.col("l_quantity"), F.ceil(F.col("l_quantity") / 16) * 16
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("batches"), F.sum(q).cast("long").alias("frames"), F.sum(p).cast("long").alias("padded"), F.round(F.sum(p) / F.sum(q), 9).alias("padding_ratio"))


@query("pause_cuts", "CUES WITH g AS (SELECT file_id, idx, lead(start_ms) OVER w - end_ms AS gap, row_number() OVER w AS k FROM cues WINDOW w AS (PARTITION BY file_id ORDER BY start_ms, idx)) SELECT file_id, arg_max(idx, gap * 1000000 + k) AS cut_after, max(gap) AS gap FROM g WHERE gap >= 350 GROUP BY ALL")
def pause_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest pause of each file; of equal ones the last."""
    c = cues(spark, sf_dir)
    w = _per_file(c)
    g = c.select("file_id", "idx", (F.lead("start_ms").over(w) - F.col("end_ms")).alias("gap"), F.row_number().over(w).alias("k")).where("gap >= 350")
    return g.groupBy("file_id").agg(F.max_by("idx", F.struct("gap", "k")).alias("cut_after"), F.max("gap").alias("gap"))


@query(
    "gap_interpolation",
    """CUES WITH k AS (SELECT *, CASE WHEN idx % 5 = 0 THEN start_ms END AS old, CASE WHEN idx % 5 = 0 THEN CAST(start_ms + 4000 + (idx % 11) * 1000 AS BIGINT) END AS new FROM cues),
    a AS (SELECT file_id, idx, start_ms, last_value(old IGNORE NULLS) OVER b AS o0, last_value(new IGNORE NULLS) OVER b AS n0, first_value(old IGNORE NULLS) OVER f AS o1, first_value(new IGNORE NULLS) OVER f AS n1 FROM k
        WINDOW b AS (PARTITION BY file_id ORDER BY start_ms, idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f AS (PARTITION BY file_id ORDER BY start_ms, idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT file_id, idx, CAST(round(n0 + (start_ms - o0) * (n1 - n0) / (o1 - o0)) AS BIGINT) AS mapped FROM a WHERE o1 > o0 AND n1 > n0 AND o1 - o0 <= 120000000 AND n1 - n0 <= 120000000 AND (n1 - n0) / (o1 - o0) BETWEEN 0.5 AND 2""",
)
def gap_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.operators.spans import interpolate

    c = cues(spark, sf_dir)
    anchor = F.col("idx") % 5 == 0
    c = c.withColumns({"old": F.when(anchor, F.col("start_ms")), "new": F.when(anchor, F.col("start_ms") + 4000 + (F.col("idx") % 11) * 1000)})
    return interpolate(c, ["file_id"], ["start_ms", "idx"], "start_ms", "old", "new", 120_000_000).where("mapped is not null").select("file_id", "idx", "mapped")


@query(
    "theil_sen_rate",
    """CUES WITH p AS (SELECT file_id, CAST(start_ms AS DOUBLE) AS x, CAST(start_ms * 1.0 + (idx % 13) * 100 AS DOUBLE) AS y, row_number() OVER (PARTITION BY file_id ORDER BY start_ms, idx) AS k FROM cues QUALIFY k <= 32)
    SELECT a.file_id, round(quantile_cont((b.y - a.y) / (b.x - a.x), 0.5), 9) AS rate, count(*) AS pairs FROM p a JOIN p b ON a.file_id = b.file_id AND b.x - a.x >= 15000 GROUP BY ALL""",
)
def theil_sen_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.operators.clock import theil_sen

    c = cues(spark, sf_dir).select("file_id", "start_ms", "idx", F.col("start_ms").cast("double").alias("x"), (F.col("start_ms") + (F.col("idx") % 13) * 100).cast("double").alias("y"))
    return theil_sen(c, ["file_id"], ["start_ms", "idx"], "x", "y")


@query(
    "greedy_unique_starts",
    """CUES WITH RECURSIVE o AS (SELECT file_id, start_ms, row_number() OVER (PARTITION BY file_id ORDER BY start_ms) AS k FROM (SELECT DISTINCT file_id, start_ms FROM cues)),
    r AS (SELECT file_id, k, start_ms AS taken, true AS keep FROM o WHERE k = 1
        UNION ALL SELECT o.file_id, o.k, CASE WHEN o.start_ms > r.taken + 7200000 THEN o.start_ms ELSE r.taken END, o.start_ms > r.taken + 7200000 FROM r JOIN o ON o.file_id = r.file_id AND o.k = r.k + 1)
    SELECT file_id, taken AS start_ms FROM r WHERE keep""",
)
def greedy_unique_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.operators.spans import spaced_starts

    return spaced_starts(cues(spark, sf_dir), ["file_id"], "start_ms", 2 * HOUR)


@query(
    "piecewise_lookup",
    """CUES WITH m AS (SELECT file_id, idx AS region, start_ms AS lo, coalesce(lead(start_ms) OVER (PARTITION BY file_id ORDER BY start_ms, idx), 9007199254740991) AS hi, (idx % 9) * 250 AS shift FROM cues WHERE idx % 25 = 0)
    SELECT c.file_id, c.idx, m.region, c.start_ms + m.shift AS mapped FROM cues c JOIN m ON c.file_id = m.file_id AND c.start_ms >= m.lo AND c.start_ms < m.hi""",
)
def piecewise_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues(spark, sf_dir)
    m = c.where("idx % 25 = 0").select("file_id", F.col("start_ms").alias("lo"), F.struct(F.col("start_ms").alias("at"), F.col("idx").alias("region"), ((F.col("idx") % 9) * 250).alias("shift")).alias("seg"))
    got = TL.asof_last(c.select("file_id", "idx", "start_ms"), m, ["file_id"], "start_ms", "lo", "seg", "seg").where("seg is not null")
    return got.select("file_id", "idx", F.col("seg.region").alias("region"), (F.col("start_ms") + F.col("seg.shift")).alias("mapped"))


@query(
    "removed_spans",
    """CUES WITH x AS (SELECT file_id, start_ms AS lo, start_ms + 1800000 AS hi FROM cues WHERE idx % 40 = 0)
    SELECT file_id, idx FROM cues c WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.file_id = c.file_id AND c.start_ms >= x.lo AND c.start_ms < x.hi)""",
)
def removed_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.operators.spans import outside_spans

    c = cues(spark, sf_dir)
    x = c.where("idx % 40 = 0").select("file_id", F.col("start_ms").alias("span_start"), (F.col("start_ms") + 1800000).alias("span_end"))
    return outside_spans(c.select("file_id", "idx", "start_ms"), x, ["file_id"], "start_ms").select("file_id", "idx")


@query(
    "offsets_agree",
    """CUES WITH o AS (SELECT file_id, (idx % 6) * 100 AS a, (idx % 4) * 150 AS b FROM cues) SELECT file_id, round(avg(CASE WHEN abs(a - b) <= 250 THEN 1.0 ELSE 0.0 END), 9) AS share, avg(CASE WHEN abs(a - b) <= 250 THEN 1.0 ELSE 0.0 END) >= 0.9 AS agree FROM o GROUP BY ALL""",
)
def offsets_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = F.avg(F.when(F.abs((F.col("idx") % 6) * 100 - (F.col("idx") % 4) * 150) <= 250, 1.0).otherwise(0.0))
    return cues(spark, sf_dir).groupBy("file_id").agg(F.round(near, 9).alias("share"), (near >= 0.9).alias("agree"))


@query("clock_neighbours", "CUES WITH n AS (SELECT file_id, idx, start_ms - lag(start_ms) OVER w AS gap, abs((idx % 17) * 300 - lag((idx % 17) * 300) OVER w) AS d FROM cues WINDOW w AS (PARTITION BY file_id ORDER BY start_ms, idx)) SELECT file_id, idx, coalesce(gap BETWEEN 0 AND 180000 AND d <= CASE WHEN gap > 90000 THEN 1500 ELSE 2000 + least(2000, 0.05 * gap) END, false) AS compatible FROM n")
def clock_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.operators.clock import compatible

    c = cues(spark, sf_dir).withColumn("shift", (F.col("idx") % 17) * 300)
    w = _per_file(c)
    return c.select("file_id", "idx", F.coalesce(compatible(F.col("start_ms") - F.lag("start_ms").over(w), F.col("shift") - F.lag("shift").over(w)), F.lit(False)).alias("compatible"))


@query("sorted_spans", "CUES SELECT file_id, sha1(string_agg(start_ms || '-' || end_ms, ',' ORDER BY start_ms, end_ms)) AS fingerprint FROM cues GROUP BY ALL")
def sorted_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array_sort(F.collect_list(F.struct("start_ms", "end_ms")))
    return cues(spark, sf_dir).groupBy("file_id").agg(F.sha1(F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start_ms"], s["end_ms"])), ",")).alias("fingerprint"))


@query("reference_tracks", "CUES WITH n AS (SELECT file_id, kind, count(*) AS cues FROM cues GROUP BY ALL), t AS (SELECT file_id, sum(cues) AS total FROM n GROUP BY ALL) SELECT file_id, kind, cues FROM n JOIN t USING (file_id) WHERE cues >= 5 AND cues >= 0.2 * total")
def reference_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = cues(spark, sf_dir).groupBy("file_id", "kind").agg(F.count("*").alias("cues"))
    return n.withColumn("total", F.sum("cues").over(W.partitionBy("file_id"))).where("cues >= 5 and cues >= 0.2 * total").drop("total")


@query("long_cues", "CUES SELECT file_id, idx, end_ms - start_ms > 2500 OR length(trim(label)) > 9 AS needs_split, 0.3 <= (end_ms - start_ms) / 1500.0 AND (end_ms - start_ms) / 1500.0 <= 2.5 AS plausible FROM cues")
def long_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("end_ms") - F.col("start_ms")
    return cues(spark, sf_dir).select("file_id", "idx", ((d > 2500) | (F.length(F.trim("label")) > 9)).alias("needs_split"), (d / 1500.0).between(0.3, 2.5).alias("plausible"))


@query("eligible_runs", "CUES SELECT file_id, idx, coalesce(value >= 5 AND lead(value) OVER w >= 5 AND lead(start_ms) OVER w >= end_ms AND lead(start_ms) OVER w - end_ms <= 3600000, false) AS contiguous FROM cues WINDOW w AS (PARTITION BY file_id ORDER BY start_ms, idx)")
def eligible_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues(spark, sf_dir)
    w = _per_file(c)
    after = F.lead("start_ms").over(w)
    return c.select("file_id", "idx", F.coalesce((F.col("value") >= 5) & (F.lead("value").over(w) >= 5) & (after >= F.col("end_ms")) & (after - F.col("end_ms") <= HOUR), F.lit(False)).alias("contiguous"))


@query("resume_filter", "CUES SELECT file_id, count(*) AS kept FROM cues WHERE file_id % 3 = 0 OR start_ms < 1704067200000 + file_id * 86400000 GROUP BY ALL")
def resume_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of done files, or from before the place where a file resumes; the state is one row a file."""
    c = cues(spark, sf_dir)
    state = c.select("file_id").distinct().withColumn("resume", F.when(F.col("file_id") % 3 == 0, -1).otherwise(F.lit(1704067200000) + F.col("file_id") * 86400000))
    return c.join(state, "file_id").where("resume = -1 or start_ms < resume").groupBy("file_id").agg(F.count("*").alias("kept"))
