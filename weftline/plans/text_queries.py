"""Queries over text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as T

from .base import query, table

def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


FOLD_ARGS = f"{_quote(T.FOLD_FROM)}, {_quote(T.FOLD_TO)}"
NORM = f"translate(regexp_replace(text, '[^{T.KEEP}]', '', 'g'), {FOLD_ARGS})"


@query("normalize_text", f"SELECT doc_id, length(n) AS norm_chars, md5(n) AS norm_md5 FROM (SELECT doc_id, {NORM} AS n FROM documents)")
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = T.normalize_book(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", n.alias("n")).select("doc_id", F.length("n").cast("long").alias("norm_chars"), F.md5("n").alias("norm_md5"))


@query(
    "timeline_text",
    rf"""SELECT conv_id, turn, md5(translate(regexp_replace(lower(replace(replace(replace(replace(regexp_replace(text, '<[^>]*>|\{{[^}}]*\}}', '', 'g'), '&nbsp;', ' '), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')),
    '[^{T.KEEP}\p{{L}}\p{{N}}\p{{M}}]', '', 'g'), {FOLD_ARGS})) AS norm_md5 FROM conversations""",
)
def timeline_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(T.normalize_timeline(F.col("text"))).alias("norm_md5"))


@query(
    "speech_text",
    r"""SELECT page_id, md5(array_to_string(list_filter(list_transform(list_filter(list_transform(
        string_split(replace(regexp_replace(regexp_replace(replace(replace(coalesce(html, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)), '(?i)<br[ \t\n]*/?>', chr(10), 'g'), '<[^<>]*>|\{\\[^{}]*\}', '', 'g'), '&nbsp;', ' '), chr(10)),
        lambda x: regexp_replace(x, '^[\s\x{3000}]+|[\s\x{3000}]+$', '', 'g')), lambda x: NOT regexp_matches(x, '^[\s♪♫♬♩~～〜]*（(?i:音楽|BGM|ＢＧＭ|前奏|間奏|後奏)）[\s♪♫♬♩~～〜]*$')),
        lambda x: regexp_replace(x, '^(（[^（）\n]+）[\s\x{3000}]*)+', '')), lambda x: NOT regexp_matches(x, '^[\s♪♫♬♩~～〜…・.]*$')), chr(10))) AS speech_md5 FROM pages""",
)
def speech_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.md5(T.speech_text(F.coalesce("html", F.lit("")))).alias("speech_md5"))


@query(
    "punctuation_width",
    r"SELECT conv_id, turn, md5(translate(text, '!?', '！？')) AS wide_md5, md5(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')) AS spaces_md5 FROM conversations",
)
def punctuation_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(T.full_width_marks(F.col("text"))).alias("wide_md5"), F.md5(T.collapse_spaces(F.col("text"))).alias("spaces_md5"))


@query(
    "sentence_signs",
    rf"""SELECT conv_id, turn, regexp_matches(text, '[{T.TERMINATORS}]\s*$') AS terminated,
        (t = '' OR regexp_matches(t, '[{T.MERGE_TERMINATORS}]$') OR (regexp_matches(t, '[．.]$') AND NOT regexp_matches(t, '[A-Za-zＡ-Ｚａ-ｚ][．.]$'))) AS sentence_end,
        CAST(length(regexp_replace(text, '[^{T.SPOKEN}]', '', 'g')) AS BIGINT) AS spoken, regexp_matches(text, {_quote(T.PUNCT_ONLY)}) AS only_marks
        FROM (SELECT *, regexp_replace(text, '[\s\x{{3000}}]+$', '') AS t FROM conversations)""",
)
def sentence_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", T.ends_with_terminator(c).alias("terminated"), T.is_sentence_end(c).alias("sentence_end"), T.spoken_chars(c).cast("long").alias("spoken"), T.is_punctuation_only(c).alias("only_marks")
    )


@query(
    "sentence_cuts",
    rf"""WITH p AS (SELECT doc_id, regexp_extract_all(text, '[^{T.TERMINATORS}]*[{T.TERMINATORS}]+[」』）)】〕》〉"”’]*|[^{T.TERMINATORS}]+$') AS raw FROM documents)
        SELECT doc_id, CAST(len(raw) - len(list_filter(raw[2:], lambda x: length(x) < 4)) AS BIGINT) AS n_pieces, CAST(length(array_to_string(raw, '')) AS BIGINT) AS chars FROM p""",
)
def sentence_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = T.sentence_pieces(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", pieces.alias("p")).select("doc_id", F.size("p").cast("long").alias("n_pieces"), F.length(F.array_join("p", "")).cast("long").alias("chars"))


@query(
    "abbreviation_dots",
    r"""WITH w AS (SELECT p_partkey, p_name || '.' AS s, regexp_extract(p_name || '.', '(\S+)\.\s*$', 1) AS w FROM part)
        SELECT p_partkey, length(w) > 0 AND ((length(w) = 1 AND upper(w) = w AND lower(w) <> w) OR lower(w) IN ('mr', 'mrs', 'ms', 'dr', 'prof', 'sr', 'jr', 'st', 'mt', 'no', 'vs', 'etc')) AS abbreviation,
        w IN ('」', ')') AS closing FROM w""",
)
def abbreviation_dots(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.concat("p_name", F.lit("."))
    return table(spark, sf_dir, "part").select("p_partkey", T.is_abbreviation(c).alias("abbreviation"), T.is_closing_mark(F.regexp_extract(c, r"(\S+)\.\s*$", 1)).alias("closing"))


@query(
    "edit_similarity",
    """SELECT a.p_partkey AS a, b.p_partkey AS b, CAST(levenshtein(a.p_name, b.p_name) AS BIGINT) AS edits,
        round(1 - levenshtein(a.p_name, b.p_name) / greatest(length(a.p_name), length(b.p_name)), 9) AS similarity
        FROM part a JOIN part b ON a.p_brand = b.p_brand AND a.p_size = b.p_size AND a.p_partkey < b.p_partkey""",
)
def edit_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.operators.matching import name_pairs

    pairs = name_pairs(table(spark, sf_dir, "part"), ["p_brand", "p_size"], "p_partkey", "p_name")
    return pairs.select("a", "b", F.col("edits").cast("long").alias("edits"), F.round("similarity", 9).alias("similarity"))


@query(
    "offset_slices",
    rf"""WITH c AS (SELECT item_id, text, list_filter(list_transform(range(1, length(text) + 1), lambda i: struct_pack(ch := substr(text, CAST(i AS INTEGER), 1), at := i - 1)), lambda p: regexp_matches(p.ch, '[{T.KEEP}]')) AS k FROM benchmark)
        SELECT item_id, CAST(len(k) AS BIGINT) AS kept, CAST(k[11].at AS BIGINT) AS first_at, substr(text, CAST(k[11].at + 1 AS INTEGER), CAST(k[30].at - k[11].at + 1 AS INTEGER)) AS slice FROM c""",
)
def offset_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "benchmark").withColumn("k", T.with_offsets(F.col("text")))
    return o.select("item_id", F.size("k").cast("long").alias("kept"), F.get("k", F.lit(10))["at"].cast("long").alias("first_at"), T.original_slice(F.col("text"), F.col("k"), F.lit(10), F.lit(30)).alias("slice"))


@query(
    "book_languages",
    """SELECT page_id, CASE WHEN p[1] = 'yue' OR (p[1] = 'zh' AND (list_contains(p, 'hk') OR list_contains(p, 'mo') OR list_contains(p, 'yue'))) THEN 'yue' WHEN p[1] = '' THEN NULL ELSE p[1] END AS language,
        regexp_replace(regexp_replace(replace(url, chr(92), '/'), '^.*/', ''), '[^A-Za-z0-9._-]+', '_', 'g') AS safe_name
        FROM (SELECT page_id, url, string_split(CASE page_id % 4 WHEN 0 THEN 'zh-hk' WHEN 1 THEN 'zh-cn' WHEN 2 THEN 'yue' ELSE regexp_extract(url, '/(..)/', 1) END, '-') AS p FROM pages)""",
)
def book_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 4
    tag = F.when(k == 0, "zh-HK").when(k == 1, "zh_CN").when(k == 2, "yue").otherwise(F.regexp_extract("url", "/(..)/", 1))
    return table(spark, sf_dir, "pages").select("page_id", T.book_language(tag).alias("language"), T.safe_name(F.col("url")).alias("safe_name"))


@query("unique_texts", "SELECT doc_id, length(text) >= 6 AND count(*) OVER (PARTITION BY text) = 1 AS is_unique, count(*) OVER (PARTITION BY text) AS copies FROM documents")
def unique_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequency by a digest of the text: sums are formed before the shuffle, so a hot text is one row per task."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("h"), F.length("text").alias("n"))
    counts = d.groupBy("h").agg(F.count("*").alias("copies"))
    return d.join(counts, "h").select("doc_id", ((F.col("n") >= 6) & (F.col("copies") == 1)).alias("is_unique"), "copies")


@query(
    "passage_exact",
    """SELECT item_id, doc_id, CAST(strpos(d.text, b.text) - 1 AS BIGINT) AS at FROM benchmark b JOIN documents d ON contains(d.text, b.text)""",
)
def passage_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where items stand in texts, seeded by each item's rarest four words."""
    from weftline.operators.matching import exact_passages

    return exact_passages(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


@query(
    "passage_votes",
    r"""WITH d AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) AS p, w FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents)),
        dg AS (SELECT doc_id, p, array_to_string(w[p : p + 3], ' ') AS g FROM d WHERE p + 3 <= len(w)),
        b AS (SELECT item_id, generate_subscripts(w, 1) AS p, w FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM benchmark)),
        bg AS (SELECT item_id, p, array_to_string(w[p : p + 3], ' ') AS g FROM b WHERE p + 3 <= len(w)),
        v AS (SELECT item_id, doc_id, dg.p - bg.p AS origin, count(*) AS votes FROM dg JOIN bg USING (g) GROUP BY ALL)
        SELECT item_id, doc_id, CAST(max(votes) AS BIGINT) AS votes FROM v WHERE votes >= 2 GROUP BY ALL""",
)
def passage_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.operators.matching import gram_votes

    return gram_votes(table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents"))


@query(
    "passage_dice",
    """WITH g AS (SELECT item_id, unnest(list_transform(range(1, length(t)), lambda i: substr(t, CAST(i AS INTEGER), 2))) AS g FROM (SELECT item_id, lower(text) AS t FROM benchmark)),
        c AS (SELECT item_id, g, count(*) AS n FROM g GROUP BY ALL), s AS (SELECT item_id, sum(n) AS total FROM c GROUP BY ALL)
        SELECT x.item_id AS a, y.item_id AS b, CAST(sum(least(x.n, y.n)) AS BIGINT) AS shared, round(2 * sum(least(x.n, y.n)) / (max(sx.total) + max(sy.total)), 9) AS dice
        FROM c x JOIN c y ON x.g = y.g AND x.item_id < y.item_id JOIN s sx ON sx.item_id = x.item_id JOIN s sy ON sy.item_id = y.item_id GROUP BY ALL HAVING 2 * sum(least(x.n, y.n)) >= 0.5 * (max(sx.total) + max(sy.total))""",
)
def passage_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dice of whole items."""
    from weftline.operators.matching import bigram_dice

    return bigram_dice(table(spark, sf_dir, "benchmark").select("item_id", F.lower("text").alias("t")), "item_id", "t", 0.5)
