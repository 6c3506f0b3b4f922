"""Subtitle and side-file formats, read and written with Column expressions.

Readers take one row per file (keys and its text) and give one row per cue, so
files spread over the cluster; a file itself must fit a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STAMP = r"^(?:(\d+):)?(\d{1,2}):(\d{1,2})([.,])(\d{1,3})$"
SRT_TIME = r"\d{2}:\d{2}:\d{2}[,.]\d{3}"
VTT_TIME = r"(?:\d{2,}:)?\d{2}:\d{2}[.,]\d{3}"
# Limits of the strict reader: bytes of a file, cues, characters of a cue and of all cues.
MAX_BYTES, MAX_CUES, MAX_CUE_CHARS, MAX_CHARS = 8 << 20, 20_000, 8192, 500_000


def stamp_ms(c: Column) -> Column:
    """Milliseconds of ``[H:]M:S.f`` with one to three digits of fraction; null if it is no stamp."""
    part = lambda k: F.regexp_extract(c, STAMP, k)
    hours = F.when(part(1) == "", "0").otherwise(part(1))
    ms = hours.cast("long") * 3_600_000 + part(2).cast("long") * 60_000 + part(3).cast("long") * 1000 + F.rpad(part(5), 3, "0").cast("long")
    return F.when(c.rlike(STAMP), ms)


def format_like(ms: Column, stamp: Column) -> Column:
    """Write ``ms`` in the layout of ``stamp``: its widths, its sign before the fraction, its digits of fraction (rounded)."""
    part = lambda k: F.regexp_extract(stamp, STAMP, k)
    digits = F.length(part(5))
    unit = F.pow(F.lit(10), 3 - digits).cast("long")
    t = (F.round(ms / unit) * unit).cast("long")
    pad = lambda v, k: F.lpad(v.cast("string"), F.greatest(F.length(part(k)), F.length(v.cast("string"))), F.lit("0"))
    div = lambda a, b: F.floor(a / b)
    hours = F.when((part(1) != "") | (t >= 3_600_000), F.concat(pad(div(t, 3_600_000), 1), F.lit(":"))).otherwise("")
    return F.concat(hours, pad(div(t, 60_000) % 60, 2), F.lit(":"), pad(div(t, 1000) % 60, 3), part(4), F.lpad(div(t % 1000, unit).cast("string"), digits, F.lit("0")))


def clock_time(ms: Column, sign: str) -> Column:
    """hh:mm:ss and milliseconds; a negative time is 0."""
    t = F.greatest(ms, F.lit(0)).cast("long")
    div = lambda a, b: F.floor(a / b)
    return F.format_string(f"%02d:%02d:%02d{sign}%03d", div(t, 3_600_000), div(t, 60_000) % 60, div(t, 1000) % 60, t % 1000)


def _numbered(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("wl_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def _joined(df: DataFrame, keys: list[str], block: Column, name: str, between: str, head: str = "", tail: str = "") -> DataFrame:
    rows = df.select(*keys, "wl_k", block.alias("wl_b")).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("wl_k", "wl_b"))).alias("wl_all"))
    return rows.select(*keys, F.size("wl_all").cast("long").alias("n"), F.concat(F.lit(head), F.array_join(F.col("wl_all.wl_b"), between), F.lit(tail)).alias(name))


def render_srt(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, n, srt): cues of start_ms, end_ms, text renumbered in order."""
    block = F.concat(F.col("wl_k").cast("string"), F.lit("\n"), clock_time(F.col("start_ms"), ","), F.lit(" --> "), clock_time(F.col("end_ms"), ","), F.lit("\n"), F.col("text"), F.lit("\n"))
    return _joined(_numbered(df, keys, order), keys, block, "srt", "\n")


def render_cue_srt(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """As ``render_srt`` without empty texts, line breaks inside a text as spaces."""
    text = F.trim(F.regexp_replace("text", r"\s*[\r\n]+\s*", " "))
    return render_srt(df.withColumn("text", text).where("text <> ''"), keys, order)


def render_vtt(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    block = F.concat(clock_time(F.col("start_ms"), "."), F.lit(" --> "), clock_time(F.col("end_ms"), "."), F.lit("\n"), F.col("text"), F.lit("\n"))
    return _joined(_numbered(df, keys, order), keys, block, "vtt", "\n", "WEBVTT\n\n")


def render_json(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    block = F.to_json(F.struct(F.col("wl_k").alias("index"), F.col("start_ms").alias("startMs"), F.col("end_ms").alias("endMs"), "text"))
    return _joined(_numbered(df, keys, order), keys, block, "json", ",", '{"cues":[', "]}")


def _blocks(text: Column) -> Column:
    """Pieces of a file between blank lines, BOM and carriage returns gone."""
    plain = F.regexp_replace(F.regexp_replace(text, "^\ufeff", ""), "\r\n?", "\n")
    return F.filter(F.split(plain, r"\n(?:[ \t]*\n)+"), lambda b: ~b.rlike(r"^\s*$"))


def parse_srt(files: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, index, start_ms, end_ms, text): lenient. In a block the first time line counts, a number just above it is its index, the rest its text; blocks without a time line are dropped."""
    shape = rf"(?s)^(?:(.*?)\n)??({SRT_TIME})[ \t]*-->[ \t]*({SRT_TIME})[^\n]*(?:\n(.*))?$"
    b = files.select(*keys, F.posexplode(_blocks(F.col(text))).alias("wl_at", "wl_b")).withColumn("wl_b", F.regexp_replace("wl_b", r"^\n+|\s+$", "")).where(F.col("wl_b").rlike(shape))
    part = lambda k: F.regexp_extract("wl_b", shape, k)
    given = F.regexp_extract(part(1), r"(?:^|\n)\s*(\d{1,9})\s*$", 1)
    w = Window.partitionBy(*keys).orderBy("wl_at")
    rows = b.select(*keys, F.when(given != "", given).cast("int").alias("wl_given"), F.row_number().over(w).alias("wl_n"), stamp_ms(part(2)).alias("start_ms"), stamp_ms(part(3)).alias("end_ms"), part(4).alias("text"), "wl_at")
    # a cue without a number goes on from the last one that has it
    base = F.last(F.when(F.col("wl_given").isNotNull(), F.col("wl_given") - F.col("wl_n")), True).over(w)
    return rows.withColumn("index", F.coalesce("wl_given", F.col("wl_n") + F.coalesce(base, F.lit(0)))).select(*keys, "index", "start_ms", "end_ms", "text")


def parse_strict(files: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, start_ms, end_ms, text, fault): SRT or WebVTT; the first fault found, by name, stands on every row of its file (and a file without cues is one row)."""
    t = F.col(text)
    vtt = F.regexp_replace(t, "^\ufeff", "").rlike(r"^WEBVTT(?:[ \t\n\r]|$)")
    shape = rf"(?s)^(?:[^\n]*\n)?({VTT_TIME})[ \t]+-->[ \t]+({VTT_TIME})((?:[ \t]+[^\n]*)?)(?:\n(.*))?$"
    blocks = F.transform(_blocks(t), lambda b: F.regexp_replace(b, r"^\n+|\s+$", ""))
    blocks = F.filter(blocks, lambda b: ~(vtt & b.rlike(r"^(?:WEBVTT|NOTE|STYLE|REGION)(?:[ \t\n]|$)")))
    rows = files.select(*keys, t.alias("wl_t"), vtt.alias("wl_vtt"), F.posexplode_outer(blocks).alias("wl_at", "wl_b"))
    part = lambda k: F.regexp_extract("wl_b", shape, k)
    start, end = stamp_ms(part(1)), stamp_ms(part(2))
    late = lambda c: c.rlike(r"(?:^|:)[6-9]\d:\d\d[.,]|:[6-9]\d[.,]")
    fault = (
        F.when(F.octet_length("wl_t") > MAX_BYTES, "too many bytes").when(F.col("wl_t").contains("\x00"), "holds NUL").when(F.col("wl_b").isNull(), "no cues").when(~F.col("wl_b").rlike(shape), "not a cue")
        .when(F.col("wl_vtt") & ~part(3).rlike(r"^(?:[ \t]+[a-z]+:[^ \t:]+)*[ \t]*$"), "bad settings").when(late(part(1)) | late(part(2)), "bad time").when(end <= start, "ends before it starts")
        .when(part(4) == "", "empty cue").when(F.length(part(4)) > MAX_CUE_CHARS, "cue too long")
    )
    cues = rows.select(*keys, start.alias("start_ms"), end.alias("end_ms"), part(4).alias("text"), fault.alias("wl_fault"))
    file = Window.partitionBy(*keys)
    many = F.when(F.count("*").over(file) > MAX_CUES, "too many cues").when(F.sum(F.length("text")).over(file) > MAX_CHARS, "too many characters")
    return cues.select(*keys, "start_ms", "end_ms", "text", F.coalesce(F.min("wl_fault").over(file), many).alias("fault"))


def scan_ass(files: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """(keys, line, kind, start_ms, end_ms, text, alignable): events of ASS scripts; the Format line says the order of columns; text keeps its commas.

    Alignable: a dialogue of 250 ms or more that shows something (override blocks and drawings do not).
    """
    lines = files.select(*keys, F.posexplode(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n")).alias("line", "l"))
    so_far = Window.partitionBy(*keys).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    section = F.last(F.when(F.col("l").rlike(r"^\s*\[.*\]\s*$"), F.lower(F.trim("l"))), True).over(so_far)
    lines = lines.withColumn("section", section).where("section = '[events]'")
    order = F.last(F.when(F.col("l").rlike(r"^\s*(?i:format)\s*:"), F.transform(F.split(F.lower(F.regexp_extract("l", r":(.*)$", 1)), ","), lambda x: F.trim(x))), True).over(so_far)
    events = lines.withColumn("cols", order).where(F.col("cols").isNotNull() & F.col("l").rlike(r"^\s*(?i:dialogue|comment)\s*:"))
    values = F.split(F.regexp_extract("l", r"^[^:]*:(.*)$", 1), ",", F.size("cols"))
    get = lambda name: F.get(F.col("v"), (F.array_position("cols", name) - 1).cast("int"))
    out = events.withColumn("v", values).select(
        *keys, "line", F.lower(F.regexp_extract("l", r"^\s*(\w+)", 1)).alias("kind"), stamp_ms(F.trim(get("start"))).alias("start_ms"), stamp_ms(F.trim(get("end"))).alias("end_ms"), get("text").alias("text")
    )
    shown = F.regexp_replace(F.regexp_replace("text", r"\{[^}]*\\p[1-9][^}]*\}[^{]*", ""), r"\{[^}]*\}|\\[Nnh]", "")
    return out.withColumn("alignable", (F.col("kind") == "dialogue") & (F.col("end_ms") - F.col("start_ms") >= 250) & (F.trim(shown) != ""))


def parse_speaker_stream(files: DataFrame, keys: list[str], raw: str, chunk: Column, offset: Column | None = None) -> DataFrame:
    """(keys, start_ms, end_ms, speaker, text) of ``[s][Sxx]text[e]`` repeated: at least 0.2 s long, speakers named by chunk, empty texts dropped."""
    shape = r"\[(\d+(?:\.\d+)?)\]\[(S\d+)\]([^\[\]]*)\[(\d+(?:\.\d+)?)\]"
    parts = F.arrays_zip(*(F.regexp_extract_all(raw, F.lit(shape), F.lit(k)).alias(f"p{k}") for k in (1, 2, 3, 4)))
    rows = files.select(*keys, chunk.cast("string").alias("wl_chunk"), (offset if offset is not None else F.lit(0)).alias("wl_off"), F.explode(parts).alias("p"))
    ms = lambda k: F.round(F.col(f"p.p{k}").cast("double") * 1000).cast("long") + F.col("wl_off")
    out = rows.select(*keys, ms(1).alias("start_ms"), F.greatest(ms(4), ms(1) + 200).alias("end_ms"), F.concat_ws(":", "wl_chunk", "p.p2").alias("speaker"), F.trim("p.p3").alias("text"))
    return out.where("text <> ''")


def token_lines(lines: DataFrame, keys: list[str], line: str) -> DataFrame:
    """Token sidecars ``{"t", "o", "e"?}``: adds t, o, e and valid; one bad line of a file (no object, lengths that differ) makes all its lines invalid."""
    shape = "t array<string>, o array<bigint>, e array<bigint>"
    x = lines.withColumn("wl_x", F.from_json(line, shape, {"mode": "PERMISSIVE"}))
    ok = F.col("wl_x.t").isNotNull() & F.col("wl_x.o").isNotNull() & (F.size("wl_x.t") == F.size("wl_x.o")) & (F.col("wl_x.e").isNull() | (F.size("wl_x.e") == F.size("wl_x.t")))
    x = x.withColumn("valid", F.every(F.coalesce(ok, F.lit(False))).over(Window.partitionBy(*keys)))
    return x.select("*", *(F.when(F.col("valid"), F.col(f"wl_x.{c}")).alias(c) for c in "toe")).drop("wl_x")


def attach_tokens(cues: DataFrame, tokens: DataFrame, keys: list[str], order: list[str], line: str) -> DataFrame:
    """Give the k-th cue of a file its k-th token row, if the file has as many of both; else none gets any."""
    k = lambda df, by: df.withColumns({"wl_k": F.row_number().over(Window.partitionBy(*keys).orderBy(*by)), "wl_n": F.count("*").over(Window.partitionBy(*keys))})
    return k(cues, order).join(k(tokens, [line]).select(*keys, "wl_k", "wl_n", "t", "o", "e"), [*keys, "wl_k", "wl_n"], "left").drop("wl_k", "wl_n")


def probe_ms(c: Column) -> Column:
    """Duration in a prober's JSON, in milliseconds."""
    return F.floor(F.get_json_object(c, "$.format.duration").cast("double") * 1000 + 1e-6)


def banner_ms(c: Column) -> Column:
    """Duration in a decoder's banner, in milliseconds."""
    part = lambda k: F.regexp_extract(c, r"Duration: (\d+):(\d{2}):(\d{2})\.(\d+)", k)
    ms = part(1).cast("long") * 3_600_000 + part(2).cast("long") * 60_000 + part(3).cast("long") * 1000 + F.rpad(F.substring(part(4), 1, 3), 3, "0").cast("long")
    return F.when(c.rlike(r"Duration: \d+:\d{2}:\d{2}\.\d+"), ms)


def sniff_charset(content: Column) -> Column:
    """UTF-16 by its mark or by zeros in one half of the first bytes, else bytes as they are (Latin-1)."""
    head = F.hex(F.substring(content, 1, 64))
    pairs = F.regexp_extract_all(head, F.lit("(.{4})"), F.lit(1))
    low, high = F.size(F.filter(pairs, lambda p: p.rlike("^00(?!00)"))), F.size(F.filter(pairs, lambda p: p.rlike("^(?!00)..00")))
    return F.when(head.startswith("FFFE"), "UTF-16LE").when(head.startswith("FEFF"), "UTF-16BE").when((high > 0) & (high * 2 >= F.size(pairs)), "UTF-16LE").when((low > 0) & (low * 2 >= F.size(pairs)), "UTF-16BE").otherwise("ISO-8859-1")


def decode_file(content: Column) -> Column:
    charset = sniff_charset(content)
    return F.when(charset == "UTF-16LE", F.decode(content, "UTF-16LE")).when(charset == "UTF-16BE", F.decode(content, "UTF-16BE")).otherwise(F.decode(content, "ISO-8859-1"))


def token_table(lines: DataFrame, line: str = "value") -> DataFrame:
    """(id, token, is_special, byte_value) of ``token<tab or space>id`` lines, the last separator counting."""
    tab = rf"^(.*)\t(\d+)\s*$"
    shape = F.when(F.col(line).rlike(tab), F.array(F.regexp_extract(line, tab, 1), F.regexp_extract(line, tab, 2))).otherwise(F.array(F.regexp_extract(line, r"^(.*) (\d+)\s*$", 1), F.regexp_extract(line, r"^(.*) (\d+)\s*$", 2)))
    t = lines.where(F.col(line).rlike(r"[\t ]\d+\s*$")).select(shape.alias("p")).select(F.col("p")[1].cast("int").alias("id"), F.col("p")[0].alias("token"))
    byte = F.regexp_extract("token", r"^<0x([0-9A-Fa-f]{2})>$", 1)
    return t.select("id", "token", F.col("token").rlike(r"^(<(blk|blank|unk|eps|s|/s|pad|sos/eos)>|\[PAD\]|\[UNK\]|\|)$").alias("is_special"), F.when(byte != "", F.conv(byte, 16, 10).cast("int")).alias("byte_value"))


def model_registry(files: DataFrame, text: str = "text") -> DataFrame:
    """(id, architecture, languages, files, total_bytes, fault) of registry documents: a list, or an object with packs; absent fields get their defaults; a CTC pack must name its blank."""
    pack = "struct<id:string,architecture:string,languages:array<string>,profile:string,blankToken:string,files:array<struct<name:string,bytes:bigint,required:boolean>>>"
    t = F.trim(text)
    packs = F.when(t.startswith("["), F.from_json(t, f"array<{pack}>")).otherwise(F.from_json(t, f"packs array<{pack}>")["packs"])
    p = files.select(F.explode(packs).alias("p")).select("p.*")
    need = F.filter(F.coalesce("files", F.array().cast("array<struct<name:string,bytes:bigint,required:boolean>>")), lambda f: F.coalesce(f["required"], F.lit(True)))
    total = F.aggregate(need, F.lit(0).cast("long"), lambda a, f: a + F.coalesce(f["bytes"], F.lit(0)))
    fault = F.when(F.col("id").isNull(), "no id").when(F.lower("architecture").contains("ctc") & F.col("blankToken").isNull(), "no blank token")
    return p.select("id", F.coalesce("architecture", F.lit("transducer")).alias("architecture"), F.coalesce("languages", F.array().cast("array<string>")).alias("languages"), F.coalesce("profile", F.lit("mixed")).alias("profile"), total.alias("total_bytes"), fault.alias("fault"))
