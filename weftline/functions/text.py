"""Text functions on cues as Column expressions; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that carry speech (digits, Latin letters, kana, Han), as a regular expression class.
KEEP = (
    r"0-9A-Za-z\x{3005}-\x{3007}\x{3041}-\x{3096}\x{309D}-\x{309F}\x{30A1}-\x{30FA}\x{30FC}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{25CB}\x{25EF}\x{303B}"
    r"\x{2E80}-\x{2EFF}\x{2F00}-\x{2FDF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2EBE0}\x{2F800}-\x{2FA1F}\x{30000}-\x{323AF}"
    r"\x{FF10}-\x{FF19}\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}\x{FF66}-\x{FF9D}"
)
# Half-width katakana U+FF66..U+FF9D in full width, in order.
HALF_KATAKANA = "ヲァィゥェォャュョッーアイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワン"
# Sentence ends, closing marks, abbreviations, ends that stop a merge, characters counted as spoken (as KEEP), text of marks only.
TERMINATORS = "。！？!?…‥．."
CLOSING = "」』）)】〕》〉\"”’"
ABBREVIATIONS = ("mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "mt", "no", "vs", "etc")
MERGE_TERMINATORS = "。！？!?」』）)】〕〉》"
SPOKEN = (
    r"0-9A-Za-z\x{3041}-\x{309A}\x{309D}-\x{309F}\x{30A1}-\x{30FA}\x{30FC}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}"
    r"\x{FF10}-\x{FF19}\x{FF21}-\x{FF3A}\x{FF41}-\x{FF5A}\x{FF66}-\x{FF9D}\x{20000}-\x{2FFFF}"
)
PUNCT_ONLY = r"^[\s、。！？!?…‥．.,，「」『』（）()【】〔〕《》〈〉\"”’・ー〜~\-]*$"


def _fold_table() -> tuple[str, str]:
    """Every character that folds, and what it folds to: full-width ASCII to ASCII, A-Z to a-z, katakana to hiragana."""
    hira = lambda c: chr(ord(c) - 0x60) if "ァ" <= c <= "ヶ" else c
    pairs = {chr(c): chr(c + 32) for c in range(0x41, 0x5B)}
    pairs |= {chr(c): chr(c - 0xFEE0).lower() for c in range(0xFF01, 0xFF5F)}
    pairs |= {chr(0xFF66 + k): hira(c) for k, c in enumerate(HALF_KATAKANA)}
    pairs |= {chr(c): chr(c - 0x60) for c in range(0x30A1, 0x30F7)}
    return "".join(pairs), "".join(pairs.values())


FOLD_FROM, FOLD_TO = _fold_table()


def fold(c: Column) -> Column:
    return F.translate(c, FOLD_FROM, FOLD_TO)


def normalize_book(c: Column) -> Column:
    """Speech characters only, folded; everything else goes."""
    return fold(F.regexp_replace(c, f"[^{KEEP}]", ""))


def normalize_timeline(c: Column) -> Column:
    """Markup and entities resolved, lower case, folded, letters, digits and marks of every script kept."""
    plain = F.regexp_replace(c, r"<[^>]*>|\{[^}]*\}", "")
    for entity, sign in (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        plain = F.replace(plain, F.lit(entity), F.lit(sign))
    return fold(F.regexp_replace(F.lower(plain), rf"[^{KEEP}\p{{L}}\p{{N}}\p{{M}}]", ""))


def speech_text(c: Column) -> Column:
    """Caption without markup, leading full-width labels, music captions and music-only lines."""
    plain = F.regexp_replace(c, "\r\n|\r|(?i:<br[ \t\n]*/?>)", "\n")
    plain = F.replace(F.regexp_replace(plain, r"<[^<>]*>|\{\\[^{}]*\}", ""), F.lit("&nbsp;"), F.lit(" "))
    lines = F.transform(F.split(plain, "\n"), lambda x: F.regexp_replace(x, r"^[\s\x{3000}]+|[\s\x{3000}]+$", ""))
    # fixed values: words and signs of captions that say only that there is music
    lines = F.filter(lines, lambda x: ~x.rlike(r"^[\s♪♫♬♩~～〜]*（(?i:音楽|BGM|ＢＧＭ|前奏|間奏|後奏)）[\s♪♫♬♩~～〜]*$"))
    lines = F.transform(lines, lambda x: F.regexp_replace(x, r"^(（[^（）\n]+）[\s\x{3000}]*)+", ""))
    return F.array_join(F.filter(lines, lambda x: ~x.rlike(r"^[\s♪♫♬♩~～〜…・.]*$")), "\n")


def full_width_marks(c: Column) -> Column:
    return F.translate(c, "!?", "！？")


def collapse_spaces(c: Column) -> Column:
    """Edges dropped; an inner run is one space if neither neighbour is CJK, else nothing."""
    cjk = r"[\x{3000}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}]"
    c = F.regexp_replace(c, r"^\s+|\s+$", "")
    return F.regexp_replace(F.regexp_replace(c, rf"(?<={cjk})\s+|\s+(?={cjk})", ""), r"\s+", " ")


def ends_with_terminator(c: Column) -> Column:
    return c.rlike(rf"[{TERMINATORS}]\s*$")


def is_closing_mark(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "").rlike(r"^[」』）)】〕》〉\"”’]$")


def is_abbreviation(c: Column) -> Column:
    """The text so far ends in a dot that is part of a title or an initial."""
    word = F.regexp_extract(c, r"(\S+)\.\s*$", 1)
    initial = (F.length(word) == 1) & (F.upper(word) == word) & (F.lower(word) != word)
    return (F.length(word) > 0) & (initial | F.lower(word).isin(*ABBREVIATIONS))


def is_sentence_end(c: Column) -> Column:
    """Empty, or the last sign ends a sentence; a dot after a Latin letter is an abbreviation's."""
    t = F.regexp_replace(c, r"[\s\x{3000}]+$", "")
    return (t == "") | t.rlike(rf"[{MERGE_TERMINATORS}]$") | (t.rlike(r"[．.]$") & ~t.rlike(r"[A-Za-zＡ-Ｚａ-ｚ][．.]$"))


def spoken_chars(c: Column) -> Column:
    return F.length(F.regexp_replace(c, f"[^{SPOKEN}]", ""))


def is_punctuation_only(c: Column) -> Column:
    return c.rlike(PUNCT_ONLY)


def sentence_pieces(c: Column, least: int = 4) -> Column:
    """Pieces ending after terminators and closing marks; a piece shorter than ``least`` joins the one before."""
    raw = F.regexp_extract_all(c, F.lit(rf"[^{TERMINATORS}]*[{TERMINATORS}]+[」』）)】〕》〉\"”’]*|[^{TERMINATORS}]+$"), F.lit(0))

    def join(acc: Column, x: Column) -> Column:
        head = F.slice(acc, 1, F.size(acc) - 1)
        return F.when((F.size(acc) > 0) & (F.length(x) < least), F.concat(head, F.array(F.concat(F.element_at(acc, -1), x)))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(raw, F.array().cast("array<string>"), join)


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; two empty texts are alike."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def with_offsets(c: Column) -> Column:
    """Each character that normalising keeps, with its place in the text: array of (ch, at)."""
    chars = F.filter(F.transform(F.split(c, ""), lambda x, i: F.struct(x.alias("ch"), i.alias("at"))), lambda p: p["ch"] != "")
    kept = F.filter(chars, lambda p: p["ch"].rlike(f"[{KEEP}]"))
    return F.transform(kept, lambda p: F.struct(fold(p["ch"]).alias("ch"), p["at"].alias("at")))


def original_slice(text: Column, offsets: Column, start: Column, end: Column) -> Column:
    """The source text of normalised characters [start, end); empty for an empty or outlying range."""
    first, last = F.get(offsets, start)["at"], F.get(offsets, end - 1)["at"]
    return F.when((end > start) & (start >= 0) & (end <= F.size(offsets)), F.substr(text, first + 1, last - first + 1)).otherwise("")


def book_language(c: Column) -> Column:
    """Language of a BCP 47 tag; Chinese of Hong Kong, Macau or marked yue is Cantonese."""
    parts = F.split(F.lower(F.translate(c, "_", "-")), "-")
    primary = F.get(parts, F.lit(0))
    yue = (primary == "yue") | ((primary == "zh") & (F.array_contains(parts, "hk") | F.array_contains(parts, "mo") | F.array_contains(parts, "yue")))
    return F.when(yue, "yue").when(primary == "", None).otherwise(primary)


def safe_name(c: Column) -> Column:
    """Path parts and odd signs out of a file name."""
    return F.regexp_replace(F.substring_index(F.translate(c, "\\", "/"), "/", -1), r"[^A-Za-z0-9._-]+", "_")
