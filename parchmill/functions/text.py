"""Text columns: ECMAScript-compatible basics, artefact repair and normalisation, display widths.

Everything here is a native expression.  White space is the ECMAScript set, lengths count code
points (``utf16_length`` counts UTF-16 units)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parchmill.functions.lexicon import compat_table

# Character sets that results depend on.
SPACE_SET = "\t\n\x0b\x0c\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
INVISIBLE = "\u00ad\u200b\u200c\u200d\ufeff"
NARROW = "\u00a0\u2000-\u200a\u202f\u205f\u3000"
LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl"}
COMPAT_SET = "\u2e80-\u2fdf\uf900-\ufaff\uff01-\uff5e\uff66-\uffdc"
ZERO_WIDTH = "\u0300-\u036f\u200b-\u200f\ufe00-\ufe0f\ufe20-\ufe2f\U0001f3fb-\U0001f3ff"
WIDE = "\u1100-\u115f\u2329\u232a\u2e80-\u303e\u3040-\ua4cf\uac00-\ud7a3\uf900-\ufaff\ufe30-\ufe6f\uff00-\uff60\uffe0-\uffe6\U0001f300-\U0001f64f\U0001f680-\U0001f6ff\U0001f900-\U0001f9ff\U0001fa70-\U0001faff\U00020000-\U0003fffd"
ANSI = "\x1b\\[[0-9;]*m"
CUT_BEFORE = "\n\n[注意：原文共 "
CUT_AFTER = " 字符，因超出单次请求上限，以上仅为前 {} 字符，其余内容已被截断。请只依据已给出的内容作答，不要推测或补全被截断的部分。]"
# End of the fixed values.

SPACE = f"[{SPACE_SET}]"
NARROW_ONLY = r"^[\x20-\x7e\u00a1-\u00ac\u00ae-\u02ff]*\z"
COMPAT_FROM, COMPAT_TO = compat_table()


def trim(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, rf"^{SPACE}+|{SPACE}+\z", "")


def blank(c: Column) -> Column:
    return trim(c) == ""


def utf16_length(c: Column) -> Column:
    return F.length(c) + F.length(F.regexp_replace(c, "[^\U00010000-\U0010ffff]", ""))


def round1(c: Column) -> Column:
    """One decimal, halves upwards (not Spark's ``round``, which differs in its last bit)."""
    return F.floor(c * 10 + F.lit(0.5)) / F.lit(10.0)


def number_text(c: Column) -> Column:
    """A double as ECMAScript prints it: 100, 42.9."""
    return F.regexp_replace(c.cast("string"), r"\.0$", "")


def repair_artifacts(c: Column) -> Column:
    """Invisible signs gone, odd blanks plain, ligatures as letters; texts without any pass one test."""
    out = F.regexp_replace(F.regexp_replace(c, f"[{INVISIBLE}]", ""), f"[{NARROW}]", " ")
    for sign, letters in LIGATURES.items():
        out = F.replace(out, F.lit(sign), F.lit(letters))
    return F.when(c.rlike(f"[{INVISIBLE}{NARROW}{''.join(LIGATURES)}]"), out).otherwise(c)


def fold_compat(c: Column) -> Column:
    """Radicals, compatibility ideographs, full-width ASCII and half-width kana folded."""
    return F.when(needs_folding(c), F.translate(c, COMPAT_FROM, COMPAT_TO)).otherwise(c)


def needs_folding(c: Column) -> Column:
    return c.rlike(f"[{COMPAT_SET}]")


def normalize_space(c: Column) -> Column:
    c = F.regexp_replace(c, "[ \t]+", " ")
    c = F.regexp_replace(c, " ?\n ?", "\n")
    return trim(F.regexp_replace(c, "\n{3,}", "\n\n"))


def clean(c: Column) -> Column:
    return normalize_space(fold_compat(repair_artifacts(c)))


def snippet(c: Column, size: int) -> Column:
    return F.regexp_replace(F.left(c, F.lit(size)), f"{SPACE}+", " ")


def display_width(c: Column) -> Column:
    """Terminal cells: escape sequences and combining marks 0, wide characters 2, others 1."""
    plain = F.regexp_replace(F.regexp_replace(c, ANSI, ""), f"[{ZERO_WIDTH}]", "")
    return F.length(plain) + F.length(F.regexp_replace(plain, f"[^{WIDE}]", ""))


def pad_display(c: Column, width: int | Column) -> Column:
    return F.concat(c, F.repeat(F.lit(" "), F.greatest(F.lit(0), (F.lit(width) if isinstance(width, int) else width) - display_width(c))))


def truncate_display(c: Column, width: int) -> Column:
    """The longest prefix one cell short of ``width`` and an ellipsis, if the text is too wide."""
    chars = F.split(c, "")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("used"), F.lit(False).alias("full"))

    def step(acc: Column, char: Column) -> Column:
        size = display_width(char)
        full = acc["full"] | (acc["used"] + size > width - 1)
        return F.struct(F.when(full, acc["out"]).otherwise(F.concat(acc["out"], char)).alias("out"), F.when(full, acc["used"]).otherwise(acc["used"] + size).alias("used"), full.alias("full"))

    # Texts of one cell a character need no fold.
    narrow = F.when(F.length(c) <= width, c).otherwise(F.concat(F.left(c, F.lit(width - 1)), F.lit("…")))
    folded = F.when(display_width(c) <= width, c).otherwise(F.concat(F.aggregate(chars, start, step)["out"], F.lit("…")))
    return F.when(c.rlike(NARROW_ONLY), narrow).otherwise(folded)


def score_bar(label: Column, score: Column, segments: int = 20) -> Column:
    """Label, bar and value as plain text."""
    value = F.when(F.isnan(score) | F.isnull(score) | (F.abs(score) == float("inf")), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score)))
    filled = F.floor(value / 100 * segments + 0.5).cast("int")
    bar = F.concat(F.repeat(F.lit("█"), filled), F.repeat(F.lit("░"), segments - filled))
    return F.concat(F.lit("  "), pad_display(label, F.greatest(display_width(label), F.lit(12))), F.lit("  "), bar, F.lit("  "), F.format_string("%.1f", value))


def score_band(score: Column) -> Column:
    return F.when(score >= 80, "green").when(score >= 60, "yellow").otherwise("red")


def format_bytes(c: Column) -> Column:
    kb, mb = c / 1024, c / 1024 / 1024
    return F.when(c < 1024, F.concat(c.cast("string"), F.lit(" B"))).when(c < 1024 * 1024, F.concat(F.format_string("%.1f", kb), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.1f", mb), F.lit(" MB")))


def positive_int(c: Column) -> Column:
    """The number a text holds if it is a whole number above 0 and below 2**53, else null."""
    t = trim(c)
    n = F.when(t.rlike(r"^[+-]?[0-9]+\z"), t.try_cast("bigint"))
    return F.when((n > 0) & (n < 2**53), n)


def mask_key(c: Column) -> Column:
    return F.when(F.length(c) > 8, F.concat(F.left(c, F.lit(4)), F.lit("****"), F.right(c, F.lit(4)))).otherwise(F.lit("****"))


def base_url(c: Column) -> Column:
    return F.regexp_replace(c, r"/+\z", "")


def clamp_input(c: Column, limit: int) -> Column:
    """text (cut at ``limit`` code points, with a note), original_chars, used_chars, truncated."""
    size = F.length(c)
    cut = size > limit
    note = F.concat(F.lit(CUT_BEFORE), size.cast("string"), F.lit(CUT_AFTER.format(limit)))
    return F.struct(
        F.when(cut, F.concat(F.left(c, F.lit(limit)), note)).otherwise(c).alias("text"), size.alias("original_chars"), F.when(cut, F.lit(limit)).otherwise(size).alias("used_chars"), cut.alias("truncated")
    )


def dotenv(c: Column) -> Column:
    """KEY=value lines as a map; the last of a key wins, one pair of quotes is taken off.  A
    session needs ``spark.sql.mapKeyDedupPolicy=LAST_WIN`` only for other code: duplicates are
    resolved here."""
    lines = F.filter(F.transform(F.split(c, "\r?\n"), trim), lambda x: (x != "") & ~x.startswith("#") & (F.instr(x, "=") > 1))
    pairs = F.transform(lines, lambda x: _pair(F.regexp_replace(x, rf"^export{SPACE}+", "")))
    last = F.aggregate(pairs, F.array().cast("array<struct<key:string,value:string>>"), lambda acc, p: F.concat(F.filter(acc, lambda q: q["key"] != p["key"]), F.array(p)))
    return F.map_from_entries(last)


def _pair(line: Column) -> Column:
    at = F.instr(line, "=")
    value = trim(F.substring(line, at + 1, F.length(line)))
    bare = F.when(value.rlike("(?s)^(\".*\"|'.*')\\z") & (F.length(value) >= 2), F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value)
    return F.struct(trim(F.substring(line, F.lit(1), at - 1)).alias("key"), bare.alias("value"))
