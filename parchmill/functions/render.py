"""Terminal renderings of results as columns of lines; ``painted`` adds colours."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parchmill.functions.text import display_width, pad_display, truncate_display

# What empty results read.
NO_SKILLS, NO_SCHOOLS, NO_DETAILS, NOTHING = "  未提取到技能", "  未提取到教育经历", "(信息缺失)", "  (无)"
OMITTED = ("  … 其余 ", " 行已省略（使用 --full 查看全部）")
LEAST_WIDTH, MOST_WIDTH, USUAL_WIDTH = 40, 100, 80
SECTION, HEADER, STATUS = "▌", "◆", {"ok": "✔", "warn": "▲", "info": "·"}
COLOURS = {"bold": 1, "dim": 2, "red": 31, "green": 32, "yellow": 33, "blue": 34, "magenta": 35, "cyan": 36, "gray": 90}
# End of the fixed values.


def preview(text: Column, most: int, columns: int) -> Column:
    """lines: the first ``most`` with right-padded numbers, cut to ``columns``; omitted: how many
    more; note: the line that says so, null if none are."""
    every = F.split(text, "\n")
    digits = F.length(F.size(every).cast("string"))
    shown = F.transform(F.slice(every, 1, most), lambda line, k: F.concat(F.lit("  "), pad_display((k + 1).cast("string"), digits), F.lit(" │ "), truncate_display(line, columns)))
    omitted = F.greatest(F.size(every) - most, F.lit(0))
    note = F.when(omitted > 0, F.concat(F.lit(OMITTED[0]), omitted.cast("string"), F.lit(OMITTED[1])))
    return F.struct(shown.alias("lines"), omitted.alias("omitted"), note.alias("note"))


def skill_lines(skills: Column, columns: int) -> Column:
    """Skills, two blanks apart, folded greedily into lines of at most ``columns`` cells."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("line"))

    def put(acc: Column, skill: Column) -> Column:
        longer = F.when(acc["line"] == "", skill).otherwise(F.concat(acc["line"], F.lit("  "), skill))
        fits = display_width(longer) <= columns
        return F.struct(F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["line"]))).alias("done"), F.when(fits, longer).otherwise(skill).alias("line"))

    folded = F.aggregate(skills, start, put, lambda acc: F.when(acc["line"] == "", acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["line"]))))
    return F.when(F.size(skills) == 0, F.array(F.lit(NO_SKILLS))).otherwise(F.transform(folded, lambda x: F.concat(F.lit("  "), x)))


def school_lines(education: Column) -> Column:
    """One numbered line a school: the fields it has, then the time."""

    def line(e: Column, k: Column) -> Column:
        head = F.array_join(F.filter(F.array(e["school"], e["major"], e["degree"]), lambda x: x != ""), " · ")
        time = F.when(e["graduation_time"] != "", F.concat(F.lit("  "), e["graduation_time"])).otherwise("")
        return F.concat(F.lit("  "), (k + 1).cast("string"), F.lit(". "), F.when(head == "", NO_DETAILS).otherwise(head), time)

    return F.when(F.size(education) == 0, F.array(F.lit(NO_SCHOOLS))).otherwise(F.transform(education, line))


def facts(pairs: dict[str, Column]) -> Column:
    """Label and value lines, labels padded to the widest shown; null and empty values are left out."""
    every = F.array(*(F.struct(F.lit(k).alias("label"), v.cast("string").alias("value")) for k, v in pairs.items()))
    shown = F.filter(every, lambda p: p["value"] != "")
    wide = F.array_max(F.transform(shown, lambda p: display_width(p["label"])))
    listed = F.transform(shown, lambda p: F.concat(F.lit("  "), pad_display(p["label"], wide), F.lit("  "), p["value"]))
    return F.when(F.size(shown) == 0, F.array(F.lit(NOTHING))).otherwise(listed)


def content_width(columns: Column) -> Column:
    """The terminal's columns within limits; the usual number where they aren't known."""
    return F.least(F.lit(MOST_WIDTH), F.greatest(F.lit(LEAST_WIDTH), F.coalesce(columns, F.lit(USUAL_WIDTH))))


def divider(columns: Column, sign: str = "─") -> Column:
    return F.repeat(F.lit(sign), content_width(columns).cast("int"))


def section_title(title: Column) -> Column:
    return F.concat(F.lit(f"{SECTION} "), title)


def result_header(title: Column, subtitle: Column) -> Column:
    """Lines: an empty one, the title, and the subtitle if there is one."""
    head = F.array(F.lit(""), F.concat(F.lit(f"{HEADER} "), title))
    return F.when(F.coalesce(subtitle, F.lit("")) == "", head).otherwise(F.concat(head, F.array(F.concat(F.lit("  "), subtitle))))


def status_line(kind: Column, message: Column) -> Column:
    """A message behind the sign of its kind; kinds that aren't known read as info."""
    sign = F.when(kind == "ok", STATUS["ok"]).when(kind == "warn", STATUS["warn"]).otherwise(STATUS["info"])
    return F.concat(sign, F.lit(" "), message)


def painted(text: Column, colour: str) -> Column:
    """``text`` between the escape sequences of a colour."""
    return F.concat(F.lit(f"\x1b[{COLOURS[colour]}m"), text, F.lit("\x1b[0m"))
