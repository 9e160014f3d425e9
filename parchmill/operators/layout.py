"""Lines of a page from positioned text runs: folds over arrays, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parchmill.functions.text import blank

# The layout rule's factors and character set.
LINE_SHIFT, SPACE_GAP, DEFAULT_SIZE = 0.5, 0.28, 10.0
CJK = "[\u3000-\u303f\u4e00-\u9fff\uff00-\uffef]"
# End of the fixed values.

PART = "struct<x:double,seq:int,width:double,size:double,str:string>"


def _or(c: Column, other: Column) -> Column:
    """ECMAScript's ||: null and 0 give way."""
    return F.when(c.isNull() | (c == 0), other).otherwise(c)


def lines(items: Column) -> Column:
    """Text of each line of a page: array<struct<seq,x,y,width,height,scale,has_eol,str>> in.

    A line ends where a run says so or lies more than half its size off the line's first run.
    Runs are ordered by x; a gap above 0.28 of the larger size is a space, but not between two
    CJK characters."""
    runs = F.array_sort(F.transform(F.filter(items, lambda i: i["str"].isNotNull()), lambda i: F.struct(i["seq"].alias("seq"), i.alias("run"))))
    empty = F.array().cast(f"array<struct<y:double,parts:array<{PART}>>>")

    def place(acc: Column, r: Column) -> Column:
        i = r["run"]
        size = F.abs(_or(i["height"], _or(i["scale"], F.lit(DEFAULT_SIZE))))
        part = F.struct(i["x"].cast("double").alias("x"), i["seq"].cast("int").alias("seq"), F.coalesce(i["width"], F.lit(0.0)).cast("double").alias("width"), size.cast("double").alias("size"), i["str"].alias("str"))
        parts = F.when(i["str"] != "", F.array(part)).otherwise(F.array().cast(f"array<{PART}>"))
        last = F.element_at(acc, -1)
        fresh = (F.size(acc) == 0) | (i["has_eol"] & (F.size(last["parts"]) > 0)) | (F.abs(i["y"] - last["y"]) > size * LINE_SHIFT)
        opened = F.concat(acc, F.array(F.struct(i["y"].cast("double").alias("y"), parts.alias("parts"))))
        grown = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(last["y"].alias("y"), F.concat(last["parts"], parts).alias("parts"))))
        return F.when(fresh, opened).otherwise(grown)

    placed = F.aggregate(runs, empty, place)
    none = F.struct(F.lit("").alias("text"), F.lit(None).cast(PART).alias("last"))

    def join(acc: Column, p: Column) -> Column:
        last = acc["last"]
        gap = p["x"] - (last["x"] + last["width"])
        both = F.right(last["str"], F.lit(1)).rlike(CJK) & F.left(p["str"], F.lit(1)).rlike(CJK)
        space = F.when(last.isNotNull() & (gap > F.greatest(last["size"], p["size"]) * SPACE_GAP) & ~both, " ").otherwise("")
        return F.struct(F.concat(acc["text"], space, p["str"]).alias("text"), p.cast(PART).alias("last"))

    text = F.transform(placed, lambda line: F.aggregate(F.array_sort(line["parts"]), none, join)["text"])
    return F.filter(text, lambda x: ~blank(x))
