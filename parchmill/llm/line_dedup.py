"""Operator 9: line dedup by site-relative frequency.

Documents are grouped by host (any column, or the host of a URL).  For each (host, line) the
pages that contain the line are counted and divided by the host's pages; lines of a ratio above
``RATIO`` on at least ``MIN_PAGES`` pages are boilerplate and are dropped from every page of
that host.  Pages of equal text count as one, so a copied page doesn't turn its own lines into
boilerplate.  DataFrame functions only.

Plan: lines are trimmed, made distinct within a page and hashed before the first shuffle, so it
carries hashes, not text; the distinct page count spreads a hot line over its pages' hashes and
is pre-aggregated at each level.  The boilerplate lines (at most lines-per-page / RATIO a host)
are joined back on the hashes: adaptive execution (which must stay on) broadcasts them while they
are small by measured size, and splits a hot line's partition otherwise.  Only pages that hold one carry a
list, and texts move at most once, to meet that list.

Defined results: a null text stays null and counts as a page without lines.  A null host is the
host "".  Lines of white space are never counted or dropped.  Lines are equal if they are equal
without white space at their ends; the lines that stay keep theirs.  Repeated rows are cleaned
alike.  A page that is all boilerplate becomes empty.  Empty tables give no rows.  Other columns
are kept, whatever their names; where the report's names are taken they end in "_".
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmill.llm import storage

#: Well below the shares of the commonest repeated lines (to 13 % of a source's pages on sf0.1), above
#: that of the longest one seen, a paragraph of 530 characters (to 1.05 % on check_h).
RATIO = 0.02
MIN_PAGES = 5
BLANKS = " \t\r\x0b\x0c"
SALT = "line"


def url_host(url: Column) -> Column:
    """The lower-case host of a URL, "" if there is none."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def _trim(line: Column) -> Column:
    return F.trim(line, F.lit(BLANKS))


def _line_key(line: Column) -> Column:
    """128 bits of a trimmed line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(SALT), line).alias("b"))


def _keyed(docs: DataFrame, host: Column, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(host, F.lit("")).alias("host"), F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(SALT), text).alias("b")).alias("page"), text.alias("text"))


def _lines(keyed: DataFrame) -> DataFrame:
    """host, page, line: the distinct lines of each page, as hashes."""
    lines = F.array_distinct(F.filter(F.transform(F.split("text", "\n"), _trim), lambda x: x != ""))
    return keyed.select("host", "page", F.explode(F.transform(lines, _line_key)).alias("line"))


def boilerplate(docs: DataFrame, host: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES, text_col: str = "text") -> DataFrame:
    """host, line (its hash), pages, host_pages of each boilerplate line."""
    keyed = _keyed(docs, host, text_col)
    totals = keyed.groupBy("host").agg(F.count_distinct("page").alias("host_pages"))
    counts = _lines(keyed).groupBy("host", "line").agg(F.count_distinct("page").alias("pages")).where(F.col("pages") >= min_pages)
    return counts.join(totals, "host").where(F.col("pages") > F.col("host_pages") * F.lit(float(ratio)))


def clean(docs: DataFrame, host: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES, text_col: str = "text", report: bool = False) -> DataFrame:
    """``docs`` with its columns and boilerplate lines gone from the text; with ``report`` also
    n_lines and n_dropped."""
    keyed = _keyed(docs, host, text_col)
    found = boilerplate(docs, host, ratio, min_pages, text_col).select("host", "line")
    hits = _lines(keyed).join(found, ["host", "line"]).groupBy("host", "page").agg(F.collect_set("line").alias("drop"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    page = F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(SALT), text).alias("b"))
    at = {c: storage.free_name(f"line_{c}", docs) for c in ("host", "page", "drop")}
    joined = docs.withColumns({at["host"]: F.coalesce(host, F.lit("")), at["page"]: page}).join(hits.withColumnsRenamed(at), [at["host"], at["page"]], "left")
    lines, drop = F.split(F.col(text_col), "\n"), F.col(at["drop"])
    kept = F.filter(lines, lambda x: ~F.array_contains(drop, _line_key(_trim(x))))
    cleaned = F.when(drop.isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    columns = [cleaned.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    if report:
        n_lines = F.coalesce(F.size(lines), F.lit(0))
        columns += [n_lines.alias(storage.free_name("n_lines", docs)), F.when(drop.isNull(), 0).otherwise(F.size(lines) - F.size(kept)).alias(storage.free_name("n_dropped", docs))]
    return joined.select(*columns)
