"""The three commands as plans: parse, extract and score whole tables of documents.

Each row carries its own error code; a row with one has null results.  Model responses are an
input table; without it (or for ids it lacks, if ``rules``) the rule engine answers."""

from __future__ import annotations

import json
import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmill.functions import extract as rules_of
from parchmill.functions import jsonfix, text
from parchmill.operators import layout, score as scoring
from parchmill.sources import files

# The metadata fields of a document and their keys.
METADATA = {"title": "Title", "author": "Author", "creator": "Creator", "producer": "Producer", "creationDate": "CreationDate"}
# End of the fixed values.


def metadata(info: Column) -> Column:
    """The five fields of a JSON object that are texts; others, and broken JSON, are null."""
    v = F.try_parse_json(info)

    def field(key: str) -> Column:
        one = F.try_variant_get(v, f"$.{key}", "variant")
        return F.when(F.schema_of_variant(one) == "STRING", F.try_variant_get(v, f"$.{key}", "string"))

    return F.struct(*(field(key).alias(name) for name, key in METADATA.items()))


def parse(docs: DataFrame) -> DataFrame:
    """``docs``: path, bytes, pages (an array of runs a page, see ``layout.lines``), info (JSON)."""
    pages = F.transform("pages", lambda page: F.array_join(layout.lines(page), "\n"))
    found = docs.select("path", "bytes", F.size("pages").alias("pages"), text.clean(F.array_join(pages, "\n\n")).alias("text"), metadata(F.col("info")).alias("metadata"))
    scan = files.suspected_scan(F.col("text"), F.col("pages"))
    return found.select("path", "bytes", "pages", F.length("text").alias("chars"), "metadata", scan.alias("suspectedScanned"), "text", files.text_error(F.col("text")).alias("error_code"))


def _answers(rows: DataFrame, responses: DataFrame, keys: list[str], coerced, fields: list[str], shape: str) -> DataFrame:
    """``rows`` with the responses of their keys: result, warnings, error_code, repairs, answered."""
    fixed = responses.select(*keys, jsonfix.repaired(F.col("content")).alias("r")).select(*keys, "r.repairs", coerced(F.col("r.value")).alias("c"))
    result = F.when(F.col("c.error_code").isNull(), F.struct(*(F.col(f"c.{f}").alias(f) for f in fields)).cast(shape))
    own = fixed.select(*keys, F.lit(True).alias("answered"), result.alias("answer"), F.col("c.warnings").alias("warnings"), F.col("c.error_code").alias("error_code"), "repairs")
    return rows.join(own, keys, "left")


def _settled(joined: DataFrame, keys: list[str], ruled: Column | None) -> DataFrame:
    none = F.array().cast("array<string>")
    answered = F.coalesce("answered", F.lit(False))
    result = F.col("answer") if ruled is None else F.when(answered, F.col("answer")).otherwise(ruled)
    missing = F.lit("AI_REQUEST_FAILED") if ruled is None else F.lit(None).cast("string")
    return joined.select(
        *keys, result.alias("result"), F.when(answered, "model").otherwise("none" if ruled is None else "rules").alias("source"),
        F.coalesce("repairs", none).alias("repairs"), F.coalesce("warnings", none).alias("warnings"), F.when(answered, F.col("error_code")).otherwise(missing).alias("error_code"),
    )


def extract(docs: DataFrame, responses: DataFrame | None = None, rules: bool = True, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """id, result (the profile), source, repairs, warnings, error_code of each document.

    ``responses``: id, content; one row an id.  Both sides meet by a join on the id."""
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    profile = rules_of.profile(F.col("_text"))
    shape = rows.select(profile.alias("p")).schema["p"].dataType.simpleString()
    if responses is None:
        responses = docs.select(id_col, F.lit(None).cast("string").alias("content")).limit(0)
    joined = _answers(rows, responses, [id_col], jsonfix.coerced_profile, ["name", "phone", "email", "city", "education", "skills"], shape)
    return _settled(joined, [id_col], profile if rules else None)


def score(pairs: DataFrame, responses: DataFrame | None = None, rules: bool = True, keys: tuple[str, ...] = ("person", "job")) -> DataFrame:
    """keys, result (the report), source, repairs, warnings, error_code of each matched pair.

    ``pairs``: what ``operators.score.match`` returns.  ``responses``: the keys and content."""
    report = F.struct(*(F.col(c) for c in jsonfix.SCORES), scoring.comment().alias("comment"), scoring.questions().alias("interview_questions"))
    shape = pairs.select(report.alias("r")).schema["r"].dataType.simpleString()
    if responses is None:
        responses = pairs.select(*keys, F.lit(None).cast("string").alias("content")).limit(0)
    joined = _answers(pairs, responses, list(keys), jsonfix.coerced_report, [*jsonfix.SCORES, "comment", "interview_questions"], shape)
    return _settled(joined, list(keys), report if rules else None)


def emit(result: DataFrame, rendered: str | None = None, out: str | None = None, stream=None) -> str | None:
    """Print a result row by row: as indented JSON with its nulls, or the text of the column ``rendered``.
    With ``out`` the rows (without that column) are first written there as JSON lines; if that
    fails nothing is printed and the error code is returned.  Rows reach the driver a partition at a time."""
    rows = result.drop(rendered) if rendered else result
    if out is not None:
        try:
            files.write_json(rows, out)
        except Exception:  # whatever the file system says
            return "OUTPUT_WRITE_FAILED"
    stream = stream or sys.stdout
    for row in (result.select(rendered) if rendered else rows).toLocalIterator():
        stream.write((row[0] or "") + "\n" if rendered else json.dumps(row.asDict(True), indent=2, ensure_ascii=False, default=str) + "\n")
    return None
