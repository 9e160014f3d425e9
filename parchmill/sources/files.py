"""File scans with errors as data, and the error codes.  A bad file is a row, not a failed job."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmill.functions.text import trim

# Limits, codes and their exit codes.
MAX_PDF_BYTES, MAX_JD_BYTES, MAGIC, MAGIC_WINDOW, SCAN_CHARS = 50 * 1024 * 1024, 2 * 1024 * 1024, "%PDF-", 1024, 30
EXIT_CODES = {
    "FILE_NOT_FOUND": 3, "NOT_A_PDF": 3, "PDF_UNREADABLE": 3, "PDF_EMPTY_TEXT": 3, "JD_FILE_NOT_FOUND": 3, "JD_EMPTY": 3, "CONFIG_MISSING": 4,
    "AI_REQUEST_FAILED": 5, "AI_INVALID_JSON": 5, "AI_INVALID_SHAPE": 5, "OUTPUT_WRITE_FAILED": 6, "UNKNOWN": 1,
}
RETRYABLE = (408, 409, 425, 429, 500, 502, 503, 504)
LEVELS = {"silent": 0, "error": 1, "warn": 2, "info": 3, "debug": 4}
# End of the fixed values.


def exit_code(code: Column) -> Column:
    """0 without an error, 1 for codes that aren't known."""
    table = F.create_map(*(F.lit(x) for pair in EXIT_CODES.items() for x in pair))
    return F.when(code.isNull(), 0).otherwise(F.coalesce(F.try_element_at(table, code), F.lit(1)))


def pdf_error(length: Column, head: Column) -> Column:
    """The error code of a PDF file by its length and first bytes, null if it looks right."""
    text = F.decode(F.substring(head, 1, MAGIC_WINDOW), "ISO-8859-1")
    return F.when(length.isNull(), "FILE_NOT_FOUND").when(length == 0, "PDF_UNREADABLE").when(length > MAX_PDF_BYTES, "PDF_UNREADABLE").when(~F.contains(text, F.lit(MAGIC)), "NOT_A_PDF")


def _listed(spark: SparkSession, paths: str | list[str]) -> tuple[list[str], list[tuple[str, int | None]]]:
    """(paths that hold files, (path, 0 or None) of what has no bytes to read): empty files, and paths
    that don't exist.  Spark's own index leaves empty files out and fails on missing paths.  One
    string may be a folder or a pattern; a list names single files, where a folder is missing."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    good, bare = [], []
    for path in [paths] if isinstance(paths, str) else paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        fs = target.getFileSystem(conf)
        found = list(fs.globStatus(target) or [])
        if not isinstance(paths, str):
            found = [f for f in found if not f.isDirectory()]
        inner = [g for f in found for g in (fs.listStatus(f.getPath()) if f.isDirectory() else [f])]
        if not found:
            bare.append((path, None))
        bare += [(f.getPath().toString(), 0) for f in inner if not f.isDirectory() and not f.getLen()]
        if any(f.getLen() for f in inner if not f.isDirectory()):
            good.append(path)
    return good, bare


def _scan(spark: SparkSession, paths: str | list[str], most: int) -> DataFrame:
    """path, bytes (null: no such file) and content (null beyond ``most`` bytes, which are not read)."""
    good, bare = _listed(spark, paths)
    rows = spark.createDataFrame([(*x, None) for x in bare], "path string, bytes long, content binary")
    if not good:
        return rows
    # The content is only read for rows that pass the filter on the file's length.
    files = spark.read.format("binaryFile").load(good)
    small = files.where(F.col("length") <= most).select("path", F.col("length").alias("bytes"), "content")
    large = files.where(F.col("length") > most).select("path", F.col("length").alias("bytes"), F.lit(None).cast("binary").alias("content"))
    return small.union(large).union(rows)


def scan_pdfs(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, bytes, content, error_code of each file; files that are missing, empty, too large or no
    PDF are rows with a code."""
    files = _scan(spark, paths, MAX_PDF_BYTES)
    return files.select("path", "bytes", "content", pdf_error(F.col("bytes"), F.col("content")).alias("error_code"))


def text_error(text: Column) -> Column:
    return F.when(text == "", "PDF_EMPTY_TEXT")


def text_hint(text: Column, pages: Column) -> Column:
    """Why a document has no text: pages without any look like a scan, a file without pages is broken."""
    return F.when(text == "", F.when(pages > 0, "SUSPECTED_SCAN").otherwise("NO_PAGES"))


def suspected_scan(text: Column, pages: Column) -> Column:
    return (F.length(text) < SCAN_CHARS) & (pages > 0)


def jd_error(text: Column, size: Column) -> Column:
    """The error code of a job description: size, broken encoding (over 5 % U+FFFD), blankness."""
    broken = F.length(text) - F.length(F.replace(text, F.lit("�"), F.lit("")))
    return F.when(text.isNull(), "JD_FILE_NOT_FOUND").when((size == 0) | (size > MAX_JD_BYTES) | (broken > F.length(text) * 0.05) | (trim(text) == ""), "JD_EMPTY")


def scan_jds(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path, text (trimmed), chars, error_code of each text file; missing, empty and too large ones
    are rows with a code and without a text."""
    files = _scan(spark, paths, MAX_JD_BYTES).select("path", "bytes", F.make_valid_utf8(F.col("content").cast("string")).alias("raw"))
    text = F.when(F.col("bytes").isNull(), None).otherwise(F.coalesce("raw", F.lit("")))
    return files.select("path", trim(F.col("raw")).alias("text"), F.length(trim(F.col("raw"))).alias("chars"), jd_error(text, F.col("bytes")).alias("error_code"))


def write_documents(rows: DataFrame, folder: str, name_col: str = "name", json_col: str = "json") -> DataFrame:
    """Write each row's JSON text, indented by two spaces and ended by a line break, to a file of its
    name under ``folder``, a path that all executors share.  Returns path and error_code of each row,
    a row for each: what can't be written (or is no JSON) is OUTPUT_WRITE_FAILED."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, codes = [], []
            for name, text in zip(*(c.to_pylist() for c in batch.columns)):
                path = os.path.join(folder, name or "")
                try:
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    shown = json.dumps(json.loads(text), indent=2, ensure_ascii=False)
                    with open(path, "w", encoding="utf-8") as handle:
                        handle.write(shown + "\n")
                    codes.append(None)
                except (OSError, ValueError, TypeError, RecursionError):
                    codes.append("OUTPUT_WRITE_FAILED")
                paths.append(path)
            yield pa.RecordBatch.from_arrays([pa.array(paths), pa.array(codes, pa.string())], names=["path", "error_code"])

    return rows.select(F.col(name_col).cast("string"), F.col(json_col).cast("string")).mapInArrow(save, "path string, error_code string")


def write_json(df: DataFrame, path: str) -> None:
    """One object a line, nulls kept."""
    df.write.option("ignoreNullFields", "false").json(path)


def retryable(status: Column) -> Column:
    return status.isin(*RETRYABLE)


def downgrade(status: Column, body: Column) -> Column:
    """Whether a service refused the JSON mode, so that the request is worth another try without it."""
    return (status == 400) & F.coalesce(body.rlike("(?i)response_format|json_object"), F.lit(False))


def failure_class(status: Column) -> Column:
    """What a failed answer's status says: auth, missing, throttled, server or other; null below 400."""
    return F.when(status.isin(401, 403), "auth").when(status == 404, "missing").when(status == 429, "throttled").when(status >= 500, "server").when(status >= 400, "other")


def visible(level: Column, threshold: str) -> Column:
    table = F.create_map(*(F.lit(x) for pair in LEVELS.items() for x in pair))
    return (F.try_element_at(table, level) <= LEVELS[threshold]) & (level != "silent")
