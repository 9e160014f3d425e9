"""Commands, settings and renderings on small literal cases."""

import io
import json

from pyspark.sql import functions as F

from parchmill.functions import render, settings, text
from parchmill.plans import commands
from parchmill.sources import files


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("c")).first().c


def test_extract_prefers_responses(spark):
    docs = spark.createDataFrame([(1, "张伟\nPython"), (2, "x"), (3, None), (4, "Go")], "id int, text string")
    answers = spark.createDataFrame([(2, '{"name": "B", "skills": "a, b",}'), (4, "none")], "id int, content string")
    got = {r.id: r for r in commands.extract(docs, answers).collect()}
    assert (got[1].source, got[1].result.name, got[1].result.skills, got[1].error_code) == ("rules", "张伟", ["Python"], None)
    assert (got[2].source, got[2].result.name, got[2].result.skills, len(got[2].repairs)) == ("model", "B", ["a", "b"], 1) and got[2].warnings
    assert got[3].source == "rules" and got[3].error_code is None
    assert (got[4].result, got[4].error_code) == (None, "AI_INVALID_JSON")
    alone = {r.id: r for r in commands.extract(docs, answers, rules=False).collect()}
    assert (alone[1].result, alone[1].error_code, alone[2].error_code) == (None, "AI_REQUEST_FAILED", None)
    assert commands.extract(docs).where("source = 'rules'").count() == 4


def test_settings(spark):
    assert [one(spark, x, lambda t: settings.lenient_int(t, 7)) for x in ("12abc", " 3", "-1", "0", "x", None)] == [12, 3, 7, 7, 7, 7]
    assert one(spark, "a\nb", settings.indented) == "      a\n      b" and one(spark, "http://h/v1//", lambda t: settings.endpoint(t, "x")) == "http://h/v1/x"
    assert [one(spark, x, settings.plausible_email) for x in ("a@b.c", "a@b", "a b@c.d", "@b.c")] == [True, False, False, False]


def test_preview_and_truncation(spark):
    got = one(spark, "abcdef\n张伟张伟\nc", lambda t: render.preview(t, 2, 5))
    assert (got.lines, got.omitted) == (["  1 │ abcd…", "  2 │ 张伟…"], 1)
    assert [one(spark, x, lambda t: text.truncate_display(t, 4)) for x in ("abcd", "abcde", "e\u0301abc", "")] == ["abcd", "abc…", "e\u0301abc", ""]


def test_metadata(spark):
    got = one(spark, '{"Title": "T", "Author": 3, "Producer": null}', commands.metadata)
    assert (got.title, got.author, got.producer, got.creator) == ("T", None, None, None) and one(spark, "{", commands.metadata).title is None


def test_files(spark, tmp_path):
    for name, data in {"a.txt": b"  role  ", "b.txt": b"   ", "c.txt": b"", "d.txt": b"x" * (files.MAX_JD_BYTES + 1), "e.txt": b"ab\xff\xfe"}.items():
        (tmp_path / name).write_bytes(data)
    (tmp_path / "inner").mkdir()
    want = {"a.txt": ("role", None), "b.txt": ("", "JD_EMPTY"), "c.txt": (None, "JD_EMPTY"), "d.txt": (None, "JD_EMPTY"), "e.txt": ("ab\ufffd\ufffd", "JD_EMPTY")}
    assert {r.path[-5:]: (r.text, r.error_code) for r in files.scan_jds(spark, str(tmp_path)).collect()} == want
    # Named one by one: what is missing, and a folder, is a row too.
    named = [f"{tmp_path}/{n}" for n in ("a.txt", "c.txt", "gone.txt", "inner")]
    got = {r.path.rpartition("/")[2]: (r.text, r.error_code) for r in files.scan_jds(spark, named).collect()}
    assert got == {"a.txt": want["a.txt"], "c.txt": want["c.txt"], "gone.txt": (None, "JD_FILE_NOT_FOUND"), "inner": (None, "JD_FILE_NOT_FOUND")}
    assert [r.error_code for r in files.scan_jds(spark, f"{tmp_path}/none*").collect()] == ["JD_FILE_NOT_FOUND"]


def test_pdf_files(spark, tmp_path):
    for name, data in {"a.pdf": b"x%PDF-1.7", "b.pdf": b"plain", "c.pdf": b""}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rpartition("/")[2]: (r.bytes, r.error_code) for r in files.scan_pdfs(spark, [f"{tmp_path}/{n}.pdf" for n in "abcd"]).collect()}
    assert got == {"a.pdf": (9, None), "b.pdf": (5, "NOT_A_PDF"), "c.pdf": (0, "PDF_UNREADABLE"), "d.pdf": (None, "FILE_NOT_FOUND")}


def test_outputs(spark, tmp_path):
    files.write_json(spark.createDataFrame([(1, None)], "a int, b string"), f"{tmp_path}/out")
    rows = [json.loads(x) for f in (tmp_path / "out").glob("part-*.json") for x in f.read_text().splitlines()]
    assert rows == [{"a": 1, "b": None}]
    (tmp_path / "file").write_text("x")
    made = spark.createDataFrame([("deep/a.json", '{"é":[1,{}],"b":[]}'), ("file/b.json", "{}"), ("c.json", "{"), ("d.json", None)], "name string, json string")
    got = {r.path.rpartition("/")[2]: r.error_code for r in files.write_documents(made, f"{tmp_path}").collect()}
    assert got == {"a.json": None, "b.json": "OUTPUT_WRITE_FAILED", "c.json": "OUTPUT_WRITE_FAILED", "d.json": "OUTPUT_WRITE_FAILED"}
    assert (tmp_path / "deep" / "a.json").read_text() == '{\n  "é": [\n    1,\n    {}\n  ],\n  "b": []\n}\n'


def test_emit(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, "line a\nline b")], "a int, b string, shown string")
    stream = io.StringIO()
    assert commands.emit(rows, "shown", f"{tmp_path}/out", stream) is None and stream.getvalue() == "line a\nline b\n"
    assert [json.loads(x) for f in (tmp_path / "out").glob("part-*.json") for x in f.read_text().splitlines()] == [{"a": 1, "b": None}]
    stream = io.StringIO()
    assert commands.emit(rows.drop("shown"), stream=stream) is None and stream.getvalue() == '{\n  "a": 1,\n  "b": null\n}\n'
    assert commands.emit(rows, None, f"{tmp_path}/out", stream) == "OUTPUT_WRITE_FAILED" and stream.getvalue().count("{") == 1


def test_facts_without_any(spark):
    assert spark.range(1).select(render.facts({"a": F.lit(None).cast("string"), "b": F.lit("")}).alias("x")).first().x == ["  (无)"]
