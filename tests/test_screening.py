"""Rules of the screening engine on small literal cases."""

import pytest
from pyspark.sql import functions as F

from parchmill.functions import extract, jsonfix, text, wrap
from parchmill.operators import score
from parchmill.streaming import events

REPAIRS = [
    ('{"a": 1}', '{"a":1}', 0),
    ('```json\n{"a": 1}\n```', '{"a":1}', 1),
    ('x {"a": "}"} y', '{"a":"}"}', 1),
    ('{"a": 1,} // end', '{"a":1}', 2),
    ("{'a': 'it\\'s'}", '{"a":"it\'s"}', 1),
    ('{“a”： 1，“b”： None}', '{"a":1,"b":null}', 2),
    ('{"a": "x\ny"}', '{"a":"x\\ny"}', 1),
    ('{"a": 1, "b": [1, 2', '{"a":1,"b":[1]}', 1),
]


@pytest.mark.parametrize("raw,value,steps", REPAIRS)
def test_repair(raw, value, steps):
    got, done, ok = jsonfix.repair(raw)
    assert ok and jsonfix.compact(got) == value and len(done) == steps


def test_repair_fails():
    assert jsonfix.repair("")[2] is False and jsonfix.repair("no json")[2] is False and jsonfix.repair("NaN")[2] is True


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("c")).first().c


@pytest.mark.parametrize("raw,clean", [("⻚a ­b", "页a b"), ("Ａ，１", "A，1"), ("a  \n \n\n\n b", "a\n\nb"), ("ﬁx﻿ ", "fix"), ("", ""), (None, None)])
def test_clean(spark, raw, clean):
    assert one(spark, raw, text.clean) == clean


@pytest.mark.parametrize("raw,found", [("Google JavaScript", ["JavaScript"]), ("Java, Go.", ["Java", "Go"]), ("Vue.js c++", ["C++", "Vue.js"]), ("大模型", ["大模型"]), ("", [])])
def test_skills(spark, raw, found):
    assert one(spark, raw, extract.skills) == found


def test_fields(spark):
    raw = "姓 名：张伟\n浙江大学 软件工程 本科 2014.09 - 2018年6月\n浙江大学\n+86 13800001234 a.b@c.de 杭州 8年经验"
    assert one(spark, raw, extract.name) == "张伟" and one(spark, raw, extract.phone) == "138-0000-1234" and one(spark, raw, extract.city) == "杭州"
    assert [tuple(e) for e in one(spark, raw, extract.education)] == [("浙江大学", "软件工程", "本科", "2018.06")]
    assert one(spark, raw, lambda t: extract.years(t, 2025)) == 8 and one(spark, "3 年以上开发经验", extract.stated_years) is None


def test_scores(spark):
    people = spark.createDataFrame([(1, "TypeScript React Node.js 8年经验 本科")], "p int, t string")
    jobs = spark.createDataFrame([(1, "TypeScript React Node.js PostgreSQL Kubernetes LLM RAG 本科")], "j int, t string")
    paired = score.pairs(score.candidate_features(people, F.col("t"), 2025).drop("t"), score.job_features(jobs, F.col("t")).drop("t"))
    r = score.match(paired).first()
    assert (r.skill_score, r.experience_score, r.education_score, r.overall_score) == (42.9, 100.0, 80.0, 67.5)
    assert score.pairs(people, jobs, max_broadcast=0).count() == 1


@pytest.mark.parametrize("limits", [{}, {"max_broadcast": 4, "block": 2}, {"max_bytes": 20}])
def test_pairs_whole(spark, limits):
    people = spark.createDataFrame([(k % 6, None if k == 3 else "x") for k in range(7)], "p int, t string")  # one row twice
    jobs = spark.createDataFrame([(k, None if k == 2 else "y") for k in range(5)], "j int, u string")
    got = score.pairs(people, jobs, **limits)
    assert got.columns == ["p", "t", "j", "u"]
    assert sorted((r.p, r.j) for r in got.collect()) == sorted((k % 6, j) for k in range(7) for j in range(5))
    assert score.pairs(people.limit(0), jobs, **limits).count() == score.pairs(people, jobs.limit(0), **limits).count() == 0


@pytest.mark.parametrize("limits", [{}, {"max_broadcast": 1, "block": 1}])
def test_pairs_keep_columns(spark, limits):
    people = spark.createDataFrame([(1, "a", 2)] * 3, "p int, salt string, salt_ int")
    got = score.pairs(people, spark.createDataFrame([(7, "c"), (8, "d")], "j int, block string"), **limits)
    assert got.columns == ["p", "salt", "salt_", "j", "block"] and sorted(map(tuple, got.collect())) == sorted([(1, "a", 2, 7, "c"), (1, "a", 2, 8, "d")] * 3)


def test_rank_all(spark):
    rows = [(j, p, float([50, 50, 70.5, 0][(p * 7 + j) % 4]), "x") for j in range(3) for p in range(200)] + [(None, 5, 1.0, "x")]
    scored = spark.createDataFrame(rows, "j int, p int, overall_score double, id_range string").repartition(5)
    for ranges in (1, 8, 64):
        got = score.rank(scored, "j", "p", ranges=ranges)
        assert got.columns == [*scored.columns, "rank"]
        found = {(r.j, r.p): r["rank"] for r in got.collect()}
        for j in (0, 1, 2, None):
            order = sorted((r for r in rows if r[0] == j), key=lambda r: (-r[2], r[1]))
            assert [found[j, r[1]] for r in order] == list(range(1, len(order) + 1))
    assert score.rank(scored.limit(0), "j", "p").count() == 0 and score.rank(scored, "j", "p", top=2).count() == 7


def test_skill_rows(spark):
    docs = spark.createDataFrame([(1, "Go C++ 大模型 Google", "t"), (2, None, "t"), (3, "none", "t"), (1, "go", "t")], "id int, text string, terms string")
    lexicon = spark.createDataFrame([("C++",), ("Go",), ("大模型",), ("Go",), (None,), ("",), ("a.b",)], "skill string")
    got = extract.skill_rows(docs, "text", lexicon)
    assert got.columns == ["id", "text", "terms", "skill"]
    assert sorted((r.id, r.text, r.skill) for r in got.collect()) == sorted([(1, docs.first().text, "C++"), (1, docs.first().text, "Go"), (1, docs.first().text, "大模型"), (1, "go", "Go")])
    assert extract.skill_rows(docs, "text", lexicon.limit(0)).count() == 0


def test_no_text_fails_the_json_job(spark):
    raw = ['{"a":"\\ud800"}', "9" * 5000, "[" * 5000 + "]" * 5000, "[" * 300_000, '{"name":"\\udc00","skills":["\\ud83d"],"overall_score":' + "9" * 500 + "}", None, '{"name":' + "[" * 4000 + "]" * 4000 + "}"]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(raw)], "k int, t string").repartition(3)
    got = {r.k: r for r in rows.select("k", jsonfix.repaired(F.col("t")).alias("r"), jsonfix.coerced_profile(F.col("t")).alias("p"), jsonfix.coerced_report(F.col("t")).alias("s")).collect()}
    assert got[0].r.value == '{"a":"\ufffd"}' and got[1].r.value == "null" and got[2].r.value == raw[2] and not got[3].r.ok
    assert (got[4].p.name, got[4].p.skills, got[4].s.overall_score) == ("\ufffd", ["\ufffd"], 0.0) and not got[5].r.ok and got[6].p.name is None


@pytest.mark.parametrize("x,shown", [(0.00001, "0.00001"), (1e-6, "0.000001"), (1e-7, "1e-7"), (2**60, "1152921504606847000"), (1e21, "1e+21"), (-0.0, "0"), (1.5, "1.5"), (100, "100"), (-12345678901234567890, "-12345678901234567000")])
def test_numbers(x, shown):
    assert jsonfix.number_text(x) == shown


def test_wrap_loses_nothing():
    raw = "张伟使用 Python，React、https://example.com/a/very/long/path 。"
    for columns in (5, 12, 40):
        lines = wrap.wrap(raw, columns)
        assert "".join(lines).replace(" ", "") == raw.replace(" ", "")
    assert not any(x[:1] in wrap.NO_START for x in wrap.wrap(raw, 40)[1:])  # but for parts of a cut word


def test_fold_streams(spark, tmp_path):
    rows = [(1, 1, "item.completed", "a", None, None), (1, 2, "item.completed", "b", None, None), (1, 3, "turn.completed", None, 2, 3), (2, 1, "error", None, None, None)]
    kind = "call_id long, seq long, type string, text string, input_tokens long, output_tokens long"
    spark.createDataFrame(rows, kind).write.parquet(f"{tmp_path}/in")
    fold = events.fold(spark.readStream.schema(kind).parquet(f"{tmp_path}/in"))
    fold.writeStream.outputMode("complete").format("memory").queryName("folded").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start().awaitTermination()
    got = {r.call_id: r for r in spark.table("folded").collect()}
    assert (got[1].content, got[1].tokens, got[1].success, got[2].success) == ("b", 5, True, False)


def test_event_lines(spark):
    say = lambda text, kind="agent_message": '{"type":"item.completed","item":{"type":"%s","text":"%s"}}' % (kind, text)
    done, used = '{"type":"turn.completed"}', '{"type":"turn.completed","usage":{"input_tokens":2}}'
    calls = {
        1: [say("a"), say("no", "reasoning"), "", "  ", used, done], 2: [say("a"), done], 3: [say("a"), done, "{"], 4: [say("a"), done, "null"], 5: [say(" "), done], 6: [say("a")],
        7: [say("a"), '{"type":"error"}', done], 8: [done, "5", '"x"', "[1]", say("b")], 9: [say("x" * (4 << 20)), done], 10: [None, say("a"), done], 11: ['{"type":"item.completed","item":null}', '{"type":"item.completed","item":{"type":"agent_message","text":7}}', done],
    }
    lines = spark.createDataFrame([(c, k, x) for c, rows in calls.items() for k, x in enumerate(rows)], "call_id long, seq long, line string").repartition(3)
    folded = events.fold(events.parsed(lines))
    got = {r.call_id: (r.content if r.call_id != 9 else None, r.tokens, r.success) for r in folded.collect()}
    assert got == {1: ("a", 2, True), 2: ("a", None, True), 3: ("a", None, False), 4: ("a", None, False), 5: (" ", None, False), 6: ("a", None, False), 7: ("a", None, False), 8: ("b", None, True), 9: (None, None, False), 10: ("a", None, True), 11: (None, None, False)}
    ended = spark.createDataFrame([(1, 0, False), (2, 1, False), (3, 0, False), (8, None, True), (10, None, None), (99, 0, None)], "call_id long, exit_code int, timed_out boolean")
    codes = {r.call_id: (r.content, r.error_code) for r in events.outcome(folded, ended).collect()}
    assert codes == {1: ("a", None), 2: (None, "AI_REQUEST_FAILED"), 3: (None, "AI_REQUEST_FAILED"), 8: (None, "AI_REQUEST_FAILED"), 10: (None, "CONFIG_MISSING"), 99: (None, "AI_REQUEST_FAILED")}
