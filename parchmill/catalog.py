"""Every registered query of the screening engine and its DuckDB oracle.

The driver's tables hold no résumés, so candidates (one a customer), job descriptions (one a
nation), damaged JSON (one an event) and noisy texts (one a document) are derived by SQL
expressions that both engines read the same."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parchmill.functions import extract, jsonfix, render, settings, text, wrap
from parchmill.functions.lexicon import CITIES, DEGREES, SKILLS
from parchmill.operators import layout, score
from parchmill.plans import commands
from parchmill.sources import files
from parchmill.streaming import events

FLAGSHIP = "rank_candidates_per_jd"
AS_OF = 2025
#: Lines of a preview.
PREVIEW = 40
#: Candidates of a job in the short report.
TOP = 10

_SOME = {"Python": 2, "JavaScript": 3, "Java": 5, "TypeScript": 4, "Go": 7, "React": 3, "Vue.js": 6, "Vue": 4, "Node.js": 5, "Docker": 6, "Kubernetes": 7, "PostgreSQL": 4, "C++": 9, "大模型": 5, "机器学习": 8}


def _skill_list(key: str, shift: int) -> str:
    return ", ".join(f"CASE WHEN ({key} + {k + shift}) % {n} = 0 THEN '{s}、' ELSE '' END" for k, (s, n) in enumerate(_SOME.items()))


RESUME = f"""concat(
  CASE c_custkey % 4 WHEN 0 THEN '姓名：张伟' WHEN 1 THEN '李晓明' WHEN 2 THEN 'John Smith' ELSE '个人简历资料' END, chr(10),
  '电话 13', CAST(c_custkey % 10 AS STRING), '-', lpad(CAST(c_custkey * 7 % 10000 AS STRING), 4, '0'), '-', lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'), chr(10),
  CASE WHEN c_custkey % 9 = 0 THEN '' ELSE concat('邮箱 user', CAST(c_custkey AS STRING), '@mail', CAST(c_custkey % 7 AS STRING), '.example.com') END, chr(10),
  CASE c_custkey % 5 WHEN 0 THEN '现居杭州' WHEN 1 THEN '上海 / 北京' WHEN 2 THEN '' WHEN 3 THEN '成都' ELSE '广州深圳' END, chr(10),
  CASE c_custkey % 3 WHEN 0 THEN '浙江大学 · 软件工程 · 本科 2014.09 - 2018.06' WHEN 1 THEN '武汉学院 计算机科学 硕士 2016年9月-2019年6月' ELSE '自学' END, chr(10),
  CASE WHEN c_custkey % 6 = 0 THEN concat('浙江大学 交流 2019', chr(10), '南京学校 工商管理 2011') ELSE '' END, chr(10),
  CASE c_custkey % 4 WHEN 0 THEN concat(CAST(c_custkey % 12 AS STRING), ' 年以上工作经验') WHEN 1 THEN '2016年 至今' WHEN 2 THEN '3年经历' ELSE '' END, chr(10),
  '技能：', {_skill_list("c_custkey", 0)}, '沟通')"""
JOB = f"""concat('岗位 ', n_name, chr(10), '要求：', {_skill_list("n_nationkey", 1)}, '协作', chr(10),
  CASE n_nationkey % 3 WHEN 0 THEN '5 年以上工作经验' WHEN 1 THEN '3 年以上开发经验' ELSE '2年经验' END, chr(10),
  CASE n_nationkey % 4 WHEN 0 THEN '硕士及以上' WHEN 1 THEN '本科' WHEN 2 THEN '大专' ELSE '不限' END)"""
#: Signs that the noisy texts get: both engines must read them as literals.
_NBSP, _ZWSP, _PAGE, _WIDE_A, _COMMA, _FI, _IDEOGRAPHIC, _BOM = map(chr, (0xA0, 0x200B, 0x2EDA, 0xFF21, 0xFF0C, 0xFB01, 0x3000, 0xFEFF))
NOISY = f"""concat(CASE doc_id % 4 WHEN 0 THEN '{_NBSP}{_ZWSP}' WHEN 1 THEN '{_PAGE}{_WIDE_A}{_COMMA}' WHEN 2 THEN '{_FI}{_IDEOGRAPHIC}' ELSE '' END,
  replace(text, '. ', CASE doc_id % 3 WHEN 0 THEN concat('.', chr(9), '  ') WHEN 1 THEN concat('. ', chr(10), chr(10), chr(10), chr(10)) ELSE '. ' END), CASE WHEN doc_id % 5 = 0 THEN ' {_BOM}' ELSE '' END)"""
DAMAGED = """CASE event_id % 10
  WHEN 1 THEN concat('```json', chr(10), props, chr(10), '```') WHEN 2 THEN concat('Result: ', props, ' done') WHEN 3 THEN replace(props, '}', ' /* c */}') WHEN 4 THEN replace(props, '}', ',}')
  WHEN 5 THEN replace(props, '"', '''') WHEN 6 THEN replace(props, ':', '：') WHEN 7 THEN replace(props, '}', ', "b": True}') WHEN 8 THEN replace(props, '}', ', "b": "ab') WHEN 9 THEN 'no json' ELSE props END"""

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str, table: str, key: str, source: str) -> DataFrame:
    """The key and the derived text ``t`` of each row.  Candidates are made of few bytes, one file of
    which must not hold all pattern work in one task: their rows are dealt out before it is made."""
    rows = _table(spark, sf_dir, table)
    return (rows.repartition(key) if table == "customer" else rows).select(key, F.expr(source).alias("t"))


def _rows(name: str, table: str, source: str, key: str, columns: Callable[[Column], dict[str, Column]], sql: str | None) -> None:
    """Register a query of columns over one derived text a row, called ``t``.

    Columns are made when the query runs, as making them needs a session."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _texts(spark, sf_dir, table, key, source).select(key, *(c.alias(n) for n, c in columns(F.col("t")).items()))

    QUERIES[name] = run
    if sql is not None:
        ORACLES[name] = f"WITH s AS (SELECT {key}, {source} AS t FROM {table}) {sql}"


def _q(pattern: str) -> str:
    """A Java pattern as a DuckDB string literal."""
    return "'" + pattern.replace(r"\z", "$").replace("'", "''") + "'"


_TRIM = lambda x: f"regexp_replace({x}, {_q(f'^{text.SPACE}+|{text.SPACE}+$')}, '', 'g')"
_LIT = lambda s: "'" + s.replace("'", "''") + "'"

# --- text normalisation -------------------------------------------------------------------
_ARTIFACTS = f"regexp_replace(regexp_replace(t, {_q(f'[{text.INVISIBLE}]')}, '', 'g'), {_q(f'[{text.NARROW}]')}, ' ', 'g')"
for _sign, _letters in text.LIGATURES.items():
    _ARTIFACTS = f"replace({_ARTIFACTS}, '{_sign}', '{_letters}')"
_FOLD = lambda x: f"translate({x}, {_LIT(text.COMPAT_FROM)}, {_LIT(text.COMPAT_TO)})"
_SQUEEZE = lambda x: _TRIM(f"regexp_replace(regexp_replace(regexp_replace({x}, '[ \t]+', ' ', 'g'), ' ?\n ?', '\n', 'g'), '\n{{3,}}', '\n\n', 'g')")
_rows("clean_text", "documents", NOISY, "doc_id", lambda T: {"cleaned": text.clean(T)}, f"SELECT doc_id, {_SQUEEZE(_FOLD(_ARTIFACTS))} AS cleaned FROM s")
_rows("compat_chars", "documents", NOISY, "doc_id", lambda T: {"folded": text.fold_compat(T), "needs": text.needs_folding(T)}, f"SELECT doc_id, {_FOLD('t')} AS folded, regexp_matches(t, {_q(f'[{text.COMPAT_SET}]')}) AS needs FROM s")
_rows("artifact_repair", "documents", NOISY, "doc_id", lambda T: {"repaired": text.repair_artifacts(T)}, f"SELECT doc_id, {_ARTIFACTS} AS repaired FROM s")
_rows("whitespace_norm", "documents", NOISY, "doc_id", lambda T: {"spaced": text.normalize_space(T)}, f"SELECT doc_id, {_SQUEEZE('t')} AS spaced FROM s")
_rows("utf16_length", "documents", NOISY, "doc_id", lambda T: {"n": text.utf16_length(T)}, "SELECT doc_id, length(t) + length(regexp_replace(t, '[^\\x{10000}-\\x{10ffff}]', '', 'g')) AS n FROM s")

# --- extraction ---------------------------------------------------------------------------
_EMAIL = f"nullif(regexp_extract(t, {_q(extract.EMAIL)}), '')"
_PHONE = f"CASE WHEN regexp_matches(t, {_q(extract.PHONE)}) THEN concat_ws('-', {', '.join(f'regexp_extract(t, {_q(extract.PHONE)}, {k})' for k in (1, 2, 3))}) END"
_first = lambda values, source="t": "CASE " + " ".join(f"WHEN contains({source}, '{v}') THEN {r}" for v, r in values) + " END"
_CITY, _DEGREE, _LEVEL = _first((c, f"'{c}'") for c in CITIES), _first((d, f"'{d}'") for d in DEGREES), _first((d, str(n)) for d, n in DEGREES.items())
_STATED = f"CAST(nullif(regexp_extract(t, {_q(extract.YEARS)}, 1), '') AS INT)"
_SEEN = f"list_filter(list_transform(regexp_extract_all(t, {_q(extract.YEAR)}, 1), lambda y: CAST(y AS INT)), lambda y: y BETWEEN {extract.FIRST_YEAR} AND {AS_OF})"
_SPAN = f"({AS_OF} - list_min({_SEEN}))"
_YEARS = f"coalesce({_STATED}, CASE WHEN {_SPAN} > 0 AND {_SPAN} < {extract.MAX_SPAN} THEN {_SPAN} END)"
_LINES = f"list_filter(list_transform(string_split(t, chr(10)), lambda x: {_TRIM('x')}), lambda x: x <> '')[1:{extract.NAME_LINES}]"
_NAME = f"coalesce({_TRIM(f'nullif(regexp_extract(t, {_q(extract.NAME_LABEL)}, 1), {_LIT(str())})')}, list_filter({_LINES}, lambda x: regexp_matches(x, {_q(extract.NAME_LINE)}))[1])"
_HIT = lambda s: f"contains(lower(t), {_LIT(s.lower())}) AND regexp_matches(t, {_q(extract.skill_pattern(s))})" if s.isascii() else f"contains(t, '{s}')"
_ALL = "list_filter([" + ", ".join(f"CASE WHEN {_HIT(s)} THEN {_LIT(s)} END" for s in SKILLS) + "], lambda x: x IS NOT NULL)"
_SKILLS = f"list_filter({_ALL}, lambda x: NOT (x = 'Java' AND {_HIT('JavaScript')}) AND NOT (x = 'Vue' AND {_HIT('Vue.js')}))"

_rows("contact_email", "documents", "text", "doc_id", lambda T: {"email": extract.email(T)}, f"SELECT doc_id, {_EMAIL} AS email FROM s")
_rows("contact_phone", "documents", "text", "doc_id", lambda T: {"phone": extract.phone(T)}, f"SELECT doc_id, {_PHONE} AS phone FROM s")
_rows("skill_detect", "customer", RESUME, "c_custkey", lambda T: {"skills": F.array_join(extract.skills(T), ",")}, f"SELECT c_custkey, array_to_string({_SKILLS}, ',') AS skills FROM s")
_rows("city_first", "customer", RESUME, "c_custkey", lambda T: {"city": extract.city(T)}, f"SELECT c_custkey, {_CITY} AS city FROM s")
_rows("degree_level", "customer", RESUME, "c_custkey", lambda T: {"degree": extract.degree(T), "level": extract.degree_level(T)}, f"SELECT c_custkey, {_DEGREE} AS degree, {_LEVEL} AS level FROM s")
_rows("name_detect", "customer", RESUME, "c_custkey", lambda T: {"name": extract.name(T)}, f"SELECT c_custkey, {_NAME} AS name FROM s")
_rows("experience_years", "customer", RESUME, "c_custkey", lambda T: {"years": extract.years(T, AS_OF)}, f"SELECT c_custkey, {_YEARS} AS years FROM s")
_RAW_DATE = "CASE o_orderkey % 4 WHEN 0 THEN concat(CAST(1990 + o_orderkey % 40 AS STRING), '年', CAST(1 + o_orderkey % 12 AS STRING), '月') WHEN 1 THEN CAST(2000 + o_orderkey % 20 AS STRING) WHEN 2 THEN concat(CAST(2000 + o_orderkey % 20 AS STRING), ' - ', CAST(o_orderkey % 9 AS STRING)) ELSE 'none' END"
_DP = "'^([0-9]{4})[^0-9]*([0-9]{1,2})?'"
_DATE = lambda x: f"CASE WHEN regexp_extract(replace({x}, ' ', ''), {_DP}, 1) = '' THEN {x} WHEN regexp_extract(replace({x}, ' ', ''), {_DP}, 2) = '' THEN regexp_extract(replace({x}, ' ', ''), {_DP}, 1) ELSE concat(regexp_extract(replace({x}, ' ', ''), {_DP}, 1), '.', lpad(regexp_extract(replace({x}, ' ', ''), {_DP}, 2), 2, '0')) END"
_rows("date_norm", "orders", _RAW_DATE, "o_orderkey", lambda T: {"date": extract.date(T)}, f"SELECT o_orderkey, {_DATE('t')} AS date FROM s")


def _education(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _table(spark, sf_dir, "customer").select("c_custkey", F.posexplode(extract.education(F.expr(RESUME))).alias("ord", "e"))
    return found.select("c_custkey", "ord", "e.*")


QUERIES["education_extract"] = _education
ORACLES["education_extract"] = f"""
WITH s AS (SELECT c_custkey, {RESUME} AS t FROM customer),
l AS (SELECT c_custkey, i, string_split(t, chr(10))[i] AS line FROM (SELECT *, unnest(generate_series(1, len(string_split(t, chr(10))))) AS i FROM s)),
e AS (SELECT c_custkey, i, nullif(regexp_extract(line, {_q(extract.SCHOOL)}, 1), '') AS school, nullif(regexp_extract(line, {_q(extract.MAJOR)}, 1), '') AS major, {_first(((d, f"'{d}'") for d in DEGREES), 'line')} AS degree, regexp_extract_all(line, {_q(extract.DATE)})[-1] AS d FROM l),
f AS (SELECT *, row_number() OVER (PARTITION BY c_custkey, school ORDER BY i) AS k FROM e WHERE school IS NOT NULL)
SELECT c_custkey, ord, school, major, degree, graduation_time FROM (
  SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY i) - 1 AS INT) AS ord, school, CASE WHEN major <> school THEN major END AS major, degree, CASE WHEN d IS NOT NULL THEN {_DATE("d")} END AS graduation_time FROM f WHERE k = 1) WHERE ord < 5"""

_FIELDS = ("school", "major", "degree", "graduation_time")


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _texts(spark, sf_dir, "customer", "c_custkey", RESUME).select("c_custkey", extract.profile(F.col("t")).alias("p"))
    schools = F.transform("p.education", lambda e: F.concat_ws("|", *(F.coalesce(e[f], F.lit("")) for f in _FIELDS)))
    return found.select("c_custkey", "p.name", "p.phone", "p.email", "p.city", F.array_join(schools, ";").alias("education"), F.array_join("p.skills", ",").alias("skills"))


QUERIES["profile"] = _profile
ORACLES["profile"] = f"""
WITH s AS (SELECT c_custkey, {RESUME} AS t FROM customer),
education AS ({ORACLES["education_extract"]}),
schools AS (SELECT c_custkey, string_agg(concat({", '|', ".join(f"coalesce({f}, '')" for f in _FIELDS)}), ';' ORDER BY ord) AS education FROM education GROUP BY c_custkey)
SELECT c_custkey, {_NAME} AS name, {_PHONE} AS phone, {_EMAIL} AS email, {_CITY} AS city, coalesce(education, '') AS education, array_to_string({_SKILLS}, ',') AS skills
FROM s LEFT JOIN schools USING (c_custkey)"""


# --- matching -----------------------------------------------------------------------------
def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = score.candidate_features(_texts(spark, sf_dir, "customer", "c_custkey", RESUME), F.col("t"), AS_OF).drop("t")
    jobs = _table(spark, sf_dir, "nation").select("n_nationkey", F.expr(JOB).alias("t"))
    return score.match(score.pairs(people, score.job_features(jobs, F.col("t")).drop("t"), sized_by=jobs))


_NUM = lambda x: f"regexp_replace(CAST({x} AS VARCHAR), '\\.0$', '')"
_R1 = lambda x: f"greatest(0.0, least(100.0, floor(({x}) * 10 + 0.5) / 10.0))"
_MATCH = f"""
WITH p AS (SELECT c_custkey, {_SKILLS} AS skills, CAST(coalesce({_YEARS}, 0) AS INT) AS years, coalesce({_LEVEL}, 3) AS level FROM (SELECT c_custkey, {RESUME} AS t FROM customer)),
j AS (SELECT n_nationkey, {_SKILLS} AS required, coalesce({_STATED}, 3) AS required_years, coalesce({_LEVEL}, 3) AS required_level FROM (SELECT n_nationkey, {JOB} AS t FROM nation)),
m AS (SELECT *, list_filter(required, lambda x: list_contains(list_transform(skills, lambda y: lower(y)), lower(x))) AS matched, list_filter(required, lambda x: NOT list_contains(list_transform(skills, lambda y: lower(y)), lower(x))) AS missing FROM p, j),
q AS (SELECT *, CASE WHEN len(required) = 0 THEN 60.0 ELSE {_R1("CAST(len(matched) AS DOUBLE) / len(required) * 100")} END::DOUBLE AS skill_score,
  CAST({_R1("CAST(70 + CASE WHEN years >= required_years THEN least((years - required_years) * 8, 30) ELSE greatest((years - required_years) * 12, -70) END AS DOUBLE)")} AS DOUBLE) AS experience_score,
  CAST({_R1("CAST(80 + CASE WHEN level >= required_level THEN least((level - required_level) * 8, 20) ELSE greatest((level - required_level) * 15, -80) END AS DOUBLE)")} AS DOUBLE) AS education_score FROM m),
r AS (SELECT *, CAST({_R1("skill_score * 0.5::DOUBLE + experience_score * 0.3::DOUBLE + education_score * 0.2::DOUBLE")} AS DOUBLE) AS overall_score FROM q)"""


def _pairs_query(name: str, columns: Callable[[], list[Column]], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: _scored(spark, sf_dir).select("c_custkey", "n_nationkey", *columns())
    ORACLES[name] = f"{_MATCH} SELECT c_custkey, n_nationkey, {sql} FROM r"


_pairs_query("score_components", lambda: [F.col(c) for c in ("skill_score", "experience_score", "education_score", "overall_score")], "skill_score, experience_score, education_score, overall_score")
_pairs_query("skill_overlap_semi", lambda: [F.array_join("matched", ",").alias("matched"), F.size("matched").alias("n")], "array_to_string(matched, ',') AS matched, CAST(len(matched) AS INT) AS n")
_pairs_query("skill_gap_anti", lambda: [F.array_join("missing", ",").alias("missing"), F.size("missing").alias("n")], "array_to_string(missing, ',') AS missing, CAST(len(missing) AS INT) AS n")
_SAID = lambda sentence, *values: "concat(" + ", ".join(x for part, value in zip(sentence, (*values, None)) for x in (_LIT(part), value) if x) + ")"
_SHOWN_SKILLS = lambda c: f"array_to_string({c}[1:{score.SHOWN_SKILLS}], {_LIT(score.LIST_SIGN)})"
_COMMENT = f"""concat(
  {_SAID(score.SKILL_SENTENCE, _NUM("skill_score"), "CAST(len(matched) AS VARCHAR)", "CAST(len(required) AS VARCHAR)", f"CASE WHEN len(matched) = 0 THEN {_LIT(score.NO_HIGHLIGHT)} ELSE {_SHOWN_SKILLS('matched')} END")},
  CASE WHEN len(missing) = 0 THEN {_LIT(score.COVERED)} ELSE {_SAID(score.GAP_SENTENCE, _SHOWN_SKILLS("missing"))} END,
  {_SAID(score.OTHER_SENTENCE, _NUM("experience_score"), _NUM("education_score"))}, {_LIT(score.CLOSING)})"""
_pairs_query("match_comment", lambda: [score.comment().alias("comment")], f"{_COMMENT} AS comment")
_QUESTIONS = f"""list_concat(
  list_transform(missing[1:{score.ASKED_SKILLS}], lambda x: {_SAID(score.GAP_QUESTION, "x")}),
  list_filter([CASE WHEN years < required_years THEN {_SAID(score.YEARS_QUESTION, "CAST(required_years AS VARCHAR)", "CAST(years AS VARCHAR)")} END,
    {_LIT(score.PROJECT_QUESTION)}, CASE WHEN len(missing) = 0 THEN {_LIT(score.QUALITY_QUESTION)} END], lambda x: x IS NOT NULL))"""
_pairs_query("interview_questions", lambda: [F.array_join(score.questions(), "\n").alias("questions")], f"array_to_string({_QUESTIONS}, chr(10)) AS questions")
_pairs_query("match_report", lambda: [F.col("overall_score"), F.col("skill_score"), score.comment().alias("comment"), F.array_join(score.questions(), "\n").alias("questions")], f"overall_score, skill_score, {_COMMENT} AS comment, array_to_string({_QUESTIONS}, chr(10)) AS questions")


def _ranked(top: int | None) -> Query:
    return lambda spark, sf_dir: score.rank(_scored(spark, sf_dir), "n_nationkey", "c_custkey", top, ids=_table(spark, sf_dir, "customer")).select("n_nationkey", "rank", "c_custkey", "overall_score")


_RANKED = f"{_MATCH} SELECT n_nationkey, CAST(rank AS INT) AS rank, c_custkey, overall_score FROM (SELECT *, row_number() OVER (PARTITION BY n_nationkey ORDER BY overall_score DESC, c_custkey) AS rank FROM r)"
QUERIES |= {"rank_candidates_per_jd": _ranked(None), "top_candidates_per_jd": _ranked(TOP)}
ORACLES |= {"rank_candidates_per_jd": _RANKED, "top_candidates_per_jd": f"{_RANKED} WHERE rank <= {TOP}"}


def _skill_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates by mentioned term of a lexicon table (here the built-in list)."""
    lexicon = spark.createDataFrame([(x,) for x in SKILLS], "skill string")
    found = extract.skill_rows(_texts(spark, sf_dir, "customer", "c_custkey", RESUME), "t", lexicon)
    return found.groupBy("skill").agg(F.count("*").alias("candidates"), F.min("c_custkey").alias("first"))


QUERIES["skill_detect_join"] = _skill_join
ORACLES["skill_detect_join"] = f"WITH s AS (SELECT c_custkey, {RESUME} AS t FROM customer) SELECT skill, count(*) AS candidates, min(c_custkey) AS first FROM (SELECT c_custkey, unnest({_ALL}) AS skill FROM s) GROUP BY skill"

# --- JSON ---------------------------------------------------------------------------------
_VALUE = "CASE event_id % 10 WHEN 9 THEN NULL WHEN 7 THEN concat('{\"k\":', n, ',\"b\":true}') ELSE concat('{\"k\":', n, '}') END"
_LABEL = "CASE event_id % 10 " + " ".join(f"WHEN {k} THEN '{jsonfix.LABELS[v]}'" for k, v in {1: "fence", 2: "fragment", 3: "comments", 4: "commas", 5: "quotes", 6: "fullwidth", 7: "literals", 8: "truncated"}.items()) + " ELSE '' END"
_NUMBER = "regexp_extract(props, '-?[0-9]+')"
_rows("json_repair_value", "events", DAMAGED, "event_id", lambda T: {"value": jsonfix.repaired(T)["value"]}, None)
ORACLES["json_repair_value"] = f"SELECT event_id, {_VALUE} AS value FROM (SELECT event_id, {_NUMBER} AS n FROM events)"
_rows("json_repair_log", "events", DAMAGED, "event_id", lambda T: {"repairs": F.array_join(jsonfix.repaired(T)["repairs"], ","), "ok": jsonfix.repaired(T)["ok"]}, f"SELECT event_id, {_LABEL} AS repairs, event_id % 10 <> 9 AS ok FROM s")

#: Text, its value (None: it can't be repaired) and the steps that changed it.
_CASES = [
    ('{"a":1}', '{"a":1}', ""),
    (chr(0xFEFF) + ' {"a": [1, 2.50, 1e2, -0.0]} ', '{"a":[1,2.5,100,0]}', ""),
    ('{"a":0.00001,"b":1e-7,"c":1152921504606846976,"d":1e21,"e":123456789.125}', '{"a":0.00001,"b":1e-7,"c":1152921504606847000,"d":1e+21,"e":123456789.125}', ""),
    ("[" + "9" * 400 + ",1e999]", "[null,null]", ""),
    ('{"a":"' + chr(92) + 'ud800x"}', '{"a":"' + chr(0xFFFD) + 'x"}', ""),
    ('{"a":"' + chr(92) + "ud83d" + chr(92) + 'ude00"}', '{"a":"' + chr(0x1F600) + '"}', ""),
    ("[" * 3000 + "]" * 3000, "[" * 3000 + "]" * 3000, ""),
    ("[" * 200_000, None, "truncated"),
    ('```json\n{"a":1}\n```', '{"a":1}', "fence"),
    ('```\n[1]\n```', "[1]", "fence"),
    ("{“a”：“b”，“c”：1}", '{"a":"b","c":1}', "fullwidth"),
    ('Here it is: {"a":"}{"} and more', '{"a":"}{"}', "fragment"),
    ('{"a":1, // one\n"b":"//no"}', '{"a":1,"b":"//no"}', "comments"),
    ('{"a":1 /* one\n two */}', '{"a":1}', "comments"),
    ("{'a':'it" + chr(92) + "'s','b':\"don't\"}", '{"a":"it\'s","b":"don\'t"}', "quotes"),
    ('{"a":[1,2,],}', '{"a":[1,2]}', "commas"),
    ('{"a":"x\ty\nz\r"}', '{"a":"x' + chr(92) + "ty" + chr(92) + 'nz"}', "controls"),
    ('{"a":True,"b":False,"c":None,"d":NaN,"e":"None"}', '{"a":true,"b":false,"c":null,"d":null,"e":"None"}', "literals"),
    ('{"a":1,"b":[1,2', '{"a":1,"b":[1]}', "truncated"),
    ('{"a":"b","c":"cut', '{"a":"b"}', "truncated"),
    ("```json\n{'a':1,}\n```", '{"a":1}', "fence,quotes,commas"),
    ("Here you are:\n{'name': '张伟', // who\n 'said': “if (a) { b }”, 'skills': ['React', 'Go',],}\nBye", '{"name":"张伟","said":"if (a) { b }","skills":["React","Go"]}', "fullwidth,fragment,comments,quotes,commas"),
    ("```json\n{\n  'name': '张伟',   // who\n  'city': “杭州”,\n}\n```", '{"name":"张伟","city":"杭州"}', "fence,fullwidth,comments,quotes,commas"),
    ('{"said":"他说：' + chr(92) + '"方案（A）；' + chr(92) + '""}', '{"said":"他说：' + chr(92) + '"方案（A）；' + chr(92) + '""}', ""),
    ('{"education":[{"school":"浙江大学","major":"软件工程"},{"school":"某', '{"education":[{"school":"浙江大学","major":"软件工程"}]}', "truncated"),
    ('{"score": 82, "comment": "好", "questions": ["问题一", "问题二', '{"score":82,"comment":"好","questions":["问题一"]}', "truncated"),
    ("抱歉，我无法完成。", None, "fullwidth"),
    ("nothing at all", None, ""),
    ("", None, ""),
    (None, None, ""),
]


def _json_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.createDataFrame([(k, c[0]) for k, c in enumerate(_CASES)], "id int, raw string").repartition(3)
    done = raw.select("id", jsonfix.repaired(F.col("raw")).alias("r"))
    return done.select("id", F.col("r.value").alias("value"), F.array_join("r.repairs", ",").alias("repairs"), F.col("r.ok").alias("ok"))


QUERIES["json_repair_cases"] = _json_cases

_NO_NAME, _NO_SCHOOL, _NO_SKILL, _NO_COMMENT = (jsonfix.WARNINGS[k] for k in ("no_name", "no_education", "no_skills", "no_comment"))
_MANY = lambda n: [f"s{k}" for k in range(n)]
#: Text of a profile, and what of it isn't empty: fields, schools, skills, and the note (warnings or the error code).
_PROFILES = [
    ('{"name":"张伟","phone":"138","email":"a@b.c","city":"杭州","education":[{"school":"浙江大学","major":"软件工程","degree":"本科","graduation_time":"2018.06"}],"skills":["Go","React"]}',
     {"name": "张伟", "phone": "138", "email": "a@b.c", "city": "杭州", "education": "浙江大学|软件工程|本科|2018.06", "skills": "Go,React"}),
    ('{"name":"A","phone":"","email":null}', {"name": "A", "note": f"{_NO_SCHOOL};{_NO_SKILL}"}),
    ('{"name": " A ", "email": "bad", "education": {"university": "U", "subject": 3}, "skills": "x, y；z"}', {"name": "A", "email": "bad", "education": "U|3||", "skills": "x,y,z", "note": "education 不是数组，已包装为单元素数组;skills 是字符串，已按分隔符拆成 3 项;邮箱格式可能不合法：bad"}),
    ('{"name":"B","education":[{"schoolName":"清华大学","degree":"硕士","graduationDate":"2020-06"},{"school":"S","graduationTime":"1"},{"education":"大专","graduation_date":"2"}],"skills":"a、b|c\\nd"}', {"name": "B", "education": "清华大学||硕士|2020-06;S|||1;||大专|2", "skills": "a,b,c,d", "note": "skills 是字符串，已按分隔符拆成 4 项"}),
    ('{"name": null, "education": null, "skills": [1, " ", "q"]}', {"skills": "q", "note": f"education 为 null，已置为空数组;skills 中有 2 项不是有效文本，已忽略;{_NO_NAME};{_NO_SCHOOL}"}),
    ('{"name":"C","education":[{"school":"S"},"junk",null,42],"skills":[1,2,3]}', {"name": "C", "education": "S|||", "note": f"education[1] 不是对象（收到 string），已跳过;education[2] 不是对象（收到 null），已跳过;education[3] 不是对象（收到 number），已跳过;skills 中有 3 项不是有效文本，已忽略;{_NO_SKILL}"}),
    ('{"name": 7, "email": "a@b.c", "education": [5, {"school": ""}], "skills": {"a": 1}}', {"name": "7", "email": "a@b.c", "education": "|||", "note": f"education[0] 不是对象（收到 number），已跳过;skills 的类型不是数组（收到 object），已置为空列表;{_NO_SKILL}"}),
    ('{"name": 0.00001, "email": 1152921504606846976, "education": "", "skills": "a"}', {"name": "0.00001", "email": "1152921504606847000", "skills": "a", "note": f"邮箱格式可能不合法：1152921504606847000;{_NO_SCHOOL}"}),
    ('{"name": true, "email": ["x"], "education": "本科", "skills": ""}', {"name": "true", "note": f"education 的类型是 string，不是数组或对象，已忽略该字段;{_NO_SCHOOL};{_NO_SKILL}"}),
    ('{"name": "B", "education": 3, "skills": 7}', {"name": "B", "note": f"education 的类型是 number，不是数组或对象，已忽略该字段;skills 的类型不是数组（收到 number），已置为空列表;{_NO_SCHOOL};{_NO_SKILL}"}),
    (f'{{"name":"D","education":{{}},"skills":{json.dumps(_MANY(21))}}}', {"name": "D", "education": "|||", "skills": ",".join(_MANY(21)), "note": "education 不是数组，已包装为单元素数组;skills 有 21 项，超过约定的 20 项上限（未裁剪，如需收敛请在调用侧处理）"}),
    (f'{{"name":"D","education":[{{}}],"skills":{json.dumps(_MANY(20))}}}', {"name": "D", "education": "|||", "skills": ",".join(_MANY(20))}),
    ('{"name": "' + chr(92) + 'udfff", "education": [{}], "skills": ["' + chr(92) + 'ud800"]}', {"name": chr(0xFFFD), "education": "|||", "skills": chr(0xFFFD)}),
    ("[1,2,3]", "AI_INVALID_SHAPE"), ('"text"', "AI_INVALID_SHAPE"), ("null", "AI_INVALID_SHAPE"), ('{"name":', "AI_INVALID_JSON"),
]
_MISSING = lambda field: ";".join(jsonfix.WARNINGS[k].format(field=field) for k in ("missing", "no_number"))
#: Text of a report, and its four scores, comment, questions and note.
_REPORTS = [
    ('{"overall_score":82,"skill_score":88,"experience_score":80,"education_score":75,"comment":"好","interview_questions":["一","二"]}', (82.0, 88.0, 80.0, 75.0, "好", "一,二", "")),
    ('{"overall_score": "85分", "skill_score": 82.75, "experience_score": 120, "education_score": -3, "comment": "ok", "interview_questions": ["a", "b"]}', (85.0, 82.8, 100.0, 0.0, "ok", "a,b", "overall_score 是字符串（85分），已解析为数值;skill_score 已四舍五入到一位小数;experience_score 为 120，已夹取到上限 100;education_score 为 -3，已夹取到下限 0")),
    ('{"overall_score": true, "skill_score": "88%", "experience_score": "none", "education_score": 3, "reason": " r ", "questions": "p"}', (0.0, 88.0, 0.0, 3.0, "r", "p", "overall_score 不是有效数字，已置为 0;skill_score 是字符串（88%），已解析为数值;experience_score 不是有效数字，已置为 0")),
    ('{"skill_score": 1, "experience_score": 2, "education_score": 3}', (0.0, 1.0, 2.0, 3.0, "", "", f"{_MISSING('overall_score')};{_NO_COMMENT}")),
    ('{"comment": "c"}', (0.0, 0.0, 0.0, 0.0, "c", "", ";".join(map(_MISSING, jsonfix.SCORES)))),
    ('{"overall_score": ' + "9" * 400 + ', "skill_score": "' + "9" * 400 + '", "experience_score": 1e400, "education_score": 99.96, "summary": 5, "interviewQuestions": ["a", 1]}', (0.0, 0.0, 0.0, 100.0, "5", "a", "overall_score 不是有效数字，已置为 0;skill_score 是字符串（" + "9" * 400 + "），已解析为数值;skill_score 不是有效数字，已置为 0;experience_score 不是有效数字，已置为 0;education_score 已四舍五入到一位小数;interview_questions 中有 1 项不是有效文本，已忽略")),
    ('"x"', (None, None, None, None, None, None, "AI_INVALID_SHAPE")),
]


def _values(rows: list[tuple], names: list[str]) -> str:
    cell = lambda x: "NULL" if x is None else _LIT(x) if isinstance(x, str) else str(x) if isinstance(x, int) and not isinstance(x, bool) else str(x).lower() if isinstance(x, bool) else f"CAST({x} AS DOUBLE)"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) v({', '.join(names)})"


ORACLES["json_repair_cases"] = _values([(k, value, ",".join(jsonfix.LABELS[x] for x in steps.split(",") if x), value is not None) for k, (_, value, steps) in enumerate(_CASES)], ["id", "value", "repairs", "ok"])


def _note(c: Column) -> Column:
    return F.coalesce(c["error_code"], F.array_join(c["warnings"], ";"))


_PROFILE_COLUMNS = ("name", "phone", "email", "city", "education", "skills", "note")


def _profile_row(expected: dict | str) -> tuple:
    if isinstance(expected, str):
        return (None, None, None, None, None, None, expected)
    return (*(expected.get(c) for c in _PROFILE_COLUMNS[:4]), *(expected.get(c, "") for c in _PROFILE_COLUMNS[4:]))


def _coerce_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.createDataFrame([(k, r) for k, (r, _) in enumerate(_PROFILES)], "id int, raw string")
    p = raw.select("id", jsonfix.coerced_profile(F.col("raw")).alias("p"))
    c = F.col("p")
    schools = F.array_join(F.transform(c["education"], lambda e: F.concat_ws("|", *(F.coalesce(e[f], F.lit("")) for f in _FIELDS))), ";")
    return p.select("id", *(c[f].alias(f) for f in _PROFILE_COLUMNS[:4]), schools.alias("education"), F.array_join(c["skills"], ",").alias("skills"), _note(c).alias("note"))


def _coerce_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.createDataFrame([(k, r) for k, (r, _) in enumerate(_REPORTS)], "id int, raw string")
    p = raw.select("id", jsonfix.coerced_report(F.col("raw")).alias("p"))
    c = F.col("p")
    return p.select("id", *(c[s].alias(s) for s in jsonfix.SCORES), c["comment"].alias("comment"), F.array_join(c["interview_questions"], ",").alias("questions"), _note(c).alias("note"))


QUERIES |= {"coerce_profile": _coerce_profile, "coerce_report": _coerce_report}
ORACLES["coerce_profile"] = _values([(k, *_profile_row(e)) for k, (_, e) in enumerate(_PROFILES)], ["id", *_PROFILE_COLUMNS])
ORACLES["coerce_report"] = _values([(k, *e) for k, (_, e) in enumerate(_REPORTS)], ["id", *jsonfix.SCORES, "comment", "questions", "note"])

# --- layout, budgets, display -------------------------------------------------------------
_RUN = "seq: int, x: double, y: double, width: double, height: double, scale: double, has_eol: boolean, str: string"
_PAGES = [
    ([(0, 50.0, 100.0, 20.0, 10.0, 10.0, False, "b"), (1, 10.0, 101.0, 20.0, 10.0, 10.0, False, "a"), (2, 10.0, 80.0, 10.0, 10.0, 10.0, False, "张"), (3, 30.0, 80.0, 10.0, 10.0, 10.0, False, "伟")], "a b|张伟"),
    ([(0, 0.0, 10.0, 5.0, 0.0, 0.0, False, "x"), (1, 5.0, 10.0, 5.0, 0.0, 0.0, True, "y"), (2, 20.0, 10.0, 5.0, 0.0, 0.0, False, "z"), (3, 0.0, 0.0, 5.0, 0.0, 0.0, False, " ")], "x|y z"),
]


def _layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.createDataFrame([(k, p) for k, (p, _) in enumerate(_PAGES)], f"id int, items array<struct<{_RUN}>>")
    return pages.select("id", F.array_join(layout.lines(F.col("items")), "|").alias("page"))


QUERIES["layout_lines"] = _layout
ORACLES["layout_lines"] = _values([(k, e) for k, (_, e) in enumerate(_PAGES)], ["id", "page"])

_CLAMPED = lambda n: f"CASE WHEN length(t) > {n} THEN concat(left(t, {n}), {_LIT(text.CUT_BEFORE)}, CAST(length(t) AS VARCHAR), {_LIT(text.CUT_AFTER.format(n))}) ELSE t END"
_rows("budget_clamp", "documents", "text", "doc_id", lambda T: {"original_chars": text.clamp_input(T, 8000)["original_chars"], "used_chars": text.clamp_input(T, 8000)["used_chars"], "truncated": text.clamp_input(T, 8000)["truncated"], "shown": text.clamp_input(T, 8000)["text"]},
      f"SELECT doc_id, length(t) AS original_chars, least(length(t), 8000) AS used_chars, length(t) > 8000 AS truncated, {_CLAMPED(8000)} AS shown FROM s")


def _preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.slice(F.split("text", "\n"), 1, 40)).alias("pos", "line"))
    return lines.select("doc_id", (F.col("pos") + 1).alias("line_no"), "line")


QUERIES["line_preview"] = _preview
ORACLES["line_preview"] = "SELECT doc_id, CAST(i AS INT) AS line_no, string_split(text, chr(10))[i] AS line FROM (SELECT doc_id, text, unnest(generate_series(1, least(40, len(string_split(text, chr(10)))))) AS i FROM documents)"
_WIDTH = lambda x: f"(length(regexp_replace({x}, {_q(f'[{text.ZERO_WIDTH}]')}, '', 'g')) + length(regexp_replace({x}, {_q(f'[^{text.WIDE}]')}, '', 'g')))"
_rows("display_width", "customer", RESUME, "c_custkey", lambda T: {"width": text.display_width(T)}, f"SELECT c_custkey, {_WIDTH('t')} AS width FROM s")
_rows("pad_display", "nation", "concat('国', n_name)", "n_nationkey", lambda T: {"padded": text.pad_display(T, 20)}, f"SELECT n_nationkey, concat(t, repeat(' ', greatest(0, 20 - {_WIDTH('t')}))) AS padded FROM s")
_WIDER = "CASE n_nationkey % 3 WHEN 0 THEN concat(n_name, ' republic') WHEN 1 THEN concat('国', n_name, '中华人民', n_name) ELSE concat(left(n_name, 3), '共和国e\u0301x') END"
_rows("truncate_display", "nation", _WIDER, "n_nationkey", lambda T: {"cut": text.truncate_display(T, 12)},
      f"SELECT n_nationkey, CASE WHEN {_WIDTH('t')} <= 12 THEN t ELSE concat(left(t, list_max(list_filter(generate_series(0, length(t)), lambda i: {_WIDTH('left(t, i)')} <= 11))), '…') END AS cut FROM s")

#: Text, columns, and its lines; then the same behind "1. " and three blanks.
_WRAPPED = [
    ("0123456789abcdefghij", 10, "0123456789|abcdefghij", "1. 0123456789|   abcdefghij"),
    ("hello TypeScript world", 12, "hello|TypeScript|world", "1. hello|   TypeScript|   world"),
    ("一二三四五，六七", 6, "一二三四五，|六七", "1. 一二三四五，|   六七"),
    ("第一行\n第二行", 20, "第一行|第二行", "1. 第一行|   第二行"),
    ("a\n\nb", 20, "a||b", "1. a|   |   b"),
    ("", 20, "", "1. "),
    ("one two  three four", 13, "one two|three four", "1. one two|   three four"),
    ("ab 张伟张伟张伟张伟 cd", 13, "ab 张伟张伟张|伟张伟 cd", "1. ab 张伟张|   伟张伟张伟|   cd"),
    ("see https://example.com/a/long/path, then", 16, "see|https://example.|com/a/long/path,|then", "1. see|   https://examp|   le.com/a/long|   /path, then"),
    ("e" + chr(769) * 3 + "bcdefghijk", 10, "e" + chr(769) * 3 + "|bcdefghijk", "1. e" + chr(769) * 3 + "|   bcdefghijk"),
]


def _wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.createDataFrame([(k, t, n) for k, (t, n, *_) in enumerate(_WRAPPED)], "id int, t string, n int")
    plain, indented = (F.coalesce(*(F.when(F.col("n") == n, F.array_join(lines(n), "|")) for n in sorted({r[1] for r in _WRAPPED}))) for lines in (lambda n: wrap.wrap_lines(F.col("t"), n), lambda n: wrap.wrap_with_indent(F.col("t"), "1. ", "   ", n)))
    return raw.select("id", plain.alias("joined"), indented.alias("indented"))


QUERIES["wrap_lines"] = _wrap
ORACLES["wrap_lines"] = _values([(k, *r[2:]) for k, r in enumerate(_WRAPPED)], ["id", "joined", "indented"])
_rows("score_bar", "nation", "CAST(n_nationkey * 4.5 AS DOUBLE)", "n_nationkey", lambda T: {"bar": text.score_bar(F.lit("技能"), T), "band": text.score_band(T)},
      "SELECT n_nationkey, concat('  技能', repeat(' ', 8), '  ', repeat('█', CAST(floor(least(t, 100) / 100 * 20 + 0.5) AS INT)), repeat('░', 20 - CAST(floor(least(t, 100) / 100 * 20 + 0.5) AS INT)), '  ', format('{:.1f}', CAST(least(t, 100) AS DOUBLE))) AS bar, CASE WHEN t >= 80 THEN 'green' WHEN t >= 60 THEN 'yellow' ELSE 'red' END AS band FROM s")
_rows("format_bytes", "orders", "o_orderkey * o_orderkey % 5000000", "o_orderkey", lambda T: {"size": text.format_bytes(T)}, "SELECT o_orderkey, CASE WHEN t < 1024 THEN concat(CAST(t AS VARCHAR), ' B') WHEN t < 1048576 THEN concat(format('{:.1f}', floor(t / 1024.0::DOUBLE * 10 + 0.5) / 10), ' KB') ELSE concat(format('{:.1f}', floor(t / 1048576.0::DOUBLE * 10 + 0.5) / 10), ' MB') END AS size FROM s")
_INTS = "CASE o_orderkey % 5 WHEN 0 THEN concat(' +', CAST(o_orderkey AS STRING), ' ') WHEN 1 THEN concat('-', CAST(o_orderkey AS STRING)) WHEN 2 THEN '12abc' WHEN 3 THEN '99999999999999999' ELSE CAST(o_orderkey AS STRING) END"
_rows("positive_int", "orders", _INTS, "o_orderkey", lambda T: {"n": text.positive_int(T)}, "SELECT o_orderkey, CASE WHEN o_orderkey > 0 AND o_orderkey % 5 IN (0, 4) THEN o_orderkey END AS n FROM s")
_rows("mask_key", "nation", "concat('sk-', n_name)", "n_nationkey", lambda T: {"masked": text.mask_key(T), "url": text.base_url(F.concat(T, F.lit("//")))}, "SELECT n_nationkey, CASE WHEN length(t) > 8 THEN concat(left(t, 4), '****', right(t, 4)) ELSE '****' END AS masked, t AS url FROM s")
_ENV = "concat('# c', chr(10), 'export A=\"', n_name, '\"', chr(10), 'B = x=y', chr(10), 'A=', CAST(n_nationkey AS STRING))"
_rows("dotenv", "nation", _ENV, "n_nationkey", lambda T: {"a": text.dotenv(T)["A"], "b": text.dotenv(T)["B"]}, "SELECT n_nationkey, CAST(n_nationkey AS VARCHAR) AS a, 'x=y' AS b FROM s")

# --- errors, files, events ----------------------------------------------------------------
_CODES = [*files.EXIT_CODES, "OTHER"]
_CODE = "CASE event_id % 14 " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(_CODES)) + " END"
_rows("error_exit_codes", "events", _CODE, "event_id", lambda T: {"exit_code": files.exit_code(T)}, "SELECT event_id, CASE WHEN t IS NULL THEN 0 " + " ".join(f"WHEN t = '{c}' THEN {n}" for c, n in files.EXIT_CODES.items()) + " ELSE 1 END AS exit_code FROM s")
_JD = f"CASE doc_id % 4 WHEN 0 THEN '   ' WHEN 1 THEN repeat('{chr(0xFFFD)}', 9) WHEN 2 THEN NULL ELSE text END"
_rows("jd_validate", "documents", _JD, "doc_id", lambda T: {"error_code": files.jd_error(T, F.octet_length(T))}, "SELECT doc_id, CASE WHEN doc_id % 4 IN (0, 1) THEN 'JD_EMPTY' WHEN doc_id % 4 = 2 THEN 'JD_FILE_NOT_FOUND' WHEN trim(t) = '' THEN 'JD_EMPTY' END AS error_code FROM s")
_PDF = "CASE doc_id % 3 WHEN 0 THEN concat('%PDF-1.7', text) WHEN 1 THEN '' ELSE text END"
_rows("pdf_validate", "documents", _PDF, "doc_id", lambda T: {"error_code": files.pdf_error(F.octet_length(T), T.cast("binary"))}, "SELECT doc_id, CASE WHEN t = '' THEN 'PDF_UNREADABLE' WHEN NOT contains(left(t, 1024), '%PDF-') THEN 'NOT_A_PDF' END AS error_code FROM s")
_rows("http_retry_class", "events", "CAST(400 + event_id % 110 AS INT)", "event_id", lambda T: {"retryable": files.retryable(T), "class": files.failure_class(T), "downgrade": files.downgrade(T, F.lit("bad Response_Format"))},
      f"SELECT event_id, t IN {files.RETRYABLE} AS retryable, CASE WHEN t IN (401, 403) THEN 'auth' WHEN t = 404 THEN 'missing' WHEN t = 429 THEN 'throttled' WHEN t >= 500 THEN 'server' ELSE 'other' END AS class, t = 400 AS downgrade FROM s")
_rows("log_filter", "events", "CASE event_id % 4 WHEN 0 THEN 'error' WHEN 1 THEN 'warn' WHEN 2 THEN 'info' ELSE 'debug' END", "event_id", lambda T: {"shown": files.visible(T, "info")}, "SELECT event_id, t <> 'debug' AS shown FROM s")

#: Lines of a call's output: messages, reasoning, usage or none, errors, broken JSON and blank lines.
_LINE = """CASE WHEN event_id % 401 = 0 THEN '{"type":"error"}' WHEN event_id % 409 = 0 THEN '{"type":"turn.completed"' WHEN event_id % 11 = 0 THEN '   '
  WHEN event_id % 7 = 0 AND event_id % 2 = 0 THEN '{"type":"turn.completed"}' WHEN event_id % 7 = 0 THEN concat('{"type":"turn.completed","usage":{"input_tokens":', CAST(event_id % 100 AS STRING), ',"output_tokens":', CAST(event_id % 9 AS STRING), '}}')
  WHEN event_id % 5 = 0 THEN concat('{"type":"item.completed","item":{"type":"reasoning","text":"r', CAST(event_id AS STRING), '"}}') ELSE concat('{"type":"item.completed","item":{"type":"agent_message","text":"m', CAST(event_id AS STRING), '"}}') END"""
#: Calls whose output is below and above the cap, and one of a single null line.
_LARGE = [(-1, 3_900_000), (-2, 4_200_000)]


def _fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "events").selectExpr("user_id AS call_id", "event_id AS seq", f"{_LINE} AS line")
    large = spark.createDataFrame(_LARGE, "call_id long, n int").select("call_id", F.explode(F.array(
        F.struct(F.lit(1).alias("seq"), F.concat(F.lit('{"type":"item.completed","item":{"type":"agent_message","text":"ok","more":"'), F.repeat(F.lit("x"), F.col("n")), F.lit('"}}')).alias("line")),
        F.struct(F.lit(2).alias("seq"), F.lit('{"type":"turn.completed"}').alias("line")),
    )).alias("e")).select("call_id", F.col("e.seq").cast("long").alias("seq"), "e.line")
    return events.fold(events.parsed(lines.unionByName(large)))


QUERIES["event_fold"] = _fold
ORACLES["event_fold"] = f"""WITH l AS (SELECT user_id AS call_id, event_id AS seq, {_LINE} AS line FROM events),
e AS (SELECT *, line = '{{"type":"turn.completed"' AS bad FROM l),
g AS (SELECT call_id, arg_max(regexp_extract(line, '"text":"([^"]*)"', 1), seq) FILTER (line LIKE '%agent_message%') AS content, bool_or(line LIKE '{{"type":"turn.completed"%' AND NOT bad) AS done,
  bool_or(bad OR line = '{{"type":"error"}}') AS failed,
  arg_max(TRY_CAST(regexp_extract(line, 'input_tokens":([0-9]+)', 1) AS BIGINT) + TRY_CAST(regexp_extract(line, 'output_tokens":([0-9]+)', 1) AS BIGINT), seq) FILTER (line LIKE '%input_tokens%') AS tokens FROM e GROUP BY call_id)
SELECT *, done AND NOT failed AND coalesce(content, '') <> '' AS success FROM g
UNION ALL SELECT -1, 'ok', true, false, NULL, true UNION ALL SELECT -2, 'ok', true, true, NULL, false"""


# --- settings, renderings, commands -------------------------------------------------------
_rows("snippet", "documents", "text", "doc_id", lambda T: {"cut": text.snippet(T, 200)}, f"SELECT doc_id, regexp_replace(left(t, 200), {_q(text.SPACE + '+')}, ' ', 'g') AS cut FROM s")
_rows("empty_text", "documents", "CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'abc' ELSE text END", "doc_id", lambda T: {"suspected": files.suspected_scan(T, F.lit(1)), "error_code": files.text_error(T), "hint": files.text_hint(T, (F.col("doc_id") % 2).cast("int"))},
      "SELECT doc_id, length(t) < 30 AS suspected, CASE WHEN t = '' THEN 'PDF_EMPTY_TEXT' END AS error_code, CASE WHEN t = '' AND doc_id % 2 = 1 THEN 'SUSPECTED_SCAN' WHEN t = '' THEN 'NO_PAGES' END AS hint FROM s")
_rows("lenient_int", "orders", _INTS, "o_orderkey", lambda T: {"n": settings.lenient_int(T, 7)}, "SELECT o_orderkey, CASE WHEN o_orderkey = 0 THEN 7 WHEN o_orderkey % 5 = 1 THEN 7 WHEN o_orderkey % 5 = 2 THEN 12 WHEN o_orderkey % 5 = 3 THEN 99999999999999999 ELSE o_orderkey END AS n FROM s")
_rows("setting_precedence", "nation", "CASE n_nationkey % 3 WHEN 0 THEN 'codex' WHEN 1 THEN 'bad' END", "n_nationkey", lambda T: (lambda p: {"provider": p, "error_code": settings.provider_error(p, F.lit(None)), "url": settings.endpoint(F.concat(p, F.lit("//")), "chat/completions")})(settings.first_set(T, F.lit("openai"))),
      "SELECT n_nationkey, coalesce(t, 'openai') AS provider, CASE WHEN coalesce(t, 'openai') <> 'codex' THEN 'CONFIG_MISSING' END AS error_code, concat(coalesce(t, 'openai'), '/chat/completions') AS url FROM s")
_rows("retry_backoff", "events", "CAST(event_id % 4 AS INT)", "event_id", lambda T: {"least": settings.backoff_ms(T)["least"], "most": settings.backoff_ms(T)["most"]}, "SELECT event_id, CAST(400 * pow(2, t) AS BIGINT) AS least, CAST(400 * pow(2, t) + 199 AS BIGINT) AS most FROM s")
_rows("indent_hint", "nation", "concat(n_name, chr(10), 'b')", "n_nationkey", lambda T: {"hint": settings.indented(T)}, "SELECT n_nationkey, concat('      ', replace(t, chr(10), concat(chr(10), '      '))) AS hint FROM s")
_rows("email_plausible", "events", "CASE event_id % 4 WHEN 0 THEN 'a@b.c' WHEN 1 THEN 'bad' WHEN 2 THEN 'a b@c.d' ELSE 'a@b' END", "event_id", lambda T: {"plausible": settings.plausible_email(T)}, "SELECT event_id, event_id % 4 = 0 AS plausible FROM s")
_rows("prompt_budget", "documents", "text", "doc_id", lambda T: {"prompt": settings.prompt("Read:", {"A": text.clamp_input(T, 20000)["text"], "B": text.clamp_input(T, 8000)["text"]})},
      f"SELECT doc_id, concat('Read:', chr(10), 'A <<<', chr(10), {_CLAMPED(20000)}, chr(10), '>>>', chr(10), 'B <<<', chr(10), {_CLAMPED(8000)}, chr(10), '>>>') AS prompt FROM s")
_rows("metadata", "nation", """CASE n_nationkey % 3 WHEN 0 THEN concat('{"Title": "', n_name, '", "Author": 3}') WHEN 1 THEN '{"Creator": null, "CreationDate": "D:2020"}' ELSE 'broken' END""", "n_nationkey", lambda T: (lambda m: {"title": m["title"], "author": m["author"], "created": m["creationDate"]})(commands.metadata(T)),
      "SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN regexp_extract(t, '\"Title\": \"([^\"]*)\"', 1) END AS title, CAST(NULL AS VARCHAR) AS author, CASE WHEN n_nationkey % 3 = 1 THEN 'D:2020' END AS created FROM s")
_rows("preview_lines", "documents", "text", "doc_id", lambda T: (lambda p: {"shown": F.array_join(p["lines"], "\n"), "omitted": p["omitted"], "note": p["note"]})(render.preview(T, PREVIEW, 60)),
      f"SELECT doc_id, array_to_string(list_transform(generate_series(1, least({PREVIEW}, len(l))), lambda i: concat('  ', rpad(CAST(i AS VARCHAR), CAST(length(CAST(len(l) AS VARCHAR)) AS INT), ' '), ' │ ', CASE WHEN length(l[i]) <= 60 THEN l[i] ELSE concat(left(l[i], 59), '…') END)), chr(10)) AS shown, CAST(greatest(len(l) - {PREVIEW}, 0) AS INT) AS omitted, CASE WHEN len(l) > {PREVIEW} THEN concat({_LIT(render.OMITTED[0])}, CAST(len(l) - {PREVIEW} AS VARCHAR), {_LIT(render.OMITTED[1])}) END AS note FROM (SELECT doc_id, string_split(t, chr(10)) AS l FROM s)")

_SHOWN = [
    ("Java,C++,Python", [("U", None, "本科", "2018.06"), ("", None, None, None)], "  Java  C++|  Python", "  1. U · 本科  2018.06|  2. (信息缺失)", "  大小  3|  b     x"),
    ("", [], "  未提取到技能", "  未提取到教育经历", "  大小  0|  b     x"),
]


def _render(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(k, [s for s in r[0].split(",") if s], r[1]) for k, r in enumerate(_SHOWN)], "id int, had array<string>, went array<struct<school: string, major: string, degree: string, graduation_time: string>>")
    listed = render.facts({"大小": F.size("had"), "none": F.lit(None), "empty": F.lit(""), "b": F.lit("x")})
    return rows.select("id", *(F.array_join(c, "|").alias(n) for n, c in {"skills": render.skill_lines(F.col("had"), 10), "schools": render.school_lines(F.col("went")), "facts": listed}.items()))


QUERIES["render_profile"] = _render
ORACLES["render_profile"] = _values([(k, *r[2:]) for k, r in enumerate(_SHOWN)], ["id", "skills", "schools", "facts"])


_rows("render_marks", "nation", "CASE n_nationkey % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'warn' ELSE 'info' END", "n_nationkey",
      lambda T: {"status": render.status_line(T, F.lit("m")), "head": F.array_join(render.result_header(T, F.when(T == "ok", "s").when(T == "warn", "")), "|"), "title": render.section_title(T), "line": render.divider(F.when(T != "info", F.col("n_nationkey") * 10)), "red": render.painted(T, "red")},
      """SELECT n_nationkey, concat(CASE t WHEN 'ok' THEN '✔' WHEN 'warn' THEN '▲' ELSE '·' END, ' m') AS status, concat('|◆ ', t, CASE WHEN t = 'ok' THEN '|  s' ELSE '' END) AS head, concat('▌ ', t) AS title,
      repeat('─', CAST(CASE WHEN t = 'info' THEN 80 ELSE least(100, greatest(40, n_nationkey * 10)) END AS BIGINT)) AS line, concat(chr(27), '[31m', t, chr(27), '[0m') AS red FROM s""")  # fmt: skip


def _parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.createDataFrame([(f"p{k}", 100 + k, [p, p], '{"Title": "T"}') for k, (p, _) in enumerate(_PAGES)] + [("none", 5, [], None)], f"path string, bytes long, pages array<array<struct<{_RUN}>>>, info string")
    return commands.parse(docs).select("path", "bytes", "pages", "chars", F.col("metadata.title").alias("title"), F.col("suspectedScanned").alias("suspected"), "text", "error_code")


QUERIES["parse_command"] = _parse
_PAGE_TEXTS = [p.replace("|", "\n") for _, p in _PAGES]
ORACLES["parse_command"] = (
    " UNION ALL ".join(f"SELECT 'p{k}' AS path, {100 + k} AS bytes, 2 AS pages, {2 * len(p) + 2} AS chars, 'T' AS title, true AS suspected, concat({_LIT(p)}, chr(10), chr(10), {_LIT(p)}) AS text, NULL AS error_code" for k, p in enumerate(_PAGE_TEXTS))
    + " UNION ALL SELECT 'none', 5, 0, 0, NULL, false, '', 'PDF_EMPTY_TEXT'"
)
_CONTENT = """CASE WHEN c_custkey % 8 = 0 THEN concat('```json', chr(10), '{"name": "N', CAST(c_custkey AS STRING), '", "skills": ["a", "b"],}', chr(10), '```') ELSE 'no json' END"""


def _extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    people = _table(spark, sf_dir, "customer")
    responses = people.where("c_custkey % 4 = 0").select("c_custkey", F.expr(_CONTENT).alias("content"))
    out = commands.extract(people.select("c_custkey", F.expr(RESUME).alias("t")), responses, id_col="c_custkey", text_col="t")
    return out.select("c_custkey", "source", F.col("result.name").alias("name"), F.array_join("result.skills", ",").alias("skills"), F.size("repairs").alias("n_repairs"), "error_code")


QUERIES["extract_command"] = _extract
ORACLES["extract_command"] = f"SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'model' ELSE 'rules' END AS source, CASE c_custkey % 8 WHEN 0 THEN concat('N', CAST(c_custkey AS VARCHAR)) WHEN 4 THEN NULL ELSE {_NAME} END AS name, CASE c_custkey % 8 WHEN 0 THEN 'a,b' WHEN 4 THEN NULL ELSE array_to_string({_SKILLS}, ',') END AS skills, CAST(CASE WHEN c_custkey % 8 = 0 THEN 2 ELSE 0 END AS INT) AS n_repairs, CASE WHEN c_custkey % 8 = 4 THEN 'AI_INVALID_JSON' END AS error_code FROM (SELECT c_custkey, {RESUME} AS t FROM customer)"
_ANSWER = '{"overall_score": 88.04, "skill_score": 90, "experience_score": 85, "education_score": 80, "comment": "ok", "interview_questions": ["q"]}'


def _score(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _scored(spark, sf_dir)
    responses = _table(spark, sf_dir, "customer").where("c_custkey % 4 = 0").select("c_custkey", F.lit(1).cast(pairs.schema["n_nationkey"].dataType).alias("n_nationkey"), F.lit(_ANSWER).alias("content"))
    out = commands.score(pairs, responses, keys=("c_custkey", "n_nationkey"))
    return out.select("c_custkey", "n_nationkey", "source", F.col("result.overall_score").alias("overall_score"), F.col("result.comment").alias("comment"), F.size("result.interview_questions").alias("n_questions"), "error_code")


QUERIES["score_command"] = _score
_BY_MODEL = "c_custkey % 4 = 0 AND n_nationkey = 1"
ORACLES["score_command"] = f"{_MATCH} SELECT c_custkey, n_nationkey, CASE WHEN {_BY_MODEL} THEN 'model' ELSE 'rules' END AS source, CASE WHEN {_BY_MODEL} THEN 88.0::DOUBLE ELSE overall_score END AS overall_score, CASE WHEN {_BY_MODEL} THEN 'ok' ELSE {_COMMENT} END AS comment, CAST(CASE WHEN {_BY_MODEL} THEN 1 ELSE len({_QUESTIONS}) END AS INT) AS n_questions, CAST(NULL AS VARCHAR) AS error_code FROM r"


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
