"""Matching of candidates with job descriptions: features once a text, then arithmetic by pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parchmill.functions import extract
from parchmill.functions.text import number_text, round1

#: Job descriptions that may be broadcast, and their bytes as JSON; more are joined by blocks.
MAX_BROADCAST_JOBS = 10_000
MAX_BROADCAST_BYTES = 32 << 20
# The scoring rule's constants and sentences.
NO_SKILLS_SCORE, DEFAULT_YEARS, DEFAULT_LEVEL = 60.0, 3, 3
NO_HIGHLIGHT = "暂未识别到与岗位直接对应的技能"
COVERED = "岗位要求的技术栈基本已被简历覆盖。"
CLOSING = "（本结果由离线规则引擎生成，未调用大模型）"
PROJECT_QUESTION = "请介绍一个你主导过的、最能体现技术深度的项目，重点说明你在其中的具体职责与关键决策。"
QUALITY_QUESTION = "你如何保证交付质量？请结合一次线上问题排查经历说明你的方法论。"
LIST_SIGN, SHOWN_SKILLS, ASKED_SKILLS, MOST_QUESTIONS = "、", 5, 2, 5
SKILL_SENTENCE = ("技能匹配度 ", " 分：命中岗位要求 ", "/", " 项技能（", "）。")
GAP_SENTENCE = ("主要差距在于缺少 ", " 等相关经验。")
OTHER_SENTENCE = ("经验与学历维度分别得 ", " 分、", " 分。")
GAP_QUESTION = ("简历中没有体现 ", " 相关经验，请介绍你对该技术的了解，以及如果项目需要你会如何上手？")
YEARS_QUESTION = ("岗位期望 ", " 年以上经验，你目前约 ", " 年，请举例说明你如何在更短时间内承担同等复杂度的任务？")
# End of the fixed values.


def candidate_features(people: DataFrame, text: Column, as_of_year: int) -> DataFrame:
    """``people`` with skills, years and level in the text's place."""
    return people.select("*", extract.skills(text).alias("skills"), F.coalesce(extract.years(text, as_of_year), F.lit(0)).alias("years"), F.coalesce(extract.degree_level(text), F.lit(DEFAULT_LEVEL)).alias("level"))


def job_features(jobs: DataFrame, text: Column) -> DataFrame:
    return jobs.select("*", extract.skills(text).alias("required"), F.coalesce(extract.stated_years(text), F.lit(DEFAULT_YEARS)).alias("required_years"), F.coalesce(extract.degree_level(text), F.lit(DEFAULT_LEVEL)).alias("required_level"))


def _free(name: str, *frames: DataFrame) -> str:
    taken = {c.lower() for frame in frames for c in frame.columns}
    while name in taken:
        name += "_"
    return name


def pairs(people: DataFrame, jobs: DataFrame, max_broadcast: int = MAX_BROADCAST_JOBS, max_bytes: int = MAX_BROADCAST_BYTES, block: int = 1000, sized_by: DataFrame | None = None) -> DataFrame:
    """Each candidate with each job description: the jobs are the query set.  They are broadcast
    up to a checked count and size.  Beyond it both sides meet by blocks of jobs, and candidates
    are dealt to salts row by row (equal rows too), so that no task holds all candidates of a block.

    ``sized_by``: the rows that the jobs were made of, if these are cheaper to count."""
    found = (jobs if sized_by is None else sized_by).agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.to_json(F.struct("*")))), F.lit(0)).alias("size")).first()
    if found["n"] <= max_broadcast and found["size"] <= max_bytes:
        return people.crossJoin(F.broadcast(jobs))
    blocks = max(-(-found["n"] // block), -(-found["size"] // max_bytes))
    salts = int(people.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    salt, part = _free("salt", people, jobs), _free("block", people, jobs)
    dealt = lambda n: F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(n)).cast("int")
    left = people.withColumn(salt, dealt(salts)).withColumn(part, every(blocks))
    right = jobs.withColumn(part, dealt(blocks)).withColumn(salt, every(salts))
    return left.join(right, [part, salt]).drop(part, salt)


def _clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), round1(c)))


def _held(of: str, by: str, keep: bool) -> Column:
    """The entries of ``of`` that ``by`` holds (or not), whatever their case, in order."""
    lowered = F.transform(F.col(by), F.lower)
    return F.filter(F.array_distinct(of), lambda s: F.array_contains(lowered, F.lower(s)) if keep else ~F.array_contains(lowered, F.lower(s)))


def match(paired: DataFrame) -> DataFrame:
    """Adds matched, missing and the four scores."""
    out = paired.withColumns({"matched": _held("required", "skills", True), "missing": _held("required", "skills", False)})
    total = F.size("matched") + F.size("missing")
    gap, lift = F.col("years") - F.col("required_years"), F.col("level") - F.col("required_level")
    out = out.withColumns({
        "skill_score": F.when(total == 0, NO_SKILLS_SCORE).otherwise(_clamp(F.size("matched") / total * 100)),
        "experience_score": _clamp(70 + F.when(gap >= 0, F.least(gap * 8, F.lit(30))).otherwise(F.greatest(gap * 12, F.lit(-70)))),
        "education_score": _clamp(80 + F.when(lift >= 0, F.least(lift * 8, F.lit(20))).otherwise(F.greatest(lift * 15, F.lit(-80)))),
    })
    return out.withColumn("overall_score", _clamp(F.col("skill_score") * 0.5 + F.col("experience_score") * 0.3 + F.col("education_score") * 0.2))


def _filled(sentence: tuple[str, ...], *values: Column) -> Column:
    """The parts of a sentence with values between them."""
    parts = [F.lit(sentence[0])]
    for value, part in zip(values, sentence[1:]):
        parts += [value.cast("string"), F.lit(part)]
    return F.concat(*parts)


def comment() -> Column:
    top, gaps = (F.array_join(F.slice(c, 1, SHOWN_SKILLS), LIST_SIGN) for c in ("matched", "missing"))
    total = F.size("matched") + F.size("missing")
    shown = F.when(top == "", NO_HIGHLIGHT).otherwise(top)
    return F.concat(
        _filled(SKILL_SENTENCE, number_text(F.col("skill_score")), F.size("matched"), total, shown),
        F.when(gaps == "", COVERED).otherwise(_filled(GAP_SENTENCE, gaps)),
        _filled(OTHER_SENTENCE, number_text(F.col("experience_score")), number_text(F.col("education_score"))),
        F.lit(CLOSING),
    )


def questions() -> Column:
    about = F.transform(F.slice("missing", 1, ASKED_SKILLS), lambda s: _filled(GAP_QUESTION, s))
    short = F.when(F.col("years") < F.col("required_years"), _filled(YEARS_QUESTION, F.col("required_years"), F.col("years")))
    full = F.when(F.size("missing") == 0, QUALITY_QUESTION)
    return F.slice(F.concat(about, F.array_compact(F.array(short, F.lit(PROJECT_QUESTION), full))), 1, MOST_QUESTIONS)


#: Ranges of candidates that equal scores are counted by.
RANGES = 64


def rank(scored: DataFrame, job: str, person: str, top: int | None = None, ranges: int = RANGES, ids: DataFrame | None = None) -> DataFrame:
    """Candidates of each job by overall score, ties by id, all of them or the ``top`` first.

    With ``top`` Spark limits each group before the shuffle.  Without it no task holds all
    candidates of a job: they are counted by job, score (a thousand values) and range of ids,
    the counts are summed up in order of rank, and only rows of equal job, score and range
    are numbered together.  ``ids``: a table of the candidates, if there is one that is cheaper to
    sample the ranges from than the pairs."""
    order = [F.desc("overall_score"), F.asc(person)]
    if top is not None:
        numbered = scored.withColumn("rank", F.row_number().over(Window.partitionBy(job).orderBy(*order)))
        return numbered.where(F.col("rank") <= top)
    # Ranges by a sample of ids that is the same on every run.
    sample = sorted(r[0] for r in (scored if ids is None else ids).select(person).distinct().orderBy(F.xxhash64(person), person).limit(ranges * 32).collect() if r[0] is not None)
    cuts = sorted(set(sample[len(sample) // ranges :: max(1, len(sample) // ranges)]))
    part, before, at = (_free(x, scored) for x in ("id_range", "before", "score_key"))
    kind = scored.schema[person].dataType
    place = F.aggregate(F.array(*(F.lit(c).cast(kind) for c in cuts)), F.lit(0), lambda n, c: n + F.coalesce((c <= F.col(person)).cast("int"), F.lit(0))) if cuts else F.lit(0)
    rows = scored.withColumns({part: place, at: F.col("overall_score")})
    counts = rows.groupBy(job, at, part).agg(F.count("*").alias("n"))
    sums = Window.partitionBy(job).orderBy(F.desc(at), F.asc(part))
    counts = counts.select(F.col(job).alias("of_job"), F.col(at).alias("of_score"), F.col(part).alias("of_range"), (F.sum("n").over(sums) - F.col("n")).alias(before))
    joined = rows.join(counts, F.col(job).eqNullSafe(F.col("of_job")) & F.col(at).eqNullSafe(F.col("of_score")) & (F.col(part) == F.col("of_range"))).drop("of_job", "of_score", "of_range")
    within = F.row_number().over(Window.partitionBy(job, at, part).orderBy(F.asc(person)))
    return joined.withColumn("rank", (within + F.col(before)).cast("int")).drop(part, before, at)
