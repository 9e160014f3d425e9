"""Rule-based fields of a document as native columns: contacts, name, city, degree, education,
experience and skills.  Columns are null where nothing is found, arrays are empty."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmill.functions.lexicon import CITIES, DEGREES, SKILLS
from parchmill.functions.text import SPACE, SPACE_SET, trim

# Patterns that results depend on.
HAN = "\u4e00-\u9fa5"
PHONE = rf"(?:\+?86[-{SPACE_SET}]?)?(1[3-9][0-9])[-{SPACE_SET}]?([0-9]{{4}})[-{SPACE_SET}]?([0-9]{{4}})"
EMAIL = r"[A-Za-z0-9_.+-]+@[A-Za-z0-9_-]+\.[A-Za-z0-9_.-]+"
SCHOOL = rf"([{HAN}]{{2,12}}(?:大学|学院|学校))"
MAJOR = rf"([{HAN}]{{2,10}}(?:工程|科学|技术|管理|经济|金融|会计|法学|医学|设计|传播|教育))"
DATE = rf"([0-9]{{4}}){SPACE}*[.\-/年]{SPACE}*([0-9]{{1,2}})?"
YEAR = rf"([0-9]{{4}}){SPACE}*[.\-/年]"
YEARS = rf"([0-9]{{1,2}}){SPACE}*年(?:以上)?(?:工作)?经[验历]"
NAME_LABEL = rf"(?:姓{SPACE}*名|名字|Name){SPACE}*[:：]?{SPACE}*([{HAN}]{{2,4}}|[A-Za-z][A-Za-z.{SPACE_SET}]{{1,30}})"
NAME_LINE = rf"^(?:[{HAN}]{{2,4}}|[A-Z][a-z]+(?:{SPACE}[A-Z][a-z]+){{1,2}})\z"
SUPPRESSED_BY = {"Java": "JavaScript", "Vue": "Vue.js"}
MAX_SCHOOLS, NAME_LINES, FIRST_YEAR, MAX_SPAN = 5, 5, 1990, 50
# End of the fixed values.


def first_group(c: Column, pattern: str, group: int = 0) -> Column:
    """A group of the first match, null without one (or if it is empty)."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def email(text: Column) -> Column:
    return first_group(text, EMAIL)


def phone(text: Column) -> Column:
    return F.when(text.rlike(PHONE), F.concat_ws("-", *(F.regexp_extract(text, PHONE, k) for k in (1, 2, 3))))


def city(text: Column) -> Column:
    """The first city in the order of the list, not of the text."""
    return F.coalesce(*(F.when(F.contains(text, F.lit(c)), F.lit(c)) for c in CITIES))


def degree(text: Column) -> Column:
    return F.coalesce(*(F.when(F.contains(text, F.lit(d)), F.lit(d)) for d in DEGREES))


def degree_level(text: Column) -> Column:
    return F.coalesce(*(F.when(F.contains(text, F.lit(d)), F.lit(n)) for d, n in DEGREES.items()))


def skill_pattern(skill: str) -> str:
    return rf"(?i)(^|[^A-Za-z0-9+#.]){re.sub(r'([^A-Za-z0-9 ])', r'\\\1', skill)}([^A-Za-z0-9+#]|\z)"


def _mentioned(text: Column, terms: Column) -> Column:
    """The names of the terms that a text mentions, in order: ASCII terms by word boundary (behind a
    cheap literal test), others as they stand.  The text is lower-cased once."""

    def holds(lowered: Column, term: Column) -> Column:
        literal = F.contains(F.when(term["ascii"], lowered).otherwise(text), term["literal"])
        return literal & F.when(term["ascii"], F.regexp_like(text, term["pattern"])).otherwise(F.lit(True))

    found = F.transform(F.array(F.lower(text)), lambda lowered: F.filter(terms, lambda term: holds(lowered, term)))
    return F.transform(F.element_at(found, 1), lambda term: term["name"])


def _narrowed(found: Column) -> Column:
    """Broader names go if the narrower one is there."""
    for broad, narrow in SUPPRESSED_BY.items():
        found = F.when(F.array_contains(found, narrow), F.array_remove(found, broad)).otherwise(found)
    return found


def skills(text: Column, vocabulary: list[str] = SKILLS) -> Column:
    """Skills in the order of the vocabulary, an empty array without any or for a null text."""
    term = lambda s: F.struct(F.lit(s).alias("name"), F.lit(s.lower() if s.isascii() else s).alias("literal"), F.lit(skill_pattern(s)).alias("pattern"), F.lit(s.isascii()).alias("ascii"))
    return _narrowed(F.coalesce(_mentioned(text, F.array(*map(term, vocabulary))), F.array().cast("array<string>")))


#: Terms of a lexicon table at most: it reaches every task as one array.
MAX_TERMS = 20_000


def skill_rows(docs: DataFrame, text_col: str, lexicon: DataFrame, term_col: str = "skill") -> DataFrame:
    """``docs`` with each term of a lexicon table that its text mentions, one row a match, in a column
    ``skill``.  The lexicon may have ``MAX_TERMS`` different terms, which is checked; null and empty
    terms match nothing."""
    terms = lexicon.select(F.col(term_col).alias("name")).where(F.length("name") > 0).distinct()
    n = terms.limit(MAX_TERMS + 1).count()
    if n > MAX_TERMS:
        raise ValueError(f"over {MAX_TERMS} terms")
    ascii_ = ~F.col("name").rlike(r"[^\x00-\x7F]")
    escaped = F.regexp_replace("name", r"([^A-Za-z0-9 ])", r"\\$1")
    edge = skill_pattern("x").split("x", 1)
    made = terms.select(F.struct("name", F.when(ascii_, F.lower("name")).otherwise(F.col("name")).alias("literal"), F.concat(F.lit(edge[0]), escaped, F.lit(edge[1])).alias("pattern"), ascii_.alias("ascii")).alias("term"))
    key = "terms"
    while key in docs.columns:
        key += "_"
    whole = docs.crossJoin(F.broadcast(made.agg(F.sort_array(F.collect_list("term")).alias(key))))
    found = whole.select(*(F.col(f"`{c}`") for c in docs.columns), F.explode_outer(_mentioned(F.col(text_col), F.col(key))).alias("skill"))
    return found.where(F.col("skill").isNotNull())


def name(text: Column) -> Column:
    lines = F.slice(F.filter(F.transform(F.split(text, "\n"), trim), lambda x: x != ""), 1, NAME_LINES)
    return F.coalesce(trim(first_group(text, NAME_LABEL, 1)), F.get(F.filter(lines, lambda x: x.rlike(NAME_LINE)), F.lit(0)))


def date(raw: Column) -> Column:
    """2018年6月, 2018-6 and the like as 2018.06; a year alone as it is; else unchanged."""
    tight = F.regexp_replace(raw, SPACE, "")
    pattern = r"^([0-9]{4})[^0-9]*([0-9]{1,2})?"
    year, month = F.regexp_extract(tight, pattern, 1), F.regexp_extract(tight, pattern, 2)
    return F.when(year == "", raw).when(month == "", year).otherwise(F.concat(year, F.lit("."), F.lpad(month, 2, "0")))


def education(text: Column) -> Column:
    """One entry for each school line, first of a school, five at most."""

    def entry(line: Column) -> Column:
        school, major = first_group(line, SCHOOL, 1), first_group(line, MAJOR, 1)
        dates = F.regexp_extract_all(line, F.lit(DATE), F.lit(0))
        last = F.when(F.size(dates) > 0, date(F.element_at(dates, -1)))
        return F.struct(school.alias("school"), F.when(major != school, major).alias("major"), degree(line).alias("degree"), last.alias("graduation_time"))

    found = F.filter(F.transform(F.split(text, "\n"), entry), lambda e: e["school"].isNotNull())
    none = F.slice(found, 1, 0)
    first = F.aggregate(found, none, lambda acc, e: F.when(F.exists(acc, lambda x: x["school"] == e["school"]), acc).otherwise(F.concat(acc, F.array(e))))
    return F.slice(first, 1, MAX_SCHOOLS)


def stated_years(text: Column) -> Column:
    return first_group(text, YEARS, 1).cast("int")


def years(text: Column, as_of_year: int) -> Column:
    """Stated years of experience, else the span since the earliest year in the text."""
    seen = F.filter(F.transform(F.regexp_extract_all(text, F.lit(YEAR), F.lit(1)), lambda y: y.cast("int")), lambda y: y.between(FIRST_YEAR, as_of_year))
    span = F.lit(as_of_year) - F.array_min(seen)
    return F.coalesce(stated_years(text), F.when((span > 0) & (span < MAX_SPAN), span))


def profile(text: Column) -> Column:
    return F.struct(name(text).alias("name"), phone(text).alias("phone"), email(text).alias("email"), city(text).alias("city"), education(text).alias("education"), skills(text).alias("skills"))
