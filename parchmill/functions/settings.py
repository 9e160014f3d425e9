"""Settings held as table columns: lenient numbers, precedence, retry waits, hint texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parchmill.functions.text import SPACE, base_url, trim

# Providers, defaults and the wait before a retry.
PROVIDERS, MISSING = ("openai", "codex"), "CONFIG_MISSING"
BACKOFF_MS, JITTER_MS, HINT_INDENT = 400, 200, "      "
# End of the fixed values.


def lenient_int(raw: Column, default: int) -> Column:
    """The number a text begins with, ``default`` if there is none, it isn't above 0 or needs over 63 bits."""
    n = F.nullif(F.regexp_extract(trim(raw), "^[+-]?[0-9]+", 0), F.lit("")).try_cast("bigint")
    return F.when(n > 0, n).otherwise(F.lit(default).cast("bigint"))


def first_set(*values: Column) -> Column:
    """Override, then environment, then file, then default: empty texts count as set."""
    return F.coalesce(*values)


def provider_error(provider: Column, key: Column) -> Column:
    """CONFIG_MISSING for an unknown provider, or without a key where one is needed."""
    return F.when(~provider.isin(*PROVIDERS), MISSING).when((provider == PROVIDERS[0]) & (F.coalesce(key, F.lit("")) == ""), MISSING)


def endpoint(url: Column, path: str) -> Column:
    return F.concat(base_url(url), F.lit("/" + path))


def backoff_ms(attempt: Column) -> Column:
    """least and most milliseconds to wait after an attempt, counted from 0."""
    least = (F.lit(BACKOFF_MS) * F.pow(F.lit(2), attempt)).cast("bigint")
    return F.struct(least.alias("least"), (least + JITTER_MS - 1).alias("most"))


def indented(hint: Column, by: str = HINT_INDENT) -> Column:
    """Every line of a text after ``by``."""
    return F.array_join(F.transform(F.split(hint, "\n"), lambda line: F.concat(F.lit(by), line)), "\n")


def prompt(instructions: str, sections: dict[str, Column]) -> Column:
    """Instructions, then each named text between its own marks; texts are budgeted beforehand
    (``text.clamp_input``).  Instructions are the caller's."""
    parts = [F.lit(instructions)]
    for name, text in sections.items():
        parts += [F.lit(f"{name} <<<"), text, F.lit(">>>")]
    return F.array_join(F.array(*parts), "\n", "")


def plausible_email(c: Column) -> Column:
    sign = f"[^{SPACE[1:-1]}@]"
    return c.rlike(rf"^{sign}+@{sign}+\.{sign}+\z")
