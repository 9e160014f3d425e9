"""Wrapping of text to a display width, as an Arrow UDF: a fold with look-back over tokens."""

from __future__ import annotations

import re
from bisect import bisect_right
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from parchmill.functions.text import SPACE_SET, WIDE, ZERO_WIDTH

# Token shapes and signs that never begin a line.
TOKEN = re.compile(rf"[A-Za-z0-9_\-./+#%:@]+|[{SPACE_SET}]+|.", re.S)
NO_START = set("、。，；：！？）》」』】〕〉…—·,.;:!?)]}")
LEAST_WIDTH = 10
# End of the fixed values.

_ANSI, _ZERO, _WIDE = re.compile("\x1b\\[[0-9;]*m"), re.compile(f"[{ZERO_WIDTH}]"), re.compile(f"[{WIDE}]")


def width(text: str) -> int:
    plain = _ZERO.sub("", _ANSI.sub("", text))
    return len(plain) + len(_WIDE.findall(plain))


def _end(sums: list[int], begin: int, most: int) -> int:
    """The end of the longest run from ``begin`` that is no wider than ``most``, by running sums."""
    return bisect_right(sums, sums[begin] + most) - 1


def _parts(token: str, most: int) -> list[str]:
    """A token wider than a line in parts that fit; marks of no width stay with what they follow."""
    sums, begin, out = [0, *accumulate(map(width, token))], 0, []
    while begin < len(token):
        end = max(begin + 1, _end(sums, begin, most))
        out.append(token[begin:end])
        begin = end
    return out


def _blank(text: str) -> bool:
    return not text.strip(_STRIP)


def _filled(tokens: list[str], most: int) -> list[str]:
    """Lines of tokens that each fit in one: a line takes the tokens that its running width allows,
    and signs that may not begin the next one.  Blanks alone are no line yet, and a blank that
    would begin a line is dropped."""
    sums, begin, out = [0, *accumulate(map(width, tokens))], 0, []
    while True:
        first = next((k for k in range(begin, len(tokens)) if not _blank(tokens[k])), len(tokens))
        end = min(len(tokens), max(first + 1, _end(sums, begin, most)))
        while end < len(tokens) and tokens[end] in NO_START:
            end += 1
        out.append("".join(tokens[begin:end]).rstrip(_STRIP))
        if end >= len(tokens):
            return out
        begin = end + _blank(tokens[end])


def wrap(text: str, columns: int) -> list[str]:
    most, out = max(LEAST_WIDTH, columns), []
    for paragraph in text.split("\n"):
        held: list[str] = []
        for token in TOKEN.findall(paragraph):
            if width(token) <= most:
                held.append(token)
            else:
                lines, (*whole, rest) = _filled(held, most), _parts(token, most)
                out += [x for k, x in enumerate(lines) if x or k < len(lines) - 1] + whole
                held = [rest]
        out += _filled(held, most)
    return out


_STRIP = "\t\n\x0b\x0c\r \u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B)))


def wrap_lines(text: Column, columns: int) -> Column:
    """Array of lines no wider than ``columns`` (10 at least), but for a sign that may not start one."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else wrap(t, columns))

    return F.pandas_udf(run, "array<string>")(text)


def wrap_with_indent(text: Column, first: str, rest: str, columns: int) -> Column:
    lines = wrap_lines(text, columns - width(first))
    return F.transform(lines, lambda line, k: F.concat(F.when(k == 0, first).otherwise(rest), line))
