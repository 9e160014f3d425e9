"""The fold of model-call events, the same plan over a table and over a stream."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmill.functions import jsonfix
from parchmill.functions.text import blank

# Event and item types and the cap of a call's output bytes.
MESSAGE, ANSWER, DONE, FAILED, MAX_EVENT_BYTES = "item.completed", "agent_message", "turn.completed", ("turn.failed", "error"), 4 * 1024 * 1024
# End of the fixed values.

EVENT = "type string, item_type string, text string, has_usage boolean, input_tokens long, output_tokens long, bad boolean"


def _event(line: str | None) -> tuple:
    """The fields of EVENT of one line of output; a line that is no JSON, or null, is bad."""
    if line is None or not jsonfix.trim(line):
        return (None, None, None, False, None, None, False)
    try:
        event = jsonfix.strict(line)
    except ValueError:
        event = None
    if event is None:
        return (None, None, None, False, None, None, True)
    held = lambda row, key: row.get(key) if isinstance(row, dict) else None
    text = lambda x: jsonfix.sound(x) if isinstance(x, str) else None
    item, usage = held(event, "item"), held(event, "usage")
    number = lambda x: int(x) if isinstance(x, (int, float)) and not isinstance(x, bool) and abs(x) < 2**53 else 0
    return (text(held(event, "type")), text(held(item, "type")), text(held(item, "text")), bool(usage) or isinstance(usage, (dict, list)), number(held(usage, "input_tokens")), number(held(usage, "output_tokens")), False)


def parsed(lines: DataFrame) -> DataFrame:
    """call_id, seq, bytes and the fields of ``EVENT``, of ``lines``: call_id, seq, line."""

    def read(lines: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_event(x) for x in lines], columns=[f.split()[0] for f in EVENT.split(", ")]).astype({"input_tokens": "Int64", "output_tokens": "Int64"})

    found = lines.select("call_id", "seq", (F.octet_length(F.coalesce("line", F.lit(""))) + 1).cast("long").alias("bytes"), F.pandas_udf(read, EVENT)("line").alias("event"))
    return found.select("call_id", "seq", "bytes", "event.*")


def fold(events: DataFrame) -> DataFrame:
    """call_id, content (of the last message), done, failed, tokens (null without usage), success.

    ``events``: call_id, seq, type, text, input_tokens, output_tokens, and what else ``parsed``
    gives (a table without these has messages only, and usage in each last event).  A bad line fails its
    call, and so do more than ``MAX_EVENT_BYTES`` of output.  Every aggregate has a partial form, so
    a call's events are combined before the shuffle; on a stream the state is one small row a call."""
    has = set(events.columns)
    column = lambda name, other: F.col(name) if name in has else other
    answer = (F.col("type") == MESSAGE) & (column("item_type", F.lit(ANSWER)) == ANSWER)
    usage = (F.col("type") == DONE) & column("has_usage", F.coalesce("input_tokens", "output_tokens").isNotNull())
    tokens = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0))
    size = column("bytes", F.octet_length(F.coalesce("text", F.lit(""))))
    last = F.max(F.when(answer & F.col("text").isNotNull(), F.struct("seq", "text")))
    used = F.max(F.when(usage, F.struct("seq", tokens.alias("tokens"))))
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    failed = some(F.col("type").isin(*FAILED)) | some(column("bad", F.lit(False))) | (F.sum(size) > MAX_EVENT_BYTES)
    grouped = events.groupBy("call_id").agg(last["text"].alias("content"), some(F.col("type") == DONE).alias("done"), failed.alias("failed"), used["tokens"].alias("tokens"))
    ok = F.col("done") & ~F.col("failed") & F.coalesce(~blank(F.col("content")), F.lit(False))
    return grouped.select("call_id", "content", "done", "failed", "tokens", ok.alias("success"))


def outcome(folded: DataFrame, calls: DataFrame) -> DataFrame:
    """``folded`` with error_code and timed_out by the ``calls`` (call_id, exit_code, timed_out) that
    the events are from: a call that didn't start (a null exit code) is CONFIG_MISSING, one that timed out, ended with
    another code than 0 or whose events don't make a success is AI_REQUEST_FAILED."""
    ended = calls.select("call_id", "exit_code", F.coalesce("timed_out", F.lit(False)).alias("timed_out"))
    wrong: Column = F.col("timed_out") | (F.coalesce("exit_code", F.lit(0)) != 0) | ~F.coalesce("success", F.lit(False))
    code = F.when(F.col("exit_code").isNull() & ~F.col("timed_out"), "CONFIG_MISSING").when(wrong, "AI_REQUEST_FAILED")
    joined = ended.join(folded, "call_id", "left")
    return joined.select("call_id", F.when(code.isNull(), F.col("content")).alias("content"), "tokens", "timed_out", code.alias("error_code"))
