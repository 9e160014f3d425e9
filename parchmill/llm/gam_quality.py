"""Operator 10: quality classifier, a generalised additive model with pairwise interactions.

Whole texts are measured (see ``measure``), each measure is cut into quantile bins, and shallow
trees are boosted one feature after the other, round by round; every tree is added to its
feature's lookup table.  Then the strongest pairs of features, by the gain of a 2 x 2 cut of the
residuals, get tables of their own in the same way.  A score is the logistic of the intercept
plus one entry of each table, looked up for all rows of a slice at once.

Training rows are a bounded sample of the labelled rows that aren't held out: the ``SAMPLE``
rows of smallest xxhash64(doc_id).  The sample (ids and labels) is broadcast; the measures of its
texts are folded where rows repeat and gathered on the driver, ``SAMPLE`` rows of a few numbers
each at most, even if an id has more rows than that.  Scoring reads every row.

Defined results: a null text is an empty one and gets the score of a text without words.  Null
labels are no labels; other values than 0 and 1 neither.  Repeated rows are each scored, and count
once in training.  Without any labelled row every score is 0.5.  An empty table gives no row.
Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmill.llm.features import ALPHA, BANGS, COMMAS, DIGIT, HEAD, STOPS, UPPER, WIDE, Counts, repeated
from parchmill.llm.textbuf import per_row, sliced, sums

SAMPLE = 20_000
BINS, PAIR_BINS = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 60, 30, 6
RATE, L2 = 0.15, 2.0
THRESHOLD = 0.3
FEATURES = ("log_words", "word_length", "symbols", "upper", "digits", "stops", "commas", "bangs", "wide", "dup_lines", "repeats", "distinct", "line_words", "letters", "longest", "top_word")


def measure(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text of a slice."""
    c = Counts(buf, off)
    words, chars = np.maximum(c.n_words, 1), np.maximum(sums(HEAD[buf], off), 1)
    total = lambda table: sums(table[buf], off)
    letters = total(ALPHA)
    keys = c.hashes ^ c.salt[c.row]
    first = repeated(keys)[1]
    longest = np.zeros(c.n)
    np.maximum.at(longest, c.row, c.end - c.start)
    ranked = np.sort(keys)
    top = np.zeros(c.n)
    if len(ranked):
        edge = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        many = np.diff(np.append(edge, len(ranked)))
        # Back to rows by the first occurrence of each key.
        heads = np.flatnonzero(first)
        order = np.argsort(keys[heads])
        np.maximum.at(top, c.row[heads[order]], many)
    out = {
        "log_words": np.log1p(c.n_words), "word_length": c.word_chars / words, "symbols": c.n_symbols / chars, "upper": total(UPPER) / np.maximum(letters, 1), "digits": total(DIGIT) / chars,
        "stops": total(STOPS) / words, "commas": total(COMMAS) / words, "bangs": total(BANGS) / words, "wide": total(WIDE) / chars, "dup_lines": c.n_dup_lines / np.maximum(c.n_word_lines, 1),
        "repeats": c.n_repeat_words / words, "distinct": per_row(c.row[first], c.n) / words, "line_words": c.n_words / np.maximum(c.n_lines, 1), "letters": letters / chars, "longest": longest, "top_word": top / words,
    }
    return np.stack([np.asarray(out[f], float) for f in FEATURES], axis=1)


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + L2)


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """The values of a shallow regression tree on ordered bins, from the bins' sums of gradients
    and curvatures."""
    cg, ch = np.cumsum(g), np.cumsum(h)
    if depth and len(g) > 1:
        gains = _gain(cg[:-1], ch[:-1]) + _gain(cg[-1] - cg[:-1], ch[-1] - ch[:-1])
        k = int(np.argmax(gains))
        if gains[k] > _gain(cg[-1], ch[-1]) + 1e-9:
            return np.concatenate([_tree(g[: k + 1], h[: k + 1], depth - 1), _tree(g[k + 1 :], h[k + 1 :], depth - 1)])
    return np.full(len(g), cg[-1] / (ch[-1] + L2))


def _quad(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best 2 x 2 cut of a table of sums: its gain, and its values by cell."""
    G, H = np.cumsum(np.cumsum(g, 0), 1), np.cumsum(np.cumsum(h, 0), 1)

    def four(T):
        a = T[:-1, :-1]
        b, c = T[:-1, -1:] - a, T[-1:, :-1] - a
        return a, b, c, T[-1, -1] - a - b - c

    parts = list(zip(four(G), four(H)))
    gain = sum(_gain(x, y) for x, y in parts)
    i, j = np.unravel_index(np.argmax(gain), gain.shape)
    (a, b, c, d) = [x[i, j] / (y[i, j] + L2) for x, y in parts]
    values = np.empty_like(g)
    values[: i + 1, : j + 1], values[: i + 1, j + 1 :], values[i + 1 :, : j + 1], values[i + 1 :, j + 1 :] = a, b, c, d
    return float(gain[i, j] - _gain(G[-1, -1], H[-1, -1])), values


@dataclass
class Additive:
    """Cut points, one table a feature, and one table a pair."""

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_tables: list[np.ndarray]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.intercept)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables)):
            out += table[np.searchsorted(edges, x[:, f], "right")]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            out += table[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pair_rounds: int = PAIR_ROUNDS, n_pairs: int = PAIRS) -> Additive:
    """Cyclic boosting of single features, then of the strongest pairs."""
    d = x.shape[1] if x.ndim == 2 else len(FEATURES)
    if not len(y):
        return Additive(0.0, [np.zeros(0)] * d, [np.zeros(1)] * d, [np.zeros(0)] * d, [], [])
    rate = (y.sum() + 1) / (len(y) + 2)
    model = Additive(float(np.log(rate / (1 - rate))), [_cuts(x[:, f], BINS) for f in range(d)], [], [_cuts(x[:, f], PAIR_BINS) for f in range(d)], [], [])
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    at = [np.searchsorted(model.edges[f], x[:, f], "right") for f in range(d)]
    margin = np.full(len(y), model.intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-margin))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f in range(d):
            g, h = slopes()
            n = len(model.tables[f])
            step = RATE * _tree(np.bincount(at[f], g, n), np.bincount(at[f], h, n))
            model.tables[f] += step
            margin += step[at[f]]
    coarse = [np.searchsorted(model.coarse[f], x[:, f], "right") for f in range(d)]

    def cells(a: int, b: int) -> tuple[np.ndarray, tuple[int, int]]:
        shape = len(model.coarse[a]) + 1, len(model.coarse[b]) + 1
        return coarse[a] * shape[1] + coarse[b], shape

    g, h = slopes()
    gains = []
    for a in range(d):
        for b in range(a + 1, d):
            cell, shape = cells(a, b)
            if min(shape) > 1:
                size = shape[0] * shape[1]
                gains.append((_quad(np.bincount(cell, g, size).reshape(shape), np.bincount(cell, h, size).reshape(shape))[0], a, b))
    model.pairs = [(a, b) for _, a, b in sorted(gains, reverse=True)[:n_pairs]]
    model.pair_tables = [np.zeros(cells(a, b)[1]) for a, b in model.pairs]
    for _ in range(pair_rounds):
        for k, (a, b) in enumerate(model.pairs):
            g, h = slopes()
            cell, shape = cells(a, b)
            size = shape[0] * shape[1]
            step = RATE * _quad(np.bincount(cell, g, size).reshape(shape), np.bincount(cell, h, size).reshape(shape))[1]
            model.pair_tables[k] += step
            margin += step.reshape(-1)[cell]
    return model


def train(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "quality", sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Additive:
    """Fit on at most ``sample`` of the labelled rows for which ``usable`` holds."""
    chosen = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & usable).distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # ``sample`` rows of two numbers: bounded by the parameter.
    rows = texts.join(F.broadcast(chosen), "doc_id").select("label", "text", F.xxhash64("doc_id", "text").alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in sliced(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).cast(pa.int32()), pa.array(list(measure(buf, off)), pa.list_(pa.float64())), batch.column(2).slice(lo, hi - lo)], names=["label", "x", "rank"])

    measured = rows.mapInArrow(run, "label int, x array<double>, rank long").groupBy("rank", "label").agg(F.min("x").alias("x"))
    got = measured.orderBy("rank", "label").limit(sample).collect()
    got.sort(key=lambda r: (r.label, r.x))
    return fit(np.array([r.x for r in got]), np.array([r.label for r in got], float))


def score(docs: DataFrame, model: Additive, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in sliced(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(shared.value.score(measure(buf, off)))], names=["doc_id", "score"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
