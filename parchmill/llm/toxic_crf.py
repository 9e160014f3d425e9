"""Operator 6: toxicity by a linear-chain conditional random field.

Labelled tokens.  Labels are given by document; token labels are derived from them.  In a bounded
sample of labelled training documents, words and word beginnings that toxic documents hold and
clean ones (nearly) never do become cues (``PRECISION``, weighted by class sizes, and in so many
distinct contexts that chance among all candidates is ruled out, ``CHANCE``); in toxic documents the words with a cue are labelled 1, all other words of the sample are 0.

Model.  Two tags, transition and start scores, and an emission score that sums hashed features
of the word: the word, its first three to six letters, its last three.  It is trained on windows
of the labelled tokens by full-batch gradient steps on the conditional log-likelihood.

Scoring.  Whole texts, of any length: emission scores are computed once a distinct word; forward
and backward messages of all tokens of a slice are computed at once by a blocked scan of 2 x 2
matrices, which is exact and starts anew at each text.  The marginals' maximum, log sum and log
rate a thousand words are aggregated by a logistic layer, fitted on the sample, to the document's score; tokens above
``TAG`` are the offending spans, with byte offsets.

Training rows are bounded (``SAMPLE`` a label, ``SAMPLE_BYTES``), in an order of hashes that breaks
all ties; a text that doesn't fit in what is left is skipped and the next ones are tried.

Defined results: a null or wordless text is scored with zero aggregates.  Null labels are no
labels.  Repeated rows are each scored, and count once in training.  Without toxic labels in the
sample, or where no word sets toxic texts apart from clean ones (a fixed phrase of words that
clean texts hold too), there are no cues: every score is the smoothed base rate and a warning
says so; without any label it is 0.5.  An empty table gives no row.  Other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmill.llm.textbuf import ALNUM, LOWER, mix, sliced, spans, strings

#: Training documents at most of each label, by smallest xxhash64(doc_id).
SAMPLE = 2500
#: Bytes of all training texts at most; documents beyond it are left out of training whole.
SAMPLE_BYTES = 6 << 20
PRECISION, CHANCE = 0.97, 0.1
WINDOW = 32
BUCKETS = 1 << 18
STEPS, RATE, L2 = 40, 0.3, 1e-6
THRESHOLD, TAG = 0.7, 0.5
LANE = 64


def _tokens(buf: np.ndarray, off: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words of a slice, with start, end and row."""
    low = LOWER[buf]
    start, end, row = spans(low, off, ALNUM)
    ends = np.append(0, np.cumsum(end - start)).astype(np.int32)
    data = np.ascontiguousarray(low[ALNUM[low]]) if len(low) else low
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(data)), start, end, row


def cues_of(word: str) -> list[str]:
    """What may become a cue: the word and its longer beginnings."""
    return ["=" + word, *("^" + word[:k] for k in (4, 5, 6) if len(word) > k)]


def features_of(word: str) -> list[str]:
    return ["=" + word, *("^" + word[:k] for k in (3, 4, 5, 6) if len(word) >= k), "$" + word[-3:]]


def _hash(features: list[str]) -> np.ndarray:
    one = xxhash.xxh3_64_intdigest
    return (np.fromiter((one(f) for f in features), np.uint64, len(features)) & np.uint64(BUCKETS - 1)).astype(np.int64)


@dataclass
class ToxicTagger:
    """Weights of the hashed features, transition scores [from, to], and the document layer."""

    weights: np.ndarray
    bias: float
    transitions: np.ndarray
    layer: np.ndarray
    base: float

    def emissions(self, words: list[str]) -> np.ndarray:
        """The score of tag 1 over tag 0 of each word."""
        lists = [features_of(w) for w in words]
        if not lists:
            return np.zeros(0)
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = _hash([f for x in lists for f in x])
        return np.add.reduceat(self.weights[flat], np.cumsum(sizes) - sizes) + self.bias

    def aggregate(self, p: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        top, total = np.zeros(n), np.bincount(row, p, n)
        np.maximum.at(top, row, p)
        return np.stack([np.ones(n), top, np.log1p(total), np.log1p(1000 * total / np.maximum(np.bincount(row, minlength=n), 1))], axis=1)

    def score(self, p: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
        if not self.layer.any():
            return np.full(n, self.base)
        return 1 / (1 + np.exp(-np.clip(self.aggregate(p, row, n) @ self.layer, -30, 30)))


def marginals(emission: np.ndarray, first: np.ndarray, transitions: np.ndarray) -> np.ndarray:
    """P(tag 1) of each token of chains laid end to end; ``first`` marks where a chain begins.

    Each token's matrix holds its transition and emission factors (at a chain's beginning the
    rows are equal, which forgets what came before).  The tokens are folded into lanes; products
    run over all lanes at once, lanes are chained, and a second run gives every message."""
    n = len(emission)
    if not n:
        return np.zeros(0)
    lanes = max(1, -(-n // LANE))
    size = -(-n // lanes)
    pad = lanes * size - n
    t = np.exp(transitions)
    lift = np.exp(np.clip(emission, -30, 30))
    m = np.empty((n, 2, 2))
    m[:, 0, 0], m[:, 1, 0], m[:, 0, 1], m[:, 1, 1] = t[0, 0], t[1, 0], t[0, 1] * lift, t[1, 1] * lift
    m[first, :, 0], m[first, :, 1] = 1.0, lift[first][:, None]
    if pad:
        m = np.concatenate([m, np.tile(np.eye(2), (pad, 1, 1))])
    m = np.ascontiguousarray(m.reshape(lanes, size, 2, 2).transpose(1, 0, 2, 3))

    def messages(m: np.ndarray, ahead: bool) -> np.ndarray:
        """Vectors before each step (ahead) or after it (backwards), for all lanes."""
        steps = range(size) if ahead else range(size - 1, -1, -1)
        product = np.tile(np.eye(2), (lanes, 1, 1))
        for k in steps:
            x, y = (product, m[k]) if ahead else (m[k], product)
            product = x[:, :, :1] * y[:, :1, :] + x[:, :, 1:] * y[:, 1:, :]
            product /= product.max((1, 2), keepdims=True)
        vector, enter = np.ones(2), np.empty((lanes, 2))
        for lane in range(lanes) if ahead else range(lanes - 1, -1, -1):
            enter[lane] = vector
            vector = vector @ product[lane] if ahead else product[lane] @ vector
            vector = vector / vector.max()
        out = np.empty((size, lanes, 2))
        for k in steps:
            if ahead:
                enter = enter[:, :1] * m[k][:, 0] + enter[:, 1:] * m[k][:, 1]
                enter /= enter.max(1, keepdims=True)
                out[k] = enter
            else:
                out[k] = enter
                enter = m[k][:, :, 0] * enter[:, :1] + m[k][:, :, 1] * enter[:, 1:]
                enter /= enter.max(1, keepdims=True)
        return out

    both = messages(m, True) * messages(m, False)
    return (both[..., 1] / both.sum(-1)).T.reshape(-1)[:n]


def window_counts(emission: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a chain model expects in windows of one length, each a chain of its own: P(tag 1) of
    each token, and the pairs of neighbouring tags, summed over all windows."""
    rows, size = emission.shape
    lift, t = np.exp(np.clip(emission, -30, 30)), np.exp(trans)
    a = np.empty((size, rows, 2))
    b = np.ones((size, rows, 2))
    a[0, :, 0], a[0, :, 1] = 1, lift[:, 0]
    a[0] /= a[0].sum(1, keepdims=True)
    for k in range(1, size):
        a[k] = a[k - 1] @ t
        a[k, :, 1] *= lift[:, k]
        a[k] /= a[k].sum(1, keepdims=True)
    for k in range(size - 2, -1, -1):
        x = b[k + 1].copy()
        x[:, 1] *= lift[:, k + 1]
        b[k] = x @ t.T
        b[k] /= b[k].sum(1, keepdims=True)
    p = a * b
    expected = np.zeros((2, 2))
    for k in range(1, size):
        x = b[k].copy()
        x[:, 1] *= lift[:, k]
        pair = a[k - 1][:, :, None] * t[None] * x[:, None, :]
        expected += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
    return (p[..., 1] / p.sum(-1)).T, expected


def _train_crf(ids: np.ndarray, sizes: np.ndarray, tags: np.ndarray, steps: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights by gradient ascent on windows of ``WINDOW`` tokens: observed minus expected counts.

    ids: hashed features, ``sizes`` of each token; tags: 0 or 1 of each token."""
    n = len(tags) // WINDOW * WINDOW
    tags, sizes = tags[:n], sizes[:n]
    ids = ids[: sizes.sum()]
    of = np.repeat(np.arange(n), sizes)
    used, ids = np.unique(ids, return_inverse=True)
    w, bias = np.zeros(len(used)), -2.0
    trans = np.zeros((2, 2))
    g_w, g_t, g_b = np.zeros(len(used)) + 1e-6, np.zeros((2, 2)) + 1e-6, 1e-6
    rows = n // WINDOW
    y = tags.reshape(rows, WINDOW)
    observed = np.zeros((2, 2))
    np.add.at(observed, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
    seen = np.bincount(ids, tags[of], len(used))
    heads = np.cumsum(sizes) - sizes
    for _ in range(steps):
        p, expected = window_counts((np.add.reduceat(w[ids], heads) + bias).reshape(rows, WINDOW), trans)
        p = p.ravel()
        d_w = seen - np.bincount(ids, p[of], len(used)) - L2 * n * w
        d_t, d_b = observed - expected, float((tags - p).sum())
        g_w, g_t, g_b = g_w + d_w**2, g_t + d_t**2, g_b + d_b**2
        w, trans, bias = w + RATE * d_w / np.sqrt(g_w), trans + RATE * d_t / np.sqrt(g_t), bias + RATE * d_b / math.sqrt(g_b)
    weights = np.zeros(BUCKETS)
    weights[used] = w
    return weights, bias, trans


def _layer(x: np.ndarray, y: np.ndarray, steps: int = 25) -> np.ndarray:
    """Logistic regression by Newton steps with a ridge."""
    w = np.zeros(x.shape[1])
    ridge = np.eye(x.shape[1]) * 0.5
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
    return w


def fit(texts: list[str], labels: np.ndarray, prior: float, steps: int = STEPS) -> ToxicTagger:
    """Cues, token labels, the chain and the document layer from labelled texts.

    ``prior``: the share of toxic documents among all labelled ones, which the document layer's
    intercept is corrected to, as the sample is balanced."""
    empty = ToxicTagger(np.zeros(BUCKETS), -10.0, np.zeros((2, 2)), np.zeros(4), prior)
    n1 = int(labels.sum())
    n0 = len(labels) - n1
    if not n1 or not n0:
        return empty
    words, rows = [], [np.zeros(0, np.int64)]
    for lo, _, buf, off in sliced(pa.array(texts, pa.large_string())):
        found, _, _, row = _tokens(buf, off)
        words.append(found)
        rows.append(row + lo)
    row = np.concatenate(rows)
    if not len(row):
        return empty
    coded = pa.concat_arrays(words).dictionary_encode()
    vocabulary, codes = strings(coded.dictionary), coded.indices.to_numpy()
    # Witnesses of a cue are distinct words before it: copies, exact or near, add none.
    before = np.append(-1, codes[:-1]).astype(np.int64)
    before[np.concatenate([[True], row[1:] != row[:-1]])] = -1
    number: dict[str, int] = {}
    cue_lists = [[number.setdefault(c, len(number)) for c in cues_of(w)] for w in vocabulary]
    n_cues = np.fromiter(map(len, cue_lists), np.int64, len(cue_lists))
    cues = np.fromiter((c for x in cue_lists for c in x), np.int64, int(n_cues.sum()))
    cue_begin = np.cumsum(n_cues) - n_cues
    del cue_lists
    wide = len(vocabulary) + 1
    witnesses = []
    for label in (0, 1):
        own = labels[row] == label
        word, last = np.divmod(np.unique(codes[own].astype(np.int64) * wide + before[own] + 1), wide)
        sizes = n_cues[word]
        stops = np.cumsum(sizes)
        of = cues[np.repeat(cue_begin[word] - (stops - sizes), sizes) + np.arange(stops[-1] if len(stops) else 0)]
        witnesses.append(np.bincount(np.unique(of * wide + np.repeat(last, sizes)) // wide, minlength=len(number)))
    clean, toxic = witnesses
    all1, all0 = max(int(toxic.sum()), 1), max(int(clean.sum()), 1)
    least = max(2, math.log(CHANCE / max(int((toxic > 1).sum()), 1)) / math.log(all1 / (all1 + all0)))
    chosen = (toxic >= least) & (toxic / all1 >= PRECISION * (toxic / all1 + clean / all0))
    is_cue = np.logical_or.reduceat(chosen[cues], cue_begin)
    tags = (is_cue[codes] & (labels[row] == 1)).astype(np.int64)
    if not tags.any():
        return empty
    # Windows with a toxic token, and as many clean windows again for each (at least 4000).
    windows = len(tags) // WINDOW
    hot = tags[: windows * WINDOW].reshape(windows, WINDOW).any(1)
    rank = mix(np.arange(windows, dtype=np.uint64))
    cold = np.flatnonzero(~hot)
    cold = cold[np.argsort(rank[cold])][: max(4000, 2 * int(hot.sum()))]
    pick = np.sort(np.concatenate([np.flatnonzero(hot), cold]))
    token = (pick[:, None] * WINDOW + np.arange(WINDOW)).ravel()
    lists = [features_of(w) for w in vocabulary]
    count = np.fromiter(map(len, lists), np.int64, len(lists))
    hashed = _hash([f for x in lists for f in x])
    begin = np.cumsum(count) - count
    sizes = count[codes[token]]
    stops = np.cumsum(sizes)
    ids = hashed[np.repeat(begin[codes[token]] - (stops - sizes), sizes) + np.arange(stops[-1])]
    weights, bias, trans = _train_crf(ids, sizes, tags[token], steps)
    model = ToxicTagger(weights, bias, trans, np.zeros(4), prior)
    first = np.concatenate([[True], row[1:] != row[:-1]])
    p = marginals(model.emissions(vocabulary)[codes], first, trans)
    model.layer = _layer(model.aggregate(p, row, len(texts)), labels.astype(float))
    model.layer[0] += math.log(prior / (1 - prior)) - math.log(n1 / n0)
    return model


def train(docs: DataFrame, labels: DataFrame, usable: Column, label_col: str = "toxic", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, id_col: str = "doc_id", text_col: str = "text") -> ToxicTagger:
    """Fit on at most ``sample`` documents of each label, and at most ``sample_bytes`` of text."""
    rows = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & usable)
    totals = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    ranked = [F.xxhash64("doc_id"), "doc_id"]
    rows = rows.distinct()
    chosen = rows.where("label = 1").orderBy(*ranked).limit(sample).union(rows.where("label = 0").orderBy(*ranked).limit(sample))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    joined = texts.join(F.broadcast(chosen), "doc_id").select("label", "text", F.xxhash64("doc_id", "text").alias("rank"))
    got = _bounded(joined, sample_bytes, sample)
    prior = (totals.get(1, 0) + 1) / (totals.get(0, 0) + totals.get(1, 0) + 2)
    model = fit([r.text for r in got], np.array([r.label for r in got], np.int64), prior)
    if not model.layer.any():
        warnings.warn(f"no cue of toxic words in {len(got)} training texts: every score is the base rate {model.base:.3f}", stacklevel=2)
    return model


def _bounded(rows: DataFrame, limit: int, sample: int = SAMPLE) -> list:
    """At most ``sample`` rows of each label of at most ``limit`` bytes of text in all, by rank and
    label; rows that agree in both count once.

    Only ranks and sizes of ``2 * sample`` rows, and then the texts that fit, reach the driver.
    A text that doesn't fit in what is left is skipped, and room is held for the smallest
    text of a label that has none yet."""
    sized = rows.groupBy("rank", "label").agg(F.max(F.octet_length("text")).alias("size")).where(F.col("size") <= limit)
    found = [r for y in (0, 1) for r in sized.where(F.col("label") == y).orderBy("rank").limit(sample).collect()]
    held: dict[int, int] = {}
    for r in found:
        held[r.label] = min(r["size"], held.get(r.label, r["size"]))
    if sum(held.values()) > limit:
        held = {}
    total, chosen = 0, []
    for r in sorted(found, key=lambda r: (r["rank"], r.label)):
        if total + r["size"] + sum(s for y, s in held.items() if y != r.label) <= limit:
            total += r["size"]
            held.pop(r.label, None)
            chosen.append((r["rank"], r.label))
    keys = rows.sparkSession.createDataFrame(chosen, "rank long, label int")
    # Equal rows fold before they are shuffled.
    texts = rows.join(F.broadcast(keys), ["rank", "label"], "left_semi").groupBy("rank", "label").agg(F.first("text").alias("text"))
    return sorted(texts.collect(), key=lambda r: (r["rank"], r.label))


def tag(docs: DataFrame, model: ToxicTagger, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, n_toxic_words, toxic_spans (byte offsets in the text) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights and a few more

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = shared.value, {}
        for batch in batches:
            for lo, hi, buf, off in sliced(batch.column(1)):
                n = hi - lo
                words, start, end, row = _tokens(buf, off)
                coded = words.dictionary_encode()
                vocabulary = strings(coded.dictionary)
                new = [w for w in vocabulary if w not in known]
                if len(known) + len(new) > 150_000:
                    known, new = {}, vocabulary
                known.update(zip(new, model.emissions(new).tolist()))
                emission = np.fromiter(map(known.__getitem__, vocabulary), float, len(vocabulary))[coded.indices.to_numpy()] if len(row) else np.zeros(0)
                first = np.concatenate([[True], row[1:] != row[:-1]]) if len(row) else np.zeros(0, bool)
                p = marginals(emission, first, model.transitions)
                found: list[list[dict]] = [[] for _ in range(n)]
                for k in np.flatnonzero(p >= TAG).tolist():
                    r = row[k]
                    found[r].append({"start": int(start[k] - off[r]), "end": int(end[k] - off[r])})
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, n), pa.array(model.score(p, row, n)), pa.array([len(f) for f in found], pa.int64()), pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    names=["doc_id", "score", "n_toxic_words", "toxic_spans"],
                )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, n_toxic_words long, toxic_spans array<struct<start: long, end: long>>")
