"""Bounded training, and the trained operators' parts against brute force."""

import itertools
import math
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F

from parchmill.llm import gam_quality, toxic_crf
from parchmill.llm.textbuf import column_bytes
from tests.llm import brute

WORDS = [f"w{k}é" if k % 7 == 0 else f"word{k}" for k in range(400)]


def prose(k, size=60):
    return " ".join(WORDS[(k * 13 + j * j + 3 * j) % 400] for j in range(size))


def toxic(k):
    return prose(k, 20) + " you idiot " + prose(k + 7, 20) + " idiots!"


@pytest.fixture(scope="module")
def talk(spark):
    rows = [(k, (toxic if k % 3 == 0 else prose)(k), "x", 1.0, 7) for k in range(240)] + [(240, None, "x", 1.0, 7), (241, "", "x", 1.0, 7), (242, prose(5, 40_000) + " idiot", "x", 1.0, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, score double, rank int").repartition(3)
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(240)] + [(5, None), (3, 1)], "doc_id long, y int")
    return docs, labels


def test_window_counts():
    rng = np.random.default_rng(3)
    e, t = rng.normal(size=(3, 5)), rng.normal(size=(2, 2))
    p, pairs = toxic_crf.window_counts(e, t)
    want_p, want = np.zeros((3, 5)), np.zeros((2, 2))
    for r in range(3):
        every = [(tags, math.exp(sum(e[r, k] * y for k, y in enumerate(tags)) + sum(t[a, b] for a, b in zip(tags, tags[1:])))) for tags in itertools.product((0, 1), repeat=5)]
        z = sum(w for _, w in every)
        for tags, w in every:
            want_p[r] += w / z * np.array(tags)
            for a, b in zip(tags, tags[1:]):
                want[a, b] += w / z
    assert np.allclose(p, want_p) and np.allclose(pairs, want)


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(4)
    n = toxic_crf.WINDOW * 8
    ids, sizes, tags = rng.integers(0, 40, 2 * n), np.full(n, 2), (rng.random(n) < 0.2).astype(np.int64)

    def likelihood(weights, bias, trans):
        out = 0.0
        e = (weights[ids].reshape(n, 2).sum(1) + bias).reshape(8, -1)
        for row, y in zip(e, tags.reshape(8, -1)):
            ahead = np.array([1, math.exp(row[0])])
            for x in row[1:]:
                ahead = (ahead @ np.exp(trans)) * [1, math.exp(x)]
            out += row @ y + sum(trans[a, b] for a, b in zip(y, y[1:])) - math.log(ahead.sum())
        return out

    found = [likelihood(*toxic_crf._train_crf(ids, sizes, tags, steps)) for steps in (1, 10, 60)]
    assert found[0] < found[1] < found[2]


def test_spans_and_score(spark, talk):
    docs, labels = talk
    model = toxic_crf.train(docs, labels, F.col("doc_id") % 4 != 0, "y")
    got = {r.doc_id: r for r in toxic_crf.tag(docs, model).collect()}
    assert len(got) == 243 and got[242].n_toxic_words >= 1
    for key, text in [(0, toxic(0)), (1, prose(1)), (9, toxic(9)), (240, ""), (242, prose(5, 40_000) + " idiot")]:
        words = brute.alnum(text)
        emission = [model.bias + sum(model.weights[toxic_crf._hash([f])[0]] for f in toxic_crf.features_of(w)) for w in words] if key != 242 else list(model.emissions(words))
        p = brute.marginals(emission, model.transitions) if words else []
        raw, at, spans = brute.lower(text).encode(), 0, []
        for w, x in zip(words, p):
            begin = raw.index(w.encode(), at)
            at = begin + len(w.encode())
            if x >= toxic_crf.TAG:
                spans.append((begin, at))
        total = sum(p)
        features = [1, max(p, default=0), math.log1p(total), math.log1p(1000 * total / max(1, len(p)))]
        assert [(s.start, s.end) for s in got[key].toxic_spans] == spans
        assert math.isclose(got[key].score, 1 / (1 + math.exp(-float(np.dot(features, model.layer)))), rel_tol=1e-6)


def test_training_is_bounded(spark, talk):
    docs, labels = talk
    # Whatever the order of ranks, texts above the cap are skipped and both labels stay.
    long = docs.withColumn("text", F.when(F.col("doc_id") % 4 == 1, F.repeat("text", 40)).otherwise(F.col("text")))
    model = toxic_crf.train(long, labels, F.lit(True), "y", sample_bytes=6000)
    assert model.layer.any()
    # A row that is repeated 50,000 times counts once, and once reaches the driver.
    many = docs.where("doc_id < 30").union(docs.where("doc_id = 3").crossJoin(spark.range(50_000)).drop("id"))
    joined = many.join(labels.dropna(), "doc_id").select("text", F.col("y").alias("label"), F.xxhash64("doc_id", "text").alias("rank"))
    assert len(toxic_crf._bounded(joined, 100_000, 100)) == 30
    x = gam_quality.train(many, labels, F.lit(True), "y", sample=20)
    y = gam_quality.train(docs.where("doc_id < 30"), labels, F.lit(True), "y", sample=20)
    assert x.intercept == y.intercept and all((a == b).all() for a, b in zip(x.tables, y.tables))
    # One id with more rows than the sample.
    model = gam_quality.train(docs.withColumn("doc_id", F.lit(3).cast("long")), labels.where("doc_id = 3"), F.lit(True), "y", sample=20)
    assert math.isclose(model.intercept, math.log(21 / 1))


def test_no_cues(spark):
    rows = [(k, " ".join(WORDS[(k + j) % 9] for j in range(30))) for k in range(60)]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, y int")
    with pytest.warns(UserWarning, match="no cue"):
        model = toxic_crf.train(docs, labels, F.lit(True), "y")
    assert {r.score for r in toxic_crf.tag(docs, model).collect()} == {0.5}


def test_empty_tables(spark, talk):
    docs, labels = talk
    empty = docs.limit(0)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        for module in (toxic_crf, gam_quality):
            model = module.train(empty, labels, F.lit(True), "y")
            score = module.tag if module is toxic_crf else module.score
            assert score(empty, model).count() == 0 and score(docs, model).count() == 243


def best_tree(g, h, depth):
    """The gain and values of the best greedy tree, by trying every cut."""
    whole = sum(g) ** 2 / (sum(h) + gam_quality.L2)
    cuts = [(sum(g[:k]) ** 2 / (sum(h[:k]) + gam_quality.L2) + sum(g[k:]) ** 2 / (sum(h[k:]) + gam_quality.L2), -k) for k in range(1, len(g))]
    if depth and cuts and max(cuts)[0] > whole + 1e-9:
        k = -max(cuts)[1]
        return best_tree(g[:k], h[:k], depth - 1) + best_tree(g[k:], h[k:], depth - 1)
    return [sum(g) / (sum(h) + gam_quality.L2)] * len(g)


def test_trees_and_quads():
    rng = np.random.default_rng(7)
    for n in (1, 2, 5, 9):
        g, h = rng.normal(size=n), rng.random(n)
        assert np.allclose(gam_quality._tree(g, h), best_tree(list(g), list(h), 2))
    g, h = rng.normal(size=(4, 5)), rng.random((4, 5))
    part = lambda rows, columns: (g[rows, columns].sum(), h[rows, columns].sum())
    gain = lambda x: x[0] ** 2 / (x[1] + gam_quality.L2)
    options = []
    for i in range(1, 4):
        for j in range(1, 5):
            cells = [part(r, c) for r in (slice(0, i), slice(i, 4)) for c in (slice(0, j), slice(j, 5))]
            options.append((sum(map(gain, cells)), i, j, [x[0] / (x[1] + gam_quality.L2) for x in cells]))
    best, i, j, values = max(options)
    found, table = gam_quality._quad(g, h)
    assert np.isclose(found, best - gain(part(slice(0, 4), slice(0, 5))))
    assert np.allclose([table[0, 0], table[0, -1], table[-1, 0], table[-1, -1]], values) and (table[:i, :j] == table[0, 0]).all() and (table[i:, j:] == table[-1, -1]).all()


def test_lookups():
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, len(gam_quality.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = gam_quality.fit(x, y, rounds=3, pair_rounds=40, n_pairs=2)
    assert model.pairs[0] == (0, 1)
    place = lambda cuts, v: sum(c <= v for c in cuts)
    for row, got in zip(x[:20], model.margin(x[:20])):
        want = model.intercept + sum(t[place(e, v)] for e, t, v in zip(model.edges, model.tables, row))
        want += sum(t[place(model.coarse[a], row[a]), place(model.coarse[b], row[b])] for (a, b), t in zip(model.pairs, model.pair_tables))
        assert np.isclose(got, want)
    assert ((model.score(x) >= 0.5) == y).mean() > 0.9


def test_measures():
    import pyarrow as pa

    texts = ["", "One two, two! THREE\n\nOne two, two! THREE\nÜ 77", None, prose(1, 5000), "aaa"]
    got = gam_quality.measure(*column_bytes(pa.array(texts)))
    for text, row in zip(texts, got):
        m = dict(zip(gam_quality.FEATURES, row))
        t = text or ""
        n_words, word_chars, n_symbols, n_dup, n_repeat, _ = brute.base_counts(t)
        words = t.split()
        assert np.isclose(m["log_words"], math.log1p(n_words)) and np.isclose(m["word_length"], word_chars / max(1, n_words))
        assert np.isclose(m["distinct"], len(set(words)) / max(1, n_words)) and np.isclose(m["top_word"], max(map(words.count, set(words)), default=0) / max(1, n_words))
        assert np.isclose(m["repeats"], n_repeat / max(1, n_words)) and m["longest"] == max((len(w.encode()) for w in words), default=0)
        assert np.isclose(m["digits"], sum(c.isdigit() for c in t) / max(1, len(t))) and np.isclose(m["upper"] * max(1, m["letters"] * max(1, len(t))), sum("A" <= c <= "Z" for c in t))
