"""The forest against brute force on a table with many pairs just above the threshold, nodes that
must be split and nodes that can't be."""

from collections import Counter, defaultdict

import numpy as np
import pytest

from parchmill.llm import jaccard_forest, storage


def made_texts():
    rng = np.random.default_rng(5)
    base = lambda n: [f"t{k}" for k in rng.integers(0, 5000, n)]

    def change(words, m):
        words = list(words)
        for k in rng.integers(0, len(words), m):
            words[k] = f"u{rng.integers(0, 10**6)}"
        return words

    out = []
    for _ in range(250):
        b = base(150)
        out += [change(b, int(rng.integers(0, 6))) for _ in range(int(rng.integers(1, 9)))]
    hot, shared = base(150), base(60)
    out += [change(hot, int(rng.integers(0, 5))) for _ in range(200)]
    out += [shared + base(int(rng.integers(8, 30))) for _ in range(400)]  # one passage, no links
    return [" ".join(t) for t in out]


def test_recall(spark):
    texts = made_texts()
    sets = [frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (t.split() for t in texts)]
    holders = defaultdict(list)
    for k, s in enumerate(sets):
        for g in s:
            holders[g].append(k)
    links, close = np.zeros(len(texts), int), 0
    for k, s in enumerate(sets):
        for m, both in Counter(m for g in s for m in holders[g] if m != k).items():
            similarity = both / (len(s) + len(sets[m]) - both)
            links[k] += similarity >= 0.8
            close += 0.8 <= similarity < 0.82
    assert close > 1000
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for group in (jaccard_forest.GROUP, 24):
        got = {r.doc_id: r.n_links for r in jaccard_forest.join(docs, group=group).collect()}
        found = np.array([got[k] for k in range(len(texts))])
        assert (found <= links).all() and found.sum() >= 0.999 * links.sum()


def test_stops_reach_the_recall():
    forest = jaccard_forest.Forest()
    rng = np.random.default_rng(2)
    crowded = np.where(rng.random((200, forest.trees)) < 0.3, rng.integers(6, 10, (200, forest.trees)), forest.floor)
    crowded[0], crowded[1] = forest.floor, 9
    stops = forest.stops(crowded)
    miss = np.prod(1 - 0.8 ** stops.astype(float), axis=1)
    assert (miss <= 1 - jaccard_forest.RECALL + 1e-12).all()
    # Rows of calm nodes stop as soon as the recall is reached; calm nodes make up for crowded ones.
    assert set(stops[0]) == {6, 7} and (stops[0] == forest.calm()).all() and stops[1].max() < forest.depth
    for s, c in zip(stops[2:], crowded[2:]):
        c = np.minimum(c, forest.depth)
        assert not (s < c).any() or (s <= c).all()  # no crowded node is opened before every calm one
    with pytest.raises(ValueError):
        jaccard_forest.Forest(trees=4)


def test_keep_one_with_repeated_ids_and_clashing_names(spark):
    words = " ".join(f"w{k}" for k in range(60))
    rows = [(1, words, 5, "b"), (1, words, 4, "a"), (2, words + " more", 3, "c"), (3, None, 1, "x"), (3, "", 2, "x"), (3, "", 2, "y"), (4, "lone text", 0, None), (1, "other text here", 9, None), (None, "null id", 1, "n"), (None, "null id", 1, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept_id int, set_a string").repartition(3)
    for _ in range(2):
        got = jaccard_forest.keep_one(docs)
        kept = sorted(map(tuple, got.collect()), key=str)
        assert got.columns == docs.columns and len(kept) == 8
        assert sum(r[1] == words for r in kept) == 1 and (1, "other text here", 9, None) in kept
        assert [r for r in kept if r[0] == 3] == sorted(rows[3:6], key=str) and sum(r[0] is None for r in kept) == 2
    assert jaccard_forest.keep_one(docs.limit(0)).count() == 0


def test_scratch_removes_what_it_made(spark):
    with storage.scratch(spark) as made:
        gone, stays = storage.materialise(spark.range(3).toDF("x"), "gone"), storage.keep(made, storage.materialise(spark.range(4).toDF("x"), "stays"))
    assert stays.count() == 4
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FileNotFound|FAILED_READ_FILE"):
        spark.read.parquet(gone.stored_at).count()
