"""The pipeline, whole and stage by stage, against the stages in plain Python."""

import random

import pytest

import corpus_pipeline
from parchmill.llm import vocabularies
from tests.llm import brute

KIND = "doc_id long, text string, lang string, source string, n_chars int, rule string, line_drop string, kept_id string, found string"


def made_rows():
    rng = random.Random(11)
    words = "the house of water stands near river and people walk there every morning with their children before work begins in small town while old trees give shade to quiet streets".split()
    prose = lambda n: " ".join(rng.choice(words) + (rng.choice("abcdefgh") if rng.random() < 0.3 else "") for _ in range(n))
    bench = [("b1", prose(40)), ("b2", prose(9)), ("b3", None), ("b1", None)]
    rows = []
    for k in range(140):
        text = prose(rng.randint(60, 140))
        if k % 10 == 3:
            text = "Read more in our letter\n" + text + "\n \nAll rights are reserved"
        if k % 20 == 7:
            text += " " + bench[0][1]
        if k % 25 == 9:
            text = (prose(4) + "\n") * 30
        rows.append(text)
    rows += [rows[0], rows[0], rows[1] + " more", rows[3], None, "", "few words", prose(9000), bench[1][1], prose(70) + " \u65e5\u672c\U0001f600"]
    made = [(k, t, "en" if k % 4 else None, f"s{k % 2}" if k % 9 else None, len(t or ""), "r", "d", "k", "f") for k, t in enumerate(rows)]
    return [*made, made[2], made[5]], bench


def plain(rows, bench):
    """The rows that each stage returns, all but the last."""
    kept = [r for r, ok in zip(rows, brute.fertility_kept([(r[1], r[2]) for r in rows])) if ok]
    yield kept
    texts = brute.cleaned([(r[1], r[3]) for r in kept])
    kept = [(r[0], t, *r[2:4], len(t) if t is not None else None, *r[5:]) for r, t in zip(kept, texts)]
    yield kept
    kept.sort(key=lambda r: r[0])
    groups = brute.near_groups([r[1] for r in kept])
    kept = [r for k, r in enumerate(kept) if groups[k] == k]
    yield kept
    kept = [r for r in kept if not brute.hits(r[1], bench)[4]]
    yield kept


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    rows, bench = made_rows()
    spark.createDataFrame(rows, KIND).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, bench


def test_stages_and_run(spark, tables):
    folder, rows, bench = tables
    model = vocabularies.pieces(vocabularies.public(corpus_pipeline.PIECES))
    docs, sizes = spark.read.parquet(f"{folder}/documents.parquet"), [len(rows)]
    for (_, stage), want in zip(corpus_pipeline.STAGES[:-1], plain(rows, bench)):
        got = stage(spark, docs, folder)
        assert got.columns == docs.columns and sorted(map(tuple, got.collect())) == sorted(want)
        sizes.append(len(want))
        docs = spark.createDataFrame(want, got.schema)
    assert all(a > b for a, b in zip(sizes, sizes[1:])) or sizes[1] == sizes[2], sizes
    result = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert {k: r.ids for k, r in result.items()} == {r[0]: model.encode(r[1]) for r in want} and all(r.round_trip or "  " in str(want) for r in result.values())


def test_empty_tables(spark, tables, tmp_path):
    folder, _, _ = tables
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
