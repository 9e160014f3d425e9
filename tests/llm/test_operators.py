"""Each operator against a brute-force version on small tables with nulls, empty and long texts,
ties, repeated rows, empty tables and extra columns of clashing names."""

import gzip
import hashlib
import io
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parchmill.llm import decontaminate, fertility, gam_quality, jaccard_forest, line_dedup, piece_codec, shards, storage, token_planes, toxic_crf, vocabularies, warc
from tests.llm import brute

WORDS = [f"w{k}é" if k % 7 == 0 else f"word{k}" for k in range(400)]
LONG = " ".join(WORDS[(k * 37 + k // 11) % 400] for k in range(9000))
NEAR = [" ".join(WORDS[i : i + 80]) for i in (0, 1, 200)]
TEXTS = [None, "", " \n", "one two", NEAR[0], NEAR[0], NEAR[1], NEAR[2], LONG, "idiot <|endoftext|> don't, a\x00b", "Ünï 日本 😀\nsame line\nsame line"]
KIND = "doc_id long, text string, lang string, source string, n_chars long, rep long, shard string, page string, rule string, found string, key_a string, hash long, line_page string, limit_band int"
CLASHES = (None, 1, "x", "y", "r", "f", "k", 0, "p", 3)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en" if k % 2 else None, "s" if k % 3 else None, *CLASHES) for k, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[4], (None, "null id", *rows[0][2:])], KIND).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KIND)


def test_planes(spark, docs, empty):
    path = vocabularies.public("word_bpe_49k.json")
    for unit in ("bit", "byte"):
        got = token_planes.read(token_planes.write(docs, path, storage.new_path(spark, "t"), unit=unit, block=1000), with_ids=True).orderBy("start").collect()
        start, last = 0, None
        texts = dict(enumerate(TEXTS)) | {None: "null id"}
        for r in got:
            ids = [*vocabularies.hugging(path).encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1]
            assert (r.ids, r.start, r.n_tokens) == (ids, start, len(ids)) and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
            assert last is None or r.doc_id >= last
            start, last = start + len(ids), r.doc_id
        assert len(got) == len(TEXTS) + 2
    assert token_planes.read(token_planes.write(empty, path, storage.new_path(spark, "t"))).count() == 0


def test_decontamination(spark, docs, empty):
    items = [("1", NEAR[0][:300]), ("10", "ONE two"), ("2", NEAR[2]), ("3", None), ("4", "..."), ("2", NEAR[2])]
    bench = spark.createDataFrame(items, "item_id string, text string")
    for limit in (decontaminate.BROADCAST_BYTES, 2000):
        for r in decontaminate.scan(docs, bench, broadcast_bytes=limit).collect():
            text = "null id" if r.doc_id is None else TEXTS[r.doc_id]
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute.hits(text, items)
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {k for k, t in enumerate(TEXTS) if not brute.hits(t, items)[4]} | {None}
    cut = {r.doc_id: r.text for r in decontaminate.clean(docs, bench, "spans").collect()}
    assert cut[3] == "" and cut[8] is not None and cut[0] is None
    assert decontaminate.scan(empty, bench).count() == 0 and decontaminate.scan(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_warc(spark):
    big = "é" * 60
    rows = [(3, "http://a/x", big), (1, "http://a/y", big), (2, None, None), (5, "u", "small"), (6, "u", "small"), (None, "http://a/b c\td é%20\u2028", big), (8, "http://a/b c\td é%20\u2028", "t"), (7, "u", "<p>\r\n\r\n</p>" * 5000)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, digest string")
    got = {r.page_id: r for r in warc.read(warc.write(pages, storage.new_path(spark, "w")), with_payload=True).collect()}
    assert len(got) == len(rows) and all(got[page].url == url for page, url, _ in rows)
    for page, _, html in rows:
        raw = (html or "").encode()
        assert (got[page].payload_bytes, got[page].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (got[page].record_type, got[page].refers_to) == (("revisit", 1) if page == 3 else ("response", None))
    assert warc.read(warc.write(pages.limit(0), storage.new_path(spark, "w"))).count() == 0
    # A repeated task writes the same file.
    files = [sorted(hashlib.sha256(open(r.path.removeprefix("file:").replace("//", "/", 1), "rb").read()).hexdigest() for r in warc.write(pages, storage.new_path(spark, "w")).collect()) for _ in range(2)]
    assert files[0] == files[1] and files[0]
    record = warc.encode_record(1, "u", b"x" * 500)
    raw = gzip.decompress(record)
    broken = [raw.replace(b"Content-Length: 5", b"X-Length: 5"), raw.replace(b"Content-Length: ", b"Content-Length: -"), raw.replace(b"WARC-Type", b"WARC Type", 1)[:60], raw.replace(b"WARC-Block-Digest: sha256:", b"WARC-Block-Digest: sha256:0"), raw[:-4], raw + b"more", raw.replace(b"xxx", b"xx", 1), b"\xff" + raw, raw.replace(b"WARC-Target-URI", b"X")]
    for bad in (record[:-9], record[:40] + b"?" + record[41:], *map(gzip.compress, broken)):
        with pytest.raises(warc.WarcError):
            list(warc.read_archive(io.BytesIO(bad)))
    assert [r["payload_bytes"] for r in warc.read_archive(io.BytesIO(record * 3), block=7)] == [500] * 3


def test_forest(docs, empty):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
    grams = lambda w: frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    rows = [(r.doc_id, grams(words(r.text))) for r in docs.collect()]
    links = dict.fromkeys(range(len(rows)), 0)
    for a, b in itertools.combinations(range(len(rows)), 2):
        x, y = rows[a][1], rows[b][1]
        if x and y and len(x & y) >= 0.8 * len(x | y):
            links[a] += 1
            links[b] += 1
    for group in (2048, 2):
        got = jaccard_forest.join(docs, group=group).collect()
        assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_links) for r in got) == sorted((i if i is not None else -1, links[k]) for k, (i, _) in enumerate(rows))
        assert {r.doc_id: r.class_id for r in got if r.doc_id in (4, 5, 6)} == {4: 4, 5: 4, 6: 4}
    kept = sorted(r.doc_id if r.doc_id is not None else -1 for r in jaccard_forest.keep_one(docs).collect())
    assert kept == [-1, 0, 1, 2, 3, 4, 7, 8, 9, 10]
    assert jaccard_forest.join(empty).count() == 0


def test_shards(docs, empty):
    got = sorted(shards.assign(docs, shards=4).collect(), key=lambda r: r.start)
    total, start = sum(r["size"] for r in got), 0
    slots = dict.fromkeys(range(4), 0)
    for r in got:
        text = ("null id" if r.doc_id is None else TEXTS[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.start, r.slot) == (len(text) + 8, zlib.crc32(text), start, slots[r.shard])
        assert r.shard == min(3, (2 * start + r["size"]) * 4 // (2 * total))
        start += r["size"]
        slots[r.shard] += 1
    assert shards.assign(empty).count() == 0


def test_marginals():
    rng = np.random.default_rng(1)
    e, t = rng.normal(size=9), rng.normal(size=(2, 2))
    first = np.zeros(9, bool)
    first[[0, 5]] = True
    got = toxic_crf.marginals(e, first, t)
    for lo, hi in ((0, 5), (5, 9)):
        p = np.zeros(hi - lo)
        z = 0.0
        for tags in itertools.product((0, 1), repeat=hi - lo):
            w = np.exp(sum(e[lo + k] * y for k, y in enumerate(tags)) + sum(t[a, b] for a, b in zip(tags, tags[1:])))
            z += w
            p += w * np.array(tags)
        assert np.allclose(p / z, got[lo:hi])


def labelled(spark, n, odd, plain):
    rows = [(k, (odd if k % 3 == 0 else plain)(k), k % 3 == 0) for k in range(n)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + [(n, None), (n + 1, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(y)) for k, _, y in rows] + [(5, None)], "doc_id long, y int")
    return docs, labels, {k: y for k, _, y in rows}


def prose(k, size=60):
    return " ".join(WORDS[(k * 13 + j * j + 3 * j) % 400] for j in range(size))


def test_toxic(spark):
    docs, labels, truth = labelled(spark, 240, lambda k: prose(k, 20) + " you idiot " + prose(k + 7, 20) + " idiots!", prose)
    model = toxic_crf.train(docs, labels, F.col("doc_id") % 4 != 0, "y")
    got = {r.doc_id: r for r in toxic_crf.tag(docs, model).collect()}
    assert all((got[k].score >= 0.7) == y for k, y in truth.items() if k % 4 == 0) and 0 <= got[240].score <= 1
    text = docs.where("doc_id = 12").first().text.encode()
    assert any(text[s.start : s.end].startswith(b"idiot") for s in got[12].toxic_spans)
    assert toxic_crf.tag(docs, toxic_crf.train(docs, labels.limit(0), F.lit(True), "y")).first().score == 0.5


def test_toxic_sample_skips_long_texts(spark):
    # In every order of ranks some text is behind the long one; all but that one are in the sample.
    rows = [(k, k % 2, ("x" if k == 3 else "w%d " % k) * (5000 if k == 3 else 10)) for k in range(12)]
    made = spark.createDataFrame([(r, y, t) for r, y, t in rows], "rank long, label int, text string")
    got = toxic_crf._bounded(made, 1000)
    assert sorted(r.rank for r in got) == [k for k in range(12) if k != 3]
    assert toxic_crf._bounded(made.where("rank = 3"), 1000) == [] and len(toxic_crf._bounded(made, 10**6)) == 12
    # The first label leaves room for the other.
    assert {r.label for r in toxic_crf._bounded(made.where("rank <> 3").withColumn("rank", F.col("rank") + 100 * F.col("label")), 80)} == {0, 1}


def test_quality(spark):
    docs, labels, truth = labelled(spark, 240, prose, lambda k: (prose(k, 30).upper() + "!! ") * 2)
    model = gam_quality.train(docs, labels, F.col("doc_id") % 5 != 0, "y")
    got = {r.doc_id: r.score for r in gam_quality.score(docs, model).collect()}
    assert all((got[k] >= 0.3) == y for k, y in truth.items() if k % 5 == 0) and got[240] == got[241]
    assert gam_quality.score(docs, gam_quality.train(docs, labels.limit(0), F.lit(True), "y")).first().score == 0.5


def test_pieces(docs, empty):
    path = vocabularies.public("piece_bpe_32k.model")
    got = piece_codec.encode(docs, path)
    rows = {r.doc_id: r for r in got.collect()}
    for k, t in enumerate(TEXTS):
        assert rows[k].ids == vocabularies.pieces(path).encode(t or "") and rows[k].round_trip
    assert {r.doc_id: r.text for r in piece_codec.decode(got, path).collect()}[8] == LONG
    assert piece_codec.encode(empty, path).count() == 0


def field(number, value):
    """One field of a protocol buffer message."""
    number_ = lambda x: bytes([x]) if x < 128 else bytes([x & 127 | 128]) + number_(x >> 7)
    return number_(number << 3) + number_(value) if isinstance(value, int) else number_(number << 3 | 2) + number_(len(value)) + value


def model_file(path, kind=None, chars=b"", own=(), squeeze=True):
    """The public model with another kind, character map or user-defined pieces."""
    raw, out, own = open(vocabularies.public("piece_bpe_32k.model"), "rb").read(), b"", list(own)
    for n, value in piece_codec._message(raw):
        if n == 1 and (piece := dict(piece_codec._message(value))[1].decode()) in own:
            own.remove(piece)
            value = field(1, piece.encode()) + field(3, piece_codec.USER_DEFINED)
        if n == 2 and kind:
            value = b"".join(field(k, v) if k != 3 else b"" for k, v in piece_codec._message(value) if isinstance(v, int) or k in (1, 2, 7, 44, 45, 46, 47)) + field(3, kind)
        if n == 3:
            value = field(1, b"made") + (field(2, chars) if chars else b"") + field(3, 1) + field(4, int(squeeze)) + field(5, 1)
        out += field(n, value)
    out += b"".join(field(1, field(1, p.encode()) + field(3, piece_codec.USER_DEFINED)) for p in own)
    path.write_bytes(out)
    return str(path)


@pytest.mark.parametrize("kind", [piece_codec.BPE, piece_codec.UNIGRAM])
@pytest.mark.parametrize("mapped,own,squeeze", [(True, (), True), (False, ("<tag>", "zq!", "日語"), True), (True, ("ﬁ", "<tag>"), True), (False, ("▁▁", "▁▁▁"), False), (False, (), True)])
def test_model_files(spark, tmp_path, kind, mapped, own, squeeze):
    import sentencepiece

    chars = dict(piece_codec._message(dict(piece_codec._message(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()))[3]))[2] if mapped else b""
    path = model_file(tmp_path / "m.model", kind, chars, own, squeeze)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [*TEXTS[1:], "Ｋａｄｏ　①㌔ ﬁne\tx\ny  <tag>ab <tag> czq!b日語本 zq!zq!", "e\u0301 \u1e9b\u0323 가 \x00\x01\x7f\u200b\ufeff", "a   b    c", "<tag>", "ab", "half ｶﾞ ½ ﷺ", "\U0001f600 ok", "a ▁ b ▁▁c▁", "▁", "  ▁x"]
    got = {r.doc_id: r.ids for r in piece_codec.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path).collect()}
    for k, t in enumerate(texts):
        assert got[k] == library.encode(t), t


def test_unigram_viterbi():
    model = piece_codec.PieceModel(open(vocabularies.public("piece_bpe_32k.model"), "rb").read(), piece_codec.UNIGRAM)
    for text in ("▁the", "▁word", "abcab", "▁\U0010fffea"):
        def best(s):
            if not s:
                return 0.0
            options = [model.scores[i] + best(s[len(p) :]) for k in range(1, len(s) + 1) if (i := model.index.get(p := s[:k])) is not None]
            return max(options) if s[0] in model.index else max([model.worst + best(s[1:]), *options])

        ids = model.encode_part(text)
        known = sum(model.scores[i] for i in ids if model.kinds[i] == piece_codec.NORMAL)
        assert np.isclose(known + model.worst * sum(c not in model.index for c in text), best(text))


def test_counted_words():
    piece, byte = vocabularies.public("piece_bpe_32k.model"), vocabularies.public("byte_bpe_50k.tiktoken")
    words = ["don't", "a\u00a0b", "\u00a0x", "x\u2028", "▁", "a▁b", "日本", "\U0001f600!", "ß" * 300, "\x1c", "\x85z", "1234567", "<|end|>", "e\u0301"]
    model, coder = vocabularies.pieces(piece), vocabularies.byte_ranks(byte)
    for part in (words, [w for w in words if len(w.split()) == 1 and w.split()[0] == w], WORDS * 12):
        ids, sizes = vocabularies.counted_words(piece, byte)(pa.array(part))
        for w, found in zip(part, np.split(ids, np.cumsum(sizes)[:-1])):
            assert found.tolist() == [len(coder.encode_ordinary(" " + w)), *model.encode(w)], w


def test_fertility(docs, empty):
    paths = vocabularies.public("piece_bpe_32k.model"), vocabularies.public("byte_bpe_50k.tiktoken")
    rows = fertility.measure(docs, *paths, min_docs=2).collect()
    texts = ["null id" if r.doc_id is None else TEXTS[r.doc_id] for r in rows]
    langs = dict((r.doc_id, r.lang) for r in docs.collect())
    kept = brute.fertility_kept([(t, langs[r.doc_id]) for t, r in zip(texts, rows)], min_docs=2)
    for r, t, k in zip(rows, texts, kept):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.base_counts(t)
        assert np.allclose([r.n_pieces, r.piece_chars, r.byte_chars, r.fallback, r.entropy], brute.measures(t)) and r.kept == k
    stays = fertility.keep(docs, *paths, min_docs=2)
    assert stays.columns == docs.columns and sorted(r.doc_id or -1 for r in stays.collect()) == sorted(r.doc_id or -1 for r in rows if r.kept)
    assert fertility.measure(empty, *paths).count() == 0 and fertility.keep(empty, *paths).columns == docs.columns


def test_fertility_bands_follow_the_table(spark):
    paths = vocabularies.public("piece_bpe_32k.model"), vocabularies.public("byte_bpe_50k.tiktoken")
    rng = np.random.default_rng(3)
    words = "the house of water stands near river and people walk there every morning with their children before work begins in small town".split()
    clean = [" ".join(rng.choice(words, 120)) for _ in range(300)]
    junk = [" ".join(w + " " + "".join(rng.choice(list("abcdefghijklmnoprstuv"), 6)) for w in rng.choice(words, 60)) for _ in range(9)]
    copies = [clean[0]] * 400
    long = " ".join(rng.choice(words, 30_000))
    texts = [*clean, *junk, *copies, long]
    made = spark.createDataFrame([(k, t, "en", "x") for k, t in enumerate(texts)], "doc_id long, text string, lang string, kept string").repartition(5)
    rows = fertility.measure(made, *paths).collect()
    kept = {r.doc_id for r in rows if r.kept}
    # Copies don't narrow the band to themselves.
    assert not kept & set(range(300, 309)) and len(kept & set(range(300))) >= 290
    assert kept == {k for k, x in enumerate(brute.fertility_kept([(t, "en") for t in texts])) if x}
    stays = fertility.keep(made, *paths)
    assert {r.doc_id for r in stays.collect()} == kept and stays.columns == made.columns
    # Too few documents for bands of their own: the fixed ones decide alone.
    inside = {r.doc_id for r in rows if not r.base_failed and all(lo <= r[m] <= hi for m, (lo, hi) in fertility.BANDS["en"].items())}
    assert {r.doc_id for r in fertility.measure(made, *paths, min_docs=1000).collect() if r.kept} == inside >= set(range(300, 309))


def test_lines(spark):
    rows = [(k, f"Menu \nown {k}\n\nMenu", "h") for k in range(8)] + [(8, None, "h"), (9, "Menu", None), (10, "x\ncopy", "g"), (11, "x\ncopy", "g"), (0, "Menu \nown 0\n\nMenu", "h")]
    rows.append((12, "Menu\n" + "\n".join(f"line {k}" for k in range(50_000)), "h"))
    kind = "doc_id long, text string, source string, page string, line_drop string, line_host string, line_page string, n_lines string, host int"
    docs = spark.createDataFrame([(*r, "z", "d", "lh", "lp", "n", 1) for r in rows], kind)
    out = line_dedup.clean(docs, F.col("source"), report=True)
    got = out.collect()
    assert len(got) == len(rows) and out.columns == [*docs.columns, "n_lines_", "n_dropped"] and {tuple(r)[3:9] for r in got} == {("z", "d", "lh", "lp", "n", 1)}
    want = brute.cleaned([(r[1], r[2]) for r in rows])
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(((r[0], t) for r, t in zip(rows, want)), key=str)
    by = {r.doc_id: r for r in got}
    assert by[3].text == "own 3\n" and by[3].n_dropped == 2 and by[8].text is None and by[12].n_dropped == 1 and by[9].text == "Menu" and by[10].text == "x\ncopy"
    assert line_dedup.clean(docs.limit(0), F.col("source")).count() == 0


def test_lines_below_a_tenth(spark):
    # 6 of 200 pages share a line, 4 another: a few per cent are enough, below MIN_PAGES is not.
    rows = [(k, f"own {k}\n" + ("Subscribe to our letter" if k < 6 else "rare" if k < 10 else f"end {k}"), "h") for k in range(200)]
    got = {r.doc_id: r for r in line_dedup.clean(spark.createDataFrame(rows, "doc_id long, text string, source string"), F.col("source"), report=True).collect()}
    assert [k for k, r in got.items() if r.n_dropped] and all(got[k].text == f"own {k}" for k in range(6))
    assert all(got[k].text == rows[k][1] for k in range(6, 200))


def test_local_folders_are_refused_off_local_masters():
    class Conf:
        get = staticmethod(lambda name, default: default)

    class Context:
        master = "spark://host:7077"

    class Session:
        conf, sparkContext = Conf, Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        storage.shared_dir(Session)
