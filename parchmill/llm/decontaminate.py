"""Operator 2: benchmark decontamination by a hash set of test n-grams.

Each item's windows (13 consecutive words; a shorter item is one window) are hashed.  The set
is broadcast to the tasks while its size stays under ``BROADCAST_BYTES``.  Token windows of the
training texts are hashed from prefix sums, looked up, and every hit is verified word by word.
No shuffle of the texts is needed.

A larger set is not broadcast and not read by every task.  A bitmap of its hashes (``FILTER_BITS``, of fixed
size) is; each task passes its texts through it once, and the few windows that pass meet the
set in one shuffle join by hash.  The windows that are in the set go back to their texts by
a digest of the text, where they are verified word by word, so results are the same on both ways.

Defined results: null texts have no words.  Items with no words have no window.  Items that
repeat an id count once; a null item id reads as the empty string.  Empty tables give no hits
or no rows.  Repeated documents are each judged.  Other columns, whatever their names, are
ignored or kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmill.llm import storage
from parchmill.llm.textbuf import ALNUM, LOWER, Hasher, grams, per_row, sliced, spans

N = 13
#: A document is contaminated if at least one word in so many is hit.
SHARE = 20
BROADCAST_BYTES = 64 << 20
#: Bits of the filter of a set that is too large to be broadcast: 8 MB.
FILTER_BITS = 1 << 26


def item_windows(benchmark: DataFrame, n: int = N, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(size, hash, words, item): one row for each window of each item."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in sliced(batch.column(1), 1 << 19):
                low = LOWER[buf]
                start, end, row = spans(low, off, ALNUM)
                hashes, counts = Hasher(low)(start, end), per_row(row, hi - lo)
                items, raw, out = batch.column(0).slice(lo, hi - lo).to_pylist(), low.tobytes(), []
                for size in np.unique(np.minimum(counts, n)).tolist():
                    if size:
                        at, found = grams(hashes, row, size)
                        for a, h in zip(at.tolist(), found.view(np.int64).tolist()):
                            if size == n or counts[row[a]] == size:
                                out.append((size, h, b" ".join(raw[start[k] : end[k]] for k in range(a, a + size)), items[row[a]]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.binary(), pa.string()))], names=["size", "hash", "words", "item"])

    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, "size int, hash long, words binary, item string").distinct()


class WindowSet:
    """Windows of up to a few lengths: sorted hashes, a small filter before them, and the
    words to verify a hit with."""

    def __init__(self, rows: list[tuple[int, int, bytes, str]]):
        self.sizes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.words: dict[tuple[int, int], dict[bytes, list[str]]] = {}
        for size, h, words, item in rows:
            self.words.setdefault((size, h), {}).setdefault(words, []).append(item)
        for size in {s for s, _ in self.words}:
            keys = np.sort(np.array([h for s, h in self.words if s == size], np.int64).view(np.uint64))
            bits = np.zeros(1 << 20, bool)
            bits[keys >> np.uint64(44)] = True
            self.sizes[size] = keys, bits

    def mark(self, hit: np.ndarray, items: list[set[str]], raw: bytes, start, end, row, hashes) -> None:
        """Set ``hit`` for the words in windows of the set, and add their items by row."""
        for size, (keys, bits) in self.sizes.items():
            at, found = grams(hashes, row, size)
            some = bits[found >> np.uint64(44)]
            at, found = at[some], found[some]
            same = keys[np.minimum(np.searchsorted(keys, found), len(keys) - 1)] == found
            for a, h in zip(at[same].tolist(), found[same].view(np.int64).tolist()):
                words = b" ".join([raw[start[k] : end[k]] for k in range(a, a + size)])
                got = self.words[size, h].get(words)
                if got:
                    hit[a : a + size] = True
                    items[row[a]].update(got)


def text_key(text) -> list:
    """128 bits of a text: what hits are joined back by."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text), F.xxhash64(F.lit("text"), text)]


def _filter_places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of the filter that each hash sets."""
    return (hashes % np.uint64(FILTER_BITS)).astype(np.int64), ((hashes >> np.uint64(32)) * np.uint64(0x9E3779B1) % np.uint64(FILTER_BITS)).astype(np.int64)


def _filter(windows: DataFrame) -> np.ndarray:
    """The filter's bits as bytes.  They are set by the tasks and folded by words of 32 bits, so at
    most FILTER_BITS / 32 rows reach the driver."""

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.concatenate(_filter_places(batch.column(0).to_numpy().view(np.uint64)))
            yield pa.RecordBatch.from_arrays([pa.array((at >> 5).astype(np.int32)), pa.array(np.int64(1) << (at & 31))], names=["word", "bits"])

    words = windows.select("hash").mapInArrow(places, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS >> 5, np.uint32)
    out[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    return out


def _found(docs: DataFrame, windows: DataFrame, text_col: str) -> DataFrame:
    """key_a, key_b (of a text), found: each different text that may hold windows, with their number
    of words, their first word's place in the text, their words and the item they are from."""
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(_filter(windows))  # of fixed size
    # A window has at most N words, so sizes are few.
    sizes = [r["size"] for r in windows.select("size").distinct().collect()]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [batch.column(k).to_numpy() for k in (1, 2)]
            for lo, hi, buf, off in sliced(batch.column(0)):
                low = LOWER[buf]
                start, end, row = spans(low, off, ALNUM)
                hashes, begin = Hasher(low)(start, end), np.zeros(hi - lo, np.int64)
                begin[1:] = np.cumsum(per_row(row, hi - lo))[:-1]
                for size in sizes:
                    at, made = grams(hashes, row, size)
                    some = np.ones(len(at), bool)
                    for place in _filter_places(made):
                        some &= (bits.value[place >> 5] >> (place & 31).astype(np.uint32) & np.uint32(1)).astype(bool)
                    at, made = at[some], made[some]
                    of = row[at]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[0][lo + of]), pa.array(keys[1][lo + of]), pa.array(np.full(len(at), size, np.int32)), pa.array((at - begin[of]).astype(np.int32)), pa.array(made.view(np.int64))], names=["key_a", "key_b", "size", "at", "hash"])

    a, b = text_key(F.col(text_col))
    passed = docs.select(F.col(text_col).alias("text"), a.alias("a"), b.alias("b")).mapInArrow(look, "key_a long, key_b long, size int, at int, hash long")
    met = passed.distinct().join(windows, ["size", "hash"])
    return storage.materialise(met.groupBy("key_a", "key_b").agg(F.collect_list(F.struct("size", "at", "words", "item")).alias("found")), "found-windows")


class Benchmark:
    """The windows of a benchmark, and what marks a slice of texts by them."""

    def __init__(self, benchmark: DataFrame, n: int, broadcast_bytes: int, id_col: str, text_col: str):
        self.windows = storage.materialise(item_windows(benchmark, n, id_col, text_col), "item-windows")
        size = self.windows.agg(F.sum(F.length("words") + 200)).first()[0] or 0
        self.held = None
        if size <= broadcast_bytes:
            self.held = benchmark.sparkSession.sparkContext.broadcast([(s, h, bytes(w), i) for s, h, w, i in self.windows.collect()])

    def attach(self, docs: DataFrame, text_col: str) -> DataFrame:
        """``docs``, with a last column of the windows that each text may hold if they can't be broadcast."""
        if self.held is not None:
            return docs
        found = _found(docs, self.windows, text_col)
        names = [storage.free_name(c, docs) for c in ("key_a", "key_b", "found")]
        a, b = text_key(F.col(text_col))
        joined = docs.withColumns({names[0]: a, names[1]: b}).join(found.toDF(*names), names[:2], "left")
        return joined.select(*(F.col(f"`{c}`") for c in docs.columns), names[2])

    def marker(self):
        """A function for the tasks that marks the hit words of a slice."""
        held = self.held
        cache: list[WindowSet] = []

        def mark(hit: np.ndarray, items: list[set[str]], raw: bytes, start, end, row, hashes, counts, found) -> None:
            if found is None:
                if not cache:
                    cache.append(WindowSet(held.value))
                cache[0].mark(hit, items, raw, start, end, row, hashes)
                return
            begin = np.cumsum(counts) - counts
            for k, windows in enumerate(found):
                for w in windows or ():
                    a = int(begin[k]) + w["at"]
                    if b" ".join([raw[start[j] : end[j]] for j in range(a, a + w["size"])]) == w["words"]:
                        hit[a : a + w["size"]] = True
                        items[k].add(w["item"])

        return mark


def scan(docs: DataFrame, benchmark: DataFrame, n: int = N, broadcast_bytes: int = BROADCAST_BYTES, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and the
    hit spans (byte offsets in the text) as array<struct<start,end>>."""
    bench = Benchmark(benchmark, n, broadcast_bytes, item_col, item_text_col)
    mark = bench.marker()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, n_words, n_hit, items, found in _judged(batch.column(1), batch.column(2) if batch.num_columns > 2 else None, mark):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(n_words), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()), pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]), pa.array((n_hit > 0) & (SHARE * n_hit >= n_words)), pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_spans"],
                )

    rows = bench.attach(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(judge, f"doc_id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, hit_spans array<struct<start: long, end: long>>")


def _judged(column, windows, mark):
    for lo, hi, buf, off in sliced(column):
        low = LOWER[buf]
        start, end, row = spans(low, off, ALNUM)
        hashes, raw = Hasher(low)(start, end), low.tobytes()
        hit, items = np.zeros(len(start), bool), [set() for _ in range(hi - lo)]
        mark(hit, items, raw, start, end, row, hashes, per_row(row, hi - lo), None if windows is None else windows.slice(lo, hi - lo).to_pylist())
        found: list[list[dict]] = [[] for _ in range(hi - lo)]
        at = np.flatnonzero(hit)
        if len(at):
            new = np.ones(len(at), bool)
            new[1:] = (np.diff(at) > 1) | (row[at[1:]] != row[at[:-1]])
            heads = np.flatnonzero(new)
            for a, b in zip(at[heads].tolist(), at[np.append(heads[1:], len(at)) - 1].tolist()):
                found[row[a]].append({"start": int(start[a] - off[row[a]]), "end": int(end[b] - off[row[a]])})
        yield lo, hi, per_row(row, hi - lo), per_row(row[hit], hi - lo), items, found


def clean(docs: DataFrame, benchmark: DataFrame, action: str = "documents", n: int = N, broadcast_bytes: int = BROADCAST_BYTES, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns, without contaminated documents (``action="documents"``)
    or with the hit spans cut out of every text (``action="spans"``)."""
    if action not in ("documents", "spans"):
        raise ValueError(f"unknown action {action!r}")
    bench = Benchmark(benchmark, n, broadcast_bytes, item_col, item_text_col)
    place, mark, width = docs.columns.index(text_col), bench.marker(), len(docs.columns)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows = batch.column(width) if batch.num_columns > width else None
            batch = batch.select(list(range(width)))
            for lo, hi, n_words, n_hit, _, found in _judged(batch.column(place), windows, mark):
                part = batch.slice(lo, hi - lo)
                if action == "documents":
                    yield part.filter(pa.array(~((n_hit > 0) & (SHARE * n_hit >= n_words))))
                    continue
                texts = part.column(place).to_pylist()
                for k, cuts in enumerate(found):
                    if cuts:
                        raw, at, left = texts[k].encode(), 0, []
                        for cut in cuts:
                            left.append(raw[at : cut["start"]])
                            at = cut["end"]
                        texts[k] = b"".join([*left, raw[at:]]).decode()
                yield part.set_column(place, text_col, pa.array(texts, part.column(place).type))

    return bench.attach(docs, text_col).mapInArrow(keep, docs.schema)
