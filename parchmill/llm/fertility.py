"""Operator 8: quality rules by tokeniser fertility.

Base rules count words, symbols, repeated lines and repeated 3-word windows.  The method's own
rule measures how public vocabularies split a document's words: characters per token under a
byte-level BPE and under a SentencePiece model, the share of byte-fallback tokens, and the
entropy of the token distribution in bits.
A document outside a band of its language, or of its script where the language has none, is
rejected.  Words are encoded once for each distinct word and worker.

Bands come from the table itself: documents that pass the base rules are counted by language,
length class (powers of two of the number of pieces, as entropy depends on it) and binned
measure; a band reaches ``SPREAD`` interquartile ranges beyond the quartiles, at least ``SLACK``.
All documents are counted, none is sampled, and the counts don't depend on the partitioning;
documents that agree in all binned measures count once, so a large group of copies doesn't
narrow the band to itself.
A class of fewer than ``MIN_DOCS`` documents takes the bands of the nearest one of its language
that has them; where none has, only the fixed ``BANDS`` judge, which hold besides the derived
ones everywhere.  Each
document is measured once: measures are written before the counts are taken.

Defined results: a null text has no words and fails the base rules.  A null or unknown language
falls back to the script of most letters (latin, other).  Repeated rows are each judged and each
counted.  An empty table gives no row.  Other columns, whatever their names, are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from parchmill.llm import storage, vocabularies
from parchmill.llm.features import ALPHA, HEAD, Counts
from parchmill.llm.textbuf import SPACED, release, sliced, sums, word_array

MIN_WORDS = 50
MEASURES = ("piece_chars", "byte_chars", "fallback", "entropy")
SPREAD = 3.0
#: The least reach of a band beyond its quartiles, where these lie close together.
SLACK = {"piece_chars": 0.05, "byte_chars": 0.05, "fallback": 0.02, "entropy": 0.15}
MIN_DOCS = 100
#: Width of the bins that measures are counted in, and the largest value told apart (a token
#: entropy is at most 16 bits for a vocabulary of 65,536).
BIN, TOP = 0.005, 16.0
#: (least, most) of each measure by language, then by script: what no prose of the language looks
#: like, whatever the table holds.
def _band(byte_least: float, piece_least: float = 1.35) -> dict[str, tuple[float, float]]:
    return {"piece_chars": (piece_least, 7.0), "byte_chars": (byte_least, 7.5), "fallback": (0.0, 0.02), "entropy": (3.5, 16.0)}


BANDS = {"en": _band(1.75), "de": _band(1.7), "fr": _band(1.6), "es": _band(1.5), "latin": _band(1.4), "other": {"piece_chars": (0.25, 7.0), "byte_chars": (0.2, 7.5), "fallback": (0.0, 0.9), "entropy": (2.0, 16.0)}}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _measures(counts: Counts, piece_path: str, byte_path: str) -> dict[str, np.ndarray]:
    """The four measures and the number of pieces, by row."""
    n = counts.n
    words, row = word_array(counts.buf, counts.off, SPACED)
    ids, sizes = vocabularies.counted_words(piece_path, byte_path)(words)
    # A word's first number is that of its byte-level tokens, the others are its pieces.
    heads = np.cumsum(sizes) - sizes
    n_bytes_tokens = np.bincount(row, weights=ids[heads], minlength=n)
    ids, of = np.delete(ids, heads), np.repeat(row, sizes - 1)
    n_pieces = np.bincount(of, minlength=n)
    fallback = np.bincount(of[vocabularies.piece_is_byte(piece_path)[ids]], minlength=n)
    # Entropy of each row's tokens: log2(n) - sum(c log2 c) / n over the counts c of its ids.
    keys = np.sort((of.astype(np.int64) << np.int64(32)) | ids.astype(np.int64))
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    c = np.diff(np.append(edge, len(keys))).astype(float)
    spread = np.bincount(keys[edge] >> np.int64(32), weights=c * np.log2(c), minlength=n) if len(keys) else np.zeros(n)
    tokens = np.maximum(n_pieces, 1)
    with np.errstate(divide="ignore"):
        entropy = np.where(n_pieces > 0, np.log2(tokens) - spread / tokens, 0.0)
    return {"n_pieces": n_pieces.astype(np.int64), "piece_chars": counts.word_chars / tokens, "byte_chars": counts.word_chars / np.maximum(n_bytes_tokens, 1), "fallback": fallback / tokens, "entropy": entropy}


def _bounds(lang: list, counts: Counts, bands: dict) -> tuple[list[str], dict[str, np.ndarray]]:
    """The name of each row's bands, and their fixed limits."""
    letters = sums(ALPHA[counts.buf], counts.off)
    beyond = sums(HEAD[counts.buf] * (counts.buf >= 0xCA), counts.off)  # first bytes from U+0280 on
    names = [x if x in bands else "latin" if a >= b else "other" for x, a, b in zip(lang, letters.tolist(), beyond.tolist())]
    return names, {m: np.array([bands[x][m] for x in names]).reshape(-1, 2) for m in MEASURES}


def _forget(piece_path: str, byte_path: str) -> None:
    vocabularies.counted_words(piece_path, byte_path).forget()
    release()


def _judge(column, lang: list, bands: dict, piece_path: str, byte_path: str):
    """Counts, measures and the rule of each slice: the columns of ``RULE``."""
    for lo, hi, buf, off in sliced(column):
        counts = Counts(buf, off)
        measured = _measures(counts, piece_path, byte_path)
        base_failed = (counts.n_words < MIN_WORDS) | (100 * counts.n_repeat_words > 50 * counts.n_words)
        names, bounds = _bounds(lang[lo:hi], counts, bands)
        inside = np.ones(hi - lo, bool)
        for m, bound in bounds.items():
            inside &= (measured[m] >= bound[:, 0]) & (measured[m] <= bound[:, 1])
        size = np.log2(np.maximum(measured["n_pieces"], 1)).astype(np.int32)
        rule = [pa.array(names, pa.string()), pa.array(size, pa.int32()), pa.array(inside), pa.array(base_failed), *(pa.array(measured[m]) for m in ("n_pieces", *MEASURES))]
        yield lo, hi, counts, pa.StructArray.from_arrays(rule, names=RULE_NAMES)


RULE = f"struct<band: string, size: int, inside: boolean, base_failed: boolean, n_pieces: long, {', '.join(f'{m}: double' for m in MEASURES)}>"
RULE_NAMES = ["band", "size", "inside", "base_failed", "n_pieces", *MEASURES]


def derive(rules: DataFrame, rule: str, spread: float = SPREAD, min_docs: int = MIN_DOCS) -> dict[tuple[str, int], list[float]]:
    """(least, most) of each measure in turn, by band and length class, from a column of ``RULE``.

    What is gathered is a histogram: bands x classes x measures x TOP / BIN rows at most."""
    judged = rules.select(f"{rule}.*").where(~F.col("base_failed"))
    binned = [F.round(F.least(F.col(m), F.lit(TOP)) / F.lit(BIN)).cast("int") for m in MEASURES]
    kinds = judged.select("band", "size", F.array(*binned).alias("bins")).distinct()
    found = kinds.select("band", "size", F.posexplode("bins").alias("k", "bin")).groupBy("band", "size", "k", "bin").agg(F.count("*").alias("n")).collect()
    bins: dict[tuple[str, int], list[dict[int, int]]] = {}
    for r in found:
        bins.setdefault((r.band, r.size), [{} for _ in MEASURES])[r.k][r.bin] = r.n
    limits = {}
    for key, counted in bins.items():
        if sum(counted[0].values()) >= min_docs:
            limits[key] = []
            for m, part in zip(MEASURES, counted):
                at, n = zip(*sorted(part.items()))
                up = np.cumsum(n)
                low, high = (at[int(np.searchsorted(up, q * up[-1]))] * BIN for q in (0.25, 0.75))
                reach = max(spread * (high - low), SLACK[m])
                limits[key] += [low - reach, high + reach]
    out = {}
    for band, size in bins:
        near = [s for b, s in limits if b == band]
        if near:
            out[band, size] = limits[band, min(near, key=lambda s: (abs(s - size), s))]
    return out


def _verdict(rules: DataFrame, rule: str, spread: float, min_docs: int) -> tuple[DataFrame, str]:
    """``rules`` with one more column, whether a row is kept, and its name."""
    band, size, kept = (storage.free_name(x, rules) for x in ("limit_band", "limit_size", "rule_kept"))
    limits = [storage.free_name(f"limit_{side}{k}", rules) for k in range(len(MEASURES)) for side in ("least", "most")]
    rows = [(*key, *found) for key, found in derive(rules, rule, spread, min_docs).items()]
    table = rules.sparkSession.createDataFrame(rows, f"{band} string, {size} int, {', '.join(f'{c} double' for c in limits)}")
    joined = rules.join(F.broadcast(table), (F.col(f"{rule}.band") == F.col(band)) & (F.col(f"{rule}.size") == F.col(size)), "left")
    inside = F.col(f"{rule}.inside")
    for k, m in enumerate(MEASURES):
        inside &= F.coalesce(F.col(f"{rule}.{m}").between(F.col(limits[2 * k]), F.col(limits[2 * k + 1])), F.lit(True))
    return joined.withColumn(kept, ~F.col(f"{rule}.base_failed") & inside).drop(band, size, *limits), kept


def measure(docs: DataFrame, piece_path: str, byte_path: str, bands: dict = BANDS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", spread: float = SPREAD, min_docs: int = MIN_DOCS) -> DataFrame:
    """One row a document: the base counts, base_failed, kept, and the measures behind it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, counts, rule in _judge(batch.column(1), batch.column(2).to_pylist(), bands, piece_path, byte_path):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(getattr(counts, c)) for c in COUNTS), rule], names=["doc_id", *COUNTS, "rule"])
        _forget(piece_path, byte_path)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    made = storage.materialise(rows.mapInArrow(run, f"doc_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, rule {RULE}"), "fertility")
    judged, kept = _verdict(made, "rule", spread, min_docs)
    return judged.select("doc_id", *COUNTS, "rule.base_failed", F.col(kept).alias("kept"), *(f"rule.{m}" for m in ("n_pieces", *MEASURES)))


def keep(docs: DataFrame, piece_path: str, byte_path: str, bands: dict = BANDS, text_col: str = "text", lang_col: str = "lang", spread: float = SPREAD, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with all its columns, without the documents that the rules reject.  Documents are
    written once with their measures, as bands are known only after all are measured."""
    text, lang = docs.columns.index(text_col), docs.columns.index(lang_col)
    name = storage.free_name("rule", docs)
    schema = StructType([*docs.schema.fields, StructField(name, StructType.fromDDL(f"r {RULE}")["r"].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, _, rule in _judge(batch.column(text), batch.column(lang).to_pylist(), bands, piece_path, byte_path):
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, rule], names=[*part.schema.names, name])
        _forget(piece_path, byte_path)

    made = storage.materialise(docs.mapInArrow(run, schema), "fertility")
    judged, kept = _verdict(made, name, spread, min_docs)
    return judged.where(F.col(kept)).select(*(F.col(f"`{c}`") for c in docs.columns))
