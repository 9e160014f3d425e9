"""Vectorised work on the UTF-8 bytes of whole Arrow string columns.

A column is one byte buffer plus offsets.  Word boundaries, line boundaries, counts and
64-bit hashes of words, lines and n-grams are computed for all rows of a slice at once
with numpy, without a Python object for each word.  Slices hold about ``SLICE_BYTES`` of
text (one row at least), which bounds a worker's memory whatever the batch size is.
Nulls are empty texts.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

#: [^\x20\x09-\x0D]: bytes of words that white space parts.
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False

#: [^\x00-\x2F\x3A-\x60\x7B-\x7F] on lower-cased text: digits, a-z and whatever is not ASCII.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

#: A-Z to a-z, every other byte as it is.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            self.up, self.down = (np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, b, np.uint64))]) for b in (_BASE, _INVERSE))
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def column_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not (pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    n = len(column)
    _, offsets, data = column.buffers()
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes, one row at least."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
        hi = min(n, max(lo + 1, hi))
        yield lo, hi
        lo = hi


def sliced(column, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of each slice of a column."""
    buf, off = column_bytes(column)
    for lo, hi in slices(off, limit):
        yield lo, hi, buf[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]


def spans(buf: np.ndarray, off: np.ndarray, table: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every maximal run of bytes in ``table``; no run crosses rows.

    ``cuts`` gives each byte a class; runs also end where class 1 meets class 2."""
    if not len(buf):
        z = np.zeros(0, np.int64)
        return z, z, z
    mask = table[buf]
    begins = mask.copy()
    begins[1:] &= ~mask[:-1]
    ends = mask.copy()
    ends[:-1] &= ~mask[1:]
    if cuts is not None:
        kind = cuts[buf]
        here = (kind[:-1] | kind[1:]) == 3
        begins[1:] |= here
        ends[:-1] |= here
    full = off[1:] > off[:-1]
    first, last = off[:-1][full], off[1:][full] - 1
    begins[first] = mask[first]
    ends[last] = mask[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


class Hasher:
    """64-bit hashes of any byte ranges of one buffer, from one prefix sum."""

    def __init__(self, buf: np.ndarray):
        up, self.down = _POWERS.get(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * up[: len(buf)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


def grams(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of each window of ``n`` consecutive words of one row."""
    if len(hashes) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    m = len(hashes) - n + 1
    at = np.flatnonzero(row[:m] == row[n - 1 :])
    out = np.zeros(len(at), np.uint64)
    for k in range(n):
        out = out * _BASE + hashes[at + k]
    return at, mix(out)


def release() -> None:
    """Give memory that a task has freed back to the system: workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim is not None:
        trim(0)


def per_row(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n).astype(np.int64)


def sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The sum of ``values`` (one for each byte) over each row."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def word_array(buf: np.ndarray, off: np.ndarray, table: np.ndarray, cuts: np.ndarray | None = None) -> tuple[pa.Array, np.ndarray]:
    """All words of a slice as one Arrow array, and each word's row."""
    start, end, row = spans(buf, off, table, cuts)
    ends = np.zeros(len(start) + 1, np.int32)
    np.cumsum(end - start, out=ends[1:])
    data = buf[table[buf]] if len(buf) else buf
    return pa.StringArray.from_buffers(len(start), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))), row


def strings(column: pa.Array) -> list[str]:
    """The texts of a column without nulls, by Arrow's own loop: ``to_pylist`` makes a scalar of each."""
    return column.to_numpy(zero_copy_only=False).tolist()


#: Characters of a word that ``WordCodec`` keeps, at most.
LONGEST = 64


class WordCodec:
    """Token ids of words, each distinct word encoded once.

    ``encode`` maps a list of words to (ids of all words, one after the other; number of
    ids of each word).  Words already met are kept, up to ``keep`` of them, for the next
    slices and tasks of the same worker; ``forget`` gives the memory back.  Words over
    ``LONGEST`` characters aren't kept, so the memory is bounded in bytes too.
    """

    def __init__(self, encode, keep: int = 150_000):
        self.encode, self.keep, self.known = encode, keep, {}

    def forget(self) -> None:
        self.known = {}

    def distinct(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        known = self.known
        new = [w for w in words if w not in known]
        if len(known) + len(new) > self.keep:
            known = {w: v for w in words if (v := known.get(w)) is not None}
        if new:
            flat, sizes = self.encode(new)
            data, ends = flat.astype(np.uint32).tobytes(), (np.cumsum(sizes) * 4).tolist()
            at = 0
            for w, end in zip(new, ends):
                known[w] = data[at:end]
                at = end
        got = [known[w] for w in words]
        for w in new:
            if len(w) > LONGEST:
                del known[w]
        self.known = known if len(known) <= self.keep else {}
        return np.frombuffer(b"".join(got), np.uint32), np.fromiter(map(len, got), np.int64, len(got)) >> 2

    def __call__(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids in word order, ids of each word)."""
        coded = words.dictionary_encode()
        flat, sizes = self.distinct(strings(coded.dictionary))
        codes = coded.indices.to_numpy()
        if not len(codes):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        lengths = sizes[codes]
        ends = np.cumsum(lengths)
        begins = np.cumsum(sizes) - sizes
        at = np.repeat((begins[codes] - (ends - lengths)).astype(np.int32), lengths)
        at += np.arange(len(at), dtype=np.int32)
        return flat[at], lengths


def cut_at(ids: np.ndarray, mark: int) -> tuple[np.ndarray, np.ndarray]:
    """ids without the marks; the number of ids before each mark and after the last."""
    at = np.flatnonzero(ids == mark)
    edges = np.concatenate([[-1], at, [len(ids)]])
    return ids[ids != mark], np.diff(edges) - 1
