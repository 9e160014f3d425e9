"""Operator 1: token ids in bit-plane shuffled, zstandard-compressed files.

A file holds the ids of consecutive documents (ascending id).  Ids are cut into blocks of
fixed size; each block's 32 bit planes (or 4 byte planes) are compressed one by one, so the
planes that are all zero cost a few bytes.  The footer is the chunk index (offset, ids, crc32
and plane lengths of each block) and the document index (id, number of ids).

    magic | block planes ... | zstd(footer) | footer length, uint64 | magic

Writing is one range shuffle by (id, text hash) and one Arrow pass; each task writes its file
under a temporary name and renames it, so a repeated task leaves the same file.  A file's place
in the whole is known from the manifest, one row a file.

Defined results: ids are whole numbers (cast to long; ids that are none fail the job).  Null and empty texts have the end id alone.  Rows that repeat an id follow
each other in the order of their texts' hashes, and rows equal in both give equal records.
A null id sorts first.  An empty table gives no file and no row.  Other columns, whatever
their names, are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmill.llm import storage, vocabularies
from parchmill.llm.textbuf import LOWER, sliced, word_array

MAGIC = b"PLANES01"
END_ID = 1
BLOCK = 1 << 15
#: Text encoded at a time: a slice's distinct words are looked up once.
SLICE_BYTES = 2 << 20
#: Decoded ids held at a time when documents are cut out of blocks.
READ_ROWS = 2000


def to_planes(ids: np.ndarray, unit: str) -> list[bytes]:
    raw = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if unit == "byte":
        return [np.ascontiguousarray(raw[:, k]).tobytes() for k in range(4)]
    planes = []
    for k in range(4):
        column = np.ascontiguousarray(raw[:, k])
        planes += [np.packbits((column >> np.uint8(b)) & np.uint8(1)).tobytes() for b in range(8)] if column.any() else [b""] * 8
    return planes


def from_planes(planes: list[bytes], n: int, unit: str) -> np.ndarray:
    raw = np.zeros((n, 4), np.uint8)
    if unit == "byte":
        for k, plane in enumerate(planes):
            raw[:, k] = np.frombuffer(plane, np.uint8)
    else:
        for k, plane in enumerate(planes):
            if plane:
                raw[:, k // 8] |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n) << np.uint8(k % 8)
    return raw.view("<u4").reshape(-1)


class PlaneWriter:
    """Appends ids to one file in blocks and keeps its two indexes."""

    def __init__(self, handle, unit: str = "bit", block: int = BLOCK, level: int = 3):
        self.handle, self.unit, self.block = handle, unit, block
        self.press = zstandard.ZstdCompressor(level=level)
        self.pending: list[np.ndarray] = []
        self.held = 0
        self.chunks: list[tuple] = []
        self.docs: list[tuple[int, bool, int]] = []
        self.at = handle.write(MAGIC)

    def add(self, ids: np.ndarray) -> None:
        self.pending.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            whole = np.concatenate(self.pending)
            full = len(whole) // self.block * self.block
            for k in range(0, full, self.block):
                self._put(whole[k : k + self.block])
            self.pending, self.held = [whole[full:]], len(whole) - full

    def _put(self, ids: np.ndarray) -> None:
        packed = [self.press.compress(p) if p else b"" for p in to_planes(ids, self.unit)]
        self.chunks.append((self.at, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), [len(p) for p in packed]))
        self.handle.write(b"".join(packed))
        self.at += sum(map(len, packed))

    def close(self) -> int:
        if self.held:
            self._put(np.concatenate(self.pending))
        width = 32 if self.unit == "bit" else 4
        out = [struct.pack("<BIQQ", width, self.block, len(self.chunks), len(self.docs))]
        out += [struct.pack(f"<QII{width}I", at, n, crc, *sizes) for at, n, crc, sizes in self.chunks]
        out += [struct.pack("<q?Q", *doc) for doc in self.docs]
        footer = self.press.compress(b"".join(out))
        self.handle.write(footer + struct.pack("<Q", len(footer)) + MAGIC)
        return self.at + len(footer) + 16


class PlaneReader:
    """The indexes of a file, and its ids from block to block."""

    def __init__(self, handle):
        self.handle = handle
        if handle.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a plane file")
        handle.seek(-16, 2)
        size, magic = struct.unpack("<Q8s", handle.read(16))
        if magic != MAGIC:
            raise ValueError("cut-off plane file")
        handle.seek(-16 - size, 2)
        raw = zstandard.ZstdDecompressor().decompress(handle.read(size))
        width, self.block, chunks, docs = struct.unpack_from("<BIQQ", raw)
        self.unit = "bit" if width == 32 else "byte"
        at, entry = 21, struct.Struct(f"<QII{width}I")
        self.chunks = [entry.unpack_from(raw, at + k * entry.size) for k in range(chunks)]
        at, entry = at + chunks * entry.size, struct.Struct("<q?Q")
        self.docs = [entry.unpack_from(raw, at + k * entry.size) for k in range(docs)]

    def blocks(self, first: int = 0) -> Iterator[np.ndarray]:
        undo = zstandard.ZstdDecompressor()
        for at, n, crc, *sizes in self.chunks[first:]:
            self.handle.seek(at)
            raw, planes, k = self.handle.read(sum(sizes)), [], 0
            for size in sizes:
                planes.append(undo.decompress(raw[k : k + size]) if size else b"")
                k += size
            ids = from_planes(planes, n, self.unit)
            if zlib.crc32(ids.tobytes()) != crc:
                raise ValueError(f"block at {at}: wrong checksum")
            yield ids

    def documents(self) -> Iterator[tuple[int | None, list[np.ndarray]]]:
        """(id, its token ids in parts) of each document, in order."""
        blocks, rest = self.blocks(), np.zeros(0, np.uint32)
        for doc_id, null, n in self.docs:
            parts = []
            while n > len(rest):
                if len(rest):
                    parts.append(rest)
                    n -= len(rest)
                rest = next(blocks)
            parts.append(rest[:n])
            rest = rest[n:]
            yield None if null else doc_id, parts


def write(docs: DataFrame, tokenizer: str, out: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, unit: str = "bit", block: int = BLOCK) -> DataFrame:
    """Encode whole texts, append ``end_id`` to each, and write plane files under ``out``.

    Returns the manifest, one row a file in id order: part, path, n_docs, n_tokens, n_bytes."""

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        path, writer, tokens = f"{out}/ids-{part:06d}.planes", None, 0
        codec = vocabularies.hugging_words(tokenizer)
        file = None
        try:
            for batch in batches:
                for lo, hi, buf, off in sliced(batch.column(1), SLICE_BYTES):
                    if writer is None:
                        file = storage.AtomicFile(path)
                        writer = PlaneWriter(file.__enter__(), unit, block)
                    # Lower case first spares the encoder words that it lower-cases itself.
                    plain = buf if b"<|" in buf.tobytes() else LOWER[buf]
                    words, row = word_array(plain, off, vocabularies.BETWEEN, vocabularies.LETTER_MEETS_SIGN)
                    ids, sizes = codec(words)
                    counts = np.bincount(row, weights=sizes, minlength=hi - lo).astype(np.int64)
                    ends = np.cumsum(counts)
                    ids = np.insert(ids, ends, end_id)
                    writer.add(ids)
                    keys = batch.column(0).slice(lo, hi - lo).to_pylist()
                    writer.docs += [(key or 0, key is None, int(n) + 1) for key, n in zip(keys, counts)]
                    tokens += len(ids)
        except BaseException as error:
            if file is not None:
                file.__exit__(type(error), error, None)
            raise
        if writer is not None:
            size = writer.close()
            file.__exit__(None, None, None)
            yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "n_docs": [len(writer.docs)], "n_tokens": [tokens], "n_bytes": [size]})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tie = F.xxhash64("text")
    ordered = rows.repartitionByRange("doc_id", tie).sortWithinPartitions("doc_id", tie)
    return storage.gathered(ordered.mapInArrow(save, "part long, path string, n_docs long, n_tokens long, n_bytes long"))


def read(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row a document, from the files: doc_id, start, n_tokens, ids_crc32 (and ids).

    The manifest has a row for each file, so its totals are gathered on the driver; the files
    are read one a task."""
    spark = manifest.sparkSession
    files, start = [], 0
    for row in manifest.orderBy("part").collect():
        files.append((row.path, start))
        start += row.n_tokens
    columns = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                path, at = files[k]
                with storage.open_input(path) as handle:
                    rows: list[tuple] = []
                    for doc_id, parts in PlaneReader(handle).documents():
                        crc = n = 0
                        for part in parts:
                            crc = zlib.crc32(part.tobytes(), crc)
                            n += len(part)
                        rows.append((doc_id, at, n, crc, *([np.concatenate(parts).tolist()] if with_ids else [])))
                        at += n
                        if len(rows) == READ_ROWS:
                            yield _batch(rows, with_ids)
                            rows = []
                    if rows:
                        yield _batch(rows, with_ids)

    if not files:
        return spark.createDataFrame([], columns)
    return spark.range(0, len(files), 1, len(files)).mapInArrow(load, columns)


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    columns = list(zip(*rows))
    arrays = [pa.array(c, pa.int64()) for c in columns[:4]] + ([pa.array(columns[4], pa.list_(pa.int64()))] if with_ids else [])
    return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(arrays)])
