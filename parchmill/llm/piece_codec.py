"""Operator 7: SentencePiece encoding and decoding by an Aho-Corasick automaton and Viterbi.

The model file is read here, without the library: pieces, scores, kinds and the normaliser's
switches.  An Aho-Corasick automaton over the pieces reports, at each position, the pieces that
end there (its output links); one pass relaxes the best path to each position.

* Unigram models: the best path has the largest sum of scores; an unknown character costs
  ``UNKNOWN_PENALTY`` below the lowest score.
* BPE models: a path is admissible if each pair of neighbours is what merging would leave of the
  two joined; one admissible piece ends at each reachable position, so the pass yields exactly
  what merging by rank yields, in linear time.  Pair checks are kept.

Texts are cut where no piece can cross (before a space that follows another character, and
around characters that no piece holds), and each distinct part is encoded once a worker.
A model's character map is applied first, longest match first; user-defined pieces stand for
themselves wherever they occur, and models that have some are encoded text by text.

Defined results: a null text has no pieces and decodes to the empty text.  Unknown characters
become byte pieces, or the unknown id where the model has none (then the text doesn't come back).
Bytes that are no UTF-8 decode to U+FFFD.  Repeated rows are each encoded.  An empty table gives
no row.  Other columns, whatever their names, are ignored.  Models of words or characters, and
such that mark spaces after words, are refused with an error.
"""

from __future__ import annotations

import functools
import heapq
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmill.llm import storage
from parchmill.llm.textbuf import WordCodec, column_bytes, release, slices

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = raw[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def _message(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) of a protocol buffer message; submessages and strings are bytes."""
    at = 0
    while at < len(raw):
        key, at = _varint(raw, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(raw, at)
        else:
            if kind == 2:
                size, at = _varint(raw, at)
            else:
                size = {1: 8, 5: 4}[kind]
            value, at = raw[at : at + size], at + size
        yield key >> 3, value


class CharMap:
    """A normaliser's table: a double-array trie of UTF-8 keys, and their replacements."""

    def __init__(self, raw: bytes):
        (size,) = struct.unpack_from("<I", raw)
        units, blob = np.frombuffer(raw, "<u4", size // 4, 4), raw[4 + size :]
        self.table: dict[str, str] = {}
        bytes_, offset = np.arange(1, 256, dtype=np.uint32), lambda u: int((u >> np.uint32(10)) << ((u & np.uint32(512)) >> np.uint32(6)))
        left = [(offset(units[0]), b"")]
        while left:
            node, key = left.pop()
            # A child's unit is where its byte leads from the node, and is labelled with that byte.
            at = bytes_ ^ np.uint32(node)
            at = at[at < len(units)]
            for place in at[(units[at] & np.uint32(0x800000FF)) == (at ^ np.uint32(node))].tolist():
                below, longer = place ^ offset(units[place]), key + bytes([place ^ node])
                if units[place] >> np.uint32(8) & np.uint32(1):
                    begin = int(units[below]) & 0x7FFFFFFF
                    self.table[longer.decode()] = blob[begin : blob.index(b"\0", begin)].decode()
                left.append((below, longer))
        self.sizes: dict[str, list[int]] = {}
        for key in self.table:
            self.sizes.setdefault(key[0], []).append(len(key))
        for sizes in self.sizes.values():
            sizes.sort(reverse=True)

    def __call__(self, text: str) -> str:
        if self.sizes.keys().isdisjoint(text):
            return text
        out, at = [], 0
        while at < len(text):
            size = next((k for k in self.sizes.get(text[at], ()) if text[at : at + k] in self.table), 0)
            out.append(self.table[text[at : at + size]] if size else text[at])
            at += size or 1
        return "".join(out)


class PieceModel:
    """The pieces of a model file and the automaton over them."""

    def __init__(self, raw: bytes, model_type: int | None = None):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.kinds: list[int] = []
        self.type, chars, suffix = UNIGRAM, b"", 0
        self.dummy_prefix = self.squeeze = True
        for field, value in _message(raw):
            if field == 1:
                entry = dict(_message(value))
                self.pieces.append(entry.get(1, b"").decode())
                self.scores.append(struct.unpack("<f", entry[2])[0] if 2 in entry else 0.0)
                self.kinds.append(entry.get(3, NORMAL))
            elif field == 2:
                spec = dict(_message(value))
                self.type, suffix = spec.get(3, UNIGRAM), spec.get(24, 0)
            elif field == 3:
                spec = dict(_message(value))
                chars = spec.get(2, b"")
                self.dummy_prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        self.type = model_type or self.type
        if self.type not in (UNIGRAM, BPE) or suffix:
            raise ValueError("only unigram and BPE models that mark spaces before words are supported")
        self.mapped = CharMap(chars) if chars else None
        self.own = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == USER_DEFINED}
        longest = sorted(self.own, key=len, reverse=True)
        self.own_pattern = re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None
        self.index = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds)) if k == NORMAL}
        self.byte_ids = [None] * 256
        for i, k in enumerate(self.kinds):
            if k == BYTE:
                self.byte_ids[int(self.pieces[i][3:-1], 16)] = i
        self.unknown = self.kinds.index(UNKNOWN) if UNKNOWN in self.kinds else 0
        self.characters = {c for p in self.index for c in p}
        #: No piece goes on with a space after another character, so texts can be cut there.
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in self.index)
        top = max((self.scores[i] for i in self.index.values()), default=0.0)
        for p, i in self.own.items():  # above any other way through the same bytes
            self.scores[i] = len(p.encode()) * top - 0.1
        self.worst = min((self.scores[i] for i in self.index.values()), default=0.0) - UNKNOWN_PENALTY
        #: By piece: whether it may follow another one, as far as asked.
        self.after: list[dict[int, bool]] = [{} for _ in self.pieces]
        self.asked = 0
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for p, i in self.index.items():
            if self.type == UNIGRAM or len(p) == 1 or self._merge(p) == [i]:
                self.automaton.add_word(p, (i, len(p), self.after[i]))
        if self.type == UNIGRAM:
            for p, i in self.own.items():
                self.automaton.add_word(p, (i, len(p), self.after[i]))
        self.automaton.make_automaton()

    def _merge(self, text: str) -> list[int]:
        """Plain BPE: join the best-scored neighbours, the first of equals, until none join; by a
        heap, so the time is n log n for a text of any length."""
        parts: list[str | None] = list(text)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int, str]] = []

        def offer(k: int) -> None:
            if k >= 0 and after[k] < n:
                both = parts[k] + parts[after[k]]
                i = self.index.get(both)
                if i is not None:
                    heapq.heappush(heap, (-self.scores[i], k, after[k], both))

        for k in range(n - 1):
            offer(k)
        while heap:
            _, k, mate, both = heapq.heappop(heap)
            if parts[k] is None or after[k] != mate or parts[k] + parts[mate] != both:
                continue  # one of the two has been joined since
            parts[k], parts[mate] = both, None
            after[k] = after[mate]
            if after[k] < n:
                before[after[k]] = k
            offer(before[k])
            offer(k)
        return [self.index.get(p, self.unknown) for p in parts if p is not None]

    def _together(self, a: int, b: int) -> bool:
        if self.asked > 300_000:
            for known in self.after:
                known.clear()
            self.asked = 0
        self.asked += 1
        found = self.after[b][a] = self._merge(self.pieces[a] + self.pieces[b]) == [a, b]
        return found

    def _bytes_of(self, char: str) -> list[int]:
        ids = [self.byte_ids[b] for b in char.encode()]
        return [self.unknown] if None in ids else ids

    def encode_part(self, text: str) -> list[int]:
        """Piece ids of normalised text (spaces are ▁)."""
        return self._by_pairs(text) if self.type == BPE else self._by_scores(text)

    def _by_scores(self, text: str) -> list[int]:
        n, low = len(text), float("-inf")
        best, back = [0.0] + [low] * n, [None] * (n + 1)
        ends: list[list[tuple[int, int, dict]]] = [[] for _ in range(n)]
        for end, out in self.automaton.iter(text):
            ends[end].append(out)
        for at in range(1, n + 1):
            single = False
            for i, size, _ in ends[at - 1]:
                single |= size == 1
                score = best[at - size] + self.scores[i]
                if score > best[at]:
                    best[at], back[at] = score, (i, size)
            if not single and best[at - 1] + self.worst > best[at]:
                best[at], back[at] = best[at - 1] + self.worst, (None, 1)
        out: list[list[int]] = []
        at = n
        while at:
            i, size = back[at]
            out.append([i] if i is not None else self._bytes_of(text[at - 1]))
            at -= size
        return [i for ids in reversed(out) for i in ids]

    def _by_pairs(self, text: str) -> list[int]:
        n = len(text)
        last: list[int] = [-2] + [-1] * n  # the piece that ends here; -2: a break, -1: none
        size_of = [0] * (n + 1)
        if not self.characters.issuperset(text):
            for k, c in enumerate(text):
                if c not in self.characters:
                    last[k + 1], size_of[k + 1] = -2, 1
        for end, (i, size, after) in self.automaton.iter(text):
            end += 1
            if last[end] == -1:
                before = last[end - size]
                if before >= 0:
                    ok = after.get(before)
                    if ok is None:
                        ok = self._together(before, i)
                else:
                    ok = before == -2
                if ok:
                    last[end], size_of[end] = i, size
        out: list[int] = []
        at = n
        while at:
            i = last[at]
            if i >= 0:
                out.append(i)
            elif i == -1:
                return self._merge(text)  # a piece that merging can't reach; not seen in trained models
            else:
                out += reversed(self._bytes_of(text[at - 1]))
            at -= size_of[at]
        out.reverse()
        return out

    def plain(self, text: str) -> str:
        """``text`` after the character map, which leaves user-defined pieces as they are."""
        if self.mapped is None:
            return text
        if self.own_pattern is None:
            return self.mapped(text)
        return "".join(x if x in self.own else self.mapped(x) for x in self.own_pattern.split(text))

    def normalise(self, text: str) -> str:
        text = self.plain(text)
        if self.squeeze:
            text = " ".join(x for x in text.split(" ") if x)
        text = ((SPACE if self.dummy_prefix and text else "") + text).replace(" ", SPACE)
        return text.rstrip(SPACE) if self.squeeze else text

    def encode(self, text: str) -> list[int]:
        text = self.normalise(text)
        if self.own_pattern is None or self.type == UNIGRAM:
            return self.encode_part(text)
        return [i for part in self.own_pattern.split(text) if part for i in ([self.own[part]] if part in self.own else self.encode_part(part))]

    def table(self) -> list[bytes]:
        """The bytes that each id decodes to."""
        out = []
        for i, (p, k) in enumerate(zip(self.pieces, self.kinds)):
            out.append(bytes([int(p[3:-1], 16)]) if k == BYTE else b"" if k == CONTROL else " ⁇ ".encode() if i == self.unknown else p.replace(SPACE, " ").encode())
        return out

    def decode(self, ids: list[int]) -> str:
        if not hasattr(self, "_table"):
            self._table = self.table()
        text = b"".join([self._table[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


@functools.lru_cache(maxsize=2)
def load(path: str) -> PieceModel:
    with storage.open_input(path) as handle:
        return PieceModel(handle.read())


@functools.lru_cache(maxsize=2)
def _parts(path: str) -> WordCodec:
    model = load(path)

    def encode(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        got = [model.encode_part(p.replace(" ", SPACE)) for p in parts]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter((i for x in got for i in x), np.uint32, int(sizes.sum())), sizes

    return WordCodec(encode)


def _text_by_text(column, model: PieceModel) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    for lo, hi in slices(column_bytes(column)[1]):
        found = [model.encode(t) for t in column.slice(lo, hi - lo).to_pylist()]
        counts = np.fromiter(map(len, found), np.int64, len(found))
        yield lo, hi, np.fromiter((i for ids in found for i in ids), np.uint32, int(counts.sum())), counts


def encode_column(column, path: str) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, ids, ids of each row) of each slice of a column of texts."""
    model, codec = load(path), _parts(path)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    if model.own_pattern is not None:
        yield from _text_by_text(column, model)
        return
    if model.mapped is not None:
        column = pa.array(map(model.plain, column.to_pylist()), column.type)
    # Marks that a text holds itself are not squeezed, but go at its end.
    if model.squeeze:
        column = pc.utf8_ltrim(pc.replace_substring_regex(column, " +", " "), " ")
    column = pc.replace_substring(column, SPACE, " ")
    if model.squeeze:
        column = pc.utf8_rtrim(column, " ")
    if model.dummy_prefix:
        column = pc.if_else(pc.equal(pc.binary_length(column), 0), column, pc.binary_join_element_wise("", column, " "))
    whole, offsets = column_bytes(column)
    newline_free = "\n" not in model.characters
    for lo, hi in slices(offsets):
        buf, off = whole[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        begins = np.zeros(len(buf), bool)
        if model.cuts and len(buf):
            space = buf == 32
            begins[1:] = space[1:] & ~space[:-1]
            if newline_free:
                line = buf == 10
                begins |= line
                begins[1:] |= line[:-1]
        begins[off[:-1][off[1:] > off[:-1]]] = True
        start = np.flatnonzero(begins)
        row = np.searchsorted(off, start, "right") - 1
        parts = pa.StringArray.from_buffers(len(start), pa.py_buffer(np.append(start, len(buf)).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(buf)))
        ids, sizes = codec(parts)
        yield lo, hi, ids, np.bincount(row, weights=sizes, minlength=hi - lo).astype(np.int64)


def encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """doc_id, ids, n_pieces, n_byte_pieces, round_trip (whether decoding the ids gives the text
    back).  With ``digests``: ids_crc32 (little-endian unsigned 32-bit ids) in the ids' place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        byte = np.array([k == BYTE for k in model.kinds])
        for batch in batches:
            for lo, hi, ids, counts in encode_column(batch.column(1), model_path):
                ends = np.cumsum(counts)
                rows = [ids[a:b] for a, b in zip((ends - counts).tolist(), ends.tolist())]
                texts = batch.column(1).slice(lo, hi - lo).to_pylist()
                back = [model.decode(r.tolist()) == (t or "") for r, t in zip(rows, texts)]
                if digests:
                    first = pa.array([zlib.crc32(r.tobytes()) for r in rows], pa.int64())
                else:
                    first = pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids.astype(np.int32)))
                n_bytes = pa.array([int(byte[r].sum()) for r in rows], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), first, pa.array(counts), n_bytes, pa.array(back)], names=["doc_id", "ids_crc32" if digests else "ids", "n_pieces", "n_byte_pieces", "round_trip"])
        _parts(model_path).forget()
        release()

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, {'ids_crc32 long' if digests else 'ids array<int>'}, n_pieces long, n_byte_pieces long, round_trip boolean")


def decode(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text of arrays of piece ids; a null array is a null text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(model_path)
        for batch in batches:
            texts = [None if ids is None else model.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    rows = encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
