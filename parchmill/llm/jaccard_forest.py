"""Operator 4: n-gram Jaccard join by a MinHash LSH forest, with exact verification.

Words are those of ``ALNUM`` on lower-cased text; a document is the set of its hashed five-word
shingles (a shorter document with words is one shingle).  Documents of equal sets are one class,
its smallest id the representative; only representatives are joined.

Forest.  Each representative has ``TREES`` labels of ``DEPTH`` MinHash bytes; a tree is the prefix
trie of its labels, read in sorted order.  A representative starts at its whole labels and
shortens the prefix at which it meets others, tree by tree, level by level, down to ``FLOOR``
at the least, until its recall is reached: a pair of similarity ``THRESHOLD`` shares a prefix of
d bytes with probability THRESHOLD**d, so stops d1, d2, ... miss it with probability
(1 - THRESHOLD**d1) * (1 - THRESHOLD**d2) * ...  Nodes of at most ``GROUP`` rows are shortened first, in the
order of levels and trees; nodes above it stay at the longer prefix, that is split by the next
byte, unless the rest of the forest can't reach the recall without them.  So the depth follows
the data row by row, and the bound of the recall doesn't.  A pair is a candidate in a tree if it
shares the shorter of its two stops, and belongs to the first such tree: it is verified and
counted once without a distinct.  Set sizes (an exact bound) and the agreement of the
signatures (six standard errors below the threshold) discard pairs before their sets are
compared exactly.

Skew.  Copies are folded before the join.  Nodes of one row at the floor are dropped after a
pre-aggregated count.  What is left above ``GROUP`` rows in a node after splitting is dealt into
blocks, and each pair of blocks is a unit of its own; no node is gathered in one task, no pair is
a row, and no partner or candidate is capped.  Units are dealt to an explicit number of
partitions, as their work isn't in proportion to their bytes.  A node of R near copies that
are all links of each other takes R * R / 2 comparisons, as it has that many links to count.
Units return counts of links for each representative and a spanning set of edges, both linear
in their rows.  Components come from star contraction with written tables between rounds.

Result: one row a document with class_id (the smallest id of its component), copy_id (smallest
id of the equal sets) and n_links (documents of similarity at least ``THRESHOLD``, copies
included).

Defined results: a null or wordless text has an empty set and no links.  Ids are whole numbers
(cast to long; ids that are none fail the job).  Rows that repeat an id are separate documents
of the same id.  A set that only documents of null id have is not joined: its documents count
each other and have a null class_id.  Empty tables give no rows.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parchmill.llm import storage
from parchmill.llm.textbuf import ALNUM, LOWER, Hasher, grams, mix, per_row, release, sliced, spans

SHINGLE = 5
THRESHOLD = 0.8
RECALL = 0.99999
TREES = 40
#: MinHash bytes of a whole label, and of the shortest prefix that may be matched.
DEPTH, FLOOR = 8, 5
#: Rows of a node that is split, and of a block of a node that can't be.
GROUP = 512
#: Rows of two units compared at a time.
STRIP = 256
#: Units of so many rows are compared many at a time.
SMALL = 48
#: Unit rows in a partition.
PART_ROWS = 8192


class Forest:
    """The shape of a forest, and where its rows stop shortening."""

    def __init__(self, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, depth: int = DEPTH, floor: int = FLOOR):
        self.threshold, self.trees, self.depth, self.floor = threshold, trees, depth, floor
        #: What a stop at each depth takes off the log of the probability to miss a pair.
        self.gain = [math.inf, *(-math.log1p(-(threshold**d)) if threshold < 1 else 50.0 for d in range(1, depth + 1))]
        self.need = -math.log1p(-recall)
        if trees * self.gain[floor] < self.need:
            raise ValueError("too few trees for this recall")

    def stops(self, crowded: np.ndarray) -> np.ndarray:
        """The prefix length at which each row meets others in each tree, from the length below
        which its nodes are crowded (the floor where none is)."""
        out = np.full(crowded.shape, self.depth, np.uint8)
        total = np.full(len(crowded), self.trees * self.gain[self.depth])
        for calm in (True, False):
            for level in range(self.depth - 1, self.floor - 1, -1):
                for t in range(self.trees):
                    step = (total < self.need) & (out[:, t] > level) & ((crowded[:, t] <= level) == calm)
                    total[step] += (self.gain[level] - np.take(self.gain, out[:, t]))[step]
                    out[step, t] = level
        return out

    def calm(self) -> np.ndarray:
        """The stops of a row without crowded nodes."""
        return self.stops(np.full((1, self.trees), self.floor))[0]


def _seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64))
    return (x[:n] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (x[n:] >> np.uint64(32)).astype(np.uint32)


def shingles(buf: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles of each text, rows and then hashes ascending."""
    low = LOWER[buf]
    start, end, row = spans(low, off, ALNUM)
    hashes, counts = Hasher(low)(start, end), per_row(row, len(off) - 1)
    at, found = grams(hashes, row, size)
    rows, keys = [row[at]], [found]
    for short in range(1, size):
        at, found = grams(hashes, row, short)
        whole = counts[row[at]] == short
        rows.append(row[at[whole]])
        keys.append(found[whole])
    row, key = np.concatenate(rows), np.concatenate(keys)
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    return row[new], key[new]


def signatures(row: np.ndarray, key: np.ndarray, n: int, width: int) -> np.ndarray:
    """``width`` MinHash bytes of each of n rows; zeros for empty sets."""
    out = np.zeros((n, width), np.uint8)
    if len(key):
        heads = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        x = (key >> np.uint64(32)).astype(np.uint32)
        y = key.astype(np.uint32)
        for k, (a, b) in enumerate(zip(*_seeds(width))):
            least = np.minimum.reduceat((x ^ b) * a + y, heads)
            out[row[heads], k] = (mix(least.astype(np.uint64) + np.uint64(k << 32)) >> np.uint64(56)).astype(np.uint8)
    return out


def _digests(row: np.ndarray, key: np.ndarray, n: int) -> list[np.ndarray]:
    """Two 64-bit digests of each row's set, as signed integers."""
    ends = np.cumsum(per_row(row, n))
    out = []
    for k in (1, 2):
        total = np.zeros(len(key) + 1, np.uint64)
        np.cumsum(mix(key + np.uint64(k)), out=total[1:])
        out.append((total[ends] - total[np.append(0, ends[:-1])]).view(np.int64) if n else np.zeros(0, np.int64))
    return out


def profiles(docs: DataFrame, width: int, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, set_a, set_b (128 bits of the shingle set), n (its size), sig."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in sliced(batch.column(1), 1 << 20):
                row, key = shingles(buf, off, size)
                n = hi - lo
                sig = signatures(row, key, n, width)
                sums = _digests(row, key, n)
                fixed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(width), n, [None, pa.py_buffer(sig.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(sums[0]), pa.array(sums[1]), pa.array(per_row(row, n)), fixed], names=["doc_id", "set_a", "set_b", "n", "sig"])
        release()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, set_a long, set_b long, n long, sig binary")


#: The largest difference of two labels that share a prefix of each length, plus one.
def _limits(depth: int) -> np.ndarray:
    return np.array([(1 << 64) - 1, *(1 << (64 - 8 * d) for d in range(1, depth + 1))], np.uint64)


def _labels(sig: np.ndarray, depth: int) -> np.ndarray:
    """Labels as whole numbers whose order is that of their bytes."""
    n = len(sig)
    wide = np.zeros((n, sig.shape[1] // depth, 8), np.uint8)
    wide[:, :, :depth] = sig.reshape(n, -1, depth)
    return wide.view(">u8").reshape(n, -1).astype(np.uint64)


class Units:
    """The rows of some whole units, unit after unit, and their candidate pairs.

    A unit holds the rows of one node, or of two blocks of a large one; ``one`` tells which."""

    def __init__(self, forest: Forest, unit: np.ndarray, tree: np.ndarray, one: np.ndarray, block: np.ndarray, sizes: np.ndarray, sig: np.ndarray, stops: np.ndarray):
        # Ascending sizes within a unit: the first of a pair has the smaller set.
        self.order = np.lexsort((sizes, unit))
        self.unit, self.tree, self.one, self.block = unit[self.order], tree[self.order], one[self.order], block[self.order]
        self.sizes, self.sig, self.stops = sizes[self.order].astype(float), sig[self.order], stops[self.order]
        self.labels, self.limits, self.forest = _labels(self.sig, forest.depth), _limits(forest.depth), forest
        # Half of the bytes are enough to tell the agreement by.
        self.checked = np.ascontiguousarray(self.sig[:, ::2])
        width, t = self.checked.shape[1], forest.threshold
        self.least = (t - 6 * math.sqrt(t * (1 - t) / width)) * width

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs (in the given order of rows) that their units' trees own and that may be
        links."""
        n = len(self.unit)
        heads = np.flatnonzero(np.concatenate([[True], self.unit[1:] != self.unit[:-1]])) if n else np.zeros(0, np.int64)
        lengths = np.diff(np.append(heads, n))
        small = np.repeat(lengths <= SMALL, lengths)
        for lag in range(1, SMALL):
            x = np.flatnonzero(small[:-lag] & (self.unit[:-lag] == self.unit[lag:])) if n > lag else np.zeros(0, np.int64)
            if not len(x):
                break
            for k in range(0, len(x), 1 << 15):
                yield from self._owned(x[k : k + (1 << 15)], x[k : k + (1 << 15)] + lag, True)
        for head, length in zip(heads[lengths > SMALL].tolist(), lengths[lengths > SMALL].tolist()):
            yield from self._strips(head, head + length)

    def _strips(self, lo: int, hi: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        columns = np.ascontiguousarray(self.checked[lo:hi].T)
        for i in range(lo, hi, STRIP):
            a = slice(i, min(hi, i + STRIP))
            for j in range(i, hi, STRIP):
                b = slice(j, min(hi, j + STRIP))
                if self.sizes[a.stop - 1] < self.forest.threshold * self.sizes[b.start]:
                    break  # sizes ascend: no later strip can hold a partner
                same = np.zeros((a.stop - a.start, b.stop - b.start), np.uint16)
                for column in columns:
                    same += column[a.start - lo : a.stop - lo, None] == column[None, b.start - lo : b.stop - lo]
                good = same >= self.least
                if i == j:
                    good &= np.arange(a.start, a.stop)[:, None] < np.arange(b.start, b.stop)[None, :]
                x, y = np.nonzero(good)
                yield from self._owned(x + i, y + j, False)

    def _owned(self, x: np.ndarray, y: np.ndarray, check: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        near = (self.sizes[x] >= self.forest.threshold * self.sizes[y]) & (self.one[x] | (self.block[x] != self.block[y]))
        x, y = x[near], y[near]
        if check and len(x):
            near = (self.checked[x] == self.checked[y]).sum(1) >= self.least
            x, y = x[near], y[near]
        if len(x):
            # A tree has the pair if the labels share the shorter stop; the first one owns it.
            met = (self.labels[x] ^ self.labels[y]) < self.limits[np.minimum(self.stops[x], self.stops[y])]
            own = met.any(1) & (met.argmax(1) == self.tree[x])
            if own.any():
                yield self.order[x[own]], self.order[y[own]]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """The rows of a column of ``width`` bytes each, without nulls, as they lie in its buffer."""
    column = column.cast(pa.binary())
    if not len(column):
        return np.zeros((0, width), np.uint8)
    _, ends, data = column.buffers()
    first = int(np.frombuffer(ends, np.int32)[column.offset])
    return np.frombuffer(data, np.uint8, len(column) * width, first).reshape(len(column), width)


KEY = ["tree", "node", "i", "j"]


def _whole_units(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches cut after the last row of a unit, and the number of each row's unit; a unit has at
    most two blocks of rows, which bounds what is held."""

    def runs(batch: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(batch.num_rows, bool)
        for k in range(len(KEY)):
            c = batch.column(k)
            new[1:] |= pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False)
        return np.cumsum(new)

    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        unit = runs(batch)
        cut = int(np.searchsorted(unit, unit[-1]))
        rest = batch.slice(cut)
        if cut:
            yield batch.slice(0, cut), unit[:cut]
    if rest is not None:
        yield rest, np.zeros(rest.num_rows, np.int64)


def _units_of(forest: Forest, calm: np.ndarray, batch: pa.RecordBatch, unit: np.ndarray, sizes: np.ndarray) -> Units:
    column = lambda name: batch.column(batch.schema.get_field_index(name))
    numbers = {c: column(c).to_numpy() for c in ("tree", "i", "j", "block")}
    stops = column("stops").fill_null(calm.tobytes())
    return Units(forest, unit, numbers["tree"], numbers["i"] == numbers["j"], numbers["block"], sizes, _matrix(column("sig"), forest.trees * forest.depth), _matrix(stops, forest.trees))


def _candidates(forest: Forest) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows (tree, node, i, j, block, set_a, set_b) of units that have a candidate pair there."""
    calm = forest.calm()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, unit in _whole_units(batches):
            units = _units_of(forest, calm, batch, unit, batch.column(batch.schema.get_field_index("n")).to_numpy())
            hit = np.zeros(batch.num_rows, bool)
            for x, y in units.pairs():
                hit[x] = hit[y] = True
            if hit.any():
                yield batch.select([*KEY, "block", "set_a", "set_b"]).filter(pa.array(hit))
        release()

    return run


def _verified(forest: Forest) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(rep, links, root): documents linked to a representative by a unit's pairs, and the
    smallest representative that these links join it to."""
    calm, threshold = forest.calm(), forest.threshold

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, unit in _whole_units(batches):
            column = lambda name: batch.column(batch.schema.get_field_index(name))  # noqa: B023, E731
            sets = column("keys").cast(pa.large_binary())
            ends = np.frombuffer(sets.buffers()[1], np.int64)[sets.offset : sets.offset + len(sets) + 1]
            flat = np.frombuffer(sets.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.uint64)
            ends = (ends[1:] - ends[0]) >> 3
            sizes = np.diff(np.append(0, ends))
            # Sets as positions in the batch's own dictionary of shingles.
            codes = np.unique(flat, return_inverse=True)[1].reshape(-1)
            reps, copies = column("rep").to_numpy(), column("copies").to_numpy()
            linked, root = np.zeros(len(reps), np.int64), np.arange(len(reps))

            def find(k: int) -> int:
                while root[k] != k:  # noqa: B023
                    root[k] = root[root[k]]  # noqa: B023
                    k = root[k]  # noqa: B023
                return k

            mark = np.zeros(int(codes.max()) + 1 if len(codes) else 1, bool)
            for xs, ys in _units_of(forest, calm, batch, unit, sizes).pairs():
                order = np.argsort(xs, kind="stable")
                xs, ys = xs[order], ys[order]
                heads = np.flatnonzero(np.concatenate([[True], xs[1:] != xs[:-1]]))
                for a, b in zip(heads, np.append(heads[1:], len(xs))):
                    x, mates = int(xs[a]), ys[a:b]
                    own = codes[ends[x] - sizes[x] : ends[x]]
                    mark[own] = True
                    lengths = sizes[mates]
                    to = np.cumsum(lengths)
                    at = np.repeat(ends[mates] - lengths - (to - lengths), lengths) + np.arange(to[-1])
                    both = np.add.reduceat(mark[codes[at]].astype(np.int64), to - lengths)
                    mark[own] = False
                    good = mates[both >= threshold * (sizes[x] + lengths - both) - 1e-9]
                    if len(good):
                        linked[x] += copies[good].sum()
                        np.add.at(linked, good, copies[x])
                        for y in good.tolist():
                            p, q = find(x), find(y)
                            if p != q:
                                root[max(p, q)] = min(p, q)
            some = np.flatnonzero(linked)
            if len(some):
                tops = reps[[find(k) for k in some.tolist()]]
                yield pa.RecordBatch.from_arrays([pa.array(reps[some]), pa.array(linked[some]), pa.array(tops)], names=["rep", "links", "root"])
        release()

    return run


def _nodes(members: DataFrame, forest: Forest, group: int) -> tuple[DataFrame, DataFrame | None]:
    """(tree, node, rows, set_a, set_b): the node at which each row meets others, and the stops of
    rows that have crowded nodes (``group``), if there are any."""
    plain = members.select("tree", F.col("prefix").alias("node"), "rows", "set_a", "set_b")
    crowd = members.where(F.col("rows") > group)
    if not crowd.limit(1).count():
        return plain, None
    row, at = ["set_a", "set_b"], F.posexplode
    paths = lambda least: F.transform(F.sequence(F.lit(least), F.lit(forest.depth)), lambda d: F.substring("label", F.lit(1), d))

    def by_row(rows: DataFrame, value: str) -> DataFrame:
        """One row a representative, with (tree, value) of each of its crowded trees: at most one a tree."""
        return rows.groupBy(*row).agg(F.collect_list(F.struct("tree", value)).alias("l"))

    # Crowded nodes below the floor, by pre-aggregated counts; how far down a row's own path is crowded.
    steps = crowd.select("tree", *row, at(paths(forest.floor + 1)).alias("k", "node"))
    deeper = steps.groupBy("tree", "node").agg(F.count("*").alias("rows")).where(F.col("rows") > group).select("tree", "node", F.lit(1).alias("more"))
    far = steps.join(deeper, ["tree", "node"], "left").groupBy("tree", *row).agg((F.lit(forest.floor + 1) + F.count("more")).cast("int").alias("crowded"))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crowded = np.full((batch.num_rows, forest.trees), forest.floor)
            for k, found in enumerate(batch.column(2).to_pylist()):
                for f in found:
                    crowded[k, f["tree"]] = f["crowded"]
            stops = pa.array([x.tobytes() for x in forest.stops(crowded)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), stops], names=[*row, "stops"])

    wished = storage.materialise(by_row(far, "crowded").mapInArrow(decide, "set_a long, set_b long, stops binary"), "stops")
    # A node is open if some row under it stops there: all rows under it stop at the shortest open prefix.
    stop = F.ascii(F.substring("stops", F.col("tree") + 1, F.lit(1)).cast("string"))
    crowd = crowd.join(wished, row)
    opened = crowd.select("tree", F.substring("label", F.lit(1), stop).alias("node")).distinct().withColumn("open", F.length("node"))
    steps = crowd.select("tree", *row, "label", at(paths(forest.floor)).alias("k", "node"))
    met = steps.join(opened, ["tree", "node"]).groupBy("tree", *row, "label").agg(F.min("open").alias("open"))
    met = storage.materialise(met, "open-nodes")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stops = _matrix(batch.column(2), forest.trees).copy()
            for k, found in enumerate(batch.column(3).to_pylist()):
                for f in found:
                    stops[k, f["tree"]] = f["open"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in stops], pa.binary())], names=[*row, "stops"])

    settled = wished.join(by_row(met, "open"), row).select(*row, "stops", "l").mapInArrow(settle, "set_a long, set_b long, stops binary")
    split = met.select("tree", F.substring("label", F.lit(1), F.col("open")).alias("node"), *row)
    sizes = split.groupBy("tree", "node").agg(F.count("*").alias("rows")).where("rows > 1")
    split = split.join(sizes, ["tree", "node"]).select("tree", "node", "rows", *row)
    return plain.where(F.col("rows") <= group).union(split), storage.materialise(settled, "stops")


def links(docs: DataFrame, forest: Forest, size: int = SHINGLE, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, counts, edges): doc, its set and its representative; links of each representative
    to documents of other sets; a spanning set of the links between representatives."""
    spark, trees, width = docs.sparkSession, forest.trees, forest.trees * forest.depth
    made = storage.materialise(profiles(docs, width, size, id_col, text_col), "profiles")
    classes = made.where("n > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.min(F.struct("n", "sig")).alias("s"))
    reps = storage.materialise(classes.select("set_a", "set_b", "rep", "copies", F.col("s.n").alias("n"), F.col("s.sig").alias("sig")), "representatives")

    # Nodes of two rows and more at the floor, by pre-aggregated counts.
    label = lambda t: F.struct(t.cast("int").alias("tree"), F.substring("sig", t * forest.depth + 1, F.lit(forest.depth)).alias("label"))
    labels = reps.where("rep IS NOT NULL").select("set_a", "set_b", F.explode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), label)).alias("l"))
    labels = labels.select("set_a", "set_b", "l.tree", "l.label", F.substring("l.label", 1, forest.floor).alias("prefix"))
    shared = storage.materialise(labels.groupBy("tree", "prefix").agg(F.count("*").alias("rows")).where("rows > 1"), "floor-nodes")
    members = storage.materialise(labels.join(shared, ["tree", "prefix"]), "members")
    nodes, stops = _nodes(members, forest, group)

    # A small node is one unit; block x of a large one meets each block y in the unit (min, max).
    nodes = nodes.withColumn("blocks", F.ceil(F.col("rows") / F.lit(group)).cast("int")).withColumn("block", F.pmod(F.xxhash64("set_a", "set_b"), F.col("blocks")).cast("int"))
    units = nodes.withColumn("other", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))))
    units = storage.materialise(units.select("tree", "node", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "set_a", "set_b"), "units")
    signed = reps.select("set_a", "set_b", "n", "sig")
    signed = signed.withColumn("stops", F.lit(None).cast("binary")) if stops is None else signed.join(stops, ["set_a", "set_b"], "left")

    def dealt(rows: DataFrame, of: DataFrame) -> DataFrame:
        """Whole units, in sorted order of prefixes, over a number of partitions that follows the
        rows (adaptive execution would merge partitions by bytes)."""
        parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-of.count() // PART_ROWS))
        return rows.repartition(parts, *KEY).sortWithinPartitions(*KEY)

    light = units.join(signed, ["set_a", "set_b"]).select(*KEY, "block", "set_a", "set_b", "n", "sig", "stops")
    wanted = storage.materialise(dealt(light, units).mapInArrow(_candidates(forest), "tree int, node binary, i int, j int, block int, set_a long, set_b long"), "candidates")
    storage.discard(shared, members, units)

    # Only representatives with candidates bring their texts, once, and their sets to the units.
    needed = wanted.select("set_a", "set_b").distinct().join(reps, ["set_a", "set_b"]).select("rep", "set_a", "set_b", "copies")
    # An id may repeat with other texts: the set's digest decides which row is meant.
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
    sets = storage.materialise(_sets(needed.join(texts, "rep"), size), "sets")
    heavy = wanted.join(sets, ["set_a", "set_b"]).join(signed, ["set_a", "set_b"]).select(*KEY, "block", "rep", "copies", "keys", "sig", "stops")
    found = storage.materialise(dealt(heavy, wanted).mapInArrow(_verified(forest), "rep long, links long, root long"), "links")
    storage.discard(wanted, sets)
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    edges = found.where("rep <> root").select(F.col("rep").alias("u"), F.col("root").alias("v")).distinct()
    joined = made.join(reps.select("set_a", "set_b", "rep", "copies"), ["set_a", "set_b"], "left")
    return joined.select("doc_id", "set_a", "set_b", "n", F.coalesce("rep", "doc_id").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies")), counts, edges


def _sets(rows: DataFrame, size: int) -> DataFrame:
    """set_a, set_b, rep, copies, keys (sorted shingle hashes), from rows that have the text too;
    rows whose text has another set than set_a and set_b say are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.schema.get_field_index("text")
            a, b, rep, copies = (batch.column(batch.schema.get_field_index(c)) for c in ("set_a", "set_b", "rep", "copies"))
            for lo, hi, buf, off in sliced(batch.column(text), 1 << 20):
                row, key = shingles(buf, off, size)
                n = hi - lo
                total = _digests(row, key, n)
                same = (total[0] == a.slice(lo, n).to_numpy()) & (total[1] == b.slice(lo, n).to_numpy())
                keys = [x.tobytes() for x in np.split(key, np.cumsum(per_row(row, n))[:-1])]
                part = pa.RecordBatch.from_arrays([a.slice(lo, n), b.slice(lo, n), rep.slice(lo, n), copies.slice(lo, n), pa.array(keys, pa.binary())], names=["set_a", "set_b", "rep", "copies", "keys"])
                yield part.filter(pa.array(same))
        release()

    return rows.mapInArrow(run, "set_a long, set_b long, rep long, copies long, keys binary").dropDuplicates(["set_a", "set_b"])


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """u, root: the smallest node of each node's component, by alternating large and small stars.
    Each round is a pre-aggregated minimum and a join, and is written to the shared folder."""
    pairs = storage.materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        last, pairs = pairs, storage.materialise(small, "edges")
        storage.discard(last)
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return pairs.select("u", F.col("v").alias("root"))
        before = now
    raise RuntimeError("components: no end after the given rounds")


def _classes(docs: DataFrame, threshold: float, size: int, trees: int, recall: float, group: int, id_col: str, text_col: str) -> DataFrame:
    """One row a document: doc_id, set_a, set_b, n (shingles), class_id, copy_id, n_links."""
    members, counts, edges = links(docs, Forest(threshold, trees, recall), size, group, id_col, text_col)
    roots = components(edges)
    joined = members.join(counts, "rep", "left").join(roots.withColumnRenamed("u", "rep"), "rep", "left")
    return joined.select("doc_id", "set_a", "set_b", "n", F.coalesce("root", "rep").alias("class_id"), F.col("rep").alias("copy_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"))


def join(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, trees: int = TREES, recall: float = RECALL, group: int = GROUP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: doc_id, class_id, copy_id, n_links."""
    return _classes(docs, threshold, size, trees, recall, group, id_col, text_col).drop("set_a", "set_b", "n")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all its columns; of each component one row of the smallest id stays.

    Documents without words are no copies of each other and all stay; so do those of a null id
    whose set no other id has.  Where the smallest id repeats, one row of each of its different
    sets stays (a component has only its ids), of equal sets the row whose columns have the
    smallest hash, in whatever order the rows come."""
    found = storage.materialise(_classes(docs, threshold, size, TREES, RECALL, GROUP, id_col, text_col).select("doc_id", "set_a", "set_b", "n", "class_id"), "classes")
    ids = found.groupBy("doc_id").agg(F.count("*").alias("times"), F.max(F.expr("n = 0 OR doc_id <=> class_id")).alias("stays"))
    key = storage.free_name("kept_id", docs)
    single = ids.where("times = 1 AND stays").select(F.col("doc_id").alias(key))
    out = docs.join(single, F.col(id_col).cast("long").eqNullSafe(F.col(key)), "left_semi")
    many = ids.where("times > 1").select(F.col("doc_id").alias(key))
    if not many.limit(1).count():
        return out
    # Rows of repeated ids: their sets tell their components, as their ids don't.
    again = docs.join(many, F.col(id_col).cast("long").eqNullSafe(F.col(key)), "left_semi")
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    marked = _with_sets(again.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), whole.alias("row")), size)
    judged = marked.join(found.where("n > 0").select(F.col("doc_id").alias("d"), F.col("set_a").alias("a"), F.col("set_b").alias("b"), "class_id").distinct(), F.expr("n > 0 AND doc_id <=> d AND set_a = a AND set_b = b"), "left")
    stay = judged.where("n = 0 OR class_id IS NULL").select("row.*")
    one = judged.where("n > 0 AND doc_id = class_id").groupBy("class_id", "set_a", "set_b").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row.*")
    return out.unionByName(stay).unionByName(one)


def _with_sets(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` (of columns doc_id, text, row) with set_a, set_b and n of their texts in the text's place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, off in sliced(batch.column(1), 1 << 20):
                row, key = shingles(buf, off, size)
                n = hi - lo
                sums = _digests(row, key, n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(sums[0]), pa.array(sums[1]), pa.array(per_row(row, n)), batch.column(2).slice(lo, n)], names=["doc_id", "set_a", "set_b", "n", "row"])

    from pyspark.sql.types import LongType, StructField, StructType

    fields = [StructField(c, LongType()) for c in ("doc_id", "set_a", "set_b", "n")]
    return rows.mapInArrow(run, StructType([*fields, rows.schema["row"]]))
