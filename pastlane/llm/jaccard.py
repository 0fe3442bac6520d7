"""Documents whose sets of word shingles are alike, by count vectors in R-trees (operator 7).

Two sets link when their Jaccard similarity is ``SIMILARITY`` or more. A set's shingles are
hashed into groups; the counts of the groups are a point. For two points the sum of the smaller
coordinates bounds the overlap of the sets, and for two boxes the sum of the smaller upper edges
bounds that of all sets in them, so an R-tree over the points leaves whole subtrees out. What
survives is verified on the shingles themselves.

The tree alone would hold every part of the corpus against every other. So its upper level is a
partition in which two sets that link must meet: a set goes to the cells of its first
shingles (a quarter of them and one) in an order that puts frequent shingles last. The least set of a cell is its
leader; the cells of one leader make a unit, since near copies share most of them, and the trees are built in the units. Before that, each set
is held against one leader, and the links found are made components; then only units of several components are
searched, and only pairs of different ones are looked for. A search tells which members may link to any other, never which pairs. Their shingles are
then brought to their units, verified there, and a unit gives links of different components only, fewer than it has members. So no
table has more rows than sets have places in units. A unit with more shingles than a task should have is split into slices,
and every two slices meet.

Words are runs without white space, A-Z in lower case; a set has the different runs of five words,
or the whole of a shorter text. A text without words (or null) has an empty set and no links.
Equal sets are one class from the start. Sets are told apart by 64-bit hashes and
verified on 48 bits of each shingle's. Rows without id take no part and have no component. Repeated rows and rows that
share an id are rows of their own, each with its own set. An empty table gives no rows. A very long text is held whole by its task, with 6 bytes
a shingle. Only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pastlane.llm.arrays import Lookup, Words, mix, slices
from pastlane.llm.components import components, in_bitmap, marked, small_batches, written

WORDS = 5
SIMILARITY = (75, 100)
# The order is made from one set in SAMPLED; it changes the work but not the result. A shingle
# is frequent if FREQUENT of those have it, and no less than one in FREQUENT_SHARE of all their shingles is it, so
# there are FREQUENT_SHARE of them at most, and a shingle that is not frequent has so small a share that its sets can be gathered.
SAMPLED = 8
FREQUENT = 8
FREQUENT_SHARE = 1 << 17
SLICE = 1 << 19  # shingles of a slice of a unit
LEAF = 16
BITS = 1 << 25  # bytes of the shingles of a slice as a table of bits
MARK_BITS = (16, 27)  # bits of a bitmap of ids, as powers of two: the bound of what is broadcast
PER_GROUP = 4  # shingles of a set to a group, about
REMEMBERED_SETS = 100_000
PART = 20_000  # first shingles that are gathered at once, about
HELD = 400_000  # first shingles that a task holds before it deals them out

_BYTES = 6


def pack(values: np.ndarray) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_BYTES].tobytes()


def unpack(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // _BYTES, 8), np.uint8)
    wide[:, :_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, _BYTES)
    return wide.view("<u8").ravel()


def shingle_sets(words: Words) -> Iterator[np.ndarray]:
    """The different shingles' hashes of each row, in order."""
    hashes = words.hashes()
    grams, at = words.grams(hashes, WORDS)
    grams &= np.uint64((1 << 8 * _BYTES) - 1)
    ends = np.searchsorted(words.doc[at], np.arange(words.rows + 1))
    for row in range(words.rows):
        n = words.n[row]
        if n >= WORDS:
            yield np.unique(grams[ends[row]:ends[row + 1]])
        elif n:
            own = hashes[words.first[row]:words.first[row] + n]
            whole = mix(np.cumsum(own * np.arange(3, 3 + 2 * n, 2, dtype=np.uint64))[-1:] + np.uint64(n))
            yield whole & np.uint64((1 << 8 * _BYTES) - 1)
        else:
            yield hashes[:0]


def count_vector(shingles: np.ndarray) -> bytes:
    """Counts of the shingles' groups, half a byte each; 15 stands for that many and more."""
    groups = 16
    while groups * PER_GROUP < len(shingles) and groups < 1 << 14:
        groups *= 2
    counts = np.bincount((shingles & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    counts = np.minimum(counts, 15).astype(np.uint8)
    return (counts[0::2] | counts[1::2] << 4).tobytes()


def opened(vector: bytes) -> np.ndarray:
    """The counts as upper bounds: one that is full bounds nothing."""
    packed = np.frombuffer(vector, np.uint8)
    counts = np.stack([packed & 15, packed >> 4], axis=1).ravel().astype(np.int32)
    counts[counts == 15] = 1 << 20
    return counts


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """The counts of fewer groups: groups are shingles modulo a power of two, so these are sums."""
    return counts.reshape(*counts.shape[:-1], -1, groups).sum(axis=-2)


def enough(overlap, a, b):
    """Whether an overlap of sets of a and b shingles makes a link (or might, if it is a bound)."""
    return SIMILARITY[1] * overlap >= SIMILARITY[0] * (a + b - overlap)


def may_link(a: bytes, n: int, b: bytes, m: int) -> bool:
    if not enough(min(n, m), n, m):
        return False
    x, y = opened(a), opened(b)
    groups = min(len(x), len(y))
    return bool(enough(int(np.minimum(folded(x, groups), folded(y, groups)).sum()), n, m))


class RTree:
    """Boxes of points of one number of groups: leaves of LEAF points, then nodes of LEAF boxes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, components: np.ndarray):
        order = np.lexsort((sizes, components))  # near copies side by side make small boxes
        self.rows = order
        self.points, self.sizes, self.components = points[order], sizes[order], components[order]
        level = (self.points, self.sizes, self.sizes, self.components, self.components)
        self.levels = [level]
        while len(level[0]) > 1:
            starts = np.arange(0, len(level[0]), LEAF)
            level = (np.maximum.reduceat(level[0], starts), np.minimum.reduceat(level[1], starts),
                     np.maximum.reduceat(level[2], starts), np.minimum.reduceat(level[3], starts),
                     np.maximum.reduceat(level[4], starts))
            self.levels.append(level)

    def fold(self, groups: int) -> RTree:
        return RTree(folded(self.points, groups), self.sizes, self.components)

    def pairs(self, other: RTree) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows (of self, of other) of different components that may link, block by block."""
        todo = [(len(self.levels) - 1, 0, len(other.levels) - 1, 0)]
        while todo:
            la, a, lb, b = todo.pop()
            down_a, down_b = la >= lb and la > 0, lb >= la and lb > 0
            la, lb = la - down_a, lb - down_b
            x = slice(a * LEAF, (a + 1) * LEAF) if down_a else slice(a, a + 1)
            y = slice(b * LEAF, (b + 1) * LEAF) if down_b else slice(b, b + 1)
            ha, low_a, high_a, from_a, to_a = (v[x] for v in self.levels[la])
            hb, low_b, high_b, from_b, to_b = (v[y] for v in other.levels[lb])
            one = (from_a == to_a)[:, None] & (from_b == to_b)[None, :] & (from_a[:, None] == from_b[None, :])
            most = np.minimum(high_a[:, None], high_b[None, :])
            least_a, least_b = low_a[:, None], low_b[None, :]
            # Of all sizes in the boxes those of the easiest link: as large an overlap, as small a union as can be.
            ok = ~one & (SIMILARITY[1] * most >= SIMILARITY[0] * np.maximum(least_a, least_b))
            if ok.any():
                overlap = np.minimum(np.minimum(ha[:, None, :], hb[None, :, :]).sum(axis=2), most)
                ok &= enough(overlap, least_a, least_b)
            i, j = np.nonzero(ok)
            if la == lb == 0:
                yield self.rows[x.start + i], other.rows[y.start + j]
            else:
                todo += [(la, x.start + int(p), lb, y.start + int(q)) for p, q in zip(i, j, strict=True)]


def unit_pairs(members: list[dict]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of a unit's members (n, vector, component, side) that may link and do not yet, in blocks of pairs.

    Members of side 0 meet each other; of sides 1 and 2, only those of the other. A pair may come twice.
    """
    trees: dict[tuple[int, int], RTree] = {}
    kinds: dict[tuple[int, int], list[int]] = {}
    for place, x in enumerate(members):
        kinds.setdefault((x["side"], 2 * len(x["vector"])), []).append(place)
    for kind, own in kinds.items():
        tree = RTree(np.array([opened(members[i]["vector"]) for i in own]), np.array([members[i]["n"] for i in own]),
                     np.array([members[i]["component"] for i in own]))
        tree.rows = np.array(own)[tree.rows]
        trees[kind] = tree
    for (side, groups), tree in trees.items():
        # Sizes of a link differ by a third at most, so the numbers of groups by a factor of two at most.
        for other_groups in (groups, 2 * groups, groups // 2):
            for other_side in ((0,) if side == 0 else (3 - side,)):
                if (other_side, other_groups) not in trees or (other_side, other_groups) < (side, groups):
                    continue
                other = trees[other_side, other_groups]
                least = min(groups, other_groups)
                left = tree if least == groups else _same_order(tree, least)
                right = other if least == other_groups else _same_order(other, least)
                yield from left.pairs(right)


def _same_order(tree: RTree, groups: int) -> RTree:
    made = tree.fold(groups)
    made.rows = tree.rows[made.rows]
    return made


class Overlaps:
    """How many shingles two of some sets share: by bits, or one pair after the other where the bits would be too many."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        values, code = np.unique(np.concatenate(sets), return_inverse=True)
        width = -(-len(values) // 64) * 64
        self.bits = None
        if len(sets) * width // 8 <= BITS:
            on = np.zeros((len(sets), width), bool)
            on[np.repeat(np.arange(len(sets)), [len(x) for x in sets]), code] = True
            self.bits = np.packbits(on, axis=1).view(np.uint64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.bits is not None:
            return np.bitwise_count(self.bits[a] & self.bits[b]).sum(axis=1, dtype=np.int64)
        return np.array([len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True)) for i, j in zip(a, b, strict=True)])


def unit_links(members: list[dict]) -> Iterator[tuple[int, int]]:
    """Links between members (set, items, component, side) of different components, each of which makes them one."""
    sets = [unpack(x["items"]) for x in members]
    size = np.array([len(x) for x in sets])
    known = [{"n": len(x), "vector": count_vector(x), "component": m["component"], "side": m["side"]} for x, m in zip(sets, members, strict=True)]
    _, label = np.unique(np.array([m["component"] for m in members]), return_inverse=True)
    overlap = Overlaps(sets)
    for a, b in unit_pairs(known):
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
        if len(a):
            linked = enough(overlap(a, b), size[a], size[b])
            for i, j in zip(a[linked].tolist(), b[linked].tolist(), strict=True):
                if label[i] != label[j]:
                    yield members[i]["set"], members[j]["set"]
                    label[label == label[j]] = label[i]


def set_number(shingles: np.ndarray) -> int:
    """What a set is told apart by: a hash of its shingles in any order."""
    size = np.uint64(len(shingles))
    return int(mix(np.add.reduce(mix(shingles + size))[None] ^ size).view(np.int64)[0])


class Seen:
    """The sets that a task has met, so that copies are not sent twice; it forgets them when they are many."""

    def __init__(self):
        self.numbers: set = set()

    def first_time(self, number: object) -> bool:
        if number in self.numbers:
            return False
        if len(self.numbers) >= REMEMBERED_SETS:
            self.numbers.clear()
        self.numbers.add(number)
        return True


def _sets_of(column: pa.Array) -> Iterator[np.ndarray]:
    for start, stop in slices(column):
        yield from shingle_sets(Words(column.slice(start, stop - start)))


def _numbered(docs: DataFrame) -> DataFrame:
    """(id, mark, n, set) of all rows, and the vector where a task meets a set for the first time."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            n, sets, vectors = [], [], []
            for shingles in _sets_of(batch.column(1)):
                own = set_number(shingles) if len(shingles) else None
                n.append(len(shingles))
                sets.append(own)
                vectors.append(count_vector(shingles) if own is not None and seen.first_time(own) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(sets, pa.int64()), pa.array(vectors, pa.binary())],
                ["id", "mark", "n", "set", "vector"])

    return docs.select("id", "text", "mark").mapInArrow(number, "id long, mark long, n long, set long, vector binary")


def _items(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(set, items): the shingles of the sets of ``needed`` (set, least), read again from the row of least id that has each.

    They are most of the data and few are needed, so they are not kept from an earlier pass. Bitmaps of bounded size
    tell tasks which rows and sets are surely not needed; what they let through is joined.
    """
    low, high = MARK_BITS
    bits = min(high, max(low, int(needed.count()).bit_length() + 4))
    shared = docs.sparkSession.sparkContext.broadcast((marked(needed, "set", bits), marked(needed, "least", bits)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Seen()
        for batch in batches:
            wanted, ids = shared.value
            batch = batch.filter(pa.array([in_bitmap(ids, x) for x in batch.column(0).to_pylist()], pa.bool_()))
            found = [(key, own, pack(x)) for key, x in zip(batch.column(0).to_pylist(), _sets_of(batch.column(1)), strict=True)
                     if len(x) and in_bitmap(wanted, own := set_number(x)) and seen.first_time((key, own))]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _, _ in found], pa.int64()), pa.array([x for _, x, _ in found], pa.int64()),
                                              pa.array([x for _, _, x in found], pa.binary())], ["least", "set", "items"])

    rows = docs.select("id", "text").mapInArrow(read, "least long, set long, items binary")
    return rows.join(needed, ["set", "least"], "left_semi").select("set", "items").dropDuplicates(["set"])


def _frequent(docs: DataFrame) -> np.ndarray:
    """Shingles that many rows of a sample have."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = list(_sets_of(batch.column(0)))
            if values:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(values).view(np.int64))], ["key"])

    sample = docs.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLED)) == 0).select("text")
    counts = written(sample.mapInArrow(each, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") >= FREQUENT), "frequent")
    least = (counts.agg(F.sum("n")).first()[0] or 0) / FREQUENT_SHARE
    rows = counts.where(F.col("n") >= least).select("key").collect()
    return np.array([r.key for r in rows], np.int64).view(np.uint64)


def _first_shingles(docs: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """The first shingles of the sets: (part, keys, sets), packed by part of the keys, and (key, set) of frequent ones."""
    hot = docs.sparkSession.sparkContext.broadcast(Lookup(mix(_frequent(docs))))  # FREQUENT_SHARE at most

    def first(batches: Iterator[pa.RecordBatch], frequent: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held, size, seen = [], 0, Seen()
        for batch in batches:
            for shingles in _sets_of(batch.column(0)):
                if not len(shingles) or not seen.first_time(number := set_number(shingles)):
                    continue
                values = mix(shingles)  # an order that has nothing to do with the groups
                late = np.zeros(len(values), bool)
                late[hot.value.find(values)[0]] = True
                need = -(-SIMILARITY[0] * len(values) // SIMILARITY[1])
                chosen = np.lexsort((values, late))[:len(values) - need + 1]
                keys = values[chosen[late[chosen] == frequent]]
                held.append((keys, np.full(len(keys), number, np.int64)))
                size += len(keys)
                if size >= HELD:
                    yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
                    held, size = [], 0
        if size:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, sets in first(batches, frequent=False):
            part = (keys % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            begin = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0])
            cuts = [order[x:y] for x, y in zip(begin, np.append(begin[1:], len(order)), strict=True)]
            yield pa.RecordBatch.from_arrays([
                pa.array(part[order[begin]]), pa.array([keys[x].tobytes() for x in cuts], pa.binary()),
                pa.array([sets[x].tobytes() for x in cuts], pa.binary())], ["part", "keys", "sets"])

    def often(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, sets in first(batches, frequent=True):
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sets)], ["key", "set"])

    texts = docs.select("text")
    return (texts.mapInArrow(rare, "part long, keys binary, sets binary"), texts.mapInArrow(often, "key long, set long"))


def _met(table: pa.Table) -> pa.Table:
    """The cells of a part: the sets of each key that two sets or more have."""
    keys = np.concatenate([np.frombuffer(x.as_py(), np.uint64) for x in table["keys"]])
    sets = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in table["sets"]])
    order = np.lexsort((sets, keys))
    keys, sets = keys[order], sets[order]
    new = np.r_[True, (keys[1:] != keys[:-1]) | (sets[1:] != sets[:-1])]  # a set once, however many tasks met it
    keys, sets = keys[new], sets[new]
    begin = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    size = np.diff(np.append(begin, len(keys)))
    shared = size > 1
    rows = np.repeat(shared, size)
    ends = np.r_[0, np.cumsum(size[shared])]
    return pa.table({"sets": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(sets[rows], pa.int64()))})


def _cells(docs: DataFrame, shingles: int) -> DataFrame:
    """(cell, set, size, leader, weight): who meets whom. Cells of the same members are one, with their number as weight.

    The few sets of a shingle that is not frequent are gathered, by parts of PART keys or so;
    those of a frequent one are counted and joined.
    """
    share = 1 - SIMILARITY[0] / SIMILARITY[1]
    rare, often = _first_shingles(docs, max(1, int(shingles * share) // PART))
    rare = rare.groupBy("part").applyInArrow(_met, "sets array<long>")
    rare = rare.groupBy(F.xxhash64("sets").alias("cell")).agg(F.first("sets").alias("sets"), F.count(F.lit(1)).alias("weight")).select(
        "cell", F.explode("sets").alias("set"), F.size("sets").cast("long").alias("size"), F.col("sets")[0].alias("leader"), "weight")
    often = written(often.select(F.col("key").alias("cell"), "set").distinct(), "frequent")
    sizes = often.groupBy("cell").agg(F.count(F.lit(1)).alias("size"), F.min("set").alias("leader")).where("size > 1")
    often = often.join(sizes, "cell").select("cell", "set", "size", "leader", F.lit(1).cast("long").alias("weight"))
    return written(rare.unionByName(often), "cells")


def _leader_links(pairs: DataFrame, vectors: DataFrame, docs: DataFrame, rows_of: DataFrame) -> DataFrame:
    """The pairs (a, b), one for each set a, that link. Shingles are read and shuffled only for sets of pairs that may."""
    @F.arrow_udf("boolean")
    def may(a: pa.Array, n: pa.Array, b: pa.Array, m: pa.Array) -> pa.Array:
        return pa.array([may_link(*x) for x in zip(*(y.to_pylist() for y in (a, n, b, m)), strict=True)], pa.bool_())

    left = vectors.select(F.col("set").alias("a"), F.col("n").alias("n"), F.col("vector").alias("va"))
    right = vectors.select(F.col("set").alias("b"), F.col("n").alias("m"), F.col("vector").alias("vb"))
    pairs = written(pairs.join(left, "a").join(right, "b").where(may("va", "n", "vb", "m")).select("a", "b"), "pairs")
    needed = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).select(F.col("a").alias("set")).distinct()
    items = written(_items(docs, written(rows_of.join(needed, "set"), "needed")), "items")

    @F.arrow_udf("boolean")
    def link(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            found = []
            for a, b in zip(left, right, strict=True):
                x, y = unpack(a.as_py()), unpack(b.as_py())
                common = len(np.intersect1d(x, y, assume_unique=True))
                found.append(bool(enough(common, len(x), len(y))))
            yield pa.array(found, pa.bool_())

    whole = pairs.join(items.select(F.col("set").alias("a"), F.col("items").alias("ia")), "a").join(
        items.select(F.col("set").alias("b"), F.col("items").alias("ib")), "b")
    return whole.where(link("ia", "ib")).select("a", "b")


def _units(cells: DataFrame, vectors: DataFrame, known: DataFrame) -> DataFrame:
    """(unit, set, side, component): what is searched together; units of several components only."""
    places = cells.select(F.col("leader").alias("unit"), "set").distinct().join(vectors.select("set", "n"), "set")
    rows = written(places.join(known, places["set"] == known["node"], "left").select(
        "unit", "set", "n", F.coalesce("component", "set").alias("component")), "units")
    spread = rows.groupBy("unit").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.ceil(F.sum("n") / SLICE).alias("slices")).where("low <> high")
    rows = rows.join(spread.select("unit", "slices"), "unit")
    # A unit of s slices has a unit for each slice and for each two slices.
    rows = rows.withColumn("slice", F.pmod(F.xxhash64("set"), F.col("slices"))).withColumn(
        "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)))
    return written(rows.select(
        F.xxhash64("unit", F.least("slice", "other"), F.greatest("slice", "other")).alias("unit"), "set",
        F.when(F.col("slices") == 1, 0).when(F.col("slice") == F.col("other"), 0).when(F.col("slice") < F.col("other"), 1).otherwise(2).alias("side"),
        "component"), "searched-units")


def _searched(units: DataFrame, vectors: DataFrame) -> DataFrame:
    """(unit, set) of the members that may link to another of their unit."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit, members in zip(batch.column(0), batch.column(1), strict=True):
                members = members.as_py()
                on = np.zeros(len(members), bool)
                for a, b in unit_pairs(members):
                    on[a] = on[b] = True
                found = [members[i]["set"] for i in np.flatnonzero(on)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([unit.as_py()] * len(found), pa.int64()), pa.array(found, pa.int64())], ["unit", "set"])

    whole = units.join(vectors, "set").groupBy("unit").agg(
        F.collect_list(F.struct("set", "n", "vector", "component", "side")).alias("members"))
    return whole.mapInArrow(search, "unit long, set long")


def _unit_links(units: DataFrame, found: DataFrame, docs: DataFrame, rows_of: DataFrame) -> DataFrame:
    """(a, b): links that make the components of each unit's members one."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for members in batch.column(0):
                links = list(unit_links(members.as_py()))
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()),
                                                  pa.array([y for _, y in links], pa.int64())], ["a", "b"])

    needed = written(rows_of.join(found.select("set").distinct(), "set"), "needed")
    items = written(_items(docs, needed), "items")
    whole = units.join(found, ["unit", "set"]).join(items, "set").groupBy("unit").agg(
        F.collect_list(F.struct("set", "items", "component", "side")).alias("members"))
    return whole.select("members").mapInArrow(verify, "a long, b long")


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, mark, n, class, component): every row with the size of its set and the least id that links reach from it.

    ``mark`` is a hash of the text, which tells rows apart that share an id; ``class`` is one number for all rows that links join.
    """
    with small_batches(docs.sparkSession):
        return _components(docs, key, text)


def _components(docs: DataFrame, key: str, text: str) -> DataFrame:
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(F.col(text)).alias("mark"))
    rows = written(_numbered(docs), "sets")
    docs = docs.where(F.col("id").isNotNull())
    vectors = written(rows.where(F.col("vector").isNotNull()).groupBy("set").agg(
        F.first("n").alias("n"), F.first("vector").alias("vector")), "vectors")

    rows_of = written(rows.where(F.col("id").isNotNull() & F.col("set").isNotNull()).groupBy("set").agg(
        F.min("id").alias("least")), "rows-of-sets")
    cells = _cells(docs, vectors.agg(F.sum("n")).first()[0] or 0)

    # One leader for each set: the one that it shares most cells with.
    led = cells.where("leader <> set").groupBy("set", "leader").agg(F.sum("weight").alias("n")).groupBy("set").agg(
        F.max_by("leader", F.struct("n", "leader")).alias("leader")).select(F.col("set").alias("a"), F.col("leader").alias("b"))
    links = written(_leader_links(led, vectors, docs, rows_of), "links")
    known = components(links)

    units = _units(cells, vectors, known)
    more = _unit_links(units, written(_searched(units, vectors), "found"), docs, rows_of)
    known = components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    of_set = rows_of.join(known, rows_of["set"] == known["node"], "left").select(
        "set", F.coalesce("component", "set").alias("class"), "least")
    least = of_set.groupBy("class").agg(F.min("least").alias("component"))
    of_set = of_set.join(least, "class").select("set", "class", "component")
    return rows.select("id", "mark", "n", "set").join(of_set, "set", "left").select(
        "id", "mark", "n", "class", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"))
