"""Prefix trie of conversations (operator 12).

Every turn becomes a digest with its number of words, so texts are not shuffled; a conversation is the string of its turns' digests.
Equal conversations become one row. Distinct ones are sorted into range shards, each of which is gone through in runs of about
``RUN_TURNS`` turns. A run has a dictionary of its turns and a ternary search tree over their codes, filled from the median outwards, so that
it is balanced; one pass over its nodes, last made first, adds up members, children, leaves and saved words without recursion.

Neighbouring runs share the nodes that the last sequence of one and the first of the next have in common. Such a node counts as
opened in the run where it comes first, so its parts of members, children, leaves and savings simply add up when runs are merged by path.

* Nulls: a null role or text is empty, a null turn comes first. Rows without conversation have no place and are left out.
* Ties: turns of one number are ordered by their digests; repeated rows are turns of their own.
* Empty tables give no nodes, not even a root. Empty and very long texts are turns like others.
* Only the four named columns are read; others cannot clash.
* One task holds the digests of one conversation (24 bytes a turn). Turns count as equal if the first 128 bits of their SHA-256 are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pastlane.llm.components import written

WORD = r"[^\x20\x09-\x0D]+"
TURN = 24  # bytes of a turn: 16 of its digest, 8 of its number of words
RUN_TURNS = 1 << 16
PIECE = 4096  # ids whose text is one row

NODE = ("conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
        "saved_tokens long, ends_sha256 string, key string, parent_key string")
NOTHING = hashlib.sha256(b"").hexdigest()


def packed_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as an array of 48 hex digits each."""
    who, what = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, what), 256)
    words = F.lpad(F.lower(F.hex(F.regexp_count(what, F.lit(WORD)).cast("long"))), 16, "0")
    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.concat(F.substring(digest, 1, 32), words).alias("code"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), "turn", "code")))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda x: x["code"]).alias("turns"))


def rebuilt_turns(packed: DataFrame, family: int = 20, heads: int = 4) -> DataFrame:
    """Each conversation with its first h turns taken from the first of its family; h is the crc32 of its id modulo ``heads``."""
    first = packed.where(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("first"), F.slice("turns", 1, heads - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    joined = packed.withColumn("h", h).withColumn("first", F.col("conv_id") - F.col("conv_id") % family).join(first, "first", "left")
    head = F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), F.col("h"))
    rest = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))
    return joined.select("conv_id", F.concat(head, rest).alias("turns"))


def _path(turns: Column) -> Column:
    return F.unhex(F.array_join(turns, ""))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (path, conv_id) in order, as pieces of a text of ids."""
    for batch in batches:
        rows = []
        members = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        for path, same in groupby(members, key=itemgetter(0)):
            ids = [conv for _, conv in same]
            for i in range(0, len(ids), PIECE):
                part = ids[i:i + PIECE]
                rows.append((path, part[0], len(part), ",".join(map(str, part))))
        yield _batch(rows, "path binary, first long, n long, ids string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in the order of paths and ids, as one row a path with the digest of its ids."""
    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)

    done = []
    for path, pieces in groupby(rows(), key=itemgetter(0)):
        digest, first, n = hashlib.sha256(), None, 0
        for _, conv, size, ids in pieces:
            digest.update(("," if n else "").encode() + ids.encode())
            first, n = conv if first is None else first, n + size
        done.append((path, first, n, digest.hexdigest()))
        if len(done) >= 1000:
            yield _batch(done, ENDS)
            done = []
    yield _batch(done, ENDS)


ENDS = "path binary, conv_id long, n long, ends_sha256 string"
_TYPES = {"binary": pa.binary(), "long": pa.int64(), "string": pa.string(), "int": pa.int32()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [part.split() for part in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(column, _TYPES[kind]) for column, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def distinct_paths(sequences: DataFrame) -> DataFrame:
    """(path, conv_id, n, ends_sha256): equal conversations as one row, with their least id, number and the digest of their ids.

    A path that holds most conversations is cut by ids first, so that one task reads its ids as texts of ``PIECE`` ids only.
    """
    members = sequences.select(_path(F.col("turns")).alias("path"), "conv_id").repartitionByRange("path", "conv_id")
    pieces = members.sortWithinPartitions("path", "conv_id").mapInArrow(_pieces, "path binary, first long, n long, ids string")
    return pieces.repartition("path").sortWithinPartitions("path", "first").mapInArrow(_digests, ENDS)


def _shared(a: bytes | None, b: bytes | None) -> int:
    """How many turns two paths share from the start; -1 if one of them is not there."""
    if a is None or b is None:
        return -1
    low, high = 0, min(len(a), len(b)) // TURN
    while low < high:  # the longest equal beginning
        middle = (low + high + 1) // 2
        low, high = (middle, high) if a[:middle * TURN] == b[:middle * TURN] else (low, middle - 1)
    return low


class Tree:
    """A ternary search tree of the paths of one run. Node 0 is the root; a node's parent was made before it."""

    def __init__(self, paths: list[bytes]):
        coded = [[path[i:i + TURN] for i in range(0, len(path), TURN)] for path in paths]
        names = sorted({turn for path in coded for turn in path})
        number = {turn: code for code, turn in enumerate(names)}
        self.words = [int.from_bytes(turn[16:], "big") for turn in names]
        self.code, self.low, self.same, self.high, self.parent, self.depth = [-1], [0], [0], [0], [-1], [0]
        self.end = [0] * len(paths)
        spans = [(0, len(paths))]
        while spans:
            start, stop = spans.pop()
            if start < stop:
                middle = (start + stop) // 2
                self.end[middle] = self._insert([number[turn] for turn in coded[middle]])
                spans += [(start, middle), (middle + 1, stop)]

    def _insert(self, codes: list[int]) -> int:
        code, low, same, high = self.code, self.low, self.same, self.high
        parent = 0
        for wanted in codes:
            link, at, node = same, parent, same[parent]
            while node and code[node] != wanted:
                link, at = (low, node) if wanted < code[node] else (high, node)
                node = link[at]
            if not node:
                node = link[at] = len(code)
                code.append(wanted)
                low.append(0)
                same.append(0)
                high.append(0)
                self.parent.append(parent)
                self.depth.append(self.depth[parent] + 1)
            parent = node
        return parent

    def way(self, end: int) -> list[int]:
        """The nodes from the root to ``end``."""
        nodes = []
        while end >= 0:
            nodes.append(end)
            end = self.parent[end]
        return nodes[::-1]


def trie_rows(rows: list[tuple], before: int, after: int) -> list[tuple]:
    """The nodes of a run of rows (path, conv_id, n, ends_sha256) that shares ``before`` turns with the run before it and ``after`` with the next."""
    tree = Tree([row[0] for row in rows])
    size = len(tree.code)
    first, last = tree.way(tree.end[0]), tree.way(tree.end[-1])
    opened, inner = [1] * size, [False] * size  # inner: has children in another run
    keys: dict[int, str] = {}
    for nodes, shared, path in ((first, before, rows[0][0]), (last, after, rows[-1][0])):
        digest = hashlib.sha256()
        for node in nodes[:shared + 1]:
            depth = tree.depth[node]
            digest.update(path[max(0, depth - 1) * TURN:depth * TURN])
            keys[node] = digest.hexdigest()
    for node in first[:before + 1]:
        opened[node] = 0
    for node in last[:after + 1]:
        inner[node] = True
    least: list[int | None] = [None] * size
    convs, children, leaves, saved = [0] * size, [0] * size, [0] * size, [0] * size
    ends: list[str | None] = [None] * size
    for (_, conv, n, digest), node in zip(rows, tree.end, strict=True):
        least[node], convs[node], ends[node] = conv, n, digest
    alone = [True] * size
    for node in range(size - 1, -1, -1):
        if alone[node] and not inner[node]:
            leaves[node] += 1
        if node:
            saved[node] += (convs[node] - opened[node]) * tree.words[tree.code[node]]
            above = tree.parent[node]
            alone[above] = False
            convs[above] += convs[node]
            children[above] += opened[node]
            leaves[above] += leaves[node]
            saved[above] += saved[node]
            least[above] = least[node] if least[above] is None else min(least[above], least[node])
    return [(least[i], tree.depth[i], None if tree.parent[i] in keys or not i else least[tree.parent[i]], convs[i], children[i],
             leaves[i], saved[i], ends[i], keys.get(i), keys.get(tree.parent[i])) for i in range(size)]


def _runs(borders: dict[int, tuple[int, int]], most: int):
    """Goes through rows (shard, path, conv_id, n, ends_sha256) in order, one run after the other."""
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*(column.to_pylist() for column in batch.columns), strict=True)

        for shard, members in groupby(rows(), key=itemgetter(0)):
            before, after = borders[shard]
            run, turns = [], 0
            for _, *row in members:
                if turns > most:
                    shared = _shared(run[-1][0], row[0])
                    yield _batch(trie_rows(run, before, shared), NODE)
                    run, turns, before = [], 0, shared
                run.append(tuple(row))
                turns += len(row[0]) // TURN + 1
            yield _batch(trie_rows(run, before, after), NODE)

    return build


def _borders(shards: DataFrame) -> dict[int, tuple[int, int]]:
    """For each shard the turns that it shares with the one before and the one after it: two numbers a shard."""
    ends = shards.groupBy("shard").agg(F.min("path").alias("first"), F.max("path").alias("last"))
    order = Window.orderBy("shard")

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([(shard, _shared(earlier, first), _shared(last, later)) for shard, first, last, earlier, later in zip(
                *(column.to_pylist() for column in batch.columns), strict=True)], "shard int, before int, after int")

    found = ends.select("shard", "first", "last", F.lag("last").over(order), F.lead("first").over(order))
    return {row.shard: (row.before, row.after) for row in found.mapInArrow(shared, "shard int, before int, after int").collect()}


def prefix_trie(sequences: DataFrame, run_turns: int = RUN_TURNS) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, turns); see the module."""
    shards = written(distinct_paths(sequences).repartitionByRange("path").select(
        F.spark_partition_id().alias("shard"), "path", "conv_id", "n", "ends_sha256"), "shards")
    parts = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = shards.repartition(parts, "shard").sortWithinPartitions("shard", "path").mapInArrow(_runs(_borders(shards), run_turns), NODE)
    nodes = written(runs, "nodes")
    merged = written(nodes.where("key is not null").groupBy("key", "parent_key", "depth").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(name).alias(name) for name in ("n_convs", "n_children", "n_leaves", "saved_tokens")],
        F.max("ends_sha256").alias("ends_sha256"), F.max("parent_conv_id").alias("parent_conv_id")), "merged")
    single = nodes.where("key is null")
    known = single.where("parent_key is null")
    above = merged.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("above"))
    joined = single.where("parent_key is not null").unionByName(merged.where("parent_key is not null"), allowMissingColumns=True).join(above, "parent_key")
    joined = joined.drop("parent_conv_id").withColumnRenamed("above", "parent_conv_id")
    roots = merged.where("parent_key is null")
    names = [part.split()[0] for part in NODE.split(", ")][:8]
    rows = known.select(*names).unionByName(joined.select(*names)).unionByName(roots.select(*names))
    return rows.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING)))
