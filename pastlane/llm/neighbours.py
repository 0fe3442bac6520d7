"""Approximate nearest neighbours by stable projections and a chi-square stop (operator 9).

Vectors are projected to ``DIMENSIONS`` Gaussian coordinates. The squared distance of two
projections, over that of the vectors, is chi-square with as many degrees of freedom, so
a point whose projection is far is improbable to be near. A kd-tree over the projections
cuts space into cells; its upper levels are fitted on a bounded sample and deal all rows out
to Spark tasks, its lower levels are built inside each task. A query goes through leaves in the
order of their projected distance, verifies points by exact inner products, and passes over points and stops at leaves where one as near
as its current k-th would, with probability ``CONFIDENCE``, have been projected nearer. More coordinates make this test sharper.

First a query searches its own cell; that gives a k-th distance, with which the same test rules
out whole cells; then it searches the others. Largest inner product becomes smallest distance by
one more coordinate, which fills every vector up to the largest norm.

Every row is indexed, and stored once: a task holds one piece of a cell, and queries pass by it, however many they
are. Cells with many rows (copies of one vector, say) are dealt out in pieces.
Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do
those of another length than most, nor rows without id. Of rows that share an id the least
vector counts. Equal scores go to the smaller id. Fewer candidates than k give fewer rows, an empty table none.
Only the id and the vector are read, so other columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pastlane.session import fresh_dir

DIMENSIONS = 24
CONFIDENCE = 0.92
# Rows that the upper levels of the tree are fitted on, at most: the bound of the sample.
SAMPLE = 1 << 16
PIECE_ROWS = 8192
LEAF_ROWS = 256


def chi_square_limit(p: float, degrees: int) -> float:
    """The value that a chi-square variable of an even number of degrees stays below with probability p."""
    low, high = 0.0, 1000.0
    for _ in range(80):
        x = (low + high) / 2
        tail = math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(degrees // 2))
        low, high = (x, high) if 1 - tail < p else (low, x)
    return low


class Tree:
    """The upper levels of the kd-tree: a perfect binary tree of median splits, and its cells' boxes."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth = depth
        self.axis = np.zeros(1 << depth, np.int64)
        self.cut = np.zeros(1 << depth)
        self.low = np.full((1 << depth, points.shape[1]), -np.inf)
        self.high = np.full((1 << depth, points.shape[1]), np.inf)
        self._split(points, 1, 0, np.full(points.shape[1], -np.inf), np.full(points.shape[1], np.inf))

    def _split(self, points, node, level, low, high):
        if level == self.depth:
            self.low[node - (1 << level)], self.high[node - (1 << level)] = low, high
            return
        axis = int(np.argmax(points.max(axis=0) - points.min(axis=0))) if len(points) else level % len(low)
        cut = float(np.median(points[:, axis])) if len(points) else 0.0
        self.axis[node], self.cut[node] = axis, cut
        below, above = high.copy(), low.copy()
        below[axis] = above[axis] = cut
        left = points[:, axis] < cut
        self._split(points[left], 2 * node, level + 1, low, below)
        self._split(points[~left], 2 * node + 1, level + 1, above, high)

    def cells(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.axis[node]] >= self.cut[node])
        return node - (1 << self.depth)

    def distances(self, point: np.ndarray) -> np.ndarray:
        """Squared distance of a point to each cell's box."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        return (gap * gap).sum(axis=1)


class Projection:
    """Gaussian projections of vectors that are filled up to norm ``radius``; queries are filled with 0."""

    def __init__(self, width: int, radius: float):
        self.radius2 = radius * radius
        self.matrix = np.random.default_rng(20140901).standard_normal((width + 1, DIMENSIONS))

    def points(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.radius2 - (vectors * vectors).sum(axis=1), 0))
        return vectors @ self.matrix[:-1] + rest[:, None] * self.matrix[-1]

    def queries(self, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.matrix[:-1]


def _matrix(column, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, width)


def _leaves(points: np.ndarray) -> list[np.ndarray]:
    """Rows of the leaves of a kd-tree of median splits."""
    todo, done = [np.arange(len(points))], []
    while todo:
        rows = todo.pop()
        if len(rows) <= LEAF_ROWS:
            done.append(rows)
            continue
        part = points[rows]
        axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
        order = np.argpartition(part[:, axis], len(rows) // 2)
        todo += [rows[order[:len(rows) // 2]], rows[order[len(rows) // 2:]]]
    return done


class Piece:
    """The rows of one piece of a cell, in the leaves of a kd-tree."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, points: np.ndarray):
        leaves = [x for x in _leaves(points) if len(x)]
        self.low = np.array([points[x].min(axis=0) for x in leaves])
        self.high = np.array([points[x].max(axis=0) for x in leaves])
        self.stored = [(ids[x], vectors[x], points[x]) for x in leaves]
        self.verified = 0

    def search(self, query: int, vector: np.ndarray, point: np.ndarray, worst: float, k: int, radius2: float, limit: float):
        """(ids, scores) of the k nearest here; ``worst`` is the squared distance of the k-th neighbour found elsewhere."""
        gap = np.maximum(np.maximum(self.low - point, point - self.high), 0)
        near = (gap * gap).sum(axis=1)
        norm2 = float(vector @ vector)
        have_id, have_score = np.empty(0, np.int64), np.empty(0)
        for leaf in np.argsort(near, kind="stable"):
            if near[leaf] > limit * worst:
                break  # the chi-square test: all that is left is improbable to be near enough
            own, rows, points = self.stored[leaf]
            apart = points - point
            at = np.flatnonzero((np.einsum("ij,ij->i", apart, apart) <= limit * worst) & (own != query))
            if not len(at):
                continue
            self.verified += len(at)
            own, score = own[at], np.einsum("ij,j->i", rows[at], vector)
            if len(have_score) >= k:
                keep = score >= have_score[k - 1]
                own, score = own[keep], score[keep]
            have_id, have_score = np.append(have_id, own), np.append(have_score, score)
            order = np.lexsort((have_id, -have_score))[:k]
            have_id, have_score = have_id[order], have_score[order]
            if len(have_score) == k:
                worst = min(worst, max(radius2 + norm2 - 2 * have_score[-1], 0.0))
        return have_id, have_score


def nearest(rows: DataFrame, is_query, k: int = 20, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found of each row that ``is_query`` (a function of the
    key's Column) holds for."""
    spark = rows.sparkSession
    values = F.col("vector")
    whole = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).where(
        F.col("id").isNotNull() & F.exists(values, lambda x: x != 0)
        & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf)))
    clean = whole.groupBy("id").agg(F.min("vector").alias("vector"))
    sizes = clean.groupBy(F.size("vector").alias("width")).agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)).alias("norm2")).orderBy(
        F.desc("n"), "width").first()
    result = "query_id long, vec_id long, score double"
    if sizes is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width, total = sizes.width, sizes.n
    project = Projection(width, math.sqrt(sizes.norm2))
    clean = clean.where(F.size("vector") == width)

    unit = F.pmod(F.xxhash64("id"), F.lit(1 << 30))
    depth = max(0, min(math.ceil(math.log2(total / PIECE_ROWS)) if total > PIECE_ROWS else 0, int(math.log2(SAMPLE)) - 2))
    wanted = min(SAMPLE, 16 << depth)
    sample = clean.where(unit < int((1 << 30) * min(1.0, wanted / total))).limit(2 * wanted).select("vector").toArrow()
    points = project.points(_matrix(sample["vector"], width)) if len(sample) else np.zeros((0, DIMENSIONS))
    index = spark.sparkContext.broadcast((project, Tree(points, depth)))  # of the sample's size

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project, tree = index.value
        for batch in batches:
            vectors = _matrix(batch["vector"], width)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(tree.cells(project.points(vectors)), pa.int32()),
                 pa.array(tree.cells(project.queries(vectors)), pa.int32())], ["id", "vector", "cell", "own"])

    folder = fresh_dir(spark, "placed")
    clean.mapInArrow(place, "id long, vector array<double>, cell int, own int").write.parquet(folder)
    placed = spark.read.parquet(folder)
    counts = placed.groupBy(F.col("cell").alias("of")).agg(F.count(F.lit(1)).alias("n"))  # as many as the tree has cells
    pieces = counts.select("of", F.ceil(F.col("n") / PIECE_ROWS).cast("int").alias("pieces"))
    folder = fresh_dir(spark, "pieces")
    pieces.write.parquet(folder)
    pieces = spark.read.parquet(folder)
    queries = placed.where(is_query(F.col("id"))).select("id", "vector", "own")

    def in_piece(rows: DataFrame, piece) -> DataFrame:
        return rows.join(pieces, rows["cell"] == pieces["of"]).select(*rows.columns, piece.alias("piece"))

    stored = in_piece(placed.select("id", "vector", "cell"), F.pmod(F.xxhash64("id", F.lit("piece")), F.col("pieces")).cast("int"))
    stored = stored.select("cell", "piece", F.lit(0).alias("asks"), "id", "vector", F.lit(math.inf).alias("worst"))
    limit = chi_square_limit(CONFIDENCE, DIMENSIONS)
    names = ["query_id", "vec_id", "score"]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a piece come before the queries that pass by it."""
        project, _ = index.value
        key, held, piece = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, number, asks, ids, worst = (batch[x].to_numpy() for x in ("cell", "piece", "asks", "id", "worst"))
            cuts = np.flatnonzero((np.diff(cell) != 0) | (np.diff(number) != 0) | (np.diff(asks) != 0)) + 1
            for start, stop in zip(np.r_[0, cuts], np.r_[cuts, len(cell)], strict=True):
                if (now := (cell[start], number[start])) != key:
                    key, held, piece = now, [], None
                vectors = _matrix(batch["vector"].slice(start, stop - start), width)
                if not asks[start]:
                    held.append((ids[start:stop], vectors))
                    continue
                if piece is None and held:
                    own, rows = (np.concatenate(x) for x in zip(*held, strict=True))
                    piece, held = Piece(own, rows, project.points(rows)), []
                if piece is None:
                    continue
                found = [piece.search(*x, k, project.radius2, limit) for x in zip(
                    ids[start:stop].tolist(), vectors, project.queries(vectors), worst[start:stop].tolist(), strict=True)]
                asked = np.repeat(ids[start:stop], [len(x) for x, _ in found])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(asked, pa.int64()), *(pa.array(np.concatenate(x)) for x in zip(*found, strict=True))], names)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def searched(asked: DataFrame) -> DataFrame:
        """Results of queries (id, vector, cell, worst) in their cells."""
        asking = in_piece(asked, F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).select(
            "cell", "piece", F.lit(1).alias("asks"), "id", "vector", "worst")
        met = stored.unionByName(asking).repartition(parts, "cell", "piece").sortWithinPartitions("cell", "piece", "asks")
        return met.mapInArrow(meet, result)

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = fresh_dir(spark, "own-cell")
    best(searched(queries.select("id", "vector", F.col("own").alias("cell"), F.lit(math.inf).alias("worst")))).write.parquet(first)
    known = spark.read.parquet(first)
    kth = known.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project, tree = index.value
        for batch in batches:
            vectors = _matrix(batch["vector"], width)
            worst = np.maximum(project.radius2 + (vectors * vectors).sum(axis=1)
                               - 2 * batch["kth"].to_numpy(zero_copy_only=False), 0)
            worst = np.where(np.isnan(worst), np.inf, worst)  # fewer than k in the own cell
            near = np.array([tree.distances(x) for x in project.queries(vectors)])
            own = batch["own"].to_numpy()
            near[np.arange(len(own)), own] = np.inf
            row, cell = np.nonzero(np.isfinite(near) & (near <= limit * worst[:, None]))
            yield pa.RecordBatch.from_arrays(
                [batch["id"].take(pa.array(row)), batch["vector"].take(pa.array(row)),
                 pa.array(cell, pa.int32()), pa.array(worst[row])], ["id", "vector", "cell", "worst"])

    rest = queries.join(kth, "id", "left").select("id", "vector", "own", "kth").mapInArrow(
        others, "id long, vector array<double>, cell int, worst double")
    return best(known.select(*names).unionByName(searched(rest))).select("query_id", "rank", "vec_id", "score")
