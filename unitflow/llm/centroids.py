"""Centroid clustering of integer vectors: exact rounds of k-means, filtered through kd-trees.

Vectors are dealt into blocks of at most BLOCK, each with a kd-tree whose nodes hold count, integer sums, the sum of squares and the
bounding box. Trees are built once and written; a round sends the centroids to them and brings back one row a centroid. In a node,
a centroid that is strictly farther than another from every point of the box goes; where one is left the whole node is its, and
leaves that keep several are resolved point by point. All arithmetic is on integers, so results don't depend on how rows are dealt.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitflow.llm.common import map_rows, written

BLOCK, LEAF = 16_384, 32
#: Beyond this a scaled component would not leave squared distances of 64 of them within a long.
REACH = 1 << 27
#: Floating-point products are exact below this; larger sums are done in integers.
EXACT = 1 << 53


def usable(vector: Column, dim: int, scale: int) -> Column:
    """Whether a vector has dim components, none null or non-finite, all within REACH after scaling."""
    return F.coalesce((F.size(vector) == dim) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < REACH // scale)), F.lit(False))


def scaled(flat: np.ndarray, dim: int, scale: int) -> np.ndarray:
    return np.floor(flat.astype(np.float64) * scale).astype(np.int64).reshape(-1, dim)


def node_ranges(n: int, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the tree over n points, parents first: (start, end) and the left child's number (0: a leaf; the right one follows)."""
    spans, left = [(0, n)], [0]
    for k, (a, b) in enumerate(spans):  # grows while it is read
        if b - a > leaf:
            left[k] = len(spans)
            spans += [(a, (a + b) // 2), ((a + b) // 2, b)]
            left += [0, 0]
    return np.array(spans, np.int64).reshape(-1, 2), np.array(left, np.int64)


@dataclass
class Tree:
    """Points in the order of the tree's leaves, with the boxes, sums and sums of squares of its nodes."""

    points: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray
    squares: np.ndarray

    @classmethod
    def build(cls, points: np.ndarray) -> tuple[Tree, np.ndarray]:
        """The tree, and the order of the given points in it. Nodes are halved at the median of their widest side."""
        spans, left = node_ranges(len(points))
        order = np.arange(len(points))
        low, high = np.empty((len(spans), points.shape[1]), np.int64), np.empty((len(spans), points.shape[1]), np.int64)
        for k, (a, b) in enumerate(spans):
            held = points[order[a:b]]
            low[k], high[k] = held.min(0), held.max(0)
            if left[k]:
                side = int(np.argmax(high[k] - low[k]))
                order[a:b] = order[a:b][np.argpartition(held[:, side], (a + b) // 2 - a)]
        points = points[order]
        before = np.concatenate((np.zeros((1, points.shape[1]), np.int64), np.cumsum(points, 0)))
        squared = np.concatenate(([0], np.cumsum((points**2).sum(1))))
        return cls(points, low, high, before[spans[:, 1]] - before[spans[:, 0]], squared[spans[:, 1]] - squared[spans[:, 0]]), order

    def owners(self, centroids: np.ndarray):
        """Yields (centroid, node) for nodes that go whole to one, and (None, start, end, candidates) for leaves that several may share."""
        spans, left = node_ranges(len(self.points))
        k = len(centroids)
        exact = 8 * self.points.shape[1] * max(int(np.abs(self.points).max()), int(np.abs(centroids).max())) ** 2 < EXACT
        kind = np.float64 if exact else np.int64
        c = centroids.astype(kind)
        to = (c[None, :] - c[:, None]).reshape(k * k, -1).T  # column (a, b): from a to b
        up, down = np.maximum(to, 0), np.minimum(to, 0)
        squares = (c**2).sum(1)
        apart = (squares[None, :] - squares[:, None]).reshape(-1)
        nodes, may = np.zeros(1, np.int64), np.ones((1, k), bool)
        while len(nodes):
            low, high = self.low[nodes].astype(kind), self.high[nodes].astype(kind)
            # the least of |b - x|^2 - |a - x|^2 over the box: above 0, b is strictly farther everywhere
            least = (apart - 2 * (high @ up + low @ down)).reshape(-1, k, k)
            may = may & ~((least > 0) & may[:, :, None]).any(1)
            alone = may.sum(1) == 1
            for node, owner in zip(nodes[alone], may[alone].argmax(1)):
                yield int(owner), int(node)
            leaf = ~alone & (left[nodes] == 0)
            for node, m in zip(nodes[leaf], may[leaf]):
                yield None, *spans[node], np.flatnonzero(m)
            inner = ~alone & ~leaf
            nodes, may = np.concatenate((left[nodes[inner]], left[nodes[inner]] + 1)), np.concatenate((may[inner], may[inner]))

    def nearest(self, a: int, b: int, among: np.ndarray, centroids: np.ndarray) -> np.ndarray:
        """For points a to b the nearest of these centroids, the smaller number on ties."""
        gaps = ((self.points[a:b, None, :] - centroids[None, among, :]) ** 2).sum(2)
        return among[gaps.argmin(1)]

    def totals(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and sums of every centroid's points."""
        spans, _ = node_ranges(len(self.points))
        count, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for owner, *where in self.owners(centroids):
            if owner is not None:
                count[owner] += spans[where[0]][1] - spans[where[0]][0]
                sums[owner] += self.sums[where[0]]
                continue
            a, b, among = where
            of = self.nearest(a, b, among, centroids)
            np.add.at(count, of, 1)
            np.add.at(sums, of, self.points[a:b])
        return count, sums

    def assigned(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every point's centroid and its squared distance."""
        spans, _ = node_ranges(len(self.points))
        of = np.empty(len(self.points), np.int64)
        for owner, *where in self.owners(centroids):
            if owner is not None:
                a, b = spans[where[0]]
                of[a:b] = owner
            else:
                of[where[0] : where[1]] = self.nearest(*where, centroids)
        return of, ((self.points - centroids[of]) ** 2).sum(1)


_COLUMNS = {"points": np.int32, "low": np.int32, "high": np.int32, "sums": np.int64, "squares": np.int64}


def _trees(kept: DataFrame, dim: int, scale: int, block: int) -> DataFrame:
    """One row a block: its vec_ids in the tree's order, and the tree."""

    def pack(ids: list, points: np.ndarray) -> pa.RecordBatch:
        tree, order = Tree.build(points)
        columns = [pa.array([[ids[k] for k in order]], pa.list_(pa.int64()))]
        columns += [pa.array([np.ascontiguousarray(getattr(tree, c), t).tobytes()], pa.binary()) for c, t in _COLUMNS.items()]
        return pa.RecordBatch.from_arrays(columns, ["vec_ids", *_COLUMNS])

    def work(batches):
        ids, points, held = [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                part = batch.slice(at, block)
                if held + part.num_rows > block:
                    yield pack(ids, np.concatenate(points))
                    ids, points, held = [], [], 0
                ids += part.column(0).to_pylist()
                points.append(scaled(part.column(1).flatten().to_numpy(zero_copy_only=False), dim, scale))
                held += part.num_rows
        if held:
            yield pack(ids, np.concatenate(points))

    schema = "vec_ids array<bigint>, " + ", ".join(f"{c} binary" for c in _COLUMNS)
    return written(map_rows(kept, ["vec_id", "embedding"], work, schema), "kd-trees")


def _over(trees: DataFrame, dim: int, columns: list[str], work, schema: str) -> DataFrame:
    """work(vec_ids, tree) of every block; it gives a list of columns."""

    def each(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                data = [np.frombuffer(row.column(row.schema.get_field_index(c))[0].as_buffer(), t).astype(np.int64).reshape(-1, *([dim] if c != "squares" else [])) for c, t in _COLUMNS.items()]
                ids = row.column(0)[0].values if columns[0] == "vec_ids" else None
                made = work(ids, Tree(*data))
                yield pa.RecordBatch.from_arrays(made, [f.split()[0] for f in schema.split(", ")])

    return map_rows(trees, columns, each, schema)


@dataclass
class Clusters:
    """assigned: vec_id, cluster, distance (squared), a written table; centroids by number; inertia by number."""

    assigned: DataFrame
    centroids: list[list[int]]
    inertia: list[int]


def starts(kept: DataFrame, k: int, seed: int, dim: int, scale: int) -> list[list[int]]:
    """The k vectors with the smallest SHA-256 of "seed:vec_id", in that order; of equal ids the smaller vector first, null ids last."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = kept.select(key.alias("key"), "embedding").orderBy(F.asc_nulls_last("key"), "embedding").limit(k).collect()
    return [scaled(np.array(r["embedding"]), dim, scale)[0].tolist() for r in rows]


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dim: int = 64, scale: int = 1024, block: int = BLOCK) -> Clusters:
    """vectors (vec_id, embedding) in k clusters, after so many rounds of exact k-means over floor(scale * x).

    Only vectors of dim components, none null, non-finite or beyond 2^27 / scale, are kept. With fewer than k kept vectors there are as
    many centroids as vectors. Ties go to the smaller number; an empty cluster keeps its centroid. Repeated rows count each, a null
    vec_id stays, an empty table gives none; other columns are ignored. Only the centroids' counts and sums come to the driver."""
    if dim * (2 * REACH) ** 2 >= 1 << 63:
        raise ValueError(f"squared distances of {dim} components don't fit a long")
    kept = vectors.filter(usable(F.col("embedding"), dim, scale)).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    centroids = starts(kept, k, seed, dim, scale)
    trees = _trees(kept, dim, scale, block)

    def totals(ids, tree):
        count, sums = tree.totals(now)
        used = np.flatnonzero(count)
        flat = [(int(c), d, int(v)) for c in used for d, v in enumerate([count[c], *sums[c]])]
        return [pa.array(x, t) for x, t in zip(zip(*flat), (pa.int32(), pa.int32(), pa.int64()))]

    for _ in range(rounds if centroids else 0):
        now = np.array(centroids, np.int64)
        rows = _over(trees, dim, list(_COLUMNS), totals, "cluster int, part int, v bigint").groupBy("cluster", "part").agg(F.sum(F.col("v").cast("decimal(38)")).alias("v")).collect()
        found = {(r["cluster"], r["part"]): int(r["v"]) for r in rows}  # k * (dim + 1) rows at most
        centroids = [[found[c, d + 1] // found[c, 0] for d in range(dim)] if (c, 0) in found else old for c, old in enumerate(centroids)]

    now = np.array(centroids, np.int64)

    def assign(ids, tree):
        of, gap = tree.assigned(now)
        return [ids, pa.array(of, pa.int32()), pa.array(gap, pa.int64())]

    assigned = written(_over(trees, dim, ["vec_ids", *_COLUMNS], assign, "vec_id bigint, cluster int, distance bigint"), "clusters")
    inertia = [0] * len(centroids)
    for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38)")).alias("v")).collect():
        inertia[r["cluster"]] = int(r["v"])
    return Clusters(assigned, centroids, inertia)


def op11_centroids(vectors: DataFrame) -> DataFrame:
    found = cluster(vectors)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    rows = [(c, found.inertia[c], sum(found.inertia), digest[c]) for c in range(len(digest))]
    of = vectors.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return found.assigned.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
