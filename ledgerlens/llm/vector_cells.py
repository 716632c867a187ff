"""Exact centroid clustering over a VA-file: each vector is stored with a few-bit cell for every dimension.

For a vector and a centroid the cells give an interval of squared distances, added up from lookup tables of one entry for
each dimension and cell. Where the interval of one centroid ends below all others, the vector is assigned without its
components; only where intervals overlap are they fetched and distances computed. All arithmetic is on integers, so
assignments, centroids and distances are exact and do not depend on the cells, on partitions or on the order of rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stage

SCALE = 1024
BITS = 6  # of a cell
BLOCK = 512  # vectors stored in a row
NORMAL = 1 << 27  # vectors with a larger component (before scaling, over 131,072) go without cells, in integers of any size
REACH = 3.0  # deviations from the mean that the inner cells cover; the first and last cell take the rest
CAP = 1 << 56
LARGEST = (1 << 63) - 1
RESULT = ("vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")


def usable(rows: DataFrame, dims: int) -> DataFrame:
    """vec_id and embedding (doubles) of the vectors of ``dims`` components, none of them null or not finite."""
    doubles = rows.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return doubles.filter((F.size("embedding") == dims) & finite)


def whole(x: float) -> int:
    """floor(SCALE * x), also where the product is beyond a double."""
    return int(x) * SCALE if abs(x) > 1 << 53 else int(np.floor(x * SCALE))


def first_centroids(vectors: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest SHA-256 of ``seed:vec_id``; a null id hashes as no text, ties go by components."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    rows = vectors.orderBy(F.sha2(name, 256), "embedding").limit(k).collect()
    return [[whole(x) for x in r.embedding] for r in rows]


def cell_edges(vectors: DataFrame, dims: int) -> np.ndarray:
    """(dims, cells + 1) rising integers; cell c of a dimension holds the values from edge c to below edge c + 1.

    Inner cells are equally wide around the mean, the first and last one reach to the smallest and largest value. Other
    edges would only change how often vectors are fetched.
    """
    limit = NORMAL / SCALE
    plain = vectors.filter((F.array_max("embedding") < limit) & (F.array_min("embedding") > -limit))
    stats = plain.select(F.posexplode("embedding").alias("d", "x")).groupBy("d").agg(
        F.min("x").alias("lo"), F.max("x").alias("hi"), F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).collect()
    edges = np.zeros((dims, (1 << BITS) + 1), dtype=np.int64)
    for r in stats:  # one row for each dimension
        lo, hi = whole(r.lo), whole(r.hi) + 1
        inner = np.floor(SCALE * np.linspace(r.m - REACH * r.s, r.m + REACH * r.s, (1 << BITS) - 1)).astype(np.int64)
        edges[r.d] = np.concatenate([[lo], np.clip(inner, lo, hi), [hi]])
    return edges


def pack(vectors: DataFrame, edges: np.ndarray, dims: int) -> DataFrame:
    """Blocks of vectors: ids, cells (a byte each), the integer components, and whether these are of any size."""
    def block(ids, ints):
        cells = np.stack([np.searchsorted(edges[d, 1:-1], ints[:, d], side="right") for d in range(dims)], axis=1)
        return {"ids": ids, "cells": cells.astype(np.uint8).tobytes(), "exact": ints.astype("<i4").tobytes(), "wide": False}

    def run(batches):
        for batch in batches:
            values = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            ids = batch.column("vec_id").to_pylist()
            small = (np.abs(values) < NORMAL / SCALE).all(axis=1)
            rows = []
            at = np.flatnonzero(small)
            for start in range(0, len(at), BLOCK):
                part = at[start:start + BLOCK]
                rows.append(block([ids[i] for i in part], np.floor(values[part] * SCALE).astype(np.int64)))
            at = np.flatnonzero(~small)
            for start in range(0, len(at), BLOCK):
                part = at[start:start + BLOCK]
                text = ",".join(str(whole(float(x))) for i in part for x in values[i])
                rows.append({"ids": [ids[i] for i in part], "cells": b"", "exact": text.encode(), "wide": True})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                ("ids", pa.list_(pa.int64())), ("cells", pa.binary()), ("exact", pa.binary()), ("wide", pa.bool_())]))

    return vectors.mapInArrow(run, "ids array<long>, cells binary, exact binary, wide boolean")


class Assigner:
    """Nearest centroids of stored blocks; ties go to the smaller number."""

    def __init__(self, centroids: list[list[int]], edges: np.ndarray):
        self.centroids = np.array(centroids, dtype=object)
        self.far = [max(abs(x) for x in c) >= 2 * NORMAL for c in centroids]
        self.dims, self.cells = edges.shape[0], edges.shape[1] - 1
        low, high = edges[:, :-1], edges[:, 1:] - 1
        bounds = [self.interval(c, far, low, high) for c, far in zip(centroids, self.far)]
        table = np.stack([b[0] for b in bounds] + [b[1] for b in bounds], axis=-1)
        self.table = table.reshape(self.dims * self.cells, -1)
        self.offsets = np.arange(self.dims) * self.cells
        self.fetched = 0

    @staticmethod
    def interval(centroid, far, low, high):
        """Least and most squared distance in each dimension to each cell.

        A centroid that is too far for 64-bit integers gets a true lower bound and the largest upper bound: it is
        never the one that rules others out.
        """
        if far:
            least = [[min(CAP, max(int(a) - m, m - int(b), 0) ** 2) for a, b in zip(x, y)]
                     for m, x, y in zip(centroid, low, high)]
            return np.array(least, dtype=np.int64), np.full(low.shape, CAP, dtype=np.int64)
        m = np.array(centroid, dtype=np.int64)[:, None]
        least = np.maximum(np.maximum(low - m, m - high), 0)
        most = np.maximum(np.abs(low - m), np.abs(high - m))
        return least * least, most * most

    def exact(self, ints: np.ndarray, cluster: int) -> np.ndarray:
        """Squared distances of whole vectors to a centroid."""
        if self.far[cluster] or ints.dtype == object:
            gap = ints.astype(object) - self.centroids[cluster]
        else:
            gap = ints.astype(np.int64) - self.centroids[cluster].astype(np.int64)
        return (gap * gap).sum(axis=1)

    def assign(self, block: Block) -> np.ndarray:
        k = len(self.centroids)
        if block.wide:
            return self.closest(block.vectors(), np.ones((block.size, k), dtype=bool))
        added = self.table[self.offsets + block.cells(self.dims)].sum(axis=1)
        near = added[:, :k] <= added[:, k:].min(axis=1)[:, None]
        cluster = near.argmax(axis=1)
        open_rows = np.flatnonzero(near.sum(axis=1) > 1)
        if len(open_rows):
            self.fetched += len(open_rows)
            cluster[open_rows] = self.closest(block.vectors()[open_rows], near[open_rows])
        return cluster

    def closest(self, ints: np.ndarray, near: np.ndarray) -> np.ndarray:
        """The nearest centroid of each whole vector among those that are near."""
        best, cluster = [None] * len(ints), np.zeros(len(ints), dtype=np.int64)
        for c in range(near.shape[1]):
            rows = np.flatnonzero(near[:, c])
            if not len(rows):
                continue
            for i, d in zip(rows.tolist(), self.exact(ints[rows], c).tolist()):
                if best[i] is None or d < best[i]:
                    best[i], cluster[i] = d, c
        return cluster


class Block:
    """A stored block; the components are read when they are asked for."""

    def __init__(self, batch, row: int, dims: int):
        self.ids = batch.column("ids")[row].as_py()
        self.size, self.dims = len(self.ids), dims
        self.wide = batch.column("wide")[row].as_py()
        self.batch, self.row = batch, row

    def cells(self, dims: int) -> np.ndarray:
        return np.frombuffer(self.batch.column("cells")[self.row].as_buffer(), dtype=np.uint8).reshape(-1, dims)

    def vectors(self) -> np.ndarray:
        raw = self.batch.column("exact")[self.row].as_buffer()
        if self.wide:
            return np.array([int(x) for x in raw.to_pybytes().split(b",")], dtype=object).reshape(-1, self.dims)
        return np.frombuffer(raw, dtype="<i4").reshape(-1, self.dims)


def blocks_of(batches, dims: int):
    for batch in batches:
        for row in range(batch.num_rows):
            yield Block(batch, row, dims)


def moved(blocks: DataFrame, before: list | None, after: list, edges: np.ndarray) -> list:
    """(cluster, change of count, changes of sums) from the vectors whose centroid differs between two sets of centroids.

    Both assignments are made from the cells, so no assignment has to be kept between rounds, and vectors that stay
    and lie clear of other centroids are not fetched. Each task adds up, and one row for each cluster returns.
    """
    dims, k = edges.shape[0], len(after)

    def run(batches):
        new, old = Assigner(after, edges), before and Assigner(before, edges)
        count, sums = [0] * k, np.zeros((k, dims), dtype=object)
        for block in blocks_of(batches, dims):
            to = new.assign(block)
            source = old.assign(block) if old else np.full(block.size, -1)
            at = np.flatnonzero(to != source)
            if not len(at):
                continue
            vectors = block.vectors()[at]
            vectors = vectors if block.wide else vectors.astype(np.int64)
            for c in range(k):
                come, gone = to[at] == c, source[at] == c
                count[c] += int(come.sum()) - int(gone.sum())
                sums[c] += vectors[come].sum(axis=0).astype(object) - vectors[gone].sum(axis=0).astype(object)
        yield part([(c, count[c], [str(int(x)) for x in sums[c]]) for c in range(k)])

    def part(rows):
        cluster, n, text = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(n, pa.int64()),
                                           pa.array(text, pa.list_(pa.string()))], ["cluster", "n", "sums"])

    def add(table):
        total = [0] * dims
        for row in table.column("sums").to_pylist():
            total = [a + int(b) for a, b in zip(total, row)]
        cluster = table.column("cluster")[0].as_py()
        return pa.Table.from_batches([part([(cluster, sum(table.column("n").to_pylist()), list(map(str, total)))])])

    schema = "cluster int, n long, sums array<string>"
    return blocks.mapInArrow(run, schema).groupBy("cluster").applyInArrow(add, schema).collect()


def fit(blocks: DataFrame, centroids: list[list[int]], edges: np.ndarray, rounds: int) -> list[list[int]]:
    """Centroids after the rounds; empty ones stay. Once no centroid changes, later rounds would change nothing."""
    k, dims = len(centroids), edges.shape[0]
    count, sums, before = [0] * k, [[0] * dims for _ in range(k)], None
    for _ in range(rounds):
        for row in moved(blocks, before, centroids, edges):
            count[row.cluster] += row.n
            sums[row.cluster] = [a + int(b) for a, b in zip(sums[row.cluster], row.sums)]
        before, centroids = centroids, [
            [s // count[c] for s in sums[c]] if count[c] else centroids[c] for c in range(k)]
        if before == centroids:
            break
    return centroids


def assigned(blocks: DataFrame, centroids: list[list[int]], edges: np.ndarray) -> DataFrame:
    """vec_id, cluster and squared distance (null if beyond a long) of every vector."""
    dims = edges.shape[0]

    def run(batches):
        nearest = Assigner(centroids, edges)
        for block in blocks_of(batches, dims):
            cluster, vectors = nearest.assign(block), block.vectors()
            distance = [0] * block.size
            for c in set(cluster.tolist()):
                rows = np.flatnonzero(cluster == c)
                for i, d in zip(rows.tolist(), nearest.exact(vectors[rows], c).tolist()):
                    distance[i] = d if d <= LARGEST else None
            yield pa.RecordBatch.from_arrays([pa.array(block.ids, pa.int64()), pa.array(cluster, pa.int32()),
                                              pa.array(distance, pa.int64())], ["vec_id", "cluster", "distance"])

    return blocks.mapInArrow(run, "vec_id long, cluster int, distance long")


def cluster(rows: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3) -> DataFrame:
    """One row for each usable vector of ``rows`` (vec_id, embedding): vec_id, cluster, distance, the inertia of its
    cluster and of all, and the SHA-256 of its centroid's components joined by commas.

    Components become floor(1024 * x). Centroids start as the k vectors with the smallest hashes of their ids (fewer
    vectors give fewer centroids); a round assigns all vectors and moves each non-empty centroid to the floor of the
    mean. Vectors that are null, of other lengths, or hold null or non-finite components take no part. Repeated rows
    and null ids are rows of their own. Distances and inertias beyond a long are null. No vector gives no rows. Other
    columns are not read. The driver holds k centroids and one row of statistics for each dimension.
    """
    vectors = usable(rows, dims)
    centroids = first_centroids(vectors, k, seed)
    if not centroids:
        return vectors.limit(0).select("vec_id", *[F.lit(None).cast(t).alias(n) for n, t in (
            f.split() for f in RESULT.split(", ")[1:])])
    edges = cell_edges(vectors, dims)
    blocks = stage(pack(vectors, edges, dims), "cells")
    centroids = fit(blocks, centroids, edges, rounds)
    found = stage(assigned(blocks, centroids, edges), "assigned")
    lost = F.count_if(F.col("distance").isNull())
    sums = {r.cluster: None if r.lost else int(r.s) for r in found.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s"), lost.alias("lost")).collect()}
    total = None if None in sums.values() else sum(sums.values())

    def long(v):
        return F.lit(v if v is not None and v <= LARGEST else None).cast("long")

    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return found.select(
        "vec_id", "cluster", "distance",
        F.get(F.array(*[long(sums.get(c)) for c in range(len(centroids))]), F.col("cluster")).alias("cluster_inertia"),
        long(total).alias("inertia"), F.get(F.array(*map(F.lit, digests)), F.col("cluster")).alias("centroid_sha256"))
