"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, shard results merged.

Vectors are dealt into shards by a hash of their id. A task builds the graph of a shard over its distinct vectors and
stores it as flat arrays: members and neighbours of each layer, vectors, and the ids of equal vectors. Queries meet every
shard in blocks; each block walks the graph in lock-step (all its queries take a step together), and the nearest over all
shards are kept. A shard has one graph for each *band* of lengths, whose longest vector is at most four times its shortest.
Vectors of a band are scaled by a power of two and lengthened by one component that gives all of them the same norm, so
that the largest inner product is the smallest distance, and the geometry holds in single precision for any lengths.
Bands of fewer vectors than are linked by brute force anyway have no graph; queries meet all their vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stage

SHARD_ROWS = 20_000  # rows of a shard, in expectation, of tables of up to SHARDS shards
SHARDS = 64  # beyond so many, shards grow with the table, as a walk takes the logarithm of a shard's rows ...
SHARD_BYTES = 100 << 20  # ... until their vectors reach what a task can hold beside the links
BAND = 2.0  # width of a band, as a logarithm of lengths to base 2
QUERY_BLOCK = 2_000  # queries that meet a shard in one task, in expectation
LINKS = 16  # of a node in the upper layers; twice as many in the lowest
BUILD_WIDTH, SEARCH_WIDTH = 80, 160  # beam of candidates while building and searching
STEP = 4  # nodes that a query expands in a step
LOCKSTEP = 512  # queries that walk together
FIRST = 512  # nodes that are linked by brute force before the walk starts
GRAPH = ("dim int, shard int, links binary, layers binary, members binary, vectors binary, bands binary, ids binary, "
         "starts binary")


def diverse(near: np.ndarray, sims: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """Pick up to ``most`` links of each row of candidates (best first, -1 for none).

    A candidate is taken if it is nearer to the node than to any taken one; free places go to the best of the rest.
    """
    rows, width = near.shape
    held = vectors[np.maximum(near, 0)]
    between = held @ held.transpose(0, 2, 1)
    taken = np.zeros((rows, width), bool)
    for j in range(width):
        closest = np.where(taken, between[:, :, j], -np.inf).max(axis=1)
        taken[:, j] = (near[:, j] >= 0) & (sims[:, j] > closest) & (taken.sum(axis=1) < most)
    order = np.argsort(np.where(near < 0, 2, ~taken), axis=1, kind="stable")[:, :most]
    out = np.full((rows, most), -1, near.dtype)
    out[:, :order.shape[1]] = np.take_along_axis(near, order, axis=1)
    return out


def walk(links: np.ndarray, vectors: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int):
    """Best-first search of all queries in lock-step: (nodes, sims), best first, -1 where there is none.

    ``entry`` holds starting nodes of each query. A query ends when all nodes of its beam are expanded.
    """
    q = len(queries)
    beam = np.full((q, width), -1, np.int64)
    sims = np.full((q, width), -np.inf, np.float32)
    done = np.zeros((q, width), bool)
    visited = np.zeros((q, len(vectors)), bool)
    rows = np.arange(q)
    fresh = entry
    active = rows
    while len(active):
        fresh = np.sort(fresh, axis=1)
        fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = -1
        known = np.maximum(fresh, 0)
        fresh = np.where(visited[active[:, None], known], -1, fresh)
        visited[np.repeat(active, fresh.shape[1])[fresh.ravel() >= 0], fresh.ravel()[fresh.ravel() >= 0]] = True
        got = np.einsum("qmd,qd->qm", vectors[known], queries[active])
        got[fresh < 0] = -np.inf
        both = np.concatenate([beam[active], fresh], axis=1)
        value = np.concatenate([sims[active], got], axis=1)
        was = np.concatenate([done[active], np.zeros(fresh.shape, bool)], axis=1)
        order = np.argsort(-value, axis=1, kind="stable")[:, :width]
        beam[active], sims[active] = np.take_along_axis(both, order, 1), np.take_along_axis(value, order, 1)
        done[active] = np.take_along_axis(was, order, 1)
        open_ = (beam[active] >= 0) & ~done[active] & (sims[active] > -np.inf)
        more = open_.any(axis=1)
        active, open_ = active[more], open_[more]
        if not len(active):
            break
        first = np.argsort(~open_, axis=1, kind="stable")[:, :STEP]
        chosen = np.take_along_axis(open_, first, 1)
        nodes = np.where(chosen, np.take_along_axis(beam[active], first, 1), -1)
        marks = done[active]
        np.put_along_axis(marks, first, np.take_along_axis(marks, first, 1) | chosen, 1)
        done[active] = marks
        fresh = np.where(nodes[:, :, None] >= 0, links[np.maximum(nodes, 0)], -1).reshape(len(active), -1)
    return beam, sims


class Graph:
    """Layers from the top: members (nodes of the layer, those of the layer above first) and their flat links."""

    def __init__(self, vectors: np.ndarray, members: list[np.ndarray], links: list[np.ndarray]):
        self.vectors, self.members, self.links = vectors, members, links

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 0, links: int = LINKS, width: int = BUILD_WIDTH) -> Graph:
        n = len(vectors)
        rng = np.random.default_rng(seed)
        level = np.floor(-np.log(1 - rng.random(n)) / math.log(links)).astype(int) if n else np.zeros(0, int)
        order = np.argsort(-level, kind="stable")
        graph = cls(vectors, [], [])
        for layer in range(level.max(initial=0), -1, -1):
            members = order[: int((level >= layer).sum())]
            graph.grow(members, links if layer else 2 * links, width)
        return graph

    def grow(self, members: np.ndarray, cap: int, width: int) -> None:
        """Add a layer below: its nodes are inserted in batches, each no larger than what is there."""
        local = self.vectors[members]
        links = np.full((len(members), cap), -1, np.int64)
        at = min(FIRST, len(members))
        self._insert(links, local, 0, at, None, cap, width)
        while at < len(members):
            stop = min(len(members), at + min(at, 2 * LOCKSTEP))
            start = self.descend(local[at:stop], width=8)  # places in the layer above are places in this one
            start = np.where(start < at, start, 0)
            self._insert(links, local, at, stop, start, cap, width)
            at = stop
        self.members.append(members)
        self.links.append(links)

    @staticmethod
    def _insert(links, local, at, stop, start, cap, width) -> None:
        new = local[at:stop]
        among = new @ new.T
        np.fill_diagonal(among, -np.inf)
        near = np.argsort(-among, axis=1, kind="stable")[:, :width]
        sims = np.take_along_axis(among, near, 1)
        near = np.where(sims > -np.inf, near + at, -1)
        if start is not None:
            for lo in range(0, len(new), LOCKSTEP):
                part = slice(lo, lo + LOCKSTEP)
                found, value = walk(links[:at], local[:at], new[part], start[part], width)
                both, value = np.concatenate([near[part, :cap * 2], found], 1), np.concatenate([sims[part, :cap * 2], value], 1)
                order = np.argsort(-value, axis=1, kind="stable")[:, :near.shape[1]]
                if order.shape[1] < near.shape[1]:
                    order = np.pad(order, ((0, 0), (0, near.shape[1] - order.shape[1])), mode="edge")
                near[part], sims[part] = np.take_along_axis(both, order, 1), np.take_along_axis(value, order, 1)
        near, sims = near[:, :width], sims[:, :width]
        for lo in range(0, len(new), LOCKSTEP):
            part = slice(lo, lo + LOCKSTEP)
            links[at + lo:min(at + lo + LOCKSTEP, stop)] = diverse(near[part, :3 * cap], sims[part, :3 * cap], local, cap)
        # Links back: a node that gets too many keeps a diverse choice of them.
        source = np.repeat(np.arange(at, stop), cap)
        target = links[at:stop].ravel()
        source, target = source[target >= 0], target[target >= 0]
        value = np.einsum("ed,ed->e", local[source], local[target])
        order = np.lexsort((source, -value, target))
        source, target = source[order], target[order]
        heads = np.flatnonzero(np.r_[True, target[1:] != target[:-1]]) if len(target) else np.zeros(0, int)
        rank = np.arange(len(target)) - np.repeat(heads, np.diff(np.r_[heads, len(target)]))
        source, target, rank = source[rank < cap], target[rank < cap], rank[rank < cap]
        touched, row = np.unique(target, return_inverse=True)
        for lo in range(0, len(touched), 4 * LOCKSTEP):
            part = touched[lo:lo + 4 * LOCKSTEP]
            offered = np.full((len(part), 2 * cap), -1, np.int64)
            offered[:, :cap] = links[part]
            mine = (row >= lo) & (row < lo + len(part))
            offered[row[mine] - lo, cap + rank[mine]] = source[mine]
            offered = np.sort(offered, axis=1)
            offered[:, 1:][offered[:, 1:] == offered[:, :-1]] = -1
            value = np.einsum("pcd,pd->pc", local[np.maximum(offered, 0)], local[part])
            value[offered < 0] = -np.inf
            best = np.argsort(-value, axis=1, kind="stable")
            offered, value = np.take_along_axis(offered, best, 1), np.take_along_axis(value, best, 1)
            full = (offered >= 0).sum(axis=1) > cap
            links[part[~full]] = offered[~full, :cap]
            if full.any():
                links[part[full]] = diverse(offered[full], value[full], local, cap)

    def descend(self, queries: np.ndarray, width: int) -> np.ndarray:
        """Best places of each query in the lowest layer built so far, as starting points of the one below."""
        start = np.zeros((len(queries), 1), np.int64)
        for members, links in zip(self.members, self.links):
            start = np.concatenate([walk(links, self.vectors[members], queries[lo:lo + LOCKSTEP], start[lo:lo + LOCKSTEP], width)[0]
                                    for lo in range(0, len(queries), LOCKSTEP)])
        return start

    def search(self, queries: np.ndarray, k: int, width: int = SEARCH_WIDTH) -> np.ndarray:
        """Numbers of the k nearest vectors found for each query, best first, -1 where there are fewer."""
        out = np.full((len(queries), k), -1, np.int64)
        if not len(self.vectors):
            return out
        top = Graph(self.vectors, self.members[:-1], self.links[:-1])
        members, links = self.members[-1], self.links[-1]
        local = self.vectors[members]
        for lo in range(0, len(queries), LOCKSTEP):
            part = queries[lo:lo + LOCKSTEP]
            found, sims = walk(links, local, part, top.descend(part, 8), max(width, k))
            found = np.where(sims > -np.inf, members[np.maximum(found, 0)], -1)[:, :k]
            out[lo:lo + len(part), :found.shape[1]] = found
        return out


def level_norms(x: np.ndarray) -> np.ndarray:
    """Vectors with one more component, so that all have the largest norm."""
    square = np.einsum("nd,nd->n", x, x)
    return np.c_[x, np.sqrt(np.maximum(square.max(initial=0) - square, 0))].astype(np.float32)


def lengths(x: np.ndarray) -> np.ndarray:
    """Logarithms to base 2 of the norms of finite vectors that are not zero, without overflow."""
    largest = np.abs(x).max(axis=1)
    part = np.ldexp(x, -np.frexp(largest)[1][:, None])
    return np.frexp(largest)[1] + 0.5 * np.log2(np.einsum("nd,nd->n", part, part))


def scaled(x: np.ndarray, to: float | np.ndarray) -> np.ndarray:
    """Vectors divided by the power of two at or above a length (given as its logarithm)."""
    return np.ldexp(x, -np.ceil(np.broadcast_to(to, len(x))).astype(int)[:, None])


def in_bands(size: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Order by length, longest first, and the ends of the bands in it: each begins at the longest vector left."""
    order = np.argsort(-size, kind="stable")
    falling, ends = -size[order], [0]
    while ends[-1] < len(size):
        ends.append(int(np.searchsorted(falling, falling[ends[-1]] + BAND, "right")))
    return order, ends


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vec, dim): one row for each id; no null ids, null, empty or zero vectors, null or non-finite components.

    Of several vectors with one id the smallest (component by component) counts.
    """
    vec = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).select("vec_id", vec.alias("vec"))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    one = rows.filter(fine).groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("vec").alias("vec"))
    return one.withColumn("dim", F.size("vec"))


def build_graphs(rows: DataFrame, shards: dict[int, int], copies: int) -> DataFrame:
    """One row of flat arrays for each (dim, shard). ``copies`` ids of equal vectors are kept, the smallest."""
    def run(key, df):
        df = df.sort_values("vec_id")
        x = np.stack(df["vec"].to_numpy()).astype(np.float64)
        distinct, number = np.unique(x, axis=0, return_inverse=True)
        size = lengths(distinct)
        order, ends = in_bands(size)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        distinct, size, number = distinct[order], size[order], place[number.ravel()]
        order = np.argsort(number, kind="stable")  # equal vectors together, ids ascending
        number = number[order]
        heads = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
        rank = np.arange(len(number)) - np.repeat(heads, np.diff(np.r_[heads, len(number)]))
        ids = df["vec_id"].to_numpy()[order][rank < copies]
        starts = np.r_[0, np.cumsum(np.bincount(number[rank < copies], minlength=len(distinct)))]
        bands, links, members, shapes = [], [], [], []
        for lo, hi in zip(ends, ends[1:]):
            if hi - lo > FIRST:
                graph = Graph.build(level_norms(scaled(distinct[lo:hi], size[lo])), seed=int(key[1]))
                links += graph.links
                members += graph.members
                shapes += [part.shape for part in graph.links]
                bands.append((lo, hi, len(graph.links)))
            else:
                bands.append((lo, hi, 0))
        return pd.DataFrame([{
            "dim": key[0], "shard": key[1], "layers": np.array(shapes, np.int64).tobytes(),
            "links": b"".join(part.astype(np.int32).tobytes() for part in links),
            "members": b"".join(m.astype(np.int32).tobytes() for m in members), "vectors": distinct.tobytes(),
            "bands": np.array(bands, np.int64).tobytes(), "ids": ids.astype(np.int64).tobytes(),
            "starts": starts.astype(np.int64).tobytes()}])

    count = F.create_map(*[F.lit(v) for kv in shards.items() for v in kv])
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.element_at(count, F.col("dim"))).cast("int"))
    return dealt.groupBy("dim", "shard").applyInPandas(run, GRAPH)


class Shard:
    """Stored arrays of a shard: vectors in double precision by band, graphs of the bands, ids of each vector."""

    def __init__(self, row):
        self.vectors = np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"])
        self.ids, self.starts = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["starts"], np.int64)
        self.graphs, self.loose = [], []  # (first vector, graph); numbers of vectors without a graph
        flat, who = np.frombuffer(row["links"], np.int32), np.frombuffer(row["members"], np.int32)
        shapes = iter(np.frombuffer(row["layers"], np.int64).reshape(-1, 2))
        at = m = 0
        for lo, hi, layers in np.frombuffer(row["bands"], np.int64).reshape(-1, 3):
            links, members = [], []
            for _ in range(layers):
                n, cap = next(shapes)
                links.append(flat[at:at + n * cap].reshape(n, cap).astype(np.int64))
                members.append(who[m:m + n].astype(np.int64))
                at, m = at + n * cap, m + n
            if layers:
                part = self.vectors[lo:hi]
                self.graphs.append((lo, Graph(level_norms(scaled(part, lengths(part[:1]))), members, links)))
            else:
                self.loose.append(np.arange(lo, hi))
        self.loose = np.concatenate(self.loose) if self.loose else np.zeros(0, np.int64)

    def search(self, queries: np.ndarray, k: int, width: int):
        """Numbers of the vectors found for each query: k of each graph, k of those without one (compared exactly)."""
        unit = np.c_[scaled(queries, lengths(queries)), np.zeros(len(queries))].astype(np.float32)
        found = []
        for first, graph in self.graphs:
            got = graph.search(unit, k, width)
            found.append(np.where(got < 0, -1, got + first))
        if len(self.loose):
            held, blocks = self.vectors[self.loose], []
            for lo in range(0, len(queries), LOCKSTEP):
                score = products(queries[lo:lo + LOCKSTEP], held)
                blocks.append(self.loose[np.argsort(-score, axis=1, kind="stable")[:, :k]])
            found.append(np.concatenate(blocks))
        return np.concatenate(found, axis=1)


def products(queries: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Inner products in the order of their size: queries are scaled, which keeps it, so small ones do not vanish."""
    return scaled(queries, lengths(queries)) @ held.T


def shard_count(n: int, dim: int, shard_rows: int = SHARD_ROWS) -> int:
    """Shards of n vectors: of ``shard_rows`` up to SHARDS of them, then larger ones, up to SHARD_BYTES each."""
    return -(-n // max(shard_rows, min(n // SHARDS, SHARD_BYTES // (8 * dim))))


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, shard_rows: int = SHARD_ROWS,
            width: int = SEARCH_WIDTH) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows with the largest inner products found for each query row.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are all rows but the query's own, of the
    same dimension. Scores are exact, in double precision; ties go to the smaller vec_id. Equal vectors are one node, so
    copies neither fill the graph nor hide each other: of a node, the k + 1 smallest ids are as many as a result can
    hold. Rows that take no part are those that ``usable`` leaves out. Fewer than k candidates give fewer rows; an
    empty table gives none.
    """
    rows = stage(usable(vectors), "vectors")
    sizes = {r.dim: (r.n, r.q) for r in rows.groupBy("dim").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("q")).collect()}
    shards = {d: shard_count(n, d, shard_rows) for d, (n, _) in sizes.items()}
    blocks = {d: max(1, -(-q // QUERY_BLOCK)) for d, (_, q) in sizes.items()}
    if not sizes:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    graphs = stage(build_graphs(rows, shards, k + 1), "graphs")

    def of(counts):
        return F.element_at(F.create_map(*[F.lit(v) for kv in counts.items() for v in kv]), F.col("dim"))

    queries = rows.filter(F.col("vec_id") % every == 0).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), of(blocks)).cast("int"))
    queries = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), of(shards) - 1)))
    dealt = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), of(blocks) - 1)))

    def run(held, asked):
        empty = pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        if not len(held) or not len(asked):
            return empty
        shard = Shard(held.iloc[0])
        ids, starts = shard.ids, shard.starts
        q = np.stack(asked["vec"].to_numpy()).astype(np.float64)
        found = shard.search(q, k + 1, width)
        out = []
        for own, vec, numbers in zip(asked["vec_id"].to_numpy(), q, found):
            numbers = numbers[numbers >= 0]
            score = (shard.vectors[numbers] * vec).sum(axis=1)
            many = starts[numbers + 1] - starts[numbers]
            which = np.concatenate([ids[starts[i]:starts[i + 1]] for i in numbers]) if len(numbers) else ids[:0]
            score = np.repeat(score, many)
            other = which != own
            which, score = which[other], score[other]
            first = np.lexsort((which, -score))[:k]
            out.append(pd.DataFrame({"query_id": own, "vec_id": which[first], "score": score[first]}))
        return pd.concat(out) if out else empty

    near = dealt.groupBy("dim", "shard", "block").cogroup(queries.groupBy("dim", "shard", "block")).applyInPandas(
        run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
