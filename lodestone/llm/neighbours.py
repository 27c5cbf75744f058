"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on at most ``SAMPLE`` vectors and broadcast; every vector is put in a leaf. A query
walks the tree best bin first: a priority queue holds nodes by the distance of their centre, the
nearest is opened next, and leaves are visited until their number reaches the calibrated one and they
hold enough vectors. That number is the least whose recall is ``RECALL`` on as many vectors again, which the
tree wasn't fitted on (on the sample itself where the table has no more): centres are nearer to what they were fitted on. Queries meet the
vectors of their leaves by a join on the leaf, in blocks; within a block, of vectors that are equal
only the ones with the smallest ids are kept that can be among the nearest.

Defined cases: vectors that are null, zero, of another length than most, or with null or non-finite
components take no part, nor do rows without an id; rows with one id are one candidate, at the nearest of its vectors; with
fewer candidates than k all are returned; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.shared import settle

#: Vectors the tree is fitted on at most, children of a node, sample vectors in a leaf at most.
SAMPLE, BRANCH, LEAF = 20_000, 16, 48
RECALL, CALIBRATED_ON = 0.96, 400
BLOCK = 256


class Tree:
    """Centres of all nodes, children of inner nodes; leaves are numbered in the order they are made."""

    def __init__(self, sample: np.ndarray, seed: int = 1):
        self.centres, self.children, self.leaf_of = [sample.mean(0) if len(sample) else np.zeros(0)], [[]], [-1]
        self.n_leaves, rng, todo = 0, np.random.default_rng(seed), [(0, sample)]
        while todo:
            node, part = todo.pop()
            groups = self._split(part, rng) if len(part) > LEAF else []
            if len(groups) < 2:  # small, or all vectors equal
                self.leaf_of[node] = self.n_leaves
                self.n_leaves += 1
                continue
            for centre, members in groups:
                self.children[node].append(len(self.centres))
                todo.append((len(self.centres), members))
                self.centres.append(centre)
                self.children.append([])
                self.leaf_of.append(-1)
        self.centres = np.array(self.centres)
        self.children = [np.array(c, int) for c in self.children]

    @staticmethod
    def _split(part: np.ndarray, rng) -> list[tuple[np.ndarray, np.ndarray]]:
        distinct = np.unique(part, axis=0)
        if len(distinct) < 2:
            return []
        centres = distinct[rng.choice(len(distinct), min(BRANCH, len(distinct)), replace=False)]
        for _ in range(10):
            near = nearest(part, centres)
            used = np.unique(near)
            new = np.array([part[near == k].mean(0) for k in used])
            if len(new) == len(centres) and np.allclose(new, centres):
                break
            centres = new
        near = nearest(part, centres)
        return [(centres[k], part[near == k]) for k in np.unique(near)]

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector, by the nearest child at every node."""
        out, todo = np.zeros(len(x), int), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if not len(kids):
                out[rows] = self.leaf_of[node]
                continue
            near = nearest(x[rows], self.centres[kids])
            todo += [(int(kid), rows[near == k]) for k, kid in enumerate(kids) if (near == k).any()]
        return out

    def leaves(self, q: np.ndarray) -> Iterator[int]:
        """All leaves, best bin first."""
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            while len(kids := self.children[node]):
                gaps = ((self.centres[kids] - q) ** 2).sum(1)
                order = np.argsort(gaps)
                for k in order[1:]:
                    heapq.heappush(queue, (float(gaps[k]), int(kids[k])))
                node = int(kids[order[0]])
            yield self.leaf_of[node]


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the nearest centre, in blocks."""
    out, half = np.empty(len(x), int), (centres**2).sum(1) / 2
    for k in range(0, len(x), 4096):
        out[k : k + 4096] = (half - x[k : k + 4096] @ centres.T).argmin(1)
    return out


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - q) ** 2).sum(1))


def calibrate(tree: Tree, sample: np.ndarray, k: int, rng) -> int:
    """Leaves to visit so that, over sample vectors as queries, RECALL of the k nearest are found."""
    if tree.n_leaves < 2:
        return 1
    leaf = tree.assign(sample)
    needed = []
    for i in rng.choice(len(sample), min(CALIBRATED_ON, len(sample)), replace=False):
        gaps = distances(sample[i], sample)
        gaps[i] = np.inf
        best = leaf[np.argpartition(gaps, min(k, len(gaps) - 1))[:k]]
        rank = {at: n for n, at in enumerate(tree.leaves(sample[i]))}
        needed += [rank[at] + 1 for at in best]
    return int(np.quantile(needed, RECALL, method="higher"))


def _vectors(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    v = batch.column("v")
    flat = v.flatten().to_numpy(zero_copy_only=False).astype(float)
    return batch.column("id").to_numpy(), flat.reshape(-1, dim)


def _fewest(ids: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Rows without repeats of an id's vector, and without those that more than k other ids with equal vectors and smaller ids stand before."""
    order = np.lexsort((ids, *x.T[: min(8, x.shape[1])]))
    same = np.zeros(len(order), bool)
    same[1:] = (x[order[1:]] == x[order[:-1]]).all(1)
    new = ~same
    new[1:] |= ids[order[1:]] != ids[order[:-1]]
    count = np.cumsum(new)
    before = count - np.maximum.accumulate(np.where(~same, count, 0))
    return order[new & (before <= k)]


def _blocks(leaf: np.ndarray, ids: np.ndarray, x: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    order = np.argsort(leaf, kind="stable")
    edges = np.flatnonzero(np.diff(leaf[order], prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        for s in range(a, b, BLOCK):
            rows = order[s : min(b, s + BLOCK)]
            numbers = [pa.array([n], pa.int32()) for n in (int(leaf[rows[0]]), len(rows))]
            yield pa.RecordBatch.from_arrays([*numbers, pa.array([ids[rows].tobytes()]), pa.array([x[rows].tobytes()])], names=names)


def _close(qids, q, ids, x, k: int, limits) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of the queries and vectors that can be among the k nearest: a product finds them, with room for
    its rounding, and their distances are then computed exactly."""
    gaps = (x**2).sum(1) - 2 * (q @ x.T) + (q**2).sum(1)[:, None]
    room = 1e-9 * (1 + (x**2).sum(1).max() + (q**2).sum(1).max())
    gaps[qids[:, None] == ids] = np.inf
    most = np.full(len(qids), np.inf)
    order = np.argsort(ids, kind="stable")
    first = np.flatnonzero(np.append(True, ids[order[1:]] != ids[order[:-1]]))
    if len(first) > k:  # an id with several vectors is one candidate, at its nearest
        nearest_of = gaps if len(first) == len(ids) else np.minimum.reduceat(gaps[:, order], first, axis=1)
        most = np.partition(nearest_of, k - 1, axis=1)[:, k - 1]
    known, limit = limits
    if len(known):
        at = np.minimum(np.searchsorted(known, qids), len(known) - 1)
        most = np.minimum(most, np.where(known[at] == qids, limit[at] ** 2, np.inf))
    i, j = np.nonzero((gaps <= most[:, None] + room) & (gaps < np.inf))
    return qids[i], ids[j], distances(q[i], x[j])


def _best(held: list, k: int):
    """The k nearest of each query so far, and for each query that has k the distance of the last."""
    qid, vid, gap = (np.concatenate(c) for c in zip(*held, strict=True))
    order = np.lexsort((gap, vid, qid))
    qid, vid, gap = qid[order], vid[order], gap[order]
    new = np.ones(len(qid), bool)
    new[1:] = (qid[1:] != qid[:-1]) | (vid[1:] != vid[:-1])  # an id counts once, at its nearest
    qid, vid, gap = qid[new], vid[new], gap[new]
    order = np.lexsort((vid, gap, qid))
    qid, vid, gap = qid[order], vid[order], gap[order]
    first = np.flatnonzero(np.append(True, qid[1:] != qid[:-1])) if len(qid) else np.zeros(0, int)
    place = np.arange(len(qid)) - np.repeat(first, np.diff(np.append(first, len(qid))))
    full = place == k - 1
    keep = place < k
    return [(qid[keep], vid[keep], gap[keep])], (qid[full], gap[full])


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, seed: int = 1) -> DataFrame:
    """query_id, rank, vec_id, score for each row of queries among the rows of vectors; both have vec_id, embedding."""
    spark = vectors.sparkSession

    def valid(df: DataFrame) -> DataFrame:
        ok = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
        return df.select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).where("id is not null and v is not null").where(ok)

    lengths = valid(vectors).groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    dim = lengths[0]["d"] if lengths else 1
    rows, asked = (valid(df).where(F.size("v") == dim) for df in (vectors, queries))
    picked = rows.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(2 * SAMPLE).toPandas()
    sample = np.array(picked["v"].tolist(), float).reshape(-1, dim)
    sample = sample[np.sort(np.unique(sample, axis=0, return_index=True)[1])]  # repeats would make neighbours look near
    sample, other = sample[:SAMPLE], sample[SAMPLE:]
    tree = Tree(sample, seed)
    judged = other if len(other) >= SAMPLE // 4 else sample
    visits = calibrate(tree, judged, k, np.random.default_rng(seed)) if len(sample) else 1
    shared = spark.sparkContext.broadcast(tree)

    def place(batches):
        for batch in batches:
            ids, x = _vectors(batch, dim)
            kept = _fewest(ids, x, k)
            yield from _blocks(shared.value.assign(x[kept]), ids[kept], x[kept], ["leaf", "n", "ids", "vecs"])

    members = settle(rows.mapInArrow(place, "leaf int, n int, ids binary, vecs binary"))
    held = {r["leaf"]: r["n"] for r in members.groupBy("leaf").agg(F.sum("n").alias("n")).collect()}  # a row for each leaf

    def route(batches):
        for batch in batches:
            ids, x = _vectors(batch, dim)
            at, leaf = [], []
            for i, q in enumerate(x):
                seen = found = 0
                for one in shared.value.leaves(q):
                    seen, found = seen + 1, found + held.get(one, 0)
                    if one in held:
                        at.append(i)
                        leaf.append(one)
                    if seen >= visits and found > 2 * k + 1:
                        break
            yield from _blocks(np.array(leaf, int), ids[at], x[at], ["leaf", "m", "qids", "qvecs"])

    def meet(batches):
        held, size, limits = [], 0, (np.zeros(0, np.int64), np.zeros(0))
        for batch in batches:
            for row in batch.to_pylist():
                ids, x = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vecs"]).reshape(-1, dim)
                qids, q = np.frombuffer(row["qids"], np.int64), np.frombuffer(row["qvecs"]).reshape(-1, dim)
                held.append(_close(qids, q, ids, x, k, limits))
                size += len(held[-1][0])
                if size > 200_000:
                    held, limits = _best(held, k)
                    size = len(held[0][0])
        if held:
            best = _best(held, k)[0][0]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in best], names=["query_id", "vec_id", "score"])

    sought = asked.mapInArrow(route, "leaf int, m int, qids binary, qvecs binary")
    pairs = members.join(sought, "leaf").select("ids", "vecs", "qids", "qvecs")
    found = pairs.mapInArrow(meet, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
