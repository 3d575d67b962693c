"""Approximate nearest neighbours: a hierarchical k-means tree, best-bin-first.

The tree is fitted on a bounded sample (``SAMPLE`` vectors and ``SAMPLE_BYTES`` at most, those of the smallest hashes of vec_id), split by
spherical k-means into up to ``BRANCH`` children until a leaf stands for ``LEAF`` rows of the table or holds ``LEAST`` sampled ones; so its depth
grows with the table. Every vector is then filed in a leaf. A query walks the tree with a priority queue: the nearest open node
is taken, a leaf is visited, an inner node queues its children. How many leaves are visited is calibrated: for ``CALIBRATION`` queries,
their true neighbours by brute force over all vectors (in blocks, each task keeps the best few) show how many visits reach the wanted recall,
and all queries make as many. A query whose leaves hold fewer candidates than asked for visits on until they suffice. What share of the vectors
that is depends on how clustered they are: ``report`` tells.

Neighbouring leaves make up ``REGIONS`` regions. A query goes to each region that holds one of its leaves once, with their numbers, and only meets the vectors in
those. Regions are stored in blocks of ``BLOCK_BYTES`` at most, so a vector that a third of the rows share doesn't gather in one task; a block meets the queries
that visit its region, in parts of ``PART_BYTES``, finds its own best few for each, and these are merged.
Nearness is cosine in double precision. Each vector is first scaled by a power of two, which leaves the measure as it is and keeps squares from
overflowing or vanishing. Sums are taken for each pair in the same order, so equal vectors tie exactly; ties go to the smaller vec_id.

Vectors that are null, zero, empty or hold null or non-finite components, or whose length isn't the most common one, take no part, nor do rows without a vec_id. Of
rows that repeat a vec_id, each is a candidate, but none for a query of that id. Further columns, whatever their names, are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import heapq
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

SAMPLE, SAMPLE_BYTES, BRANCH, LEAF, LEAST = 131_072, 96 << 20, 16, 128, 8
CALIBRATION, RECALL = 200, 0.95
REGIONS, BLOCK_BYTES, PART_BYTES, AT_ONCE = 64, 32 << 20, 16 << 20, 256


def usable(embeddings: DataFrame) -> DataFrame:
    """vec_id and the vector (array<double>) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ok)


def scaled(x: np.ndarray) -> np.ndarray:
    """Each row times the power of two that brings its largest component below 1."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows that stand opposite each other, in double precision; each sum in the order of its row."""
    a, b = scaled(a), scaled(b)
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class Tree:
    """Centres of the children of each inner node; leaves are numbered."""

    def __init__(self, vectors: np.ndarray, leaf: int, seed: int = 3):
        """vectors: the sample; leaf: how many of them a leaf holds at most."""
        self.leaf = leaf
        self.centres: list[np.ndarray] = []
        self.children: list[list[int]] = []  # of inner nodes; -1 - leaf for leaves
        self.leaves, self.rng = 0, np.random.default_rng(seed)
        self.root = self._grow(unit(vectors)) if len(vectors) else self._leaf()

    def _leaf(self) -> int:
        self.leaves += 1
        return -self.leaves

    def _grow(self, x: np.ndarray) -> int:
        if len(x) <= self.leaf or (x == x[0]).all():
            return self._leaf()
        other = x[int((x != x[0]).any(1).argmax())]
        branch = min(BRANCH, len(x), max(2, -(-2 * len(x) // self.leaf)))
        centres = np.unique(np.vstack([x[self.rng.choice(len(x), branch - 1, replace=False)], x[0], other]), axis=0)
        for _ in range(12):
            near = (x @ centres.T).argmax(1)
            moved = np.stack([x[near == k].sum(0) if (near == k).any() else centres[k] for k in range(len(centres))])
            norm = np.sqrt((moved * moved).sum(1, keepdims=True))
            centres = np.where(norm > 0, moved / np.maximum(norm, 1e-30), centres)
        near = (x @ centres.T).argmax(1)
        used = np.unique(near)
        if len(used) < 2:
            return self._leaf()
        at = len(self.centres)
        self.centres.append(centres[used])
        self.children.append([])
        self.children[at] = [self._grow(x[near == k]) for k in used]
        return at

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each unit vector, by the nearest child at each node."""
        out = np.zeros(len(x), np.int32)
        stack = [(self.root, np.arange(len(x)))]
        while stack:
            node, rows = stack.pop()
            if node < 0:
                out[rows] = -1 - node
            elif len(rows):
                near = (x[rows] @ self.centres[node].T).argmax(1)
                stack += [(child, rows[near == k]) for k, child in enumerate(self.children[node])]
        return out

    def visits(self, q: np.ndarray):
        """Leaves for a unit vector, best bin first."""
        queue, order = [(-1.0, 0, self.root)], 0
        while queue:
            _, _, node = heapq.heappop(queue)
            if node < 0:
                yield -1 - node
                continue
            for s, child in zip(self.centres[node] @ q, self.children[node], strict=True):
                order += 1
                heapq.heappush(queue, (-float(s), order, child))


def _pairs(ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, vec_id and score of the k nearest of some vectors to each query, best first: one matrix product for a quick bound, then exact scores for all that could be among them."""
    out: list[tuple] = []
    units = unit(vectors) if len(vectors) else vectors
    for at in range(0, len(queries) if len(ids) else 0, AT_ONCE):
        these = queries[at : at + AT_ONCE]
        rough = unit(q[at : at + AT_ONCE]) @ units.T
        rough[these[:, None] == ids[None, :]] = -np.inf
        least = np.partition(rough, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(these), -np.inf)
        row, col = np.nonzero((rough >= least[:, None] - 1e-9) & (rough > -np.inf))
        score = np.concatenate([cosine(q[at + row[i : i + 65_536]], vectors[col[i : i + 65_536]]) for i in range(0, len(row), 65_536)] or [np.zeros(0)])
        by = np.lexsort((ids[col], -score, row))
        row, col, score = row[by], col[by], score[by]
        first = np.searchsorted(row, np.arange(len(these)))
        keep = np.arange(len(row)) - first[row] < k
        out.append((these[row[keep]], ids[col[keep]], score[keep]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _best(ids: np.ndarray, vectors: np.ndarray, query: int, q: np.ndarray, k: int) -> list[tuple[int, float]]:
    _, found, score = _pairs(ids, vectors, np.array([query]), q[None, :], k)
    return list(zip(found.tolist(), score.tolist(), strict=True))


def truth(rows: DataFrame, queries: np.ndarray, q: np.ndarray, k: int) -> pd.DataFrame:
    """query_id, vec_id, leaf, score: the true neighbours of a bounded set of queries. Each task reads its rows in blocks and passes k rows a query on."""

    def run(batches):
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int32))
        for batch in batches:
            if batch.num_rows:
                ids, leaf = batch.column("vec_id").to_numpy(), batch.column("leaf").to_numpy()
                order = np.argsort(ids, kind="stable")
                found = _pairs(ids, _matrix(batch.column("v")), queries, q, k)
                of = leaf[order][np.searchsorted(ids[order], found[1])]
                held = tuple(np.concatenate(x) for x in zip(held, (*found, of), strict=True))
                by = np.lexsort((held[1], -held[2], held[0]))
                held = tuple(x[by] for x in held)
                keep = np.arange(len(by)) - np.searchsorted(held[0], held[0]) < k
                held = tuple(x[keep] for x in held)
        yield common.batch_of(query_id=pa.array(held[0]), vec_id=pa.array(held[1]), leaf=pa.array(held[3], pa.int32()), score=pa.array(held[2]))

    found = rows.mapInArrow(run, "query_id long, vec_id long, leaf int, score double")
    top = found.withColumn("r", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("r") <= k)
    return top.drop("r").toPandas()


def calibrate(tree: Tree, queries: np.ndarray, q: np.ndarray, near: pd.DataFrame, recall: float = RECALL) -> int:
    """The least number of leaf visits that finds the wanted share of the true neighbours."""
    needed = []
    by = {int(i): g["leaf"].tolist() for i, g in near.groupby("query_id")}
    for i, v in zip(queries.tolist(), unit(q) if len(q) else q, strict=True):
        if want := by.get(i):
            place = {leaf: n for n, leaf in enumerate(tree.visits(v), 1)}
            needed += [place[leaf] for leaf in want]
    return int(np.quantile(needed, recall, method="higher")) if needed else 1


class Index(NamedTuple):
    """Filed rows (vec_id, v, leaf), the tree, the vectors' length, how many leaves a query visits and how many rows each leaf holds."""

    rows: DataFrame
    tree: Broadcast
    width: int
    visits: int
    sizes: dict[int, int]

    def region(self, leaf):
        return leaf * REGIONS // max(REGIONS, self.tree.value.leaves)


def build(embeddings: DataFrame, k: int = 5, every: int = 50, recall: float = RECALL) -> Index:
    valid = usable(embeddings)
    widths = valid.groupBy(F.size("v").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "w").limit(1).collect()
    width, total = (widths[0]["w"], widths[0]["n"]) if widths else (1, 0)
    valid = valid.where(F.size("v") == width)
    wanted = max(1, min(total, SAMPLE, SAMPLE_BYTES // (8 * width), 2 * LEAST * -(-total // LEAF)))
    sample = _matrix(valid.orderBy(F.xxhash64("vec_id"), "vec_id").limit(wanted).select("v").toArrow().column("v")) if total else np.zeros((0, 1))
    tree = valid.sparkSession.sparkContext.broadcast(Tree(sample, max(LEAST, LEAF * len(sample) // max(1, total))))

    def filed(batches):
        for batch in batches:
            if batch.num_rows:
                leaf = tree.value.leaf_of(unit(_matrix(batch.column("v"))))
                yield common.batch_of(vec_id=batch.column("vec_id"), v=batch.column("v"), leaf=pa.array(leaf))

    rows = common.saved(valid.mapInArrow(filed, "vec_id long, v array<double>, leaf int"), "filed")
    some = rows.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "v").orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(CALIBRATION).toArrow()
    queries, q = some.column("vec_id").to_numpy().astype(np.int64), _matrix(some.column("v")) if some.num_rows else np.zeros((0, width))
    visits = calibrate(tree.value, queries, q, truth(rows, queries, q, k), recall) if len(queries) else 1
    sizes = {r["leaf"]: r["n"] for r in rows.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # bounded by the tree's leaves
    return Index(rows, tree, width, visits, sizes)


def visiting(index: Index, asked: DataFrame, k: int, vectors: bool = True) -> DataFrame:
    """query_id, region, the leaves that the query visits there and, if wanted, the vector q."""
    shared, visits, sizes, scale = index.tree, index.visits, index.sizes, max(REGIONS, index.tree.value.leaves)

    def run(batches):
        for batch in batches:
            query, regions, leaves, cut = [], [], [], [0]
            for i, v in enumerate(unit(_matrix(batch.column("v"))) if batch.num_rows else []):
                held, at = 0, []
                for n, leaf in enumerate(shared.value.visits(v)):
                    if n >= visits and held > k:
                        break
                    held += sizes.get(leaf, 0)
                    at.append(leaf)
                found = np.sort(np.array(at, np.int32))
                region, first = np.unique(found.astype(np.int64) * REGIONS // scale, return_index=True)
                query += [i] * len(region)
                regions += region.tolist()
                leaves.append(found)
                cut += (cut[-1] + np.append(first[1:], len(found))).tolist()
                if cut[-1] > 500_000 or (query and i == batch.num_rows - 1):
                    of = pa.array(query, pa.int32())
                    lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(np.concatenate(leaves)))
                    yield common.batch_of(query_id=batch.column("vec_id").take(of), region=pa.array(regions, pa.int32()), leaves=lists, **({"q": batch.column("v").take(of)} if vectors else {}))
                    query, regions, leaves, cut = [], [], [], [0]

    return asked.mapInArrow(run, "query_id long, region int, leaves array<int>" + ", q array<double>" * vectors)


def _asked(index: Index, every: int) -> DataFrame:
    return index.rows.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "v")


def report(embeddings: DataFrame, k: int = 5, every: int = 50, recall: float = RECALL) -> dict:
    """The number of vectors, leaves and visits a query, and the share of all (query, vector) pairs that are compared."""
    index = build(embeddings, k, every, recall)
    asked = _asked(index, every)
    by_leaf = visiting(index, asked, k, False).select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()
    pairs = sum(r["n"] * index.sizes.get(r["leaf"], 0) for r in by_leaf)
    return {"vectors": sum(index.sizes.values()), "leaves": index.tree.value.leaves, "visits": index.visits, "share": pairs / max(1, sum(index.sizes.values()) * asked.count())}


def _best_in_leaves(left: pa.Table, right: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, vec_id and score of the k nearest to each query, among the vectors in the leaves that it visits."""
    leaf, ids = left.column("leaf").to_numpy(), left.column("vec_id").to_numpy()
    by = np.argsort(leaf, kind="stable")
    leaf, ids, vectors = leaf[by], ids[by], _matrix(left.column("v"))[by]
    lists = right.column("leaves").combine_chunks()
    queries, q = right.column("query_id").to_numpy(), _matrix(right.column("q"))
    visited = lists.flatten().to_numpy()
    of = np.repeat(np.arange(len(queries)), np.diff(lists.offsets.to_numpy()))
    order = np.argsort(visited, kind="stable")
    visited, of = visited[order], of[order]
    out = []
    for one in np.unique(leaf).tolist():
        rows, some = slice(*np.searchsorted(leaf, [one, one + 1])), of[slice(*np.searchsorted(visited, [one, one + 1]))]
        if len(some):
            out.append(_pairs(ids[rows], vectors[rows], queries[some], q[some], k))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    query, found, score = (np.concatenate(x) for x in zip(*out, strict=True))
    by = np.lexsort((found, -score, query))
    query, found, score = query[by], found[by], score[by]
    keep = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[keep], found[keep], score[keep]


def search(embeddings: DataFrame, k: int = 5, every: int = 50, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose vec_id is divisible by ``every``."""
    index = build(embeddings, k, every, recall)
    visitors = {r["region"]: r["n"] for r in visiting(index, _asked(index, every), k, False).groupBy("region").agg(F.count(F.lit(1)).alias("n")).collect()}
    held: dict[int, int] = {}
    for leaf, n in index.sizes.items():
        held[index.region(leaf)] = held.get(index.region(leaf), 0) + n
    blocks = {region: -(-n * 8 * index.width // BLOCK_BYTES) for region, n in held.items()}
    parts = {region: -(-n * 8 * index.width // PART_BYTES) for region, n in visitors.items()}

    def of(table: dict[int, int]):
        """The table's number of a row's region; the map holds only those above 1."""
        more = [F.lit(x) for region, n in table.items() if n > 1 for x in (region, n)]
        return F.coalesce(F.create_map(*more)[F.col("region")], F.lit(1)) if more else F.lit(1)

    some = lambda n, c: F.pmod(F.xxhash64(c), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n.cast("int") - 1))
    region = F.floor(F.col("leaf").cast("long") * REGIONS / F.lit(max(REGIONS, index.tree.value.leaves))).cast("int")
    stored = index.rows.withColumn("region", region).withColumn("block", some(of(blocks), "vec_id")).withColumn("part", each(of(parts)))
    asked = visiting(index, _asked(index, every), k).withColumn("block", each(of(blocks))).withColumn("part", some(of(parts), "query_id"))

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        found = _best_in_leaves(left, right, k) if left.num_rows and right.num_rows else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        return pa.table({n: pa.array(c) for n, c in zip(("query_id", "vec_id", "score"), found, strict=True)})

    pairs = stored.groupBy("region", "block", "part").cogroup(asked.groupBy("region", "block", "part")).applyInArrow(met, "query_id long, vec_id long, score double")
    ranked = pairs.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.read(spark, sf_dir, "embeddings"))
