"""Sharding by a k-d tree over document metadata.

Each document is a point: UTF-8 bytes (on a log scale), language and a hash of its text, 20 bits each. The tree splits a
cell along its widest dimension (the reach of the middle nine tenths of its weight, as a share of the whole dimension) at
the weighted quantile that leaves whole shards on both sides; the weight is the size in bytes. Along a dimension, points are ordered
by a key of 60 bits: the dimension, the hash of the text, a hash of doc_id. Quantiles are found by distributed
histograms over ten bits of that key at a time, each pass for all cells of a level, until the cut is within a
tolerance. Where a cut can't meet its quantile, each side gets as many shards as its weight has earned. A group of equal
texts stays together unless that alone would miss the quantile by ``GROUP`` of a shard; then doc_id splits it. The law that
holds is ``bytes``.

Heavy texts can't be cut, so those over a ``HEAVY``-th of a shard, at most ``HEAVY`` rows a shard whatever the input, are
placed before the tree grows, heaviest first on the emptiest shard, and the leaves' targets are what is left to fill. A text that outweighs an
even share makes its shard too large wherever it goes: such texts fill the fewest shards of at most ``CROWD`` times the heaviest
of them, and all other shards share the rest evenly.

Null texts have no bytes; every size has 16 added. One text of any length is one point. Ties on every dimension are cut by doc_id. Rows with equal doc_id
are points of their own, rows that are wholly equal go together. Further columns, whatever their names, are ignored; a table without
``lang`` is read as one language. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

SHARDS, EXTRA = 40, 16
BITS, STEP = 20, 10
BLOCK = 1 << 17
DIMS = ("d_size", "d_lang", "d_text")
#: A cut may miss its quantile by this share of a shard, and by GROUP of one to keep equal texts together.
TOLERANCE, GROUP = 0.002, 0.02
HEAVY, CROWD = 16, 1.5


def points(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, the dimensions and a tie-breaker, by built-in functions only."""
    text, bits = F.coalesce(F.col("text"), F.lit("")), 1 << BITS
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit("")
    size = F.octet_length(text).cast("long")
    log_size = F.least(F.floor(F.log2(size + 1) * (bits // 40)), F.lit(bits - 1)).cast("int")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (size + EXTRA).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        log_size.alias("d_size"), F.pmod(F.xxhash64(lang), F.lit(bits)).cast("int").alias("d_lang"),
        F.pmod(F.xxhash64(text), F.lit(bits)).cast("int").alias("d_text"), F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.lit(7)), F.lit(bits)).cast("int").alias("d_tie"),
    )


class Tree:
    """Nodes are [dimension, cut, left, right], or the number of a shard."""

    def __init__(self):
        self.root: list | int = 0

    def cells(self, columns: dict[str, np.ndarray]) -> np.ndarray:
        """The shard or, while the tree grows, the open cell of each point."""
        out = np.zeros(len(columns["d_tie"]), np.int32)

        def down(node, rows):
            if not isinstance(node, list):
                out[rows] = node
            elif len(rows):
                left = key_of(columns, node[0], rows) < node[1]
                down(node[2], rows[left])
                down(node[3], rows[~left])

        down(self.root, np.arange(len(out)))
        return out


def key_of(columns: dict[str, np.ndarray], dim: int, rows) -> np.ndarray:
    return (columns[DIMS[dim]][rows] << 2 * BITS) | (columns["d_text"][rows] << BITS) | columns["d_tie"][rows]


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {n: batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in (*DIMS, "d_tie", "size")}


def _histograms(table: DataFrame, tree: Tree, asked: list[tuple[int, int, int, int]]) -> dict[tuple[int, int], np.ndarray]:
    """By (cell, dimension): weights of the next STEP bits of the key, of the points whose key begins with ``prefix``.

    asked: (cell, dimension, prefix, bits of the prefix). What comes to the driver is bounded by len(asked) x 2^STEP.
    """

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            c = _columns(batch)
            cells = tree.cells(c)
            for n, (cell, dim, prefix, bits) in enumerate(asked):
                rows = np.flatnonzero(cells == cell)
                if len(rows):
                    key = key_of(c, dim, rows)
                    here = (key >> (3 * BITS - bits)) == prefix
                    bins = (key[here] >> (3 * BITS - bits - STEP)) & ((1 << STEP) - 1)
                    sums[n] = sums.get(n, 0) + np.bincount(bins, c["size"][rows][here], 1 << STEP).astype(np.int64)
        for n, w in sums.items():
            used = np.flatnonzero(w)
            yield common.batch_of(n=pa.array(np.full(len(used), n, np.int32)), bin=pa.array(used.astype(np.int32)), w=pa.array(w[used]))

    found = {(cell, dim): np.zeros(1 << STEP, np.int64) for cell, dim, _, _ in asked}
    for r in table.mapInArrow(run, "n int, bin int, w long").groupBy("n", "bin").agg(F.sum("w").alias("w")).collect():
        found[asked[r["n"]][:2]][r["bin"]] = r["w"]
    return found


def _spread(w: np.ndarray) -> float:
    run = np.cumsum(w)
    return float(np.searchsorted(run, 0.95 * run[-1]) - np.searchsorted(run, 0.05 * run[-1])) / len(w)


def _best_share(targets: list[float], part: float) -> int:
    """How many of the targets, at least one and not all, come nearest to this part of their sum."""
    run = np.cumsum(targets)[:-1] / sum(targets)
    return int(np.abs(run - part).argmin()) + 1


def grow(table: DataFrame, leaves: list[tuple[int, float]], shard_bytes: float) -> Tree:
    """The whole tree, a level at a time: one pass for the widths, then one for each further ten bits that a cut needs.

    leaves: the shards and the weight that each should get, as ratios.
    """
    tree = Tree()
    slack, group = TOLERANCE * shard_bytes, GROUP * shard_bytes
    open_cells, following = {0: leaves}, 1 + max((s for s, _ in leaves), default=0)
    at: dict[int, tuple[list | None, int]] = {0: (None, 0)}  # the parent's place of each open cell
    while level := {c: x for c, x in open_cells.items() if len(x) > 1}:
        first = _histograms(table, tree, [(c, d, 0, 0) for c in level for d in range(len(DIMS))])
        axis = {c: max(range(len(DIMS)), key=lambda d: _spread(first[c, d])) for c in level}
        weight = {c: int(first[c, axis[c]].sum()) for c in level}
        part = {c: sum(t for _, t in x[: len(x) // 2]) / sum(t for _, t in x) for c, x in level.items()}
        state = {c: (0, 0, weight[c] * part[c], first[c, axis[c]]) for c in level}
        cuts: dict[int, tuple[int, float]] = {}  # the key, and the weight in front of it
        while state:
            further = {}
            for c, (prefix, bits, goal, w) in state.items():
                run = np.cumsum(w)
                b = min(int(np.searchsorted(run, goal, "right")), len(w) - 1)
                low, high, bits = goal - (run[b] - w[b]), run[b] - goal, bits + STEP
                if min(low, high) <= (group if bits >= 2 * BITS else slack) or bits >= 3 * BITS:
                    cuts[c] = ((prefix << STEP | b) + int(high < low)) << (3 * BITS - bits), weight[c] * part[c] + (high if high < low else -low)
                else:
                    further[c] = (prefix << STEP | b, bits, low)
            found = _histograms(table, tree, [(c, axis[c], p, bits) for c, (p, bits, _) in further.items()]) if further else {}
            state = {c: (p, bits, goal, found[c, axis[c]]) for c, (p, bits, goal) in further.items()}
        for c, x in level.items():
            cut, left = cuts[c]
            n = len(x) // 2 if abs(left - weight[c] * part[c]) <= group or not weight[c] else _best_share([t for _, t in x], left / weight[c])
            node, (parent, side) = [axis[c], cut, following, following + 1], at.pop(c)
            del open_cells[c]
            open_cells |= {following: x[:n], following + 1: x[n:]}
            at |= {following: (node, 2), following + 1: (node, 3)}
            following += 2
            if parent is None:
                tree.root = node
            else:
                parent[side] = node
    for c, ((shard_, _),) in open_cells.items():
        parent, side = at[c]
        if parent is None:
            tree.root = shard_
        else:
            parent[side] = shard_
    return tree


def place(heavy: list[tuple], total: int, shards: int) -> tuple[dict[tuple, int], list[tuple[int, float]]]:
    """The shards of heavy rows, and what is left to fill in each shard that isn't full.

    heavy: (size, text_crc32, d_text, doc_id, rows that are equal to it). Equal texts are placed as one where they fit into a shard.
    """
    texts: dict[tuple, list] = {}
    for row in heavy:
        texts.setdefault(row[:3], []).append(row)
    items = []
    for rows in texts.values():
        whole = sum(r[0] * r[4] for r in rows)
        items += [(whole, rows)] if whole <= total / shards else [(r[0] * r[4], [r]) for r in rows]
    items.sort(key=lambda x: (-x[0], x[1][0]))
    crowds: list[list] = []  # shards of those that outweigh an even share: [bytes, items]
    n, level = 0, total / shards
    while n < len(items) and items[n][0] > level:
        while n < len(items) and items[n][0] > level:
            crowd = next((c for c in crowds if c[0] + items[n][0] <= CROWD * items[0][0]), None)
            if crowd is None:
                crowds.append(crowd := [0, []])
            crowd[0] += items[n][0]
            crowd[1].append(items[n])
            n += 1
        level = (total - sum(c[0] for c in crowds)) / max(1, shards - len(crowds))
    loads, of = [0] * (shards - len(crowds)), {}
    for i, (_, crowd) in enumerate(crowds):
        of |= {row[:4]: len(loads) + i for _, rows in crowd for row in rows}
    for whole, rows in items[n:]:
        s = loads.index(min(loads))
        loads[s] += whole
        of |= {row[:4]: s for row in rows}
    light = total - sum(r[0] * r[4] for r in heavy)
    by, full = sorted(loads), 0.0
    for k in range(1, len(by) + 1):  # the level to which the light texts fill the k emptiest shards
        full = (light + sum(by[:k])) / k
        if k == len(by) or full <= by[k]:
            break
    return of, [(s, full - x) for s, x in enumerate(loads) if x < full] or [(0, 1.0)]


def shard(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null: the law isn't ``key``).

    Slots are dealt by (shard, block of rows): each block is numbered in a task of its own and moved by what the blocks before it hold,
    so that no task sees a whole shard.
    """
    table = common.saved(points(docs), "shard-points")
    sums = table.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("n")).first()
    limit = sums["total"] // (shards * HEAVY)
    heavy = table.where(F.col("size") > limit).groupBy("size", "text_crc32", "d_text", "doc_id").agg(F.count(F.lit(1)).alias("n")).collect()
    of, leaves = place([tuple(r) for r in heavy], sums["total"], shards)
    tree = grow(table.where(F.col("size") <= limit), leaves, sums["total"] / shards)

    def run(batches):
        for batch in batches:
            found = tree.cells(_columns(batch))
            sizes = batch.column("size").to_numpy()
            for i in np.flatnonzero(sizes > limit).tolist():
                found[i] = of[tuple(batch.column(c)[i].as_py() for c in ("size", "text_crc32", "d_text", "doc_id"))]
            yield common.batch_of(doc_id=batch.column("doc_id"), size=batch.column("size"), text_crc32=batch.column("text_crc32"), shard=pa.array(found, pa.int32()))

    blocks = max(1, sums["n"] // BLOCK // shards + 1)
    placed = table.mapInArrow(run, "doc_id long, size long, text_crc32 long, shard int").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))
    counts = placed.groupBy("shard", "block").agg(F.count(F.lit(1)).alias("n"))
    moved = counts.select("shard", "block", F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("moved"))
    local = placed.withColumn("k", F.row_number().over(W.partitionBy("shard", "block").orderBy("doc_id")))
    return local.join(moved, ["shard", "block"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("k") - 1 + F.col("moved")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(common.read(spark, sf_dir, "documents"))
