"""Near-duplicate detection: improved consistent weighted sampling over TF-IDF shingles, banded, verified.

A document is the weighted set of its shingles, runs of five words (a shorter text is one shingle of all its words; ASCII
case is ignored). A shingle weighs (1 + ln tf) (1 + DAMPING idf / ln(1 + N)), idf = ln((1 + N) / (1 + df)). Undamped, a group
of thousands of near copies would fall apart: their common shingles would weigh a fraction of what each one's own edits
weigh. Document frequencies are counted over all documents, by hash bucket in a table of fixed size, so what is broadcast
doesn't grow with the data.
``SAMPLES`` consistent samples (r and c from Gamma(2, 1), beta uniform, all from the shingle's hash) are drawn in proportion to
the weights, and ``ROWS`` of them make a band.

Texts with the same words are one class from the start; its smallest doc_id stands for it. Two representatives that share a
bucket of a band are compared unless they came together before; those with a weighted Jaccard similarity of at least 0.8 are
linked, and classes are the connected components, found by hooking and pointer jumping over tables. First each bucket's
members are compared with the smallest and the largest of them, in linear number, which joins large groups of copies. Then
all other members of different classes in it are compared, whichever way their first links went. That is quadratic in the
unlike members of a bucket; pairs whose total weights alone rule the threshold out are skipped. Hot buckets are split into
blocks of bounded size, and each pair of blocks is a task's small piece of work. No bucket is capped.

Texts without a word (null, empty, blank) form one class of their own. A null doc_id counts as the smallest. Rows with equal doc_id count as one
document, whose text is the smallest of theirs, and ``dedup`` returns one row of them. Texts of any length are compared whole. Further columns, whatever
their names, are ignored by ``classes`` and kept by ``dedup``. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 10, 3
DAMPING = 0.1
BUCKETS, SEGMENTS, HOT = 1 << 20, 64, 1000
BLOCK, UNIT = 128, 2048  # a block's members count one each, and one more for each so many words
_GRID = 1 << 12
_U = np.uint64


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gamma(2, 1) variables r, their inverses, and the logarithms of others, c: fixed values on a grid, in random order."""
    rng = np.random.default_rng(31)
    r, c = rng.gamma(2, 1, _GRID).astype(np.float32), rng.gamma(2, 1, _GRID)
    return r, (1 / r).astype(np.float32), np.log(c).astype(np.float32)


_R, _R_INV, _LOG_C = _tables()
_SEEDS = common.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))


def shingles(words: common.Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The shingle hashes of all texts one after another, and where each text's begin."""
    first, counts = words.first, words.counts
    ok = common.inside(first, k)
    long_hashes = common.windows(words.hashes, k)[ok] if len(ok) else np.zeros(0, np.uint64)
    n = np.maximum(counts - k + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if not len(short):
        return long_hashes, np.concatenate([[0], np.cumsum(n)])
    begin = np.concatenate([[0], np.cumsum(n)])
    own = np.array([common.mix(np.array([int(common.folded(words.hashes[first[i] : first[i + 1]]))], np.uint64))[0] for i in short], np.uint64)
    out = np.insert(long_hashes, begin[short], own)
    n[short] = 1
    return out, np.concatenate([[0], np.cumsum(n)])


def _set_of(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(hashes, return_counts=True)


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Over all documents: in how many the shingles of each hash bucket occur, and the number of documents. 8 MB, whatever the input."""

    def run(batches):
        table, n = np.zeros(BUCKETS, np.int64), 0
        for batch in common.slices(batches):
            found, begin = shingles(common.Words(batch.column("text"), lower=True))
            bucket = (found >> _U(44)).astype(np.int64)
            pairs = np.unique(np.repeat(np.arange(batch.num_rows, dtype=np.int64), np.diff(begin)) << 20 | bucket)
            table += np.bincount(pairs & (BUCKETS - 1), minlength=BUCKETS)
            n += batch.num_rows
        if n:
            parts = [p.tobytes() for p in table.astype(np.uint32 if table.max() < 1 << 32 else np.int64).reshape(SEGMENTS, -1)]
            yield common.batch_of(segment=pa.array(range(SEGMENTS), pa.int32()), counts=pa.array(parts, pa.binary()), n=pa.array([n] * SEGMENTS, pa.int64()))

    def merge(batches):
        # one segment's rows stream through; they are sorted by segment, so one sum is open at a time
        open_, total, n = None, None, 0
        for batch in batches:
            for segment, data, rows in zip(batch.column("segment").to_pylist(), batch.column("counts").to_pylist(), batch.column("n").to_pylist(), strict=True):
                if segment != open_:
                    if open_ is not None:
                        yield common.batch_of(segment=pa.array([open_], pa.int32()), counts=pa.array([total.tobytes()], pa.binary()), n=pa.array([n], pa.int64()))
                    open_, total, n = segment, np.zeros(BUCKETS // SEGMENTS, np.int64), 0
                total += np.frombuffer(data, np.uint32 if len(data) == BUCKETS // SEGMENTS * 4 else np.int64)
                n += rows
        if open_ is not None:
            yield common.batch_of(segment=pa.array([open_], pa.int32()), counts=pa.array([total.tobytes()], pa.binary()), n=pa.array([n], pa.int64()))

    kind = "segment int, counts binary, n long"
    rows = common.texts_of(docs).select("text").mapInArrow(run, kind).repartition(SEGMENTS, "segment").sortWithinPartitions("segment").mapInArrow(merge, kind).collect()
    out = np.zeros((SEGMENTS, BUCKETS // SEGMENTS), np.int64)
    for r in rows:
        out[r["segment"]] = np.frombuffer(r["counts"], np.int64)
    return out.ravel(), max([0, *(r["n"] for r in rows)])


def inverse_frequencies(docs: DataFrame) -> np.ndarray:
    """1 + DAMPING ln((1 + N) / (1 + df)) / ln(1 + N) for each bucket of shingles."""
    df, n = document_frequencies(docs)
    return (1 + DAMPING * np.log((1 + n) / (1 + df)) / np.log(max(2, 1 + n))).astype(np.float32)


def weights(found: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return (1 + np.log(counts)) * idf[(found >> _U(44)).astype(np.int64)]


def samples(found: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each of the seeds, a hash of the consistent sample (shingle and level) of a weighted set."""
    log_s = np.log(weight).astype(np.float32)
    best, chosen, level = np.full(len(_SEEDS), np.inf, np.float32), np.zeros(len(_SEEDS), np.uint64), np.zeros(len(_SEEDS), np.float32)
    rows = np.arange(len(_SEEDS))
    for a in range(0, len(found), 256):
        h, s = found[a : a + 256], log_s[a : a + 256]
        z = h[None, :] ^ _SEEDS[:, None]
        z *= _U(0xD6E8FEB86659FD93)
        z ^= z >> _U(32)
        z *= _U(0x94D049BB133111EB)
        t = _R_INV.take(at := (z >> _U(52)).view(np.int64), mode="clip")
        t *= s
        t += z.astype(np.uint32).astype(np.float32) * np.float32(2**-32)
        beta_less = t - np.floor(t, out=(whole := np.empty_like(t)))
        # ln a = ln c - r (t - beta + 1), and t - beta = ln S / r - (the part of t that was floored away)
        cost = _LOG_C.take(((z >> _U(40)) & _U(_GRID - 1)).view(np.int64), mode="clip") - s - _R.take(at, mode="clip") * (np.float32(1) - beta_less)
        i = cost.argmin(1)
        low = cost[rows, i]
        better = low < best
        best[better], chosen[better], level[better] = low[better], h[i][better], whole[rows, i][better]
    return common.mix(chosen ^ common.mix(level.astype(np.int64).astype(np.uint64) + _U(11)))


def bands(sampled: np.ndarray) -> np.ndarray:
    """One key for each band of ROWS samples."""
    by = sampled.reshape(BANDS, ROWS)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = common.mix(key * _U(0x9FB21C651E98DF25) + by[:, j])
    return key


def signatures(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """doc_id, two hashes of the whole word sequence, the text's size in units of a block, and the band keys (none for texts without words)."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches):
        idf = shared.value
        for batch in common.slices(batches):
            words = common.Words(batch.column("text"), lower=True)
            found, begin = shingles(words)
            keys, a, b = [], [], []
            for i in range(batch.num_rows):
                own = words.hashes[words.first[i] : words.first[i + 1]]
                a.append(int(common.folded(own)) - (1 << 63))
                b.append(int(common.folded(common.mix(own + _U(5)))) - (1 << 63))
                one, counts = _set_of(found[begin[i] : begin[i + 1]])
                keys.append(bands(samples(one, weights(one, counts, idf))).view(np.int64) if len(one) else None)
            units = pa.array(1 + words.counts // UNIT, pa.int64())
            yield common.batch_of(doc_id=batch.column("doc_id"), h1=pa.array(a, pa.int64()), h2=pa.array(b, pa.int64()), units=units, keys=pa.array(keys, pa.list_(pa.int64())))

    return common.texts_of(docs).mapInArrow(run, "doc_id long, h1 long, h2 long, units long, keys array<long>")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two sets (sorted hashes, weights): the sum of the minima over that of the maxima."""
    at = np.searchsorted(a[0], b[0])
    at[at == len(a[0])] = 0
    both = a[0][at] == b[0] if len(a[0]) else np.zeros(len(b[0]), bool)
    least = float(np.minimum(a[1][at[both]], b[1][both]).sum())
    return least / max(float(a[1].sum() + b[1].sum()) - least, 1e-30)


def weighted_sets(texts: pa.Array, idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    found, begin = shingles(common.Words(texts, lower=True))
    for i in range(len(texts)):
        one, counts = _set_of(found[begin[i] : begin[i + 1]])
        yield one, weights(one, counts, idf)


def verified(links: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """The links (a, b) that hold. Texts meet the links by joins; a leader's set is made once for its run of rows."""
    shared = links.sparkSession.sparkContext.broadcast(idf)

    def run(batches):
        idf, last, held = shared.value, None, None
        for batch in common.slices(batches, "text_b", 1 << 20):
            keep, a = [], batch.column("a").to_pylist()
            for i, other in enumerate(weighted_sets(batch.column("text_b"), idf)):
                if a[i] != last:
                    last, held = a[i], next(weighted_sets(batch.column("text_a").slice(i, 1), idf))
                keep.append(similarity(held, other) >= threshold)
            yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])

    with_b = links.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    both = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def compared(ids: list[int], classes_: list[int], sides: list[int], sets: list[tuple[np.ndarray, np.ndarray]], threshold: float) -> Iterator[tuple[int, int]]:
    """Links that hold between members of different classes: of one block (side 2) or across two (sides 0 and 1). Pairs that came together here are skipped."""
    total = np.array([float(w.sum()) for _, w in sets])
    side, root = np.array(sides), {c: c for c in classes_}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = c = root[root[c]]
        return c

    for i in range(len(ids)):
        may = (side[i + 1 :] != side[i]) | (side[i] == 2)
        may &= np.minimum(total[i + 1 :], total[i]) >= (threshold - 1e-6) * np.maximum(total[i + 1 :], total[i])
        for j in (np.flatnonzero(may) + i + 1).tolist():
            x, y = find(classes_[i]), find(classes_[j])
            if x != y and similarity(sets[i], sets[j]) >= threshold:
                root[y] = x
                yield min(ids[i], ids[j]), max(ids[i], ids[j])


def inner_links(members: DataFrame, labels: DataFrame, texts: DataFrame, idf: np.ndarray, threshold: float, block: int) -> DataFrame:
    """The links (a, b) that hold among all members of a bucket but its smallest and largest, between classes."""
    inner = members.where("doc_id <> lo and doc_id <> hi").select("band", "key", "doc_id", "units").distinct().join(labels, "doc_id")
    parts = inner.groupBy("band", "key", "c").agg(F.sum("units").alias("m"))
    several = parts.groupBy("band", "key").agg(F.count(F.lit(1)).alias("k"), F.sum(F.when(F.col("m") <= block, F.col("m")).otherwise(0)).alias("small")).where("k > 1").drop("k")
    # classes larger than a block have blocks of their own (g = 1); the others share some (g = 0)
    own = F.col("m") > block
    number = F.when(own, F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("m") / block))).otherwise(F.pmod(F.xxhash64("c"), F.greatest(F.lit(1), F.ceil(F.col("small") / block))))
    placed = inner.join(parts.join(several, ["band", "key"]), ["band", "key", "c"])
    placed = common.saved(placed.select("band", "key", "doc_id", "c", F.struct(own.cast("int").alias("g"), F.when(own, F.col("c")).otherwise(0).alias("of"), number.alias("i")).alias("blk")), "blocks")
    blocks = placed.select("band", "key", "blk").distinct()
    pairs = blocks.join(blocks.withColumnRenamed("blk", "blk2"), ["band", "key"]).where("blk <= blk2 and not (blk.g = 1 and blk2.g = 1 and blk.of = blk2.of)")
    pairs = pairs.select("band", "key", "blk", "blk2", F.xxhash64("band", "key", "blk", "blk2").alias("piece"))
    one = pairs.where("blk = blk2").select("band", "key", "blk", "piece", F.lit(2).alias("side"))
    left = pairs.where("blk < blk2").select("band", "key", "blk", "piece", F.lit(0).alias("side"))
    right = pairs.where("blk < blk2").select("band", "key", F.col("blk2").alias("blk"), "piece", F.lit(1).alias("side"))
    dealt = placed.join(one.union(left).union(right), ["band", "key", "blk"]).select("piece", "side", "doc_id", "c")
    needed = texts.join(placed.select("doc_id").distinct().hint("merge"), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    shared = members.sparkSession.sparkContext.broadcast(idf)

    def run(batches):
        idf, piece, held = shared.value, None, ([], [], [], [])

        def links():
            found = list(compared(*held, threshold)) if len(set(held[1])) > 1 else []
            return common.batch_of(a=pa.array([a for a, _ in found], pa.int64()), b=pa.array([b for _, b in found], pa.int64()))

        for batch in common.slices(batches, "text", 1 << 20):
            columns = [batch.column(c).to_pylist() for c in ("piece", "doc_id", "c", "side")]
            for p, *row, one in zip(*columns, weighted_sets(batch.column("text"), idf), strict=True):
                if p != piece:
                    yield links()
                    piece, held = p, ([], [], [], [])
                for column, value in zip(held, (*row, one), strict=True):
                    column.append(value)
        yield links()

    # pieces are many and small: dealt by their hash, sorted, and streamed one after another
    rows = dealt.join(common.saved(needed, "texts"), "doc_id").select("piece", "doc_id", "c", "side", "text")
    return rows.repartition("piece").sortWithinPartitions("piece").mapInArrow(run, "a long, b long").distinct()


def components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (doc_id, c) after the links (a, b): hooking of roots onto the smallest root they are linked to, then pointer jumping, until nothing moves."""
    while True:
        ends = links.join(labels.select(F.col("doc_id").alias("a"), F.col("c").alias("ca")), "a").join(labels.select(F.col("doc_id").alias("b"), F.col("c").alias("cb")), "b")
        hooks = ends.where("ca <> cb").select(F.greatest("ca", "cb").alias("root"), F.least("ca", "cb").alias("to")).groupBy("root").agg(F.min("to").alias("to"))
        hooks = common.saved(hooks, "hooks")
        if hooks.isEmpty():
            return labels
        while True:  # chains of hooks, halved at each step
            onward = hooks.select(F.col("root").alias("to"), F.col("to").alias("further"))
            jumped = common.saved(hooks.join(onward, "to", "left").select("root", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved")), "jumps")
            hooks = jumped.select("root", "to")
            if jumped.where("moved").isEmpty():
                break
        labels = common.saved(labels.join(hooks.withColumnRenamed("root", "c"), "c", "left").select("doc_id", F.coalesce("to", "c").alias("c")), "labels")


def met(rows: DataFrame, groups: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """Rows with their group's columns. Groups of over a ``HOT``-th of the rows, fewer than ``HOT`` whatever the input, are broadcast, so that none lands in one task."""
    hot = F.broadcast(groups.where(F.col(n) > F.lit(total / HOT)))
    others = rows.join(hot.select(*keys), keys, "left_anti").join(groups, keys)
    return rows.join(hot, keys).unionByName(others)


def classes(docs: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest doc_id of its class), class_size and kept (it is that document)."""
    return common.ids_back(_classes(docs, threshold, block), "doc_id", "class_id")


def _classes(docs: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    texts = common.texts_of(docs)
    if not texts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        docs = common.saved(texts.groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")), "documents")
    idf = inverse_frequencies(docs)
    rows = common.saved(signatures(docs, idf), "signatures")
    whole = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    reps = whole.select(F.col("rep").alias("doc_id")).distinct()
    texts = common.texts_of(docs)
    signed = rows.where("keys is not null").join(reps, "doc_id", "left_semi").select("doc_id", "units", F.posexplode("keys").alias("band", "key"))
    buckets = signed.groupBy("band", "key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    leaders = common.saved(buckets, "leaders")
    members = common.saved(signed.join(leaders, ["band", "key"]).select("doc_id", "units", "band", "key", "lo", "hi"), "members")
    labels = common.saved(members.select("doc_id").distinct().select("doc_id", F.col("doc_id").alias("c")), "labels")
    pairs = members.select(F.least("doc_id", "lo").alias("a"), F.greatest("doc_id", "lo").alias("b")).union(members.select(F.least("doc_id", "hi").alias("a"), F.greatest("doc_id", "hi").alias("b")))
    links = common.saved(pairs.where("a < b").distinct(), "links")
    needed = texts.join(links.select(F.col("a").alias("doc_id")).union(links.select("b")).distinct().hint("merge"), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    labels = components(labels, common.saved(verified(links, common.saved(needed, "texts"), idf, threshold), "held"))
    labels = components(labels, common.saved(inner_links(members, labels, texts, idf, threshold, block), "held"))
    of_rep = common.saved(whole.join(labels, whole["rep"] == labels["doc_id"], "left").select("h1", "h2", "n", F.coalesce("c", "rep").alias("class_id")), "reps")
    total = rows.count()
    placed = common.saved(met(rows.select("doc_id", "h1", "h2"), of_rep, ["h1", "h2"], "n", total).select("doc_id", "class_id"), "placed")
    sizes = common.saved(of_rep.groupBy("class_id").agg(F.sum("n").alias("class_size")), "sizes")
    return met(placed, sizes, ["class_id"], "class_size", total).select("doc_id", "class_id", "class_size", (F.col("doc_id") == F.col("class_id")).alias("kept"))


def dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that stay, one row of each class, with all their columns; of rows that repeat a doc_id the one with the smallest text."""
    found = _classes(docs, threshold)
    twins = common.texts_of(docs).groupBy("doc_id").agg(F.count(F.lit(1)).alias("twins"))
    stay = common.saved(found.where("kept").select("doc_id").join(twins, "doc_id").select("doc_id", "twins"), "kept")
    return common.one_of_each(docs, [common.id_of(docs)], stay)


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(common.read(spark, sf_dir, "documents"))
