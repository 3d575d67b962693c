"""Exact dedup by content sort.

Texts are lower-cased in A-Z only and compared as bytes. Sampled splitters range-partition them in the order (normalised bytes,
doc_id), each partition is sorted by the whole bytes, outside memory where needed, and equals stand next to each other: a run of
equal texts is found by comparing each text with the one before it, in full.

A splitter lies between two neighbours of the sorted sample and is no longer than what parts them: the second one's bytes up to the first that
differs. Only between equal neighbours is it the whole text, with a doc_id to cut at, so that a group of copies of any size is
dealt over as many partitions as it fills. The sample has ``SAMPLED`` texts for each partition, whatever the input; one task
sorts it. Runs that touch a partition's edge may go on in the next one; one row for each such run carries its text, and
those few rows (two a partition at most) are merged by comparing the texts again.

A null text counts as an empty one, a null doc_id as the smallest. Texts of any length are compared whole. Of rows with equal text and equal
doc_id one is kept. Further columns, whatever their names, are ignored by ``groups`` and returned by ``dedup``. An empty
table gives an empty table.
"""

from __future__ import annotations

import bisect
import hashlib
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SAMPLED = 24
_RUNS = "doc_id long, k long, sha string, part int, run long, edge boolean, n long, lo long, hi long, last boolean, twins long, norm binary"


def _normalised(texts: pa.Array) -> pa.Array:
    return pc.ascii_lower(texts.fill_null("")).cast(pa.binary())


def separator(a: bytes, b: bytes) -> bytes:
    """The shortest start of b that is greater than a, which is less than b."""
    n = len(os.path.commonprefix([a[:64], b[:64]]))
    while n and n % 64 == 0 and a[n : n + 64] and a[n : n + 64] == b[n : n + 64]:
        n += 64
    return b[: n + len(os.path.commonprefix([a[n : n + 64], b[n : n + 64]])) + 1]


def _separators(every: int):
    """Of the sorted sample, what stands between each so many rows and the ones before: bytes, and a doc_id where those are equal."""

    def run(batches):
        seen, before = 0, None
        for batch in batches:
            for text, doc in zip(batch.column("norm").to_pylist(), batch.column("doc_id").to_pylist(), strict=True):
                if seen and seen % every == 0 and (text, doc) > before:
                    same = text == before[0]
                    yield common.batch_of(norm=pa.array([text if same else separator(before[0], text)], pa.binary()), doc_id=pa.array([doc if same else common.NULL_ID], pa.int64()))
                seen, before = seen + 1, (text, doc)

    return run


def splitters(texts: DataFrame, parts: int, sampled: int = SAMPLED) -> list[tuple[bytes, int]]:
    """Points in the order (normalised bytes, doc_id), about ``parts`` - 1 of them."""
    rows = texts.count()

    def normalise(batches):
        for batch in batches:
            yield common.batch_of(doc_id=batch.column("doc_id"), norm=_normalised(batch.column("text")))

    some = texts.sample(fraction=min(1.0, sampled * parts / max(1, rows)), seed=17).mapInArrow(normalise, "doc_id long, norm binary")
    found = some.repartition(1).sortWithinPartitions("norm", "doc_id").mapInArrow(_separators(sampled), "norm binary, doc_id long").collect()
    return sorted({(bytes(r["norm"]), r["doc_id"]) for r in found})


def dealt(texts: DataFrame, keep: str, sampled: int) -> DataFrame:
    """doc_id, k and norm in runs of equal texts, the row that stays at the end of its run."""
    points = splitters(texts, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), sampled)
    shared = texts.sparkSession.sparkContext.broadcast(points)

    def run(batches):
        for batch in common.slices(batches, limit=1 << 23):
            norm = _normalised(batch.column("text"))
            part = [bisect.bisect_right(shared.value, key) for key in zip(norm.to_pylist(), batch.column("doc_id").to_pylist(), strict=True)]
            yield common.batch_of(doc_id=batch.column("doc_id"), k=batch.column("k"), norm=norm, part=pa.array(part, pa.int32()))

    placed = texts.mapInArrow(run, "doc_id long, k long, norm binary, part int").repartitionById(len(points) + 1, "part")
    return placed.sortWithinPartitions("norm", "doc_id" if keep == "largest" else F.desc("doc_id"), "k").drop("part")


class _Ended:
    """Runs that have ended, until enough rows are together for a batch; of a run only ids, digest and, at an edge, text are kept."""

    def __init__(self, part: int):
        self.part, self.ids, self.sizes, self.digests, self.numbers, self.edges, self.texts, self.rows = part, [], [], [], [], [], [], 0

    def add(self, number: int, ids: list[np.ndarray], digest: str, text: bytes | None) -> None:
        """ids: pieces of two columns, doc_id and k."""
        self.ids += ids
        self.sizes.append(n := sum(map(len, ids)))
        self.digests.append(digest)
        self.numbers.append(number)
        self.edges.append(text is not None)
        self.texts.append(text)
        self.rows += n

    def batch(self) -> pa.RecordBatch:
        (ids, ks), sizes = np.concatenate(self.ids).T, np.array(self.sizes)
        starts = np.cumsum(sizes) - sizes
        ends = starts + sizes - 1
        spread = lambda values: np.repeat(np.asarray(values), sizes)
        run_of = pa.array(np.repeat(np.arange(len(sizes)), sizes))
        last, norm = np.zeros(len(ids), bool), [None] * len(ids)
        last[ends] = True
        twins = np.add.reduceat(((ids == spread(ids[ends])) & (ks == spread(ks[ends]))).astype(np.int64), starts)
        for at, text in zip(starts, self.texts, strict=True):
            norm[at] = text
        out = common.batch_of(
            doc_id=pa.array(ids), k=pa.array(ks), sha=pa.array(self.digests, pa.string()).take(run_of), part=pa.array(np.full(len(ids), self.part, np.int32)), run=pa.array(spread(self.numbers), pa.int64()), edge=pa.array(spread(self.edges)),
            n=pa.array(spread(sizes), pa.int64()), lo=pa.array(spread(np.minimum.reduceat(ids, starts))), hi=pa.array(spread(np.maximum.reduceat(ids, starts))), last=pa.array(last), twins=pa.array(spread(twins)), norm=pa.array(norm, pa.binary()),
        )
        self.__init__(self.part)
        return out


def _runs(batches):
    """Rows of each run of equal neighbours, sent on when the run has ended."""
    ended, run, text, held, digest = _Ended(TaskContext.get().partitionId()), -1, None, [], ""
    for batch in batches:
        texts = batch.column("norm")
        ids = np.column_stack([batch.column(c).to_numpy() for c in ("doc_id", "k")])
        if not len(ids):
            continue
        new = np.ones(len(ids), bool)
        new[1:] = pc.not_equal(texts[1:], texts[:-1]).to_numpy(zero_copy_only=False)
        new[0] = run < 0 or texts[0].as_py() != text
        at = 0
        for start in np.flatnonzero(new).tolist():
            if start > at:
                held.append(ids[at:start])
            if run >= 0:
                ended.add(run, held, digest, text if run == 0 else None)
                if ended.rows > 5000:
                    yield ended.batch()
            text, run, held, at = texts[start].as_py(), run + 1, [], start
            digest = hashlib.sha256(text).hexdigest()
        held.append(ids[at:])
    if run >= 0:
        ended.add(run, held, digest, text)
        yield ended.batch()


def _grouped(docs: DataFrame, keep: str, sampled: int = SAMPLED) -> DataFrame:
    """What ``groups`` gives, with k, a hash of the text as it is, and twins: how many rows equal the one that stays in doc_id and k."""
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep: smallest or largest, not {keep!r}")
    texts = common.texts_of(docs, _hash(docs).alias("k"))
    runs = common.saved(dealt(texts, keep, sampled).mapInArrow(_runs, _RUNS), "exact-runs")
    edges = runs.where("edge and norm is not null").select("part", "run", "norm", "n", "lo", "hi")
    merged = edges.groupBy("norm").agg(F.sum("n").alias("all_n"), F.min("lo").alias("all_lo"), F.max("hi").alias("all_hi"))
    of_run = edges.join(merged, "norm").select("part", "run", "all_n", "all_lo", "all_hi")
    wanted = "hi" if keep == "largest" else "lo"
    plain = runs.where("not edge").select("doc_id", "k", "sha", F.col(wanted).alias("keep_id"), F.col("n").alias("group_size"), "last", "twins")
    cut = runs.where("edge").join(of_run, ["part", "run"]).select("doc_id", "k", "sha", F.col(f"all_{wanted}").alias("keep_id"), F.col("all_n").alias("group_size"), "last", "twins")
    return plain.unionByName(cut).select("doc_id", "k", "keep_id", "group_size", ((F.col("doc_id") == F.col("keep_id")) & F.col("last")).alias("kept"), F.col("sha").alias("text_sha256"), "twins")


def _hash(docs: DataFrame):
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))


def groups(docs: DataFrame, keep: str = "smallest", sampled: int = SAMPLED) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256. ``keep``: "smallest" or "largest" doc_id of a group."""
    return common.ids_back(_grouped(docs, keep, sampled).drop("k", "twins"), "doc_id", "keep_id")


def dedup(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The documents whose row stays, with all their columns. Of rows that repeat doc_id and text, one stays."""
    stay = common.saved(_grouped(docs, keep).where("kept").select("doc_id", "k", "twins"), "kept")
    return common.one_of_each(docs, [common.id_of(docs), _hash(docs)], stay)


def op3_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(common.read(spark, sf_dir, "documents"), keep="largest")


ORACLE = """
with t as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as norm from documents),
g as (select norm, max(doc_id) as keep_id, count(*) as group_size from t group by norm)
select t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id and row_number() over (partition by t.norm, t.doc_id) = 1 as kept, sha256(t.norm) as text_sha256
from t join g on t.norm = g.norm
"""
