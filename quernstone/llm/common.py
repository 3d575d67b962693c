"""What the corpus operators share: batches of texts as flat arrays, hashes of words and of word windows, and tables cut from their lineage.

Texts come in as Arrow batches. A null text counts as an empty one everywhere, and a null doc_id as the smallest long, which
stands for it until ``ids_back`` turns it into null again. Words are maximal runs of bytes
other than 0x20 and 0x09-0x0D, which in UTF-8 are the same words as in code points. A word is known by a 64-bit
hash (a polynomial over a table of random values, then mixed); two different words of one corpus share a hash with
a probability of about n^2 / 2^65.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 21
_U = np.uint64
_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_A, _B = _U(0x9FB21C651E98DF25), _U(0xD6E8FEB86659FD93)
_LONG = 4096
with np.errstate(over="ignore"):
    _POWERS = np.cumprod(np.full(_LONG, _A, np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over the whole word."""
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(29))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(32))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and the offsets of its texts in them, nulls as empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds at most ``limit`` bytes of text, or one text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = flat(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(offs, offs[at] + limit, "right")) - 1)
            yield batch.slice(at, end - at)
            at = end


class Words:
    """The words of some texts: hashes, byte spans in ``buf``, and ``first``, where each text's words start."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        buf, offs = flat(texts)
        self.buf, n = buf, len(buf)
        word = ~_SPACE[buf]
        begins, ends = np.ones(n, bool), np.ones(n, bool)
        if n:
            np.logical_not(word[:-1], out=begins[1:])
            np.logical_not(word[1:], out=ends[:-1])
            begins[offs[:-1][offs[:-1] < n]] = True
            ends[offs[1:][offs[1:] > 0] - 1] = True
        self.starts, self.ends = np.flatnonzero(word & begins), np.flatnonzero(word & ends) + 1
        self.first = np.searchsorted(self.starts, offs)
        self.hashes = self._hash(buf[word], self.ends - self.starts, _BYTE_LOWER if lower else _BYTE)

    @staticmethod
    def _hash(kept: np.ndarray, lengths: np.ndarray, table: np.ndarray) -> np.ndarray:
        if not len(lengths):
            return np.zeros(0, np.uint64)
        at = np.cumsum(lengths) - lengths
        place = np.arange(len(kept)) - np.repeat(at, lengths)
        values = table[kept] * _POWERS[place % _LONG]
        if lengths.max() > _LONG:
            far = np.flatnonzero(place >= _LONG)
            values[far] *= mix((place[far] // _LONG).astype(np.uint64) + _B)
        return mix(np.add.reduceat(values, at) + lengths.astype(np.uint64) * _B)

    def __len__(self) -> int:
        return len(self.hashes)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k consecutive values (not mixed with text borders in mind: see ``inside``)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, have, power, width, step = np.zeros(len(hashes), np.uint64), 0, hashes, 1, int(_B)
    while True:
        if k & width:
            tail = len(hashes) - have
            out[:tail] = out[:tail] * _U(step) + power[have : have + tail] if have else power[:tail]
            have += width
        if have == k:
            return mix(out[:n])
        shorter = len(power) - width
        power = np.concatenate([power[:shorter] * _U(step) + power[width:], power[shorter:]])
        step, width = step * step % (1 << 64), width * 2


def folded(hashes: np.ndarray) -> np.uint64:
    """One hash of a sequence of hashes."""
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(len(hashes), 0xC2B2AE3D27D4EB4F, np.uint64))
        return np.uint64((hashes * powers).sum(dtype=np.uint64) + _U(len(hashes)))


def inside(first: np.ndarray, k: int) -> np.ndarray:
    """Which runs of k consecutive words lie in one text."""
    total = int(first[-1])
    if total < k:
        return np.zeros(0, bool)
    last = np.repeat(first[1:], np.diff(first))
    return np.arange(total - k + 1) + k <= last[: total - k + 1]


def owners(first: np.ndarray) -> np.ndarray:
    """The text number of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only where the setting is missing (tests)."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file://" + tempfile.mkdtemp(prefix="quernstone-")
        atexit.register(shutil.rmtree, base[7:], True)
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def _removed(context, path: str) -> None:
    """At the end of the driver, unless Spark has ended before it."""
    if context._jsc is not None and not context._jsc.sc().isStopped():
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def saved(df: DataFrame, name: str) -> DataFrame:
    """df as a table written to the shared folder and read again: lost executors cost a reread, not a recomputation."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_removed, spark.sparkContext, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


NULL_ID = -(1 << 63)


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (string or null), with the further columns named; all others are pruned at the scan."""
    return docs.select(id_of(docs).alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def id_of(docs: DataFrame):
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(NULL_ID))


def ids_back(df: DataFrame, *names: str) -> DataFrame:
    """df with null for the number that stands for it."""
    return df.withColumns({n: F.nullif(F.col(n), F.lit(NULL_ID)) for n in names or ("doc_id",)})


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for columns that df doesn't have, in whatever case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def one_of_each(docs: DataFrame, keys: list, stay: DataFrame) -> DataFrame:
    """One row of docs, with all its columns, for each row of ``stay``: values of the keys, and ``twins``, how many rows of docs have them.

    Only rows with twins, if there are any, are aggregated; all others meet ``stay`` in a semi-join.
    """
    names = fresh(docs, *(f"key{i}" for i in range(len(keys))), "row")
    keyed, told = docs.withColumns(dict(zip(names, keys, strict=False))), stay.toDF(*names[:-1], "twins")
    out = keyed.join(told.where("twins = 1"), names[:-1], "left_semi").select(*[keyed[f"`{c}`"] for c in docs.columns])
    many = told.where("twins > 1")
    if many.isEmpty():
        return out
    rows = keyed.join(many, names[:-1], "left_semi").select(*names[:-1], F.struct(*[keyed[f"`{c}`"] for c in docs.columns]).alias(names[-1]))
    one = rows.groupBy(*names[:-1]).agg(F.min_by(names[-1], F.struct(F.coalesce(F.col(f"{names[-1]}.text"), F.lit("")), F.hash(F.to_json(names[-1])))).alias(names[-1]))
    return out.unionByName(one.select(f"{names[-1]}.*"))


def batch_of(**columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))


def worker_path(name: str) -> str:
    """The place of a public vocabulary file on this machine."""
    import public_tokenizers

    return name if os.path.isabs(name) else public_tokenizers.path(name)
