"""Substring dedup: suffix automata of reference shards, documents streamed through them for matching statistics.

A window of ``window`` consecutive words is removed from a document when its word sequence also starts in a document with a
smaller doc_id; a word goes when a removed window covers it. Windows are judged on the input, so every document is both
text and, for larger ids, reference.

Broadcasting automata of all shards to all documents would cost documents times shards. Shards are therefore cut so that
a document needs few of them. Of the hashes of half-window runs of words, the least in each window is an anchor; equal windows
have equal anchors, so a window can only recur where one of its anchors does. Each anchor that occurs in two documents names a shard: the stretches
of words around its occurrences. A shard's stretches stream in order of doc_id through the automaton of those
before them; where the longest match that ends at a word has the window's length or more, the maximal span of such windows is removed,
after which the stretch joins the reference. The automata compare words, not hashes.

Texts with the same words, told by a 128-bit digest of them, are settled before: all but those with the smallest doc_id go whole (if they have a window at all), and
only that document's anchors are counted. A shard with more than ``HOT`` stretches isn't put in one task and has no automaton: its windows are known by 128-bit digests
of their words, the smallest document of each is found by sums that are taken before the shuffle too, and the shard's stretches are dealt over several tasks,
each of which gets the windows that recur once. There are as many tasks as keep these copies below ``COPIES`` rows for each stretch.

Null texts have no words, shorter texts than a window lose none, texts of any length are read whole. A null doc_id counts as the smallest. Rows with equal doc_id don't remove each
other's words. Further columns, whatever their names, are ignored. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW, HOT, COPIES = 50, 1000, 32
_MAX = np.uint64((1 << 64) - 1)


class Automaton:
    """A suffix automaton that grows by one string of words after another; no match crosses from one to the next."""

    def __init__(self):
        self.following, self.link, self.length, self.last = [{}], [-1], [0], 0

    def _state(self, length: int, following: dict, link: int) -> int:
        self.length.append(length)
        self.following.append(following)
        self.link.append(link)
        return len(self.length) - 1

    def add(self, words: list) -> None:
        for word in [*words, object()]:  # the object stands between two strings and equals nothing
            self._extend(word)

    def _extend(self, word) -> None:
        following, link, length = self.following, self.link, self.length
        new, p = self._state(length[self.last] + 1, {}, 0), self.last
        while p >= 0 and word not in following[p]:
            following[p][word] = new
            p = link[p]
        if p >= 0:
            q = following[p][word]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = self._state(length[p] + 1, dict(following[q]), link[q])
                while p >= 0 and following[p].get(word) == q:
                    following[p][word] = copy
                    p = link[p]
                link[q] = link[new] = copy
        self.last = new

    def matches(self, words: list) -> list[int]:
        """For each word, the length of the longest run of words that ends there and occurs in a string added before."""
        following, link, length, out, state, n = self.following, self.link, self.length, [], 0, 0
        for word in words:
            while state and word not in following[state]:
                state = link[state]
                n = length[state]
            state = following[state].get(word, 0)
            n = n + 1 if state else 0
            out.append(n)
        return out


def spans(matched: list[int], window: int) -> list[tuple[int, int]]:
    """Maximal runs of words covered by a match of at least the window's length; the end is exclusive."""
    out: list[tuple[int, int]] = []
    for end, n in enumerate(matched, 1):
        if n >= window:
            if out and end - window <= out[-1][1]:
                out[-1] = (out[-1][0], end)
            else:
                out.append((end - window, end))
    return out


def _sliding(values: np.ndarray, width: int, least) -> np.ndarray:
    """The least (np.minimum) or largest (np.maximum) of each ``width`` neighbours."""
    have, out = 1, values
    while have * 2 <= width:
        out = least(out[:-have], out[have:])
        have *= 2
    return least(out[: len(values) - width + 1], out[width - have :]) if width > have else out


def anchors(words: common.Words, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Positions (words of all texts counted through) and hashes of the anchors."""
    k = window // 2
    width, runs = window - k + 1, common.windows(words.hashes, k)
    if len(runs) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    least = np.where(common.inside(words.first, window), _sliding(runs, width, np.minimum), 0)
    pad = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(_sliding(np.concatenate([pad, least, pad]), width, np.maximum) == runs)
    at = at[runs[at] != 0]
    return at, runs[at]


def _bytes(words: common.Words, a: int, b: int) -> bytes:
    """The bytes from word a up to word b, as they stand in the text."""
    return words.buf[words.starts[a] : words.ends[b - 1]].tobytes() if b > a else b""


def _digests(data: list[bytes]) -> np.ndarray:
    """128 bits of each, as two numbers."""
    return np.frombuffer(b"".join(hashlib.blake2b(d, digest_size=16).digest() for d in data), "<i8").reshape(-1, 2)


def _profiles(window: int):
    def run(batches):
        for batch in common.slices(batches):
            words = common.Words(batch.column("text"))
            at, hashes = anchors(words, window)
            cut = np.searchsorted(at, words.first)
            h1, h2 = _digests([b" ".join(_bytes(words, int(words.first[i]), int(words.first[i + 1])).split()) for i in range(batch.num_rows)]).T
            place = (at - np.repeat(words.first[:-1], np.diff(cut))).astype(np.int32)
            lists = lambda v, kind: pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(v, kind))
            yield common.batch_of(doc_id=batch.column("doc_id"), k=batch.column("k"), n=pa.array(words.counts, pa.int64()), h1=pa.array(h1, pa.int64()), h2=pa.array(h2, pa.int64()), anchors=lists(hashes.view(np.int64), pa.int64()), places=lists(place, pa.int32()))

    return run


def _stretches(window: int):
    """(anchor, doc_id, k, start, words): the words of all windows that hold the anchor."""
    k = window // 2

    def run(batches):
        for batch in common.slices(batches, limit=1 << 20):
            words, out = common.Words(batch.column("text")), []
            for i, (doc, key, hits) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("k").to_pylist(), batch.column("hits").to_pylist(), strict=True)):
                first, last = int(words.first[i]), int(words.first[i + 1])
                for hit in hits:
                    a, b = max(first, first + hit["place"] - (window - k)), min(last, first + hit["place"] + window)
                    out.append((hit["anchor"], doc, key, a - first, _bytes(words, a, b)))
                if len(out) > 20_000 or (out and i == batch.num_rows - 1):
                    columns = list(zip(*out, strict=True))
                    yield common.batch_of(anchor=pa.array(columns[0], pa.int64()), doc_id=pa.array(columns[1], pa.int64()), k=pa.array(columns[2], pa.int64()), start=pa.array(columns[3], pa.int32()), words=pa.array(columns[4], pa.binary()))
                    out = []

    return run


def _streamed(window: int):
    """Rows sorted by anchor and doc_id: each shard's stretches against the automaton of those with smaller ids."""

    def run(batches):
        anchor, doc, machine, waiting, out = None, None, None, [], []
        for batch in batches:
            for a, d, k, start, data in zip(*(batch.column(c).to_pylist() for c in ("anchor", "doc_id", "k", "start", "words")), strict=True):
                if a != anchor:
                    anchor, doc, machine, waiting = a, d, None, []
                elif d != doc:
                    for words in waiting:
                        machine = machine or Automaton()
                        machine.add(words)
                    doc, waiting = d, []
                words = data.split()
                matched = machine.matches(words) if machine else []
                out += [(d, k, start + b, start + e) for b, e in spans(matched, window)]
                if not matched or matched[-1] < len(words):
                    waiting.append(words)
            if out:
                columns = list(zip(*out, strict=True))
                yield common.batch_of(doc_id=pa.array(columns[0], pa.int64()), k=pa.array(columns[1], pa.int64()), begin=pa.array(columns[2], pa.int32()), end=pa.array(columns[3], pa.int32()))
                out = []

    return run


def _windows_of(batch: pa.RecordBatch, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Digests of the windows of some stretches (two numbers each), the row of each, and where in the stretch it begins. Equal stretches are read once."""
    known: dict[bytes, np.ndarray] = {}
    found = []
    for data in batch.column("words").to_pylist():
        if data not in known:
            words = data.split()
            ends = np.cumsum([len(w) + 1 for w in words]).tolist()
            joined = b" ".join(words)
            known[data] = _digests([joined[(ends[i - 1] if i else 0) : ends[i + window - 1] - 1] for i in range(len(words) - window + 1)])
        found.append(known[data])
    sizes = np.array([len(f) for f in found], np.int64)
    row = np.repeat(np.arange(len(found)), sizes)
    return np.concatenate(found), row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _first_holders(window: int):
    """(anchor, w1, w2, lo, hi): the smallest and the largest document of each window of a hot shard, over a task's stretches."""
    names = ("anchor", "w1", "w2", "lo", "hi")

    def merged(parts):
        a, w1, w2, lo, hi = (np.concatenate(x) for x in zip(*parts, strict=True))
        by = np.lexsort((w2, w1, a))
        a, w1, w2, lo, hi = a[by], w1[by], w2[by], lo[by], hi[by]
        cut = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])]))
        return a[cut], w1[cut], w2[cut], np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut)

    def run(batches):
        parts, held = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            w, row, _ = _windows_of(batch, window)
            doc = batch.column("doc_id").to_numpy()[row]
            parts.append((batch.column("anchor").to_numpy()[row], w[:, 0], w[:, 1], doc, doc))
            held += len(w)
            if held > 1_000_000:
                parts = [merged(parts)]
                held = len(parts[0][0])
                if held > 500_000:
                    yield common.batch_of(**dict(zip(names, map(pa.array, parts[0]), strict=True)))
                    parts, held = [], 0
        if held:
            yield common.batch_of(**dict(zip(names, map(pa.array, merged(parts)), strict=True)))

    return run


def _against_holders(window: int):
    """Sorted by anchor, part and kind: first the windows that recur around an anchor, with their smallest document, then stretches; the spans that a smaller document holds too."""

    def run(batches):
        place, first = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            stretch = batch.filter(pa.array(batch.column("kind").to_numpy() == 1))
            hashes, rows, begins = _windows_of(stretch, window) if stretch.num_rows else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
            cut, out, i = np.searchsorted(rows, np.arange(stretch.num_rows + 1)), [], 0
            keys = list(map(tuple, hashes.tolist()))
            columns = [batch.column(c).to_pylist() for c in ("anchor", "part", "kind", "doc_id", "k", "start", "w1", "w2")]
            for a, part, kind, d, k, start, w1, w2 in zip(*columns, strict=True):
                if (a, part) != place:
                    place, first = (a, part), {}
                if kind == 0:
                    first[w1, w2] = d
                    continue
                gone = [int(begins[j]) for j in range(cut[i], cut[i + 1]) if first.get(keys[j], d) < d]
                i += 1
                if gone:
                    ends = np.zeros(gone[-1] + window, np.int64)
                    ends[np.array(gone) + window - 1] = window
                    out += [(d, k, start + b, start + e) for b, e in spans(ends.tolist(), window)]
            if out:
                columns = list(zip(*out, strict=True))
                yield common.batch_of(doc_id=pa.array(columns[0], pa.int64()), k=pa.array(columns[1], pa.int64()), begin=pa.array(columns[2], pa.int32()), end=pa.array(columns[3], pa.int32()))

    return run


def repeated(docs: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """doc_id, k (a hash of the text), whole (all words go) and spans (begin and end of removed runs of words), for documents that lose words."""
    texts = common.texts_of(docs, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("k"))
    profiles = common.saved(texts.mapInArrow(_profiles(window), "doc_id long, k long, n long, h1 long, h2 long, anchors array<long>, places array<int>"), "profiles")
    firsts = common.saved(profiles.where(F.col("n") >= window).groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")), "firsts")
    told = profiles.where(F.col("n") >= window).join(firsts, ["h1", "h2"])
    copies = told.where("doc_id > rep").select("doc_id", "k").distinct()
    marks = told.where("doc_id = rep").select("doc_id", "k", F.explode(F.arrays_zip("anchors", "places")).alias("m")).select("doc_id", "k", F.col("m.anchors").alias("anchor"), F.col("m.places").alias("place"))
    shared = common.saved(marks.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("n")).where("lo < hi").select("anchor", "n"), "shared")
    hits = common.saved(marks.join(shared, "anchor"), "hits")

    def stretches(of: DataFrame) -> DataFrame:
        by_doc = of.groupBy("doc_id", "k").agg(F.collect_list(F.struct("anchor", "place")).alias("hits"))
        return texts.join(by_doc, ["doc_id", "k"]).mapInArrow(_stretches(window), "anchor long, doc_id long, k long, start int, words binary")

    span = "doc_id long, k long, begin int, end int"
    found = stretches(hits.where(F.col("n") <= hot)).repartition("anchor").sortWithinPartitions("anchor", "doc_id").mapInArrow(_streamed(window), span)
    if not shared.where(F.col("n") > hot).isEmpty():
        heated = common.saved(stretches(hits.where(F.col("n") > hot)), "heated")
        held = heated.mapInArrow(_first_holders(window), "anchor long, w1 long, w2 long, lo long, hi long").groupBy("anchor", "w1", "w2").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo < hi")
        told = common.saved(held.select("anchor", "w1", "w2", "lo"), "told")
        # a shard's stretches in parts, and a copy of its recurring windows for each part
        sizes = told.groupBy("anchor").agg(F.count(F.lit(1)).alias("m")).join(shared, "anchor")
        sizes = common.saved(sizes.select("anchor", F.greatest(F.lit(1), F.least(F.ceil(F.col("n") / hot), F.floor(COPIES * F.col("n") / F.col("m")))).cast("int").alias("parts")), "parts")
        windows = told.join(sizes, "anchor").select("anchor", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("kind"), F.col("lo").alias("doc_id"), F.lit(0).cast("long").alias("k"), F.lit(0).alias("start"), F.lit(b"").alias("words"), "w1", "w2")
        dealt = heated.join(sizes, "anchor").select("anchor", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("kind"), "doc_id", "k", "start", "words", F.lit(0).cast("long").alias("w1"), F.lit(0).cast("long").alias("w2"))
        found = found.unionByName(windows.unionByName(dealt).repartition("anchor", "part").sortWithinPartitions("anchor", "part", "kind").mapInArrow(_against_holders(window), span))
    cut = found.groupBy("doc_id", "k").agg(F.collect_set(F.struct("begin", "end")).alias("spans")).withColumn("whole", F.lit(False))
    return cut.unionByName(copies.withColumn("spans", F.lit(None).cast("array<struct<begin:int,end:int>>")).withColumn("whole", F.lit(True)))


def _kept(batches):
    for batch in common.slices(batches):
        words = common.Words(batch.column("text"))
        for_rows = zip(batch.column("spans").to_pylist(), batch.column("whole").to_pylist(), strict=True)
        counts, removed, texts = words.counts, [], []
        for i, (cut, whole) in enumerate(for_rows):
            first = int(words.first[i])
            keep = np.full(counts[i], not whole)
            for s in cut or ():
                keep[s["begin"] : s["end"]] = False
            removed.append(int(counts[i] - keep.sum()))
            data = words.buf[words.starts[first] if counts[i] else 0 : words.ends[first + counts[i] - 1] if counts[i] else 0].tobytes().split()
            texts.append(b" ".join(w for w, k in zip(data, keep, strict=True) if k) if removed[-1] else b" ".join(data))
        yield common.batch_of(doc_id=batch.column("doc_id"), n_words=pa.array(counts, pa.int64()), n_removed=pa.array(removed, pa.int64()), kept=pa.array(texts, pa.binary()))


def kept_words(docs: DataFrame, window: int = WINDOW, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed and kept (binary), the remaining words joined by one space."""
    texts = common.texts_of(docs, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("k"))
    found = common.saved(repeated(docs, window, hot), "repeated")
    joined = texts.join(found, ["doc_id", "k"], "left").select("doc_id", "text", "spans", F.coalesce("whole", F.lit(False)).alias("whole"))
    return common.ids_back(joined.mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept binary"))


def _digest(batches):
    for batch in batches:
        sha = [hashlib.sha256(k).hexdigest() for k in batch.column("kept").to_pylist()]
        yield common.batch_of(doc_id=batch.column("doc_id"), n_words=batch.column("n_words"), n_removed=batch.column("n_removed"), kept_sha256=pa.array(sha, pa.string()))


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_words(common.read(spark, sf_dir, "documents")).mapInArrow(_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


ORACLE = """
with d as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
starts as (select r, doc_id, w, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50),
windows as (select r, doc_id, i, array_to_string(w[i : i + 49], ' ') as run from starts),
firsts as (select run, min(doc_id) as lo from windows group by run),
gone as (select windows.r, windows.i from windows join firsts on windows.run = firsts.run and windows.doc_id > firsts.lo),
covered as (select distinct r, i + step as at from gone, (select unnest(range(0, 50)) as step)),
words as (select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as at from d),
kept as (select words.r, string_agg(word, ' ' order by words.at) as joined, count(*) as n from words left join covered on words.r = covered.r and words.at = covered.at where covered.r is null group by words.r)
select d.doc_id, len(d.w)::bigint as n_words, len(d.w) - coalesce(kept.n, 0) as n_removed, sha256(coalesce(kept.joined, '')) as kept_sha256
from d left join kept on d.r = kept.r
"""
