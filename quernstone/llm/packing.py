"""Packing by Karmarkar-Karp multiway differencing.

Every document becomes its ids and the end id. Whole runs of ``capacity`` ids fill sequences of their own. What is left of
a document is cut into pieces of at most ``PIECE`` ids, dealt at random (by a hash that each row salts) to groups of about ``WINDOWS`` sequences,
and each group is divided into windows: partial partitions are merged largest spread first, the heavy windows of one with
the light windows of the other, until one partition with near-equal windows is left. The window count starts at the least
that could hold the group and rises whenever a window exceeds the capacity.

A group's size is bounded whatever the input, so no source, copy, repeated row or long document gathers in one task. The library
works word by word, so ids of words met before are looked up: by a hash, and the characters are compared, so that no other word's
ids are taken. Texts whose words can't be told apart here go to the library whole. Null texts are
empty and consist of the end id. A text of any length is encoded whole. Rows with equal doc_id are packed each for itself. Further columns are ignored. An
empty table gives no pieces.
"""

from __future__ import annotations

import functools
import heapq
import re
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

VOCABULARY, END = "word_bpe_49k.json", 2
CAPACITY, PIECE, WINDOWS = 4096, 512, 128
CACHE = 700_000

_LIMIT = 0x2028
_LETTERS, _NUMBERS = "a-zA-ZªµºÀ-ÖØ-öø-įı-ɏ", "0-9²³¹¼-¾"
#: Texts of these characters alone are split here; others go to the library whole.
_PLAIN = rf"[\t\n\r\x20-\x7e¡-¬®-įı-ɏ‐-‧]"
_CONTRACTED = re.compile("'(?:[stmd]|re|ve|ll)", re.IGNORECASE)


def _marked(pattern: str) -> np.ndarray:
    return np.array([re.fullmatch(pattern, chr(c)) is not None for c in range(_LIMIT)] + [False])


@functools.lru_cache(maxsize=1)
def _characters() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By code point: 0 for space, 1 letter, 2 number, 3 other, 4 not plain; the lower-case form; a random value of that; powers."""
    kind = np.where(_marked(r"\s"), 0, np.where(_marked(f"[{_LETTERS}]"), 1, np.where(_marked(f"[{_NUMBERS}]"), 2, 3)))
    kind[~_marked(_PLAIN)] = 4
    values = np.random.default_rng(20240608).integers(1, 1 << 63, _LIMIT + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    lower = np.arange(_LIMIT + 1, dtype=np.uint16)
    for c in np.flatnonzero(kind == 1):
        lower[c] = low if (low := ord(chr(c).lower())) < _LIMIT else c
    values = values[lower]
    with np.errstate(over="ignore"):
        powers = np.cumprod(np.full(256, 0x9FB21C651E98DF25, np.uint64))
    return kind.astype(np.uint8), lower, values, powers


@functools.lru_cache(maxsize=1)
def _byte_letters() -> dict[int, int]:
    """The letters by which byte-level tokenizers write bytes: printable ones for themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in own)}


def _spread(begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of runs one after another, each from its begin on."""
    ends = np.cumsum(sizes)
    return np.repeat(begins - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


class Vocabulary:
    """The tokenizer, and words met before with their ids in an open hash table; emptied when it holds too many."""

    SLOTS = 1 << 21

    def __init__(self, vocabulary: str = VOCABULARY):
        from tokenizers import Tokenizer

        self.coder = Tokenizer.from_file(common.worker_path(vocabulary))
        self._empty()

    def _empty(self) -> None:
        self.keys, self.at, self.size = np.zeros(self.SLOTS, np.uint64), np.zeros(self.SLOTS, np.int64), np.zeros(self.SLOTS, np.int32)
        self.ids, self.used, self.known = np.zeros(1 << 20, np.uint32), 0, 0
        self.letters, self.letter_at, self.length, self.written = np.zeros(1 << 20, np.uint16), np.zeros(self.SLOTS, np.int64), np.zeros(self.SLOTS, np.int32), 0

    def library(self, text: str) -> np.ndarray:
        return np.array(self.coder.encode(text, add_special_tokens=False).ids, np.uint32)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash, or of the free place for it."""
        slot = (hashes >> np.uint64(43)).astype(np.int64)
        open_ = np.flatnonzero((self.keys[slot] != hashes) & (self.keys[slot] != 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) % self.SLOTS
            key = self.keys[slot[open_]]
            open_ = open_[(key != hashes[open_]) & (key != 0)]
        return slot

    def add(self, words: list[str], keys: np.ndarray) -> None:
        """New words, each once, and their hashes."""
        tokenize = self.coder.model.tokenize
        ids = [[t.id for t in tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(_byte_letters()))] for w in map(str.lower, words)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        ends = self.used + np.cumsum(sizes)
        while ends[-1] > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[self.used : ends[-1]] = [i for x in ids for i in x]
        points = np.minimum(np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32), _LIMIT)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        stops = self.written + np.cumsum(lengths)
        while stops[-1] > len(self.letters):
            self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
        self.letters[self.written : stops[-1]] = _characters()[1][points]
        left = np.arange(len(keys))
        while len(left):
            slot, one = np.unique(self.slots(keys[left]), return_index=True)
            now = left[one]
            self.keys[slot], self.at[slot], self.size[slot], self.letter_at[slot], self.length[slot] = keys[now], (ends - sizes)[now], sizes[now], (stops - lengths)[now], lengths[now]
            left = np.delete(left, one)
        self.used, self.written, self.known = int(ends[-1]), int(stops[-1]), self.known + len(keys)

    def of_words(self, words, hashes: np.ndarray, lengths: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of the words one after another, how many each has, and which words aren't those known by their hashes.

        ``words(i)`` gives the i-th word, letters the lower-case characters of all.
        """
        if self.known > CACHE:
            self._empty()
        slot = self.slots(hashes)
        missing = np.flatnonzero(self.keys[slot] == 0)
        if len(missing):
            keys, where = np.unique(hashes[missing], return_index=True)
            self.add([words(int(i)) for i in missing[where]], keys)
            slot = self.slots(hashes)
        sizes = self.size[slot].astype(np.int64)
        other = self.length[slot] != lengths
        if len(slot):
            same = self.letters[np.minimum(_spread(self.letter_at[slot], lengths), len(self.letters) - 1)] == letters
            if not same.all():
                other |= ~np.logical_and.reduceat(same, np.cumsum(lengths) - lengths)
        return self.ids[_spread(self.at[slot], sizes)], sizes, np.flatnonzero(other)

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The library's ids of each whole text. The tokenizer works word by word, so known words are looked up."""
        kind, lower, values, powers = _characters()
        whole = "".join(texts)
        offs = np.cumsum([0, *map(len, texts)])
        points = np.minimum(np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32), _LIMIT).astype(np.int64)
        c = kind[points]
        odd = {int(i) for i in np.searchsorted(offs, np.flatnonzero(c == 4), "right") - 1}
        odd |= {i for i, t in enumerate(texts) if "<|" in t or ("'" in t and _CONTRACTED.search(t))}
        begin = np.ones(len(c) + 1, bool)
        begin[1:-1] = (c[1:] != c[:-1]) | (c[1:] == 2)
        begin[offs] = True
        starts = np.flatnonzero(begin[:-1] & (c != 0))
        ends = np.flatnonzero(begin[1:] & (c != 0)) + 1
        lengths = ends - starts
        kept = points[c != 0]
        at = np.cumsum(lengths) - lengths
        place = np.arange(len(kept)) - np.repeat(at, lengths)
        terms = values[kept] * powers[place % len(powers)]
        if lengths.max(initial=0) > len(powers):
            far = np.flatnonzero(place >= len(powers))
            terms[far] *= common.mix((place[far] // len(powers)).astype(np.uint64) + np.uint64(77))
        hashes = (common.mix(np.add.reduceat(terms, at) + lengths.astype(np.uint64)) if len(at) else np.zeros(0, np.uint64)) | np.uint64(1)
        first = np.searchsorted(starts, offs)
        ids, sizes, other = self.of_words(lambda i: whole[starts[i] : ends[i]], hashes, lengths, lower[kept])
        odd |= {int(i) for i in np.searchsorted(offs, starts[other], "right") - 1}
        done = np.concatenate([[0], np.cumsum(sizes)])
        return [self.library(t) if i in odd else ids[done[first[i]] : done[first[i + 1]]] for i, t in enumerate(texts)]


@functools.lru_cache(maxsize=1)
def tokenizer(vocabulary: str = VOCABULARY) -> Vocabulary:
    return Vocabulary(vocabulary)


def cuts(n: int, capacity: int = CAPACITY, piece: int = PIECE) -> list[int]:
    """Where a document of n ids is cut: whole sequences, then near-equal pieces; from 0 to n."""
    whole = n - n % capacity
    parts = -(-(n - whole) // piece)
    return [*range(0, whole, capacity), *(whole + (n - whole) * i // parts for i in range(parts)), n]


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens of every piece, in one pass over the scan."""

    def run(batches):
        for batch in common.slices(batches):
            ids, rows = batch.column("doc_id").to_pylist(), []
            for doc, found in zip(ids, tokenizer(vocabulary).encode_all([t or "" for t in batch.column("text").to_pylist()]), strict=True):
                tokens = np.append(found, np.uint32(END)).astype("<u4")
                at = cuts(len(tokens), capacity)
                rows += [(doc, a, b - a, zlib.crc32(tokens[a:b]), len(tokens)) for a, b in zip(at, at[1:], strict=False)]
            yield common.batch_of(**{n: pa.array(c, pa.int64()) for n, c in zip(("doc_id", "start", "length", "ids_crc32", "doc_tokens"), zip(*rows, strict=True), strict=True)})

    return common.texts_of(docs).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """The window, 0 to k - 1, of each size, by Karmarkar-Karp differencing of k-tuples.

    A tuple holds k windows: sums, largest first, and for each the node of a binary tree whose leaves are sizes.
    """
    if k == 1 or not len(sizes):
        return np.zeros(len(sizes), np.int64)
    n = len(sizes)
    left, right = np.full(2 * n, -1), np.full(2 * n, -1)
    nodes, heap = n, []
    for i, s in enumerate(sizes):
        sums, tops = np.zeros(k, np.int64), np.full(k, -1)
        sums[0], tops[0] = s, i
        heap.append((-int(s), i, sums, tops))
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, order, a, at), (_, _, b, bt) = heapq.heappop(heap), heapq.heappop(heap)
        sums, bt = a + b[::-1], bt[::-1]
        tops = np.where(at < 0, bt, at)
        both = np.flatnonzero((at >= 0) & (bt >= 0))
        if len(both):
            new = np.arange(nodes, nodes + len(both))
            left[new], right[new], tops[both] = at[both], bt[both], new
            nodes += len(both)
        by = np.argsort(-sums, kind="stable")
        sums = sums[by]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), order, sums, tops[by]))
    window = np.zeros(n, np.int64)
    for w, top in enumerate(heap[0][3]):
        stack = [top] if top >= 0 else []
        while stack:
            node = stack.pop()
            if node < n:
                window[node] = w
            else:
                stack += [left[node], right[node]]
    return window


def windows(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The window of each size; no window exceeds the capacity."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = differencing(sizes, k)
        if np.bincount(window, sizes, k).max(initial=0) <= capacity:
            return window
        k += 1


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """The pieces with sequence_id and offset. Ids and texts stay behind: only rows of five numbers are shuffled."""
    found = common.saved(pieces(docs, capacity, vocabulary), "pieces")
    rest = found.where(F.col("length") < capacity)
    total = rest.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(total / (WINDOWS * capacity)))

    def packed(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "start", "ids_crc32", "doc_tokens"], kind="stable")
        window = windows(frame["length"].to_numpy(), capacity)
        frame = frame.assign(sequence_id=(frame["g"].to_numpy() << 24) + window).sort_values("sequence_id", kind="stable")
        frame["offset"] = frame.groupby("sequence_id")["length"].cumsum() - frame["length"]
        return frame.drop(columns="g")

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    grouped = rest.withColumn("g", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups))).groupBy("g").applyInPandas(packed, schema)
    whole = found.where(F.col("length") == capacity).select(*columns, (F.lit(groups << 24) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return common.ids_back(grouped.unionByName(whole))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.read(spark, sf_dir, "documents"))
