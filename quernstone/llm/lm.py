"""LM scoring: a log-bilinear neural model trained in numpy with noise-contrastive estimation.

Words are runs of bytes other than 0x20 and 0x09-0x0D after lower-casing A-Z; each text ends in one end token. Training texts
are those whose crc32(doc_id) mod 10 is not 0.

The ``FREQUENT`` most frequent tokens have vectors of their own; all others are one word to the model, the rest. The ``CONTEXT`` tokens in front of a token
(ends, at a text's start) give the context x, the sum of C_i r_i over their vectors. Token w scores q_w . x + b_w, and the class of w (``GROUP`` neighbours
by frequency) scores u . x + a. A token's probability is that of its class among all classes times its own within the class: two batched matrix products over a few
hundred rows give exact normalisers, so token probabilities sum to one. A word of the rest further costs its smoothed share among the rest.

Scores are learned by noise-contrastive estimation: tokens of the training texts against ``NOISE`` tokens drawn from their unigram
distribution for each minibatch, classes against ``NOISE_CLASSES`` drawn likewise, with steps scaled by row (AdaGrad). Biases start as the logarithms of the exact
counts. All training texts take part: each task trains a replica on the texts it reads, from the same start, and the replicas' rows are averaged, weighted by how often each was
trained. A replica has about ``REPLICA`` tokens, so what replicas send on is a bounded share of the input, and the model's size is bounded.

Counts of all words are exact and stay distributed. Only those of the most frequent words, at most ``FREQUENT``, are broadcast, a bounded table; other
words, none of which is a hot key, meet their counts in a join.

Null and empty texts consist of the end token, texts of any length are read whole. A null doc_id counts as the smallest long. Rows with equal doc_id are scored each for itself, equal texts of equal
score. Further columns, whatever their names, are ignored. An empty table gives an empty table; without training texts every probability is the smoothed one of
nothing seen.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

FREQUENT, GROUP, SMOOTH = 1 << 16, 256, 0.1
DIM, CONTEXT, NOISE, NOISE_CLASSES, BATCH, RATE = 16, 2, 64, 32, 4096, 0.05
REPLICA, SEGMENT, ROWS_AT_ONCE = 1 << 24, 1024, 1024
END_HASH = np.uint64(0x243F6A8885A308D3)
LN10 = float(np.log(10))


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(10)) == 0


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end after each text, and where each text's begin."""
    words = common.Words(texts, lower=True)
    n = words.counts + 1
    first = np.concatenate([[0], np.cumsum(n)])
    out = np.full(first[-1], END_HASH, np.uint64)
    keep = np.ones(len(out), bool)
    keep[first[1:] - 1] = False
    out[keep] = words.hashes
    return out, first


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    one, at = np.unique(np.concatenate(keys), return_inverse=True)
    return one, np.bincount(at, np.concatenate(counts), len(one)).astype(np.int64)


def word_counts(docs: DataFrame) -> DataFrame:
    """w (hash) and c of every token of the training texts; summed in each task before the shuffle."""

    def run(batches):
        keys, counts, held = [], [], 0
        for batch in common.slices(batches):
            one, c = np.unique(_tokens(batch.column("text"))[0], return_counts=True)
            keys.append(one)
            counts.append(c)
            held += len(one)
            if held > 1_500_000:
                one, c = _summed(keys, counts)
                if len(one) > 1_000_000:
                    yield common.batch_of(w=pa.array(one.view(np.int64)), c=pa.array(c))
                    keys, counts, held = [], [], 0
                else:
                    keys, counts, held = [one], [c], len(one)
        if held:
            one, c = _summed(keys, counts)
            yield common.batch_of(w=pa.array(one.view(np.int64)), c=pa.array(c))

    return common.texts_of(docs).where(~held_out(F.col("doc_id"))).mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


class Lookup:
    """Numbers and counts of the frequent words by hash; numbers go by frequency, that of any other word is how many there are."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        by = np.argsort(hashes)
        self.hashes, self.counts, self.numbers = hashes[by], counts[by], by.astype(np.int32)

    def __call__(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each token and its count (0 if it isn't frequent)."""
        n = len(self.hashes)
        if not n:
            return np.zeros(len(tokens), np.int32), np.zeros(len(tokens), np.int64)
        one, back = np.unique(tokens, return_inverse=True)  # few distinct tokens are looked up once
        at = np.minimum(np.searchsorted(self.hashes, one), n - 1)
        known = self.hashes[at] == one
        return np.where(known, self.numbers[at], n)[back].astype(np.int32), np.where(known, self.counts[at], 0)[back]

    @property
    def end(self) -> int:
        return int(self(np.array([END_HASH]))[0][0])


def contexts(numbers: np.ndarray, first: np.ndarray, end: int) -> np.ndarray:
    """The numbers of the CONTEXT tokens in front of each token, the nearest first; in front of a text stand ends."""
    place = np.arange(len(numbers)) - np.repeat(first[:-1], np.diff(first))
    out = np.full((CONTEXT, len(numbers)), end, np.int32)
    for i in range(CONTEXT):
        out[i, i + 1 :] = np.where(place[i + 1 :] > i, numbers[: len(numbers) - i - 1], end)
    return out


class Weights(NamedTuple):
    """r: context vectors of words (the rest last); c: a matrix for each context place; u, a: classes; q, b: words."""

    r: np.ndarray
    c: np.ndarray
    u: np.ndarray
    a: np.ndarray
    q: np.ndarray
    b: np.ndarray


def start(counts: np.ndarray, rest: int) -> Weights:
    """The unigram model: counts of the words by number, and that of all others together."""
    rng, n = np.random.default_rng(5), len(counts)
    smooth = counts + SMOOTH
    classes = np.add.reduceat(smooth, np.arange(0, n, GROUP)) if n else np.zeros(0)
    a = np.log(np.append(classes, rest + SMOOTH) / (classes.sum() + rest + SMOOTH))
    b = np.log(smooth / np.repeat(classes, GROUP)[:n])
    c = np.stack([np.eye(DIM) / (i + 1) for i in range(CONTEXT)])
    return Weights(*(x.astype(np.float32) for x in (rng.normal(0, 0.3, (n + 1, DIM)), c, np.zeros((len(a), DIM)), a, np.zeros((n, DIM)), b)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place of x."""
    np.clip(x, -30, 30, out=x)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _by_row(rows: np.ndarray, grads: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, the sums of their gradients and how many there were of each."""
    by = np.argsort(rows.astype(np.int32))
    rows = rows[by]
    cut = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, np.int64)
    return rows[cut], np.add.reduceat(grads[by], cut, axis=0) if len(cut) else grads[:0], np.diff(np.append(cut, len(rows)))


class Trainer:
    """One replica: weights that start as all others' do, and how often each row has been trained."""

    def __init__(self, weights: Weights, seed: int):
        self.w = Weights(*(x.copy() for x in weights))
        self.seen = {name: np.zeros(len(getattr(weights, name)), np.float32) for name in ("r", "q", "u")}
        self.squares = Weights(*(np.full(len(x), 1e-8, np.float32) for x in weights))
        self.rng = np.random.default_rng(seed)
        share = np.exp(weights.a.astype(np.float64))
        self.n, self.rest = len(weights.q), len(weights.a) - 1
        word = np.exp(weights.b.astype(np.float64)) * share[np.arange(self.n) // GROUP] if self.n else np.zeros(0)
        self.classes, self.words = self._noise(share, NOISE_CLASSES), self._noise(word, NOISE)
        # what each layer subtracts from a score; that of a word also holds the share of its class, as in the unigram model
        offset = np.log(np.maximum(share, 1e-30)).astype(np.float32)[np.arange(self.n) // GROUP]
        self.shifts = {"u": -self.classes[1], "q": offset - self.words[1]}

    @staticmethod
    def _noise(share: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        share = share / max(share.sum(), 1e-30)
        return np.cumsum(share), np.log(k * np.maximum(share, 1e-30)).astype(np.float32), k

    def _move(self, name: str, rows, grad: np.ndarray) -> None:
        x, squares = getattr(self.w, name), getattr(self.squares, name)
        squares[rows] += (grad * grad).mean(tuple(range(1, grad.ndim))) if grad.ndim > 1 else grad * grad
        scale = RATE / np.sqrt(squares[rows])
        x[rows] -= grad * scale.reshape(-1, *[1] * (grad.ndim - 1))

    def _contrast(self, vectors: str, biases: str, noise: tuple, target: np.ndarray, x: np.ndarray) -> np.ndarray:
        """One step of a layer; the gradient by the contexts x."""
        cumulated, _, k = noise
        w, bias, shift = getattr(self.w, vectors), getattr(self.w, biases), self.shifts[vectors]
        drawn = np.minimum(np.searchsorted(cumulated, self.rng.random(k) * cumulated[-1], "right"), len(cumulated) - 1)
        own, others = w[target], w[drawn]
        g_own = _sigmoid(np.einsum("ij,ij->i", own, x) + (bias[target] + shift[target])) - 1
        g_others = _sigmoid(x @ others.T + (bias[drawn] + shift[drawn]))
        grads = np.concatenate([g_own[:, None] * x, g_others.T @ x])
        rows, sums, times = _by_row(np.concatenate([target, drawn]), np.column_stack([grads, np.concatenate([g_own, g_others.sum(0)])]))
        self._move(vectors, rows, sums[:, :-1])
        self._move(biases, rows, sums[:, -1])
        self.seen[vectors][rows] += times
        return g_own[:, None] * own + g_others @ others

    def step(self, before: np.ndarray, target: np.ndarray) -> None:
        """before: CONTEXT x tokens."""
        known = np.flatnonzero(target < self.n)
        vectors = [self.w.r[b] for b in before]
        x = sum(v @ c.T for v, c in zip(vectors, self.w.c, strict=True))
        g = self._contrast("u", "a", self.classes, np.where(target < self.n, target // GROUP, self.rest), x)
        if len(known):
            g[known] += self._contrast("q", "b", self.words, target[known], x[known])
        rows, sums, times = _by_row(np.concatenate(before), np.concatenate([g @ c for c in self.w.c]))
        c_grads = np.stack([g.T @ v for v in vectors])
        self._move("r", rows, sums)
        self.seen["r"][rows] += times
        self._move("c", np.arange(CONTEXT), c_grads)

    def text(self, numbers: np.ndarray, before: np.ndarray) -> None:
        for at in range(0, len(numbers), BATCH):
            self.step(before[:, at : at + BATCH], numbers[at : at + BATCH])

    def parts(self):
        """(key, rows, how often each was trained, rows' weights times that): only what was trained, in segments."""
        w = self.w
        tables = {0: (w.r, self.seen["r"]), 1: (np.column_stack([w.q, w.b]), self.seen["q"]), 2: (np.column_stack([w.u, w.a]), self.seen["u"]), 3: (w.c.reshape(CONTEXT, -1), np.full(CONTEXT, self.seen["u"].sum(), np.float32))}
        for kind, (x, n) in tables.items():
            for at in range(0, len(x), SEGMENT):
                rows = np.flatnonzero(n[at : at + SEGMENT])
                if len(rows):
                    yield kind << 24 | at // SEGMENT, rows.astype(np.int16), n[at + rows], x[at + rows] * n[at + rows, None]


def _averaged(batches):
    """Rows sorted by key stream through; one segment is open at a time."""
    open_, sums, n = None, None, None

    def done():
        rows = np.flatnonzero(n)
        return common.batch_of(key=pa.array([open_], pa.int32()), rows=pa.array([rows.astype(np.int16).tobytes()], pa.binary()), x=pa.array([(sums[rows] / n[rows, None]).astype(np.float32).tobytes()], pa.binary()))

    for batch in batches:
        for key, rows, times, x in zip(*(batch.column(c).to_pylist() for c in ("key", "rows", "n", "x")), strict=True):
            rows, times = np.frombuffer(rows, np.int16), np.frombuffer(times, np.float32)
            x = np.frombuffer(x, np.float32).reshape(len(rows), -1)
            if key != open_:
                if open_ is not None:
                    yield done()
                open_, sums, n = key, np.zeros((SEGMENT, x.shape[1])), np.zeros(SEGMENT)
            sums[rows] += x
            n[rows] += times
    if open_ is not None:
        yield done()


def train(docs: DataFrame, lookup: Lookup, weights: Weights, tokens: int) -> Weights:
    """The weights after one pass over all training texts."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((lookup, weights))

    def run(batches):
        look, begin = shared.value
        trainer, end = Trainer(begin, TaskContext.get().partitionId()), look.end
        for batch in common.slices(batches):
            found, first = _tokens(batch.column("text"))
            numbers, _ = look(found)
            trainer.text(numbers, contexts(numbers, first, end))
        for key, rows, n, x in trainer.parts():
            yield common.batch_of(key=pa.array([key], pa.int32()), rows=pa.array([rows.tobytes()], pa.binary()), n=pa.array([n.tobytes()], pa.binary()), x=pa.array([x.tobytes()], pa.binary()))

    texts = common.texts_of(docs).where(~held_out(F.col("doc_id"))).coalesce(max(spark.sparkContext.defaultParallelism, -(-tokens // REPLICA)))
    replicas = texts.mapInArrow(run, "key int, rows binary, n binary, x binary")
    found = replicas.repartition("key").sortWithinPartitions("key").mapInArrow(_averaged, "key int, rows binary, x binary").collect()
    out = Weights(*(x.copy() for x in weights))
    for row in found:
        kind, rows = row["key"] >> 24, np.frombuffer(row["rows"], np.int16).astype(np.int64) + (row["key"] & 0xFFFFFF) * SEGMENT
        x = np.frombuffer(row["x"], np.float32).reshape(len(rows), -1)
        if kind == 0:
            out.r[rows] = x
        elif kind == 3:
            out.c[rows] = x.reshape(-1, DIM, DIM)
        else:
            vectors, biases = (out.q, out.b) if kind == 1 else (out.u, out.a)
            vectors[rows], biases[rows] = x[:, :-1], x[:, -1]
    return out


def _log_of_sums(logits: np.ndarray, bound: float) -> np.ndarray:
    """Of each row; logits, none greater than the bound in size, are used up."""
    if bound < 60:
        return np.log(np.exp(logits, out=logits).sum(1))
    top = logits.max(1, keepdims=True)
    return np.log(np.exp(logits - top).sum(1)) + top[:, 0]


def _longest(rows: np.ndarray) -> float:
    return float(np.sqrt((rows * rows).sum(1).max(initial=0)))


class Model:
    """Exactly normalised token log10 probabilities."""

    def __init__(self, w: Weights, tokens: int, kinds: int, rest_tokens: int, rest_kinds: int):
        self.u, self.a, self.q, self.b, self.n = w.u, w.a, w.q, w.b, len(w.q)
        self.after = np.stack([w.r @ c.T for c in w.c])  # what a word adds to the context, by place
        # vectors with their biases, a matrix for the classes and one for each class
        self.tables = [np.column_stack([w.u, w.a]).T.copy()] + [np.column_stack([w.q[i : i + GROUP], w.b[i : i + GROUP]]).T.copy() for i in range(0, self.n, GROUP)]
        self.longest = [_longest(t.T) for t in self.tables]
        self.tokens, self.kinds, self.rest_tokens, self.rest_kinds = tokens, kinds, rest_tokens, rest_kinds

    def log10(self, before: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Of each target after its context; of a word of the rest, that of the rest."""
        x = np.ones((len(target), DIM + 1), np.float32)
        x[:, :-1] = sum(of[b] for of, b in zip(self.after, before, strict=True))
        far, classes, out = _longest(x), np.where(target < self.n, target // GROUP, len(self.a) - 1), np.zeros(len(target))

        def add(table: int, rows: np.ndarray, own: np.ndarray) -> None:
            for at in range(0, len(rows), ROWS_AT_ONCE):
                some = rows[at : at + ROWS_AT_ONCE]
                logits = x[some] @ self.tables[table]
                out[some] += logits[np.arange(len(some)), own[some]] - _log_of_sums(logits, far * self.longest[table])

        add(0, np.arange(len(target)), classes)
        by = np.argsort(classes.astype(np.int16), kind="stable")
        cut = np.searchsorted(classes[by], np.arange(len(self.a)))
        for k in np.flatnonzero(np.diff(cut)).tolist():
            add(k + 1, by[cut[k] : cut[k + 1]], target - k * GROUP)
        return out / LN10


def fit(docs: DataFrame, counts: DataFrame) -> tuple[Lookup, Model]:
    """counts: what word_counts() gives, saved."""
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    # the least count of a frequent word, from a histogram: no task sends more to the driver than the frequent words it holds
    scale = F.floor(F.log2("c") * 16).cast("int")
    held, least = 0, 1 << 20
    for r in sorted(counts.groupBy(scale.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect(), reverse=True):
        if (held := held + r["n"]) > FREQUENT:
            break
        least = r["b"]
    top = counts.where((scale >= least) | (F.col("w") == F.lit(int(END_HASH.astype(np.int64))))).toPandas().sort_values(["c", "w"], ascending=[False, True])
    hashes, c = top["w"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64)
    lookup, rest = Lookup(hashes, c), int(total["n"]) - int(c.sum())
    weights = start(c, rest)
    if len(c):
        weights = train(docs, lookup, weights, int(total["n"]))
    return lookup, Model(weights, int(total["n"]), int(total["v"]), rest, int(total["v"]) - len(c))


def score(docs: DataFrame, counts: DataFrame | None = None, fitted: tuple[Lookup, Model] | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. counts and fitted: of the training texts, if at hand."""
    spark = docs.sparkSession
    counts = common.saved(word_counts(docs), "word-counts") if counts is None else counts
    lookup, model = fitted or fit(docs, counts)
    shared = spark.sparkContext.broadcast((lookup, model))
    base_rest, lm_rest = model.tokens + SMOOTH * (model.kinds + 1), model.rest_tokens + SMOOTH * (model.rest_kinds + 1)

    def run(batches):
        look, m = shared.value
        row, end = TaskContext.get().partitionId() << 33, look.end
        for batch in common.slices(batches):
            tokens, first = _tokens(batch.column("text"))
            numbers, c = look(tokens)
            at, frequent = first[:-1], numbers < m.n
            lm = m.log10(contexts(numbers, first, end), numbers)
            lm[~frequent] -= np.log10(lm_rest)
            base = np.where(frequent, np.log10(c + SMOOTH), 0.0) - np.log10(base_rest)
            # words that aren't frequent, each once a text, with how often they occur
            rare = np.flatnonzero(~frequent)
            by = rare[np.lexsort((tokens[rare], common.owners(first)[rare]))]
            owner = common.owners(first)[by]
            new = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (tokens[by][1:] != tokens[by][:-1])])) if len(by) else np.zeros(0, np.int64)
            cut = pa.array(np.searchsorted(owner[new], np.arange(batch.num_rows + 1)), pa.int32())
            words = pa.ListArray.from_arrays(cut, pa.array(tokens[by][new].view(np.int64)))
            times = pa.ListArray.from_arrays(cut, pa.array(np.diff(np.append(new, len(by))).astype(np.int32)))
            add = np.add.reduceat
            yield common.batch_of(row=pa.array(row + np.arange(batch.num_rows)), doc_id=batch.column("doc_id"), n_tokens=pa.array(np.diff(first)), n_known=pa.array(add(frequent.astype(np.int64), at)), base=pa.array(add(base, at)), lm=pa.array(add(lm, at)), words=words, times=times)
            row += batch.num_rows

    rows = common.saved(common.texts_of(docs).mapInArrow(run, "row long, doc_id long, n_tokens long, n_known long, base double, lm double, words array<long>, times array<int>"), "scored")
    each = rows.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("w"), F.col("x.times").alias("n"))
    met = each.join(counts, "w", "left").select("row", F.when(F.col("c") > 0, F.col("n")).otherwise(0).alias("known"), (F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + SMOOTH)).alias("tail"))
    # a text's rare words come from all partitions: sums taken before this shuffle would spare little
    tails = met.repartition("row").groupBy("row").agg(F.sum("known").alias("known"), F.sum("tail").alias("tail"))
    tail = F.coalesce("tail", F.lit(0.0))
    return rows.drop("words", "times").join(tails, "row", "left").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(model.tokens).cast("long").alias("train_tokens"), (F.col("base") + tail).alias("base_score"), (F.col("lm") + tail).alias("score")).transform(common.ids_back)


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.read(spark, sf_dir, "documents"))
