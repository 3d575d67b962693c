"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text, normalised by length, with exception phrases.

Folding lower-cases, maps homoglyphs (Cyrillic, Greek, full-width) to Latin letters, digits and signs that stand for letters to
those letters, and everything that is no letter to a space. Terms are anchored at a word's start: a term that ends in a
space is a whole word, others are stems. The lexicon, its weights and its exceptions (words or word pairs around a term that
occur in clean texts alone) are learned from labelled rows, as are the two factors and the offset of the score.

The learner sees at most ``SAMPLE`` labelled rows of each class, those of the smallest hashes of doc_id, and their whole
texts; rows without a label of 0 or 1 are left out. Of rows that repeat a doc_id it sees the one with the smallest text, and equal
texts count once. The texts stay on the executors: what the driver gets are the terms that occur in several toxic ones, the
phrases around terms and two numbers a text. Without both classes the lexicon is empty and every score is the
share of label 1 (0 without labels). Null and empty texts score what no hits score. Rows are scored one by one, so
copies, ties, repeated rows and further columns change nothing; a text of any length is scored whole, in time that grows
with its length alone (but for a logarithm). An empty table gives an empty table.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Callable, Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Labelled rows of each class that the learner reads at most.
SAMPLE = 2500
MIN_TEXTS, MIN_ODDS, SHORTEST, LONGEST = 5, 0.7, 4, 10

# Letters of other scripts that look like Latin ones, and digits or signs that stand for letters.
HOMOGLYPHS = "аa вb еe кk мm нh оo рp сc тt уy хx іi јj ѕs ԁd ɡg αa βb εe ιi κk νv οo ρp τt υu χx ıi"
SUBSTITUTES = "0o 1i 3e 4a 5s 7t @a $s"
INVISIBLE = "​‌‍⁠﻿­"


class _Folding(dict):
    """For str.translate: a letter stays or becomes its Latin look-alike, all else becomes a space."""

    def __missing__(self, code: int):
        c = chr(code)
        if 0xFF01 <= code <= 0xFF5E:
            out = self[ord(chr(code - 0xFEE0).lower())]
        elif 0x1D400 <= code <= 0x1D7FF:
            out = self[ord(unicodedata.normalize("NFKC", c).lower())]
        else:
            out = code if c.isalpha() or unicodedata.combining(c) else 32
        self[code] = out
        return out


_FOLD = _Folding({ord(a): ord(b) for a, b in HOMOGLYPHS.split()} | {ord(a): ord(b) for a, b in SUBSTITUTES.split() if a.isdigit()} | {ord(c): None for c in INVISIBLE})
_SIGN = re.compile(r"[$@](?=[^\W_])")


def fold(text: str) -> str:
    """The text as words of folded letters between spaces, one space at both ends."""
    text = text.lower()
    if "$" in text or "@" in text:
        text = _SIGN.sub(lambda m: "s" if m[0] == "$" else "a", text)
    return f" {text.translate(_FOLD)} "


class Model(NamedTuple):
    terms: dict[str, float]
    exceptions: tuple[str, ...]
    factors: tuple[float, float]
    offset: float


class Matcher:
    """An automaton over terms and exceptions; made once in each Python worker."""

    def __init__(self, model: Model):
        import ahocorasick

        self.model, self.automaton = model, ahocorasick.Automaton()
        for term, weight in model.terms.items():
            self.automaton.add_word(f" {term}", (len(term), weight))
        for phrase in model.exceptions:
            self.automaton.add_word(f" {phrase} ", (len(phrase) + 1, None))
        self.empty = not (model.terms or model.exceptions)
        if not self.empty:
            self.automaton.make_automaton()

    def weight(self, folded: str) -> float:
        """The sum of the weights of the terms found outside exception phrases."""
        if self.empty:
            return 0.0
        hits, spared = [], []
        for end, (size, weight) in self.automaton.iter(folded):
            (spared if weight is None else hits).append((end - size + 1, end + 1, weight))
        if spared:
            spared.sort(key=lambda s: s[0])
            starts, furthest = [s[0] for s in spared], list(itertools.accumulate((s[1] for s in spared), max))
            hits = [h for h in hits if not (i := bisect.bisect_right(starts, h[0])) or furthest[i - 1] < h[1]]
        return sum(h[2] for h in hits)

    def score(self, text: str | None) -> float:
        folded = fold(text or "")
        x = features(self.weight(folded), folded.count(" "))
        z = self.model.offset + self.model.factors[0] * x[0] + self.model.factors[1] * x[1]
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


def features(weight: float, spaces: int) -> tuple[float, float]:
    """Weight by length, and weight; both damped."""
    return math.log1p(100 * weight / (spaces + 50)), math.log1p(weight)


def _terms(folded: str) -> set[str]:
    out = set()
    for word in set(folded.split()):
        out.add(f"{word} ")
        out.update(word[:n] for n in range(SHORTEST, min(len(word), LONGEST) + 1))
    return out


class Counts(NamedTuple):
    """Of some texts: their number, and in how many each term occurs."""

    n: int
    by: Counter


def needed(texts: int) -> int:
    """In how many of so many toxic texts a term of the lexicon occurs at least."""
    return min(MIN_TEXTS, max(1, texts // 8))


def lexicon(toxic: Counts, clean: Counts) -> dict[str, float]:
    """Terms with their weights.

    A weight is the lower end (three standard errors) of the log odds of a text with the term. From the shortest stem that
    weighs enough, letters are added while the weight grows and the stem keeps its texts; a stem taken covers its extensions.
    """
    bad = {t: n for t, n in toxic.by.items() if n >= needed(toxic.n)}

    def low(t: str) -> float:
        n, m = bad[t] + 0.5, clean.by[t] + 0.5
        return math.log(n / (toxic.n + 1)) - math.log(m / (clean.n + 1)) - 3 * math.sqrt(1 / n + 1 / m)

    odds = {t: low(t) for t in bad}
    letters = sorted({c for t in odds for c in t})
    taken: dict[str, float] = {}
    for t in sorted((t for t, o in odds.items() if o >= MIN_ODDS), key=lambda t: (len(t), t)):
        if any(t[:n] in taken for n in range(1, len(t))):
            continue
        best = t
        while not best.endswith(" "):
            longer = max((u for c in letters if bad.get(u := best + c, 0) >= 0.9 * bad[best]), key=odds.__getitem__, default=best)
            if odds[longer] < odds[best] or longer == best:
                break
            best = longer
        taken[best] = odds[best]
    return taken


def phrases(folded: str, terms: dict[str, float], stems: tuple[str, ...]) -> set[str]:
    """Words that hold a term and pairs of words around them."""
    out: set[str] = set()
    if any(s in folded for s in stems):
        words = folded.split()
        for i, w in enumerate(words):
            if f"{w} " in terms or any(w[:n] in terms for n in range(1, len(w) + 1)):
                out |= {w, *([f"{words[i - 1]} {w}"] if i else []), *([f"{w} {words[i + 1]}"] if i + 1 < len(words) else [])}
    return out


def _fit(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted logistic regression by Newton's steps, the factors held at 0 or above."""
    a, theta = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
    ridge = np.diag([1e-3] * x.shape[1] + [1e-6]) * w.sum()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ theta, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (w * p * (1 - p))[:, None]) + ridge + 1e-9 * np.eye(len(theta)), a.T @ (w * (y - p)) - ridge @ theta)
        theta = theta + step
        theta[:-1] = np.maximum(theta[:-1], 0)
        if np.abs(step).max() < 1e-8:
            break
    return theta


def cell(label: int, folded: str) -> int:
    """Where a text is counted: clean or toxic, and in which half."""
    return 2 * label + (zlib.crc32(folded.encode("utf-8", "surrogatepass")) & 1)


class Listed:
    """Distinct folded texts with their labels."""

    def __init__(self, toxic: Iterable[str], clean: Iterable[str]):
        bad, good = set(toxic), set(clean)
        self.rows = [(t, 1) for t in sorted(bad)] + [(t, 0) for t in sorted(good - bad or good)]

    def counted(self, keys: Callable[[str], Iterable[str]], clean: int = 0, toxic: int = 0, most: int | None = None) -> dict[str, list[int]]:
        """For each key, in how many texts of each cell it occurs; keys of at least so many clean and toxic texts, and at most so many toxic ones."""
        by: dict[str, list[int]] = {}
        for text, label in self.rows:
            for key in keys(text):
                by.setdefault(key, [0] * 4)[cell(label, text)] += 1
        return {k: n for k, n in by.items() if n[0] + n[1] >= clean and n[2] + n[3] >= toxic and (most is None or n[2] + n[3] <= most)}

    def measured(self, measure: Callable[[str], tuple[float, float]]) -> list[tuple[int, float, float]]:
        """The label and two numbers of each text, in their own order."""
        return sorted((label, *measure(text)) for text, label in self.rows)


class Tabled:
    """The same of a table (text, label) that stays on the executors."""

    def __init__(self, texts: DataFrame):
        self.texts = texts

    def counted(self, keys: Callable[[str], Iterable[str]], clean: int = 0, toxic: int = 0, most: int | None = None) -> dict[str, list[int]]:
        def batch(by):
            names, cells = zip(*by, strict=True) if by else ((), ())
            return common.batch_of(key=pa.array(names, pa.string()), cell=pa.array(cells, pa.int32()), n=pa.array(by.values(), pa.int64()))

        def run(batches):
            by: Counter = Counter()
            for b in common.slices(batches):
                for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                    at = cell(label, text)
                    by.update((key, at) for key in keys(text))
                    if len(by) > 200_000:
                        yield batch(by)
                        by = Counter()
            yield batch(by)

        of = [F.sum(F.when(F.col("cell") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in range(4)]
        sums = self.texts.mapInArrow(run, "key string, cell int, n long").groupBy("key").agg(*of)
        found = sums.where(f"n0 + n1 >= {clean} and n2 + n3 >= {toxic}" + (f" and n2 + n3 <= {most}" if most is not None else "")).collect()
        return {r["key"]: [r[f"n{c}"] for c in range(4)] for r in found}

    def measured(self, measure: Callable[[str], tuple[float, float]]) -> list[tuple[int, float, float]]:
        def run(batches):
            for b in common.slices(batches):
                x = [measure(t) for t in b.column("text").to_pylist()]
                yield common.batch_of(label=b.column("label"), x=pa.array([v for v, _ in x], pa.float64()), y=pa.array([v for _, v in x], pa.float64()))

        return sorted(map(tuple, self.texts.mapInArrow(run, "label int, x double, y double").collect()))


def learn(toxic: Iterable[str], clean: Iterable[str], share: float) -> Model:
    """A model of folded texts; ``share`` is that of label 1 among all labelled rows."""
    return learned(Listed(toxic, clean), share)


def learned(texts: Listed | Tabled, share: float) -> Model:
    n = texts.counted(lambda _: ("",)).get("", [0] * 4)
    if not (n[0] + n[1] and n[2] + n[3]):
        return Model({}, (), (0.0, 0.0), math.log((share + 1e-6) / (1 - share + 1e-6)))
    halves = [k for k in (0, 1) if n[2 + k]]
    by = texts.counted(_terms, toxic=min(needed(n[2 + k]) for k in halves))

    def counts(label: int, half: int | None) -> Counts:
        cells = [2 * label, 2 * label + 1] if half is None or not n[2 * label + half] else [2 * label + half]
        return Counts(sum(n[c] for c in cells), Counter({t: m for t, v in by.items() if (m := sum(v[c] for c in cells))}))

    # the score is fitted to the hits of a lexicon that hasn't seen the text; a half without texts takes the whole
    models = [Model(lexicon(counts(1, k), counts(0, k)), (), (0.0, 0.0), 0.0) for k in (0, 1)]
    matchers: list[Matcher] = []

    def measure(text: str) -> tuple[float, float]:
        if not matchers:
            matchers.extend(map(Matcher, models))
        return features(matchers[1 - cell(0, text)].weight(text), text.count(" "))

    points = np.array(texts.measured(measure))
    each = (share / (n[2] + n[3]), (1 - share) / (n[0] + n[1]))
    theta = _fit(points[:, 1:], points[:, 0], np.where(points[:, 0] == 1, *each))
    terms = lexicon(counts(1, None), counts(0, None))
    stems = tuple(f" {t}" for t in terms)
    spared = texts.counted(lambda t: phrases(t, terms, stems), clean=3, most=0)
    return Model(terms, tuple(sorted(spared)), (float(theta[0]), float(theta[1])), float(theta[2]))


def held_out(doc_id):
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of the labelled rows of ``docs`` outside the held-out fifth. The ids of the sample, bounded by ``2 * sample``, are broadcast; texts meet them at the scan."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1)")
    rows = rows.where(~held_out(F.col("doc_id")))
    counts = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = counts.get(1, 0) / max(1, sum(counts.values()))
    pick = lambda k: rows.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = pick(0).unionByName(pick(1)).distinct()
    found = common.texts_of(docs).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))

    def folded(batches):
        for batch in common.slices(batches):
            yield common.batch_of(text=pa.array([fold(t) for t in batch.column("text").to_pylist()], pa.string()), toxic=batch.column("toxic"))

    texts = found.mapInArrow(folded, "text string, toxic int").groupBy("text").agg(F.max("toxic").alias("label"), F.min("toxic").alias("least"))
    texts = common.saved(texts, "labelled")
    if texts.where("label = 0").isEmpty():  # every clean text is a toxic one too: it counts as both
        texts = texts.withColumn("label", F.explode(F.array_distinct(F.array("label", "least"))))
    return learned(Tabled(texts.select("text", "label")), share)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row, in one pass over the scan."""

    def run(batches):
        matcher = Matcher(model)
        for batch in common.slices(batches):
            yield common.batch_of(doc_id=batch.column("doc_id"), score=pa.array([matcher.score(t) for t in batch.column("text").to_pylist()], pa.float64()))

    return common.ids_back(common.texts_of(docs).mapInArrow(run, "doc_id long, score double"))


def accepted(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below the threshold."""

    def run(batches):
        matcher = Matcher(model)
        for batch in common.slices(batches):
            yield batch.filter(pa.array([matcher.score(t) < threshold for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    scored = score(docs, train(docs, common.read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.coalesce("doc_id", F.lit(common.NULL_ID))).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
