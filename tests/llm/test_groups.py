"""Operators that relate texts to each other, against brute force on small tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from quernstone.llm import ann, common, exact, lm, neardup, substrings

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def phrase(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


# op 3


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_groups(spark, docs_of, odd, sample, keep):
    texts = odd + [t for _, t in sample] + ["Hot TEXT É"] * 700 + ["hot text É", "hot text é"]
    rows = {r["doc_id"]: r for r in exact.groups(docs_of(texts), keep).collect()}
    norm = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})
    groups = collections.defaultdict(list)
    for i, t in enumerate(texts):
        groups[norm(t)].append(i)
    assert len(rows) == len(texts)
    for t, ids in groups.items():
        stays = min(ids) if keep == "smallest" else max(ids)
        for i in ids:
            r = rows[i]
            assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (stays, len(ids), i == stays, hashlib.sha256(t.encode()).hexdigest())
    left = exact.dedup(docs_of(texts), keep).collect()
    assert sorted(r["doc_id"] for r in left) == sorted((min if keep == "smallest" else max)(g) for g in groups.values())
    assert left[0]["score"] == "x" and exact.groups(docs_of([])).count() == 0


def test_exact_repeated_ids(docs_of):
    rows = exact.groups(docs_of(["a", "A", "b", None], [5, 5, 5, 6]), "largest").collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in rows) == [(5, 5, 1, True), (5, 5, 2, False), (5, 5, 2, True), (6, 6, 1, True)]


def test_separators():
    rng = random.Random(2)
    for _ in range(300):
        a, b = sorted((bytes(rng.choices(b"ab", k=rng.randrange(0, 200))) if rng.random() < 0.5 else b"a" * rng.randrange(0, 200)) for _ in range(2))
        if a < b:
            s = exact.separator(a, b)
            assert a < s <= b and b.startswith(s) and s[:-1] <= a


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_exact_groups_over_many_partitions(docs_of, keep):
    """Common starts longer than any fixed prefix, and a group that fills several partitions."""
    start = "the same start of every text " * 40
    texts = [start + str(i % 50) for i in range(120)] + [start] * 60 + ["b", "B"] * 5 + [start + "\n" + "x" * 20000, start + "\n" + "x" * 20000 + "y"]
    points = exact.splitters(common.texts_of(docs_of(texts)), 4, 3)
    assert len(points) > 2 and max(len(t) for t, _ in points) <= 20002 + len(start)
    rows = {r["doc_id"]: r for r in exact.groups(docs_of(texts), keep, 3).collect()}
    of = collections.defaultdict(list)
    for i, t in enumerate(texts):
        of[t.lower()].append(i)
    for ids in of.values():
        assert all((rows[i]["keep_id"], rows[i]["group_size"]) == ((min if keep == "smallest" else max)(ids), len(ids)) for i in ids)
    assert sum(r["kept"] for r in rows.values()) == len(of)


@pytest.mark.parametrize("op", [exact, neardup], ids=["exact", "near"])
def test_one_row_of_each_group_stays(spark, op):
    """Repeated rows and ids, null ids, and columns named like the operators' own."""
    rows = [(5, "a"), (5, "a"), (5, "b"), (1, "b"), (None, "c"), (None, "c"), (7, None), (8, "")]
    names = "doc_id long, text string, __stay long, k long, twins string, key0 int, row int, `dotted.name` string"
    docs = spark.createDataFrame([(*r, 1, 2, "x", 3, 4, "y") for r in rows], names)
    out = op.dedup(docs)
    assert out.columns == docs.columns
    kept = sorted((tuple(r[:2]) for r in out.collect()), key=str)
    # near: a document is all rows of an id, its text the smallest of theirs; 1 has "b" alone, 5 has "a"
    assert kept == sorted([(5, "a"), (1, "b"), (None, "c"), (7, None)], key=str)
    assert op.dedup(docs.where("false")).count() == 0


def test_exact_oracle(spark):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    assert {tuple(r) for r in exact.op3_exact(spark, sf).collect()} == set(c.sql(exact.ORACLE).fetchall())


# op 2


def jaccard(a, b):
    def weights(t):
        w = WORDS.findall(t.lower())
        return {s: 1 + math.log(n) for s, n in collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))).items()} if w else {}

    x, y = weights(a), weights(b)
    least = sum(min(v, y[k]) for k, v in x.items() if k in y)
    return least / (sum(x.values()) + sum(y.values()) - least)


def near_texts():
    rng = random.Random(3)
    texts = []
    for g in range(40):
        base = phrase(rng, rng.randrange(60, 400))
        texts.append(" ".join(base))
        for _ in range(rng.randrange(0, 4)):
            edited = list(base)
            for _ in range(rng.randrange(1, 1 + max(1, len(base) // 60))):
                edited[rng.randrange(len(edited))] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(edited))
        half = base[: len(base) // 2] + phrase(rng, len(base) // 2)
        texts.append(" ".join(half))  # shares half, and must stay apart
    return texts


def test_near_classes(docs_of, odd):
    texts = near_texts() + odd
    rows = {r["doc_id"]: r for r in neardup.classes(docs_of(texts)).collect()}
    assert len(rows) == len(texts)
    clear = missed = 0
    for i, a in enumerate(texts):
        for j in range(i):
            s = jaccard(a or "", texts[j] or "") if (a or "").split() and (texts[j] or "").split() else float(not (a or "").split() and not (texts[j] or "").split())
            if s >= 0.82:
                clear, missed = clear + 1, missed + (rows[i]["class_id"] != rows[j]["class_id"])
            elif s < 0.3:
                assert rows[i]["class_id"] != rows[j]["class_id"]
    assert clear > 40 and missed <= clear // 50
    by_class = collections.Counter(r["class_id"] for r in rows.values())
    assert all(r["class_size"] == by_class[r["class_id"]] and r["class_id"] <= i and r["kept"] == (i == r["class_id"]) for i, r in rows.items())
    assert neardup.classes(docs_of([])).count() == 0
    assert sorted(r["doc_id"] for r in neardup.dedup(docs_of(texts)).collect()) == sorted(by_class)


def test_large_near_group_stays_together(docs_of):
    rng = random.Random(5)
    base, texts = phrase(rng, 200), []
    for _ in range(150):
        edited = list(base)
        edited[rng.randrange(200)] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(edited))
    texts += [" ".join(phrase(rng, 100)) for _ in range(100)]
    rows = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs_of(texts)).collect()}
    assert {rows[i] for i in range(150)} == {0} and all(rows[i] == i for i in range(150, 250))


@pytest.mark.parametrize("options", [{}, {"block": 2}])
def test_near_copies_between_unlike_members_of_a_bucket(spark, docs_of, monkeypatch, options):
    """One bucket of lo, B, C, hi and more unlike ones: only B~C holds, and D~C, but not D~B."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(200)]
    edited = lambda at, n: " ".join(base[:at] + [f"new{rng.randrange(10**9)}" for _ in range(n)] + base[at + n :])
    texts = {i: edited(20 + 10 * i, 60) for i in range(4)} | {10: edited(10, 15), 11: " ".join(base), 12: edited(170, 15)} | {20 + i: edited(25 + 10 * i, 60) for i in range(4)}
    assert jaccard(texts[10], texts[11]) > 0.82 and jaccard(texts[11], texts[12]) > 0.82 and jaccard(texts[10], texts[12]) < 0.78
    rows = [(i, i, i, 1, [7]) for i in texts]
    monkeypatch.setattr(neardup, "signatures", lambda *_: spark.createDataFrame(rows, "doc_id long, h1 long, h2 long, units long, keys array<long>"))
    found = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs_of(texts.values(), texts), **options).collect()}
    assert found == {i: 10 if i in (10, 11, 12) else i for i in texts}


def test_near_repeated_ids(docs_of):
    rows = neardup.classes(docs_of(["a b c d e f", "x y z x y z", "a b c d e f"], [1, 1, 2])).collect()
    assert sorted(r["doc_id"] for r in rows) == [1, 2]


def test_consistent_sampling_estimates_weighted_jaccard():
    rng = np.random.default_rng(1)
    hits, want = 0, 0.0
    for _ in range(60):
        h = rng.integers(0, 1 << 63, 60).astype(np.uint64)
        a, b = rng.uniform(0.5, 3, 60), rng.uniform(0.5, 3, 60)
        x, y = neardup.samples(h[:50], a[:50]), neardup.samples(h[10:], b[10:])
        hits += (x == y).sum()
        pairs = np.zeros((2, 60))
        pairs[0, :50], pairs[1, 10:] = a[:50], b[10:]
        want += pairs.min(0).sum() / pairs.max(0).sum()
    assert abs(hits / 60 / len(neardup._SEEDS) - want / 60) < 0.04


# op 7


def without_repeats(rows, window):
    words = [(i, WORDS.findall(t or "")) for i, t in rows]
    first = {}
    for i, w in sorted(words, key=lambda x: x[0]):
        for j in range(len(w) - window + 1):
            first.setdefault(tuple(w[j : j + window]), i)
    out = []
    for i, w in words:
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if first[tuple(w[j : j + window])] < i:
                gone[j : j + window] = [True] * window
        out.append((i, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()))
    return sorted(out)


@pytest.mark.parametrize(("window", "hot"), [(50, 1000), (50, 4), (6, 1000), (6, 3)])
def test_substrings(docs_of, odd, window, hot):
    rng = random.Random(window + hot)
    shared = [phrase(rng, rng.randrange(window, 3 * window)) for _ in range(5)]
    texts = list(odd)
    for _ in range(60):
        t = phrase(rng, rng.randrange(0, 120), 30 if window == 6 else 4000)
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(shared)
            a = rng.randrange(0, len(p) // 2)
            t[(at := rng.randrange(0, len(t) + 1)) : at] = p[a : a + rng.randrange(window - 1, max(window, len(p)))]
        texts.append(rng.choice([" ", "\n", "  "]).join(t))
    texts += texts[-8:]
    ids = rng.sample(range(10_000), len(texts))
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"])) for r in substrings.kept_words(docs_of(texts, ids), window, hot).collect())
    assert got == without_repeats(list(zip(ids, texts, strict=True)), window)
    assert sum(r[2] for r in got) > 0


def test_substrings_empty_and_repeated_ids(docs_of):
    assert substrings.kept_words(docs_of([])).count() == 0
    text = " ".join(f"w{i}" for i in range(80))
    rows = substrings.kept_words(docs_of([text, text, text], [1, 1, 2])).collect()
    assert sorted((r["doc_id"], r["n_removed"]) for r in rows) == [(1, 0), (1, 0), (2, 80)]


def test_substrings_oracle(spark):
    sf = "/root/testdata/sf0.01"
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = c.sql(substrings.ORACLE)
    assert want.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    rows = sorted(tuple(r) for r in substrings.op7_substrings(spark, sf).collect())
    assert rows == sorted(want.fetchall()) and sum(r[2] for r in rows) > 0


def test_automaton():
    m = substrings.Automaton()
    m.add(list("abcbc"))
    m.add(list("xbcd"))
    assert m.matches(list("abcbcd")) == [1, 2, 3, 4, 5, 3]
    assert m.matches(list("bcx")) == [1, 2, 1]
    assert substrings.spans([1, 2, 3, 4, 0, 3], 3) == [(0, 4), (3, 6)] or substrings.spans([1, 2, 3, 4, 0, 3], 3) == [(0, 6)]


# op 6


def lm_base(rows):
    low = {c: c + 32 for c in range(65, 91)}
    words = [(i, WORDS.findall((t or "").translate(low)) + [None]) for i, t in rows]
    counts = collections.Counter(w for i, ws in words if zlib.crc32(str(i).encode()) % 10 for w in ws)
    n, v = sum(counts.values()), len(counts)
    return sorted((i, zlib.crc32(str(i).encode()) % 10 == 0, len(ws), sum(counts[w] > 0 for w in ws), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)) for i, ws in words)


@pytest.mark.parametrize("frequent", [1 << 16, 20])
def test_lm_base(docs_of, odd, sample, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    texts = odd + [t for _, t in sample[:60]] + odd
    got = sorted((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in lm.score(docs_of(texts)).collect())
    want = lm_base(list(enumerate(texts)))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(math.isclose(g[5], w[5], rel_tol=1e-9) for g, w in zip(got, want, strict=True))


def test_lm_empty(docs_of):
    assert lm.score(docs_of([])).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    (row,) = lm.score(docs_of(["a b"], [held])).collect()
    assert row["train_tokens"] == 0 and row["n_known"] == 0 and math.isfinite(row["score"]) and math.isclose(row["base_score"], 0, abs_tol=1e-9)


def test_lm_trainer_learns_followers_from_drawn_noise():
    """Each word has a usual follower two places on: two words of context tell more than counts do."""
    rng, n = np.random.default_rng(0), 600
    numbers = rng.integers(0, n, 60_000).astype(np.int32)
    for i in range(2, len(numbers)):
        if rng.random() < 0.8:
            numbers[i] = (numbers[i - 2] * 7 + 1) % n
    counts = np.bincount(numbers, minlength=n)
    by = np.argsort(-counts)
    numbers, counts = np.argsort(by)[numbers].astype(np.int32), counts[by]
    weights = lm.start(counts, 0)
    before = lm.contexts(numbers, np.array([0, len(numbers)]), 0)
    plain = lm.Model(weights, 1, 1, 0, 0).log10(before, numbers)
    assert np.allclose(plain, np.log10((counts + lm.SMOOTH) / (counts.sum() + lm.SMOOTH * (n + 1)))[numbers], atol=1e-4)
    trainer = lm.Trainer(weights, 1)
    for _ in range(6):
        trainer.text(numbers, before)
    model = lm.Model(trainer.w, 1, 1, 0, 0)
    assert model.log10(before, numbers).mean() > plain.mean() + 0.1
    one = np.repeat(before[:, 100:101], n + 1, axis=1)
    assert math.isclose((10 ** model.log10(one, np.arange(n + 1))).sum(), 1, abs_tol=1e-4)


@pytest.mark.parametrize("frequent", [1 << 16, 40])
def test_lm_scores_by_brute_force(spark, docs_of, sample, monkeypatch, frequent):
    """Each token's probability by loops over all classes and words."""
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    texts = [None, "", "A b a B c"] + [t for _, t in sample[:12]] + ["unheard-of words"] * 2
    docs = docs_of(texts)
    counts = common.saved(lm.word_counts(docs), "word-counts")
    lookup, model = lm.fit(docs, counts)
    known = {int(np.uint64(r["w"] % (1 << 64))): r["c"] for r in counts.collect()}
    got = {r["doc_id"]: r["score"] for r in lm.score(docs, counts, (lookup, model)).collect()}
    low = {c: c + 32 for c in range(65, 91)}
    import pyarrow as pa

    for i, t in enumerate(texts):
        words = WORDS.findall((t or "").translate(low))
        hashes = [int(h) for h in common.Words(pa.array([" ".join(words)])).hashes] + [int(lm.END_HASH)]
        numbers = lookup(np.array(hashes, np.uint64))[0].tolist()
        want, past = 0.0, [lookup.end] * lm.CONTEXT
        for h, w in zip(hashes, numbers, strict=True):
            x = sum(model.after[k][p].astype(float) for k, p in enumerate(past))
            scores = [float(model.u[k] @ x) + float(model.a[k]) for k in range(len(model.a))]
            own = w // lm.GROUP if w < model.n else len(scores) - 1
            want += scores[own] - math.log(sum(map(math.exp, scores)))
            if w < model.n:
                inner = [float(model.q[j] @ x) + float(model.b[j]) for j in range(own * lm.GROUP, min(model.n, (own + 1) * lm.GROUP))]
                want += inner[w - own * lm.GROUP] - math.log(sum(map(math.exp, inner)))
            else:
                want += math.log((known.get(h, 0) + lm.SMOOTH) / (model.rest_tokens + lm.SMOOTH * (model.rest_kinds + 1)))
            past = [w, *past[:-1]]
        assert math.isclose(got[i], want / math.log(10), rel_tol=1e-4, abs_tol=1e-4)
    assert math.isclose(got[len(texts) - 1], got[len(texts) - 2], rel_tol=1e-6)


def test_lm_beats_the_base_on_held_out_texts(spark):
    rows = lm.score(common.read(spark, "/root/testdata/sf0.01", "documents")).where("held_out").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


# op 5


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score string").repartition(3)


def test_ann_recall_and_scores(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    data = (centres[rng.integers(0, 40, 3000)] + 0.6 * rng.normal(size=(3000, 16))).astype(np.float32)
    data[1000:1500] = data[999]  # a vector that many rows share
    rows = [(i, v.tolist(), 0, "x") for i, v in enumerate(data)] + [(9000, None, 0, "x"), (9050, [0.0] * 16, 0, "x"), (9100, [float("nan")] + [1.0] * 15, 0, "x"), (9150, [1.0] * 3, 0, "x"), (9200, [], 0, "x")]
    got = collections.defaultdict(list)
    for r in sorted(ann.search(vectors(spark, rows)).collect(), key=lambda r: (r["query_id"], r["rank"])):
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 3000, 50))
    x, ids, hits = data.astype(np.float64), np.arange(3000), 0
    for q, found in got.items():
        want = ann._best(ids, x, q, x[q], 5)
        hits += len({c for c, _ in want} & {c for c, _ in found})
        assert len(found) == 5 and found == sorted(found, key=lambda f: (-f[1], f[0]))
        assert all(s == ann.cosine(x[[q]], x[[c]])[0] for c, s in found)
    assert hits / (5 * len(got)) >= 0.9


def test_ann_small_tables(spark):
    assert ann.search(vectors(spark, [])).count() == 0
    assert ann.search(vectors(spark, [(0, [1.0, 0.0], 0, "x")])).count() == 0
    rows = ann.search(vectors(spark, [(50, [1.0, 0.0], 0, "x"), (3, [2.0, 0.0], 0, "x"), (1, [1.0, 0.0], 0, "x"), (2, [0.0, 1.0], 0, "x"), (50, [1.0, 1.0], 0, "x")])).where("query_id = 50").collect()
    assert {r["vec_id"] for r in rows} <= {1, 2, 3}


def test_ann_magnitudes():
    big, small = np.array([[1e200, 1e200]]), np.array([[1e-200, 0.0]])
    assert ann.cosine(big, big)[0] == pytest.approx(1) and ann.cosine(small, np.array([[2.0, 0.0]]))[0] == 1.0
    assert ann.cosine(np.array([[1e200, 1e-200]]), np.array([[1e200, 1e-200]]))[0] == 1.0
    assert ann.cosine(np.array([[5e-324, 0.0]]), np.array([[1.7e308, 0.0]]))[0] == 1.0
    x = np.random.default_rng(4).normal(size=(2, 50, 16))
    plain = (x[0] * x[1]).sum(1) / (np.sqrt((x[0] * x[0]).sum(1)) * np.sqrt((x[1] * x[1]).sum(1)))
    assert (ann.cosine(*x) == plain).all()  # a power of two changes no ordinary score


def test_ann_magnitudes_in_a_table(spark):
    rows = [(0, [1.0, 0.0], 0, "x"), (1, [0.0, 1.0], 0, "x"), (2, [1.0, 1.0], 0, "x")]
    wide = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1e200, 0.0]), (2, [1e-200, 1e-200]), (3, [0.0, -1e300])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], round(r["score"], 9)) for r in ann.search(wide).sort("rank").collect()] == [(1, 1.0), (2, 0.707106781), (3, 0.0)]
    assert ann.search(vectors(spark, rows)).count() == 2


def test_ann_prunes_clustered_vectors(spark):
    """The deeper tree of a larger table lets a query see a smaller share of it."""
    rng, shares = np.random.default_rng(6), []
    centres = rng.normal(size=(300, 16))
    for n in (1000, 12_000):
        data = centres[rng.integers(0, 300, n)] + 0.15 * rng.normal(size=(n, 16))
        found = ann.report(vectors(spark, [(i, v.tolist(), 0, "x") for i, v in enumerate(data)]))
        assert found["vectors"] == n and found["leaves"] >= n // 128
        shares.append(found["share"])
    assert shares[1] < shares[0] / 2 and shares[1] < 0.1
