"""Each stage on its own input, and the whole run."""

import collections
import itertools
import math
import re
import zlib

import pytest

import corpus_pipeline
from quernstone.llm import common, neardup, packing, secrets, toxicity

from test_texts import check_packing

SF = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = common.read(spark, SF, "documents")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "secrets", "packing"]
    texts = None
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in docs.collect()} if name != "packing" else None
        out = stage(spark, docs, SF)
        if name == "packing":
            rows = out.collect()
            order = sorted(texts)
            check_packing([dict(r.asDict(), doc_id=order.index(r["doc_id"])) for r in rows], [texts[i] for i in order])
            break
        assert out.columns == columns
        docs = common.saved(out, name)
        after = {r["doc_id"]: r for r in docs.collect()}
        assert set(after) <= set(before)
        if name == "secrets":
            assert set(after) == set(before) and not any(secrets.spans(r["text"]) for r in after.values())
        else:
            assert all(after[i] == before[i] for i in after)
            assert len(after) > 0.8 * len(before)
        texts = {i: r["text"] for i, r in after.items()}
    assert ids >= set(texts)
    assert sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, SF).collect()) == sorted((r["doc_id"], r["start"], r["ids_crc32"]) for r in rows)


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stages_with_odd_tables(spark, docs_of, odd, stage):
    name, run = stage
    docs = docs_of(odd)
    out = run(spark, docs, SF)
    assert out.columns == docs.columns if name != "packing" else "sequence_id" in out.columns
    assert out.count() > 0
    assert run(spark, docs_of([]), SF).count() == 0
    assert packing.CAPACITY == 4096


def brute_toxic(docs, labels):
    """doc_id to text of the documents that stay: the lexicon learned from lists, every text scored by itself."""
    taught = [(i, toxic) for i, toxic in labels if toxic in (0, 1) and zlib.crc32(str(i).encode()) % 5]
    by = [[toxicity.fold(docs[i]) for i, t in taught if t == k and i in docs] for k in (0, 1)]
    matcher = toxicity.Matcher(toxicity.learn(by[1], by[0], sum(t for _, t in taught) / len(taught)))
    return {i: t for i, t in docs.items() if matcher.score(t) < 0.5}


def brute_exact(docs):
    first = {}
    for i in sorted(docs):
        first.setdefault(re.sub("[A-Z]+", lambda m: m[0].lower(), docs[i] or ""), i)
    return {i: docs[i] for i in first.values()}


def brute_near(docs):
    """All pairs, by shingles that are tuples of words."""
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")) for i, t in docs.items()}
    found = {i: collections.Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else {} for i, w in words.items()}
    df, n = collections.Counter(s for c in found.values() for s in c), len(docs)
    weights = {i: {s: (1 + math.log(m)) * (1 + neardup.DAMPING * math.log((1 + n) / (1 + df[s])) / math.log(1 + n)) for s, m in c.items()} for i, c in found.items()}
    root = {i: i for i in docs}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    total = {i: sum(x.values()) for i, x in weights.items()}
    for a, b in itertools.combinations(sorted(docs), 2):
        x, y = weights[a], weights[b]
        if min(total[a], total[b]) < neardup.THRESHOLD * max(total[a], total[b]):
            continue  # the minima sum to no more than the lesser total
        least = sum(min(v, y[s]) for s, v in x.items() if s in y)
        if (not x and not y) or least >= neardup.THRESHOLD * max(1e-30, total[a] + total[b] - least):
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return {i: t for i, t in docs.items() if find(i) == i}


def test_run_by_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in common.read(spark, sf, "documents").collect()}
    clean = brute_toxic(docs, [(r["doc_id"], r["toxic"]) for r in common.read(spark, sf, "labels").collect()])
    single = brute_near(brute_exact(clean))
    assert len(docs) > len(clean) > len(single)
    want = [(i, secrets.redacted(t, f) if (f := secrets.spans(t)) else t) for i, t in sorted(single.items())]
    place = {i: k for k, (i, _) in enumerate(want)}
    rows = [r.asDict() for r in corpus_pipeline.run(spark, sf).collect()]
    assert {r["doc_id"] for r in rows} == set(place)
    check_packing([dict(r, doc_id=place[r["doc_id"]]) for r in rows], [t for _, t in want])


def test_run_over_odd_tables(spark, docs_of, odd, tmp_path):
    """Nulls in any column, long texts, ties, repeated rows and clashing names; then a table without rows."""
    docs = docs_of([*odd, " " * 200_000, "a secret: abcdefgh"])
    nulls = spark.createDataFrame([(None, None, None, None, None, None, None, None), (None, "of no id", None, None, None, None, None, None)], docs.schema)
    docs = docs.union(docs).union(nulls).withColumnsRenamed({"k": "__stay"})
    docs = docs.withColumns({"key0": docs["doc_id"], "row": docs["text"], "label": docs["kept"], "class_id": docs["doc_id"]})
    labels = spark.createDataFrame([(3, None, 0), (None, None, None), (None, 1, 1), (4, 1, 0), (5, 1, 0), (6, 1, None)], "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in rows}
    same = {(t or "").lower().strip() for t in odd}
    assert len(ids) == len(same) + 1 and None in ids  # blank texts are one class, and the text with a secret comes on top
    assert sorted((r["doc_id"] or -1, r["start"]) for r in rows) == sorted({(r["doc_id"] or -1, r["start"]) for r in rows})
    docs.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    labels.where("false").write.parquet(f"{tmp_path}/none/labels.parquet")
    none = corpus_pipeline.run(spark, f"{tmp_path}/none")
    assert none.count() == 0 and "sequence_id" in none.columns
