"""Operators that look at one text at a time, against plain versions of what they must return."""

import base64
import hashlib
import json
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quernstone.llm import bpe, common, packing, secrets, shards, toxicity

EMPTY_SHA = hashlib.sha256(b"").hexdigest()


@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \t\naAbé🙂\x1c  .", max_size=40)), max_size=6))
@settings(max_examples=150, deadline=None)
def test_words(texts):
    import pyarrow as pa

    found = common.Words(pa.array(texts, pa.string()))
    want = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    assert found.counts.tolist() == list(map(len, want))
    data = found.buf.tobytes()
    assert [data[a:b].decode() for a, b in zip(found.starts, found.ends, strict=True)] == [w for ws in want for w in ws]
    flat = [w for ws in want for w in ws]
    assert len(set(found.hashes.tolist())) == len(set(flat))


def test_windows():
    h = np.arange(1, 40, dtype=np.uint64)
    for k in (1, 2, 3, 5, 25, 39):
        w = common.windows(h, k)
        assert len(w) == 39 - k + 1 == len(set(w.tolist()))
        again = common.windows(np.concatenate([h[5:20], h]), k) if k <= 15 else None
        assert again is None or again[0] == w[5]
    assert len(common.windows(h, 40)) == 0


# op 4


def test_bpe_round_trip_and_library(spark, docs_of, odd, sample):
    coder, _ = bpe.encoder()
    texts = odd + [t for _, t in sample[:40]] + ["a" + " " * 300_000 + "b"]
    rows = {r["doc_id"]: r for r in bpe.digests(docs_of(texts)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        ids = coder.encode_ordinary(t or "")
        assert rows[i]["n_tokens"] == len(ids) and rows[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    encoded = bpe.encode_table(docs_of(texts[:12]))
    assert {r["doc_id"]: bytes(r["data"]).decode() for r in bpe.decode_table(encoded).collect()} == {i: t or "" for i, t in enumerate(texts[:12])}
    assert bpe.digests(docs_of([])).count() == 0


@given(st.text(alphabet="ab'1 .\n\t é  s\x1c\x85\u3000世я。", max_size=200))
@settings(max_examples=300, deadline=None)
def test_bpe_cuts_change_nothing(text):
    coder, _ = bpe.encoder()
    want = coder.encode_ordinary(text)
    assert [i for p in bpe.parts(text, 7) for i in coder.encode_ordinary(p)] == want
    assert "".join(bpe.parts(text, 7)) == text
    found = list(bpe.matches(text, 7, 2))
    assert "".join(p for p, _ in found) == text
    assert [i for p, whole in found for i in (coder._encode_single_piece(p) if whole else coder.encode_ordinary(p))] == want


def slow_split(text):
    """The pattern's matches by another engine of regular expressions."""
    import public_tokenizers
    import regex

    white = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"
    pattern = public_tokenizers.PATTERN.replace("[^\\s", "[^" + white[1:-1]).replace("\\s+(?!\\S)", f"{white}+(?={white}|$(?!\\n))").replace("\\s+", f"{white}+")
    return regex.findall(pattern, text, regex.V0)


@pytest.mark.parametrize("text", [" " * 5_000_000, "a" + "\n" * 5_000_000, "x" + " \n" * 500_000 + "é y", "\u3000" * 300_000 + "世", "a" * 5_000_000, "世界" * 300_000, "я" * 1_000_000, "世界。" * 100_000, "слово слово, " * 50_000, "!" * 1_000_000, "1" * 1_000_000, "end" + " " * 5000 + "\t", " " * 5000 + "'s", "a" + " " * 4096 + "b" + " " * 4095 + "c"], ids=lambda t: f"{len(t)}-{ord(t[0]):x}")
def test_bpe_of_very_long_runs(text):
    coder, _ = bpe.encoder()
    want, known = [], {}
    for m in slow_split(text):
        if m not in known:
            known[m] = coder._encode_single_piece(m)
        want += known[m]
    found = bpe.encode(text)
    assert found == want
    assert bpe.decode(found) == text.encode()


def test_bpe_cuts_long_texts_of_other_scripts():
    for text in ("слово слово, " * 100_000, "世界。" * 300_000, "한국어 " * 200_000):
        assert max(map(len, bpe.parts(text))) < 2 * bpe.PART_CHARS


# op 1


def der(*parts: bytes, tag: int = 0x30) -> bytes:
    body = b"".join(parts)
    n = len(body)
    return bytes([tag]) + (bytes([n]) if n < 128 else bytes([0x82]) + n.to_bytes(2, "big")) + body


def integer(x: int) -> bytes:
    return der(x.to_bytes(x.bit_length() // 8 + 1, "big"), tag=2)


RSA = der(integer(0), *[integer((1 << 255) + i) for i in range(8)])
CURVE = der(integer(1), der(b"\x07" * 32, tag=4))
SSH = b"openssh-key-v1\x00" + b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b"")) + (1).to_bytes(4, "big") + b"\x00\x00\x00\x04abcd"
b64 = lambda b: base64.b64encode(b).decode()
url = lambda o: base64.urlsafe_b64encode(json.dumps(o).encode()).decode().rstrip("=")


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        (f"key {b64(RSA)} end", ["der"]),
        ("-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(re.findall(".{1,64}", b64(RSA))) + "\n-----END RSA PRIVATE KEY-----", ["der"]),
        (f"x={b64(CURVE)}", ["der"]),
        (f"hex {RSA.hex()}", ["hex", "der"]),
        (f"ssh {b64(SSH)}", ["ssh"]),
        (f"bearer {url({'alg': 'HS256', 'typ': 'JWT'})}.{url({'sub': 1})}.c2ln", ["jwt"]),
        (f"no {b64(RSA[:-3] + b'abcdef')}", []),  # lengths don't fit
        (f"no {url({'typ': 'JWT'})}.{url({'sub': 1})}.c2ln", []),
        ("M" + "A" * 60, []),
        ("Password : 'hunter22' and AKIA" + "A" * 16 + " token=short AKIAAB", ["assign", "access"]),
        ("ſecret=abcdefgh", []),  # a letter that folds to s isn't one in either case
    ],
)
def test_secret_kinds(text, kinds):
    assert [k for _, _, k in secrets.spans(text)] == kinds


@pytest.mark.parametrize("key", [RSA, CURVE, SSH + (8).to_bytes(4, "big") + b"privates"])
@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_secret_keys_in_front_of_many_lines(key, newline):
    lines = newline.join(re.findall(".{1,64}", b64(key).rstrip("=")))
    kind = "ssh" if key.startswith(b"openssh") else "der"
    for n in (0, 1, 10, 63, 64, 100, 1000):
        text = lines + newline + newline.join(["token"] * n) + " of prose"
        assert [s for s in secrets.spans(text) if s[2] != "assign"] == [(0, len(lines), kind)]
    twice = lines + newline + lines + newline + "MAAAAAAAAAAAAAAAAAAAA" + newline + lines + newline + "end of keys"
    assert [s[2] for s in secrets.spans(twice)] == [kind] * 3
    assert not secrets.spans(secrets.redacted(twice, secrets.spans(twice)))


PEM = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(re.findall(".{1,64}", b64(RSA))) + "\n-----END RSA PRIVATE KEY-----\n"


@pytest.mark.parametrize("key", [RSA, CURVE, SSH + (8).to_bytes(4, "big") + b"privates"])
@pytest.mark.parametrize("newline", ["\\n", "\\r\\n", "\n    ", "\r\n\t"])
@pytest.mark.parametrize("armour", [True, False])
def test_secret_keys_escaped_and_indented(key, newline, armour):
    kind, lines = ("ssh" if key.startswith(b"openssh") else "der"), newline.join(re.findall(".{1,64}", b64(key)))
    text = f'{{"key": "{"-----BEGIN PRIVATE KEY-----" + newline if armour else ""}{lines}{newline}{"-----END PRIVATE KEY-----" if armour else "words"}"}}'
    assert secrets.spans(text) == [(text.index(lines), text.index(lines) + len(lines), kind)]


def test_secrets_one_level_down():
    token = f"{url({'alg': 'HS256'})}.{url({'sub': 'someone'})}.c2lnbmF0dXJl"
    for inner, kind in ((PEM, "der"), (PEM.replace("\n", "\r\n"), "der"), (token, "jwt")):
        outer = b64(inner.encode())
        wrapped = "\n".join(re.findall(".{1,76}", outer)) if kind == "der" else outer
        for o in (outer, wrapped):
            text = f"before {o} after, then\nmore prose"
            assert secrets.spans(text) == [(7, 7 + len(o), kind)]
            assert not secrets.spans(secrets.redacted(text, secrets.spans(text)))
    two = b64(PEM.encode()).rstrip("=") + "\n" + b64(PEM.encode())
    assert [k for _, _, k in secrets.spans(two)] == ["der", "der"]
    assert secrets.spans("x " + b64(b"-----BEGIN CERTIFICATE-----\nMIIBsomething that is no key at all, only words\n" * 3)) == []
    assert secrets.spans("LS0tLS1CRUdJTiAAAAAAAAAAAAAA\n" * 20_000) == []


def test_secret_spans_and_mask():
    text = "é token=abcdef01234567890123456789 z"
    found = secrets.spans(text)
    assert secrets.joined(found) == "assign:2:34,hex:8:34"
    assert secrets.redacted(text, found) == f"é {secrets.MASK} z"
    assert secrets.spans(None) == secrets.spans("") == []


def test_secret_scan(spark, docs_of, odd, sample):
    texts = odd + [t for _, t in sample]
    rows = {r["doc_id"]: r for r in secrets.scan(docs_of(texts)).collect()}
    for i, t in enumerate(texts):
        base = [("assign", m.start(), m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t or "", re.I | re.A) if len(m[2]) >= 6]
        base += [(k, m.start(), m.end()) for k, p, n in (("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24)) for m in re.finditer(p, t or "") if len(m[0]) >= n]
        base.sort(key=lambda s: (s[1], secrets.KINDS.index(s[0])))
        assert rows[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [rows[i][f"n_{k}"] for k in secrets.KINDS[:3]] == [sum(b[0] == k for b in base) for k in secrets.KINDS[:3]]
    masked = {r["doc_id"]: r for r in secrets.redact(docs_of(texts)).collect()}
    assert len(masked) == len(texts) and masked[0]["text"] is None and masked[0]["score"] == "x"
    assert all(masked[i]["n_chars"] == len(masked[i]["text"]) for i in range(1, len(texts)))
    assert not any(rows_["spans"] for rows_ in secrets.scan(secrets.redact(docs_of(texts))).collect())


# op 9


def test_library_ids(odd, sample):
    coder = packing.tokenizer().coder
    texts = [t or "" for t in odd] + ["don't WE'LL", "<|endoftext|> x", "Á Ünï ١ 12³", "İx ſ \x1c a b", "naïve-co-op..."] + [t for _, t in sample]
    for t, ids in zip(texts, packing.Vocabulary().encode_all(texts), strict=True):
        assert ids.tolist() == coder.encode(t, add_special_tokens=False).ids
    assert packing.Vocabulary().encode_all([]) == []


def test_words_with_one_hash_are_told_apart(sample, monkeypatch):
    """All words of up to 2 and of up to 9 characters share a hash: only the comparison of characters keeps them apart."""
    coder, texts = packing.tokenizer().coder, [t for _, t in sample[:30]]
    plain = packing.Vocabulary.slots
    monkeypatch.setattr(packing.common, "mix", lambda h: np.where(h % np.uint64(3) == 0, np.uint64(1 << 50), h))
    v = packing.Vocabulary()
    for t, ids in zip(texts, v.encode_all(texts), strict=True):
        assert ids.tolist() == coder.encode(t, add_special_tokens=False).ids
    assert plain is packing.Vocabulary.slots and v.known < len({w.lower() for t in texts for w in t.split()})


def test_repeated_rows_spread_over_groups(docs_of):
    rows = packing.pack(docs_of(["the same row of words " * 60] * 4000, [7] * 4000)).collect()
    loads = {}
    for r in rows:
        loads[r["sequence_id"] >> 24] = loads.get(r["sequence_id"] >> 24, 0) + r["length"]
    assert sum(loads.values()) == 4000 * rows[0]["doc_tokens"]
    assert len(loads) > 1 and max(loads.values()) < 2 * packing.WINDOWS * packing.CAPACITY


def test_words_are_forgotten_and_learned_again(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 3)
    v = packing.Vocabulary()
    for t in ("one two three four", "five six", "one two seven"):
        assert v.encode_all([t])[0].tolist() == v.coder.encode(t, add_special_tokens=False).ids


@given(st.lists(st.integers(1, 512), min_size=1, max_size=120))
@settings(max_examples=60, deadline=None)
def test_windows_hold_all_and_fit(sizes):
    sizes = np.array(sizes)
    window = packing.windows(sizes, 4096)
    loads = np.bincount(window, sizes)
    assert len(window) == len(sizes) and loads.max() <= 4096
    assert len(loads) <= -(-sizes.sum() // 4096) + 1
    if len(sizes) > 60:
        assert loads.max() - loads.min() <= 200


def test_differencing_known_case():
    sums = sorted(np.bincount(packing.differencing(np.array([8, 7, 6, 5, 4]), 2), [8, 7, 6, 5, 4]))
    assert sums == [14, 16]  # what the differencing method gives for this textbook set


def check_packing(rows, texts):
    coder = packing.tokenizer().coder
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(range(len(texts)))
    for i, parts in by_doc.items():
        ids = np.array([*coder.encode(texts[i] or "", add_special_tokens=False).ids, packing.END], "<u4")
        at = 0
        for r in sorted(parts, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.CAPACITY
    return by_sequence


def test_packing(spark, docs_of, odd, sample):
    texts = odd + [t for _, t in sample]
    rows = packing.pack(docs_of(texts)).collect()
    sequences = check_packing(rows, texts)
    assert len(sequences) <= sum(r["length"] for r in rows) / packing.CAPACITY * 1.1 + 1
    assert packing.pack(docs_of([])).count() == 0


# op 8


def test_folding():
    assert toxicity.fold("Іdiоt 1D10T st​upid m0r0n! $tupid x@y") == " idiot idiot stupid moron  stupid xay "
    assert toxicity.fold("") == "  "


def test_lexicon_stems_exceptions_and_length():
    clean = [f" w{chr(97 + i % 26)} of the w{chr(97 + i // 26)} not a foolish idea " for i in range(200)]
    toxic = [f" you gruvon{chr(97 + i % 26)} w{chr(97 + i // 26)} foolish thing " for i in range(100)]
    model = toxicity.learn(toxic, clean, 1 / 3)
    assert any(t.startswith("gruvon"[: len(t)]) and not t.endswith(" ") for t in model.terms)
    m = toxicity.Matcher(model)
    assert m.score("you gruvonzz") > 0.5 > m.score("a foolish idea of the")
    assert m.score("you gruvonzz") > m.score("you gruvonzz " + "of the " * 2000)
    spared = toxicity.Matcher(toxicity.Model({"gruvon": 3.0}, ("gruvona bird",), (1.0, 1.0), 0.0))
    assert spared.weight(" a gruvona bird ") == 0 < spared.weight(" a gruvona dog ")


WORDS = ["bad", "badly", "good", "dog", "b4d", "not", "so"]


@given(st.lists(st.sampled_from(WORDS), max_size=25), st.dictionaries(st.sampled_from(["bad", "bad ", "badl", "go", "dog "]), st.floats(0.5, 3), min_size=1), st.sets(st.sampled_from(["not bad", "bad dog", "badly so", "good", "so good dog"])))
@settings(max_examples=200, deadline=None)
def test_weight_by_naive_search(words, terms, spared):
    text = toxicity.fold(" ".join(words))
    want = 0.0
    places = [(i, i + len(p) + 2) for p in spared for i in range(len(text)) if text.startswith(f" {p} ", i)]
    for t, w in terms.items():
        for i in range(len(text)):
            if text.startswith(f" {t}", i) and not any(a <= i and i + len(t) + 1 <= b for a, b in places):
                want += w
    found = toxicity.Matcher(toxicity.Model(terms, tuple(sorted(spared)), (1.0, 1.0), 0.0)).weight(text)
    assert found == pytest.approx(want)


def test_many_hits_and_spared_phrases_in_one_text():
    matcher = toxicity.Matcher(toxicity.Model({"bad": 1.0}, ("bad dog",), (1.0, 1.0), 0.0))
    assert matcher.weight(toxicity.fold("bad dog bad cat " * 100_000)) == 100_000


def test_texts_on_executors_teach_what_a_list_teaches(spark):
    docs = common.read(spark, "/root/testdata/sf0.01", "documents")
    labels = common.read(spark, "/root/testdata/sf0.01", "labels")
    rows = labels.where(~toxicity.held_out(labels["doc_id"])).join(docs, "doc_id").select("toxic", "text").collect()
    by = [[toxicity.fold(r["text"]) for r in rows if r["toxic"] == k] for k in (0, 1)]
    want = toxicity.learn(by[1], by[0], len(by[1]) / len(rows))
    found = toxicity.train(docs.union(docs), labels)
    assert want.terms and found.terms.keys() == want.terms.keys() and found.exceptions == want.exceptions
    assert [*found.terms.values(), *found.factors, found.offset] == pytest.approx([*want.terms.values(), *want.factors, want.offset])


def auc(scores, labels):
    by = sorted(zip(scores, labels, strict=True))
    ranks: dict = {}
    for i, (x, _) in enumerate(by, 1):
        ranks.setdefault(x, []).append(i)
    mean = {x: sum(r) / len(r) for x, r in ranks.items()}
    bad = sum(labels)
    return (sum(mean[x] for x, y in by if y) - bad * (bad + 1) / 2) / (bad * (len(by) - bad))


def test_toxicity_held_out(spark):
    rows = toxicity.op8_toxicity(spark, "/root/testdata/sf0.1").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").where("held_out").collect()
    assert all((r["score"] >= 0.5) == bool(r["predicted"]) and 0 <= r["score"] <= 1 for r in rows)
    assert sum(r["predicted"] == r["toxic"] for r in rows) / len(rows) > 0.97
    assert auc([r["score"] for r in rows], [r["toxic"] for r in rows]) > 0.93


def test_toxicity_without_labels(spark, docs_of, odd):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.train(docs_of(odd), labels)
    rows = toxicity.score(docs_of(odd), model).collect()
    assert len(rows) == len(odd) and all(r["score"] < 0.5 for r in rows)
    assert toxicity.accepted(docs_of(odd), model).count() == len(odd)
    nulls = spark.createDataFrame([(1, None, None), (1, 1, 1), (None, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.score(docs_of(odd), toxicity.train(docs_of(odd), nulls)).count() == len(odd)


# op 10


def check_shards(rows, texts, shards_=40):
    assert len(rows) == len(texts)
    slots, sizes = {}, {}
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(data) + 16 and r["text_crc32"] == zlib.crc32(data) and r["law"] == "bytes" and r["grown_shard"] is None
        assert 0 <= r["shard"] < shards_
        slots.setdefault(r["shard"], []).append(r["slot"])
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes


def test_shards(spark, docs_of, odd):
    texts = odd + [f"text number {i % 1500} " * 5 for i in range(3000)] + ["the same text"] * 1500
    rows = shards.shard(docs_of(texts)).collect()
    sizes = check_shards(rows, texts)
    assert len(sizes) > 35  # a text larger than a shard leaves some empty
    of = {}
    for r in rows:
        of.setdefault(texts[r["doc_id"]] or "", set()).add(r["shard"])
    assert sum(len(s) > 1 for t, s in of.items() if t != "the same text") <= 40
    big = len("x" * 70000)
    small = [s for s in sizes.values() if s < big]
    assert max(small) <= 1.3 * sum(small) / len(small)
    assert shards.shard(docs_of([])).count() == 0
    check_shards(shards.shard(docs_of(["a"])).collect(), ["a"])


@pytest.mark.parametrize("seed", range(6))
def test_heavy_texts_leave_the_other_shards_even(seed):
    """Rows placed one by one, then light weight poured into the rest: no shard without a text that outweighs it is uneven."""
    rng = np.random.default_rng(seed)
    heavy = [(int(s), i, i, i, 1) for i, s in enumerate(rng.integers(3_000, 9_000 * 10 ** rng.integers(1, 2, endpoint=True), rng.integers(0, 60)))]
    light = 40_000 * 40
    total = light + sum(r[0] for r in heavy)
    of, leaves = shards.place(heavy, total, 40)
    assert set(of) == {r[:4] for r in heavy}
    loads = np.zeros(40)
    for r in heavy:
        loads[of[r[:4]]] += r[0]
    full = loads.copy()
    for s, t in leaves:
        full[s] += light * t / sum(t for _, t in leaves)
    assert np.isclose(full.sum(), total)
    even = [f for f, h in zip(full, loads, strict=True) if h <= total / 40]
    assert max(even) - min(even) <= 0.05 * total / 40


def test_shards_with_heavy_and_repeated_texts(spark, docs_of):
    heavy = ["y" * n for n in (90_000, 30_000, 30_000, 5_000, 5_000, 4_000)]
    texts = [f"text {i} " * (1 + i % 7) for i in range(2500)] + heavy
    rows = shards.shard(docs_of(texts)).collect()
    sizes = check_shards(rows, texts)
    of = {r["doc_id"]: r["shard"] for r in rows}
    outweighed = {of[i] for i, t in enumerate(texts) if len(t) > sum(sizes.values()) / 40}
    rest = [x for s, x in sizes.items() if s not in outweighed]
    assert max(rest) <= 1.05 * sum(rest) / len(rest) and min(rest) >= 0.9 * sum(rest) / len(rest)
    assert of[2500 + 3] == of[2500 + 4]  # equal texts
    check_shards(shards.shard(docs_of(["z" * 100_000] * 3)).collect(), ["z" * 100_000] * 3)
