"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Long texts are cut before they are encoded, at places that no match of the split pattern can cross: in front of white space
that follows anything else, and in front of a punctuation mark that follows a letter of a large script. Such a cut leaves every
match as it was, so the ids of the parts, joined, are those of the whole text. A match itself isn't cut, so a text
without such a place goes to the library whole. A run of white space of ``RUN`` characters or more, on which the library's split fails,
is told apart here instead: the pattern takes all of it at the text's end and all but its last character elsewhere, as one match, whose
bytes the library then merges.

Null and empty texts have no ids. Rows with equal doc_id are encoded each for itself; further columns are ignored.
Very long texts are encoded whole, however they are made up. An empty table gives an empty table.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

RANKS = "byte_bpe_multi_50k.tiktoken"
PART_CHARS, RUN = 1 << 15, 1 << 12
# The characters with Unicode's property White_Space.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
# Letters by every version of Unicode, and marks that are neither letters, numbers nor white space.
_LETTER, _MARK = "A-Za-z\\u0391-\\u03a1\\u03a3-\\u03ce\\u0410-\\u044f\\u05d0-\\u05ea\\u0627-\\u063a\\u3041-\\u3096\\u30a1-\\u30fa\\u4e00-\\u9fa5\\uac00-\\ud7a3", "!-/:-@\\[-`{-~\\u3001\\u3002\\uff01\\uff0c\\uff1a\\uff1b\\uff1f"
_CUT = re.compile(f"(?<=[^{_WHITE}])(?=[{_WHITE}])|(?<=[{_LETTER}])(?=[{_MARK}])")


@functools.lru_cache(maxsize=4)
def _long_run(size: int) -> re.Pattern:
    return re.compile(f"[{_WHITE}]{{{size},}}")


@functools.lru_cache(maxsize=2)
def encoder(ranks: str = RANKS):
    """The tiktoken encoding and the bytes of each id."""
    import public_tokenizers
    import tiktoken

    with open(common.worker_path(ranks), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    return coder, {rank: piece for piece, rank in table.items()}


def parts(text: str, limit: int = PART_CHARS) -> Iterator[str]:
    """The text in parts of about ``limit`` characters, cut only where the ids don't change."""
    at = 0
    while len(text) - at > limit:
        cut = _CUT.search(text, at + limit)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def matches(text: str, limit: int = PART_CHARS, run: int = RUN) -> Iterator[tuple[str, bool]]:
    """The text in order as parts of any number of matches (False) and long runs of white space that are one match (True)."""
    at = 0
    for white in _long_run(run).finditer(text):
        end = white.end() if white.end() == len(text) else white.end() - 1  # the last one may belong to what follows
        if white.start() > at:
            yield from ((p, False) for p in parts(text[at : white.start()], limit))
        yield text[white.start() : end], True
        at = end
    if at < len(text):
        yield from ((p, False) for p in parts(text[at:], limit))


def encode(text: str | None, ranks: str = RANKS) -> list[int]:
    coder, _ = encoder(ranks)
    if not text:
        return []
    if len(text) < RUN:
        return coder.encode_ordinary(text)
    return [i for part, whole in matches(text) for i in (coder._encode_single_piece(part) if whole else coder.encode_ordinary(part))]


def decode(ids: list[int], ranks: str = RANKS) -> bytes:
    """The raw bytes of the ids; they need not be whole UTF-8 characters."""
    _, pieces = encoder(ranks)
    return b"".join(map(pieces.__getitem__, ids))


def encode_table(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id and ids (array<int>) of every row."""

    def run(batches):
        for batch in common.slices(batches):
            ids = [encode(t, ranks) for t in batch.column("text").to_pylist()]
            yield common.batch_of(doc_id=batch.column("doc_id"), ids=pa.array(ids, pa.list_(pa.int32())))

    return common.ids_back(common.texts_of(docs).mapInArrow(run, "doc_id long, ids array<int>"))


def decode_table(encoded: DataFrame, ranks: str = RANKS) -> DataFrame:
    """doc_id and data (binary): the bytes that the ids stand for."""

    def run(batches):
        for batch in batches:
            data = [decode(ids or [], ranks) for ids in batch.column("ids").to_pylist()]
            yield common.batch_of(doc_id=batch.column("doc_id"), data=pa.array(data, pa.binary()))

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def digests(docs: DataFrame, ranks: str = RANKS) -> DataFrame:
    """One row per document: the number of ids, and the digests of the ids and of the bytes decoded from them.

    Encoding, decoding and digests run in one pass over the scan; nothing is shuffled.
    """

    def run(batches):
        _, pieces = encoder(ranks)
        names = {i: str(i) for i in pieces}
        for batch in common.slices(batches):
            counts, ids_sha, back_sha = [], [], []
            for text in batch.column("text").to_pylist():
                ids = encode(text, ranks)
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
                back_sha.append(hashlib.sha256(decode(ids, ranks)).hexdigest())
            yield common.batch_of(doc_id=batch.column("doc_id"), n_tokens=pa.array(counts, pa.int64()), ids_sha256=pa.array(ids_sha, pa.string()), decoded_sha256=pa.array(back_sha, pa.string()))

    return common.ids_back(common.texts_of(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(common.read(spark, sf_dir, "documents"))
