"""Those columns of some operators that SQL can express, as queries with their SQL for DuckDB.

The operators' own queries return more than SQL can (structure found by decoding, learned scores, tokens, cuts of a tree). Each query here
is such a query without those columns: the operator runs over the whole table as always.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, lm, secrets, shards

DIGITS = 6  # sums of logarithms are taken in another order by each engine


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.op1_secrets(spark, sf_dir).drop("spans")


def bpe_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decoded ids are the text."""
    return bpe.op4_byte_bpe(spark, sf_dir).select("doc_id", "decoded_sha256")


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.op6_lm_scores(spark, sf_dir).drop("score").withColumn("base_score", F.round("base_score", DIGITS))


def shards_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.op10_shards(spark, sf_dir).select("doc_id", "size", "text_crc32", "law")


def _crc32(numbers: str) -> str:
    """CRC-32, bit by bit, of a list of bytes."""
    bit = "lambda a, s: xor(a >> 1, (a & 1) * 3988292384::ubigint)"
    return f"xor(list_reduce([4294967295::ubigint] || {numbers}, lambda crc, b: list_reduce([xor(crc, b)] || range(8)::ubigint[], {bit})), 4294967295)::bigint"


_NAME = "[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]"
_ASSIGN = f"({_NAME})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"


def _matches(kind: int, pattern: str, group: int) -> str:
    return f"select r, {kind} as kind, regexp_extract_all(t, '{pattern}') as hits, regexp_extract_all(t, '{pattern}', {group}) as vals, string_split_regex(t, '{pattern}') as gaps from d"


# a match begins where the gaps and matches before it end
SECRETS_BASE = f"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
m as ({_matches(0, _ASSIGN, 2)} union all {_matches(1, "AKIA[A-Z0-9]+", 0)} union all {_matches(2, "[0-9a-f]+", 0)}),
each as (select r, kind, unnest(hits) as hit, unnest(vals) as val, unnest(gaps[1 : len(hits)]) as gap, generate_subscripts(hits, 1) as i from m where len(hits) > 0),
placed as (select r, kind, val, length(hit) as size, sum(length(gap) + length(hit)) over (partition by r, kind order by i) as stop from each),
good as (select r, kind, (stop - size)::bigint as start, stop::bigint as stop from placed where length(val) >= [6, 20, 24][kind + 1]),
found as (select r, count(*) filter (kind = 0) as a, count(*) filter (kind = 1) as b, count(*) filter (kind = 2) as h,
  string_agg(['assign', 'access', 'hex'][kind + 1] || ':' || start || ':' || stop, ',' order by start, kind) as joined from good group by r)
select doc_id, coalesce(a, 0) as n_assign, coalesce(b, 0) as n_access, coalesce(h, 0) as n_hex, sha256(coalesce(joined, '')) as base_sha256
from d left join found on d.r = found.r
"""

BPE_DECODED = "select doc_id, sha256(coalesce(text, '')) as decoded_sha256 from documents"

# a blank stands for the end token, as no word is one
LM_BASE = f"""
with d as (select row_number() over () as r, doc_id, {_crc32("list_transform(string_split(doc_id::varchar, ''), lambda x: ascii(x)::ubigint)")} % 10 = 0 as held_out,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
tokens as (select r, held_out, unnest(list_append(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+'), ' ')) as token from d),
counts as (select token, count(*) as c from tokens where not held_out group by token),
sums as (select coalesce(sum(c), 0)::bigint as n, count(*) as v from counts),
scored as (select r, count(*) as n_tokens, count(c) as n_known, sum(log10((coalesce(c, 0) + 0.1::double) / (n + 0.1::double * (v + 1)))) as base_score
  from tokens left join counts on tokens.token = counts.token cross join sums group by r)
select doc_id, held_out, n_tokens, n_known, n as train_tokens, round(base_score, {DIGITS}) as base_score from d join scored on d.r = scored.r cross join sums
"""

SHARDS_SIZES = f"""
with b as (select doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::ubigint) as bytes from documents)
select doc_id, len(bytes)::bigint + 16 as size, {_crc32("bytes")} as text_crc32, 'bytes' as law from b
"""

QUERIES = {"secrets_base": secrets_base, "bpe_decoded": bpe_decoded, "lm_base": lm_base, "shards_sizes": shards_sizes}
SQL = {"secrets_base": SECRETS_BASE, "bpe_decoded": BPE_DECODED, "lm_base": LM_BASE, "shards_sizes": SHARDS_SIZES}
