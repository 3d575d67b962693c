"""The queries of this subpackage and, where SQL can express them, their SQL for DuckDB."""

from __future__ import annotations

from . import ann, bpe, exact, lm, neardup, packing, parts, secrets, shards, substrings, toxicity


def queries() -> dict:
    return {
        "op1_secrets": secrets.op1_secrets,
        "op2_near_dedup": neardup.op2_near_dedup,
        "op3_exact": exact.op3_exact,
        "op4_byte_bpe": bpe.op4_byte_bpe,
        "op5_ann": ann.op5_ann,
        "op6_lm_scores": lm.op6_lm_scores,
        "op7_substrings": substrings.op7_substrings,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_packing": packing.op9_packing,
        "op10_shards": shards.op10_shards,
        **parts.QUERIES,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_exact": exact.ORACLE, "op7_substrings": substrings.ORACLE, **parts.SQL}
