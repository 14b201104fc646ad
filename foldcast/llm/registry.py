"""Queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, language, lines, media, mixing, simhash, substring, suffix, topk, toxicity


def queries() -> dict:
    return {
        "op1_line_dedup": lines.op1,
        "op2_media": media.op2,
        "op3_substring_dedup": substring.op3,
        "op4_mixing": mixing.op4,
        "op5_toxicity": toxicity.op5,
        "op6_suffix_dedup": suffix.op6,
        "op7_topk": topk.op7,
        "op8_bpe": bpe.op8,
        "op9_simhash": simhash.op9,
        "op10_language": language.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": lines.OP1_SQL, "op4_mixing": mixing.OP4_SQL, "op7_topk": topk.OP7_SQL}
