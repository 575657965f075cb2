"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from . import decontaminate, language, licenses, media, mixing, near_dedup, substring_dedup, tokens, toxicity, url_filter


def queries() -> dict:
    """Operators whose rows SQL can't express (2, 3, 5, 6, 7, 9, 10) are tested against brute force instead."""
    return {
        "op1_near_dedup": near_dedup.op1_near_dedup,
        "op2_substring_dedup": substring_dedup.op2_substring_dedup,
        "op3_tokens": tokens.op3_tokens,
        "op4_decontaminate": decontaminate.op4_decontaminate,
        "op5_language": language.op5_language,
        "op6_media": media.op6_media,
        "op7_toxicity": toxicity.op7_toxicity,
        "op8_url_filter": url_filter.op8_url_filter,
        "op9_licenses": licenses.op9_licenses,
        "op10_mixing": mixing.op10_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_near_dedup": near_dedup.OP1_SQL,
        "op4_decontaminate": decontaminate.OP4_SQL,
        "op8_url_filter": url_filter.OP8_SQL,
    }
