"""The registered queries of this subpackage and the SQL that states their results."""

from __future__ import annotations

from cellweave.llm import decontam, jaccard, language, media, mixing, quality, secrets, sharding, substrings, urls


def queries() -> dict:
    return {
        "op1_url_filters": urls.op1,
        "op2_jaccard_join": jaccard.op2,
        "op3_sharding": sharding.op3,
        "op4_mixing": mixing.op4,
        "op5_secret_scans": secrets.op5,
        "op6_language_model": language.op6,
        "op7_quality_classifier": quality.op7,
        "op8_media_columns": media.op8,
        "op9_suffix_dedup": substrings.op9,
        "op10_decontamination": decontam.op10,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filters": urls.OP1_SQL,
        "op4_mixing": mixing.mix_sql(),
    }
