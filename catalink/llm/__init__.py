"""Operators of a training-data pipeline, and the queries that apply them."""

from __future__ import annotations


def queries() -> dict:
    from catalink.llm import binary, fingerprint, language, licences, media, mixing, neardup, packing, quality, sharding

    return {
        "op1_fingerprint": fingerprint.op1_fingerprint,
        "op2_neardup": neardup.op2_neardup,
        "op3_language": language.op3_language,
        "op4_licences": licences.op4_licences,
        "op5_media": media.op5_media,
        "op6_binary": binary.op6_binary,
        "op7_packing": packing.op7_packing,
        "op8_quality": quality.op8_quality,
        "op9_mixing": mixing.op9_mixing,
        "op10_sharding": sharding.op10_sharding,
    }


def oracle_sql() -> dict[str, str]:
    from catalink.llm import licences, mixing

    return {"op4_licences": licences.oracle(), "op9_mixing": mixing.OP9_SQL}
