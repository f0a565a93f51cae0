"""The queries of this subpackage and their DuckDB SQL, where SQL can express them."""

from __future__ import annotations

from . import jaccard, language, licenses, ogg, packing, pieces, pii, quality, tokenids, toxicity


def queries() -> dict:
    return {
        "op1_packing": packing.query,
        "op2_token_ids": tokenids.query,
        "op3_pii": pii.query,
        "op4_ogg": ogg.query,
        "op5_licenses": licenses.query,
        "op6_pieces": pieces.query,
        "op7_language": language.query,
        "op8_jaccard_join": jaccard.query,
        "op9_toxicity": toxicity.query,
        "op10_quality_rules": quality.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_licenses": licenses.SQL, "op8_jaccard_join": jaccard.SQL, "op10_quality_rules": quality.SQL}
