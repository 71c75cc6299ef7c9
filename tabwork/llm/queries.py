"""The queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from . import chat_format, knn_join, lexical, line_dedup, manifest, mixing, oracles, packing, parity_join, quality_rules, secret_scan, sharding, token_counts, toxicity


def queries() -> dict:
    return {
        "op1_token_counts": token_counts.op1_token_counts,
        "op2_chat_formatting": chat_format.op2_chat_formatting,
        "op3_parity_join": parity_join.op3_parity_join,
        "op4_quality_rules": quality_rules.op4_quality_rules,
        "op5_voronoi_knn": knn_join.op5_voronoi_knn,
        "op6_secret_scan": secret_scan.op6_secret_scan,
        "op7_best_fit_packing": packing.op7_best_fit_packing,
        "op8_mixing": mixing.op8_mixing,
        "op9_sharding": sharding.op9_sharding,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_line_dedup": line_dedup.op11_line_dedup,
        "op12_lexical_search": lexical.op12_lexical_search,
        "op13_merkle_manifest": manifest.op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat_formatting": chat_format.oracle(),
        "op4_quality_rules": oracles.quality_sql(),
        "op5_voronoi_knn": knn_join.ORACLE,
        "op6_secret_scan": oracles.secrets_sql(),
        "op8_mixing": oracles.mixing_sql(),
        "op11_line_dedup": line_dedup.ORACLE,
        "op12_lexical_search": lexical.ORACLE,
        "op13_merkle_manifest": manifest.ORACLE,
    }
