"""The queries that __spark_entry__.py registers for this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import ann, decontamination, language_id, line_dedup, lm, manifest, mixing, near_dedup, negatives, packing, quality, substring_dedup, token_shards

QUERIES = {
    "op1_mix_sources": mixing.query,
    "op2_token_shards": token_shards.query,
    "op3_lm_score": lm.query,
    "op4_nearest": ann.query,
    "op5_line_dedup": line_dedup.query,
    "op6_decontamination": decontamination.query,
    "op7_near_dedup": near_dedup.query,
    "op8_language_id": language_id.query,
    "op9_quality": quality.query,
    "op10_substring_dedup": substring_dedup.query,
    "op11_pack": packing.query,
    "op12_manifest": manifest.query,
    "op13_hard_negatives": negatives.query,
}
ORACLES = {
    "op1_mix_sources": mixing.ORACLE,
    "op5_line_dedup": line_dedup.ORACLE,
    "op6_decontamination": decontamination.ORACLE,
    "op12_manifest": manifest.ORACLE,
    "op13_hard_negatives": negatives.ORACLE,
}
