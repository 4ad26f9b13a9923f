"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import bpe, exact_dedup, fingerprints, language_id, merkle, mixing, near_dedup, packing, quality, resampling, secrets_scan, token_counts, toxicity

QUERIES = {
    "op1_mixing": mixing.op1,
    "op2_near_dedup": near_dedup.op2,
    "op3_toxicity": toxicity.op3,
    "op4_exact_dedup": exact_dedup.op4,
    "op5_language_id": language_id.op5,
    "op6_secret_scan": secrets_scan.op6,
    "op7_fingerprints": fingerprints.op7,
    "op8_token_counts": token_counts.op8,
    "op9_packing": packing.op9,
    "op10_quality": quality.op10,
    "op11_merkle_manifest": merkle.op11,
    "op12_resampling": resampling.op12,
    "op13_bpe": bpe.op13,
}

ORACLE_SQL = {"op1_mixing": mixing.SQL, "op4_exact_dedup": exact_dedup.SQL, "op11_merkle_manifest": merkle.SQL, "op12_resampling": resampling.SQL}
