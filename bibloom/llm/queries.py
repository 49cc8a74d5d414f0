"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from bibloom.llm import exact_dedup, hadamard_clusters, license_scan, media, near_dedup, packing, pca_tiles, pieces, pii, quality, secret_scan, segment_negatives, sharding


def queries() -> dict:
    return {
        "op1_length_buckets": packing.query,
        "op2_secret_ledger": secret_scan.query,
        "op3_exact_dedup": exact_dedup.query,
        "op4_bayes_minhash": near_dedup.query,
        "op5_latent_vote": quality.query,
        "op6_two_pass_shuffle": sharding.query,
        "op7_piece_offsets": pieces.query,
        "op8_webp_lossless": media.query,
        "op9_pii_disclosure": pii.query,
        "op10_license_index": license_scan.query,
        "op11_pca_tiles": pca_tiles.query,
        "op12_hadamard_clusters": hadamard_clusters.query,
        "op13_segment_negatives": segment_negatives.query,
    }


def oracle_sql() -> dict:
    return {
        "op3_exact_dedup": exact_dedup.ORACLE,
        "op11_pca_tiles": pca_tiles.ORACLE,
        "op12_hadamard_clusters": hadamard_clusters.ORACLE,
        "op13_segment_negatives": segment_negatives.ORACLE,
    }
