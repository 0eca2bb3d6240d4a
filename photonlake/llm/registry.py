"""Queries of the training-data operators and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from photonlake.llm import language_id, license_scan, line_dedup, media, minhash, mixing, packing, pipeline, quality, suffix_dedup, vector_dedup


def queries() -> dict:
    return {
        "pipeline": pipeline.run,
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_quality_classifier": quality.op2_quality_classifier,
        "op3_language_id": language_id.op3_language_id,
        "op4_source_mixing": mixing.op4_source_mixing,
        "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
        "op6_media_columns": media.op6_media_columns,
        "op7_vector_near_dedup": vector_dedup.op7_vector_near_dedup,
        "op8_best_fit_packing": packing.op8_best_fit_packing,
        "op9_minhash_near_dedup": minhash.op9_minhash_near_dedup,
        "op10_license_scan": license_scan.op10_license_scan,
    }


def oracles() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.ORACLE, "op4_source_mixing": mixing.ORACLE}
