"""The operators' queries over whole tables, and their DuckDB SQL."""

from __future__ import annotations

from rampstat.llm import (class_lm, decontamination, exact_dedup, fill_in_middle, license_scan, line_dedup, near_dedup, packing, passages, quality, sharding,
                          vector_codes, warc)

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_benchmark_decontamination": decontamination.op2_benchmark_decontamination,
    "op3_warc_salvage": warc.op3_warc_salvage,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_extendible_sharding": sharding.op5_extendible_sharding,
    "op6_brown_class_lm": class_lm.op6_brown_class_lm,
    "op7_repeated_passages": passages.op7_repeated_passages,
    "op8_license_scan": license_scan.op8_license_scan,
    "op9_minhash_near_dedup": near_dedup.op9_minhash_near_dedup,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_exact_dedup": exact_dedup.op12_exact_dedup,
    "op13_fill_in_middle": fill_in_middle.op13_fill_in_middle,
}

ORACLE = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op2_benchmark_decontamination": decontamination.ORACLE,
    "op3_warc_salvage": warc.ORACLE,
    "op5_extendible_sharding": sharding.ORACLE,
    "op8_license_scan": license_scan.ORACLE,
    "op11_vector_codes": vector_codes.ORACLE,
    "op12_exact_dedup": exact_dedup.ORACLE,
    "op13_fill_in_middle": fill_in_middle.ORACLE,
}
