"""The queries of this subpackage and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from faultline.llm import hard_negatives, quality_rules
from faultline.llm.bit_planes import op1_bit_planes
from faultline.llm.chat_format import op3_typed_parts
from faultline.llm.decontaminate import op9_benchmark_leaks
from faultline.llm.importance import op12_target_resampling
from faultline.llm.license_scan import op10_license_scan
from faultline.llm.near_dup import op4_superminhash
from faultline.llm.personal_data import op7_revealing_terms
from faultline.llm.pieces import op5_unigram_pieces
from faultline.llm.quality_model import op6_ftrl_quality
from faultline.llm.secrets import op8_secret_field
from faultline.llm.token_counts import op11_prefix_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bit_planes": op1_bit_planes,
    "op2_quality_ratio": quality_rules.op2_quality_ratio,
    "op3_typed_parts": op3_typed_parts,
    "op4_superminhash": op4_superminhash,
    "op5_unigram_pieces": op5_unigram_pieces,
    "op6_ftrl_quality": op6_ftrl_quality,
    "op7_revealing_terms": op7_revealing_terms,
    "op8_secret_field": op8_secret_field,
    "op9_benchmark_leaks": op9_benchmark_leaks,
    "op10_license_scan": op10_license_scan,
    "op11_prefix_counts": op11_prefix_counts,
    "op12_target_resampling": op12_target_resampling,
    "op13_anchor_trees": hard_negatives.op13_anchor_trees,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {"op2_quality_ratio": quality_rules.ORACLE, "op13_anchor_trees": hard_negatives.ORACLE}
