"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, divergence, html, huffman, language, neardup, packing, pii, sharding, spelling, topk, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": toxicity.op1_toxicity,
        "op2_token_files": huffman.op2_token_files,
        "op3_warc": warc.op3_warc,
        "op4_best_two_fit": packing.op4_best_two_fit,
        "op5_personal_data": pii.op5_personal_data,
        "op6_main_text": html.op6_main_text,
        "op7_minimax_shards": sharding.op7_minimax_shards,
        "op8_exact_topk": topk.op8_exact_topk,
        "op9_minhash_classes": neardup.op9_minhash_classes,
        "op10_benchmark_scan": decontaminate.op10_benchmark_scan,
        "op11_source_divergence": divergence.op11_source_divergence,
        "op12_spelling_variants": spelling.op12_spelling_variants,
        "op13_language": language.op13_language,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_warc": warc.OP3_SQL, "op8_exact_topk": topk.OP8_SQL, "op9_minhash_classes": neardup.OP9_SQL, "op10_benchmark_scan": decontaminate.OP10_SQL, "op11_source_divergence": divergence.OP11_SQL}
