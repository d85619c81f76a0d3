"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import byte_bpe, exact_dedup, language_id, language_model, near_dedup, packing, quality, repeated_spans, sharding, vector_search

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": quality.op1_quality,
    "op2_vector_search": vector_search.op2_vector_search,
    "op3_packing": packing.op3_packing,
    "op4_byte_bpe": byte_bpe.op4_byte_bpe,
    "op5_language_model": language_model.op5_language_model,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_near_dedup": near_dedup.op7_near_dedup,
    "op8_sharding": sharding.op8_sharding,
    "op9_repeated_spans": repeated_spans.op9_repeated_spans,
    "op10_language_id": language_id.op10_language_id,
}
ORACLE_SQL: dict[str, str] = {"op6_exact_dedup": exact_dedup.ORACLE_SQL}
