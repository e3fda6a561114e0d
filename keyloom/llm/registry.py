"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, line_dedup, near_dup, packing, quality_rules, resampling, token_count, tool_calls, topk, url_filter

_MODULES = {
    "op1_tool_calls": tool_calls,
    "op2_resampling": resampling,
    "op3_url_filter": url_filter,
    "op4_topk": topk,
    "op5_best_fit_packing": packing,
    "op6_bpe_tree": bpe,
    "op7_near_dup": near_dup,
    "op8_quality_rules": quality_rules,
    "op9_line_dedup": line_dedup,
    "op10_token_count": token_count,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: module.query for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL for name, module in _MODULES.items() if hasattr(module, "SQL")}
