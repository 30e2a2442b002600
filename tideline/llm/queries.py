"""The subpackage's queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import load
from . import decontaminate, hmm, importance, jaccard, licenses, mixing, quality_rules, suffixes, toxicity, url_filters

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_toxicity": lambda s, d: toxicity.op1(load(s, d, "documents"), load(s, d, "labels")),
        "op2_license_scan": lambda s, d: licenses.op2(load(s, d, "documents")),
        "op3_ngram_jaccard_join": lambda s, d: jaccard.op3(load(s, d, "documents")),
        "op4_source_mixing": lambda s, d: mixing.op4(load(s, d, "documents")),
        "op5_sparse_suffix_dedup": lambda s, d: suffixes.op5(load(s, d, "documents")),
        "op6_hmm_scoring": lambda s, d: hmm.op6(load(s, d, "documents")),
        "op7_url_filters": lambda s, d: url_filters.op7(load(s, d, "pages")),
        "op8_quality_rules": lambda s, d: quality_rules.op8(load(s, d, "documents")),
        "op9_importance_resampling": lambda s, d: importance.op9(load(s, d, "documents"), load(s, d, "labels")),
        "op10_benchmark_decontamination": lambda s, d: decontaminate.op10(load(s, d, "documents"), load(s, d, "benchmark")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_source_mixing": mixing.SQL,
        "op7_url_filters": url_filters.SQL,
        "op8_quality_rules": quality_rules.SQL,
    }
