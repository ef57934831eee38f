"""Training-data operators; nothing else in the library imports this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import hnsw, langid, license_scan, line_dedup, mixing, ngram_join, packing, pii, quality_rules, toxicity

    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_langid": langid.op3_langid,
        "op4_packing": packing.op4_packing,
        "op5_ngram_join": ngram_join.op5_ngram_join,
        "op6_license_scan": license_scan.op6_license_scan,
        "op7_line_dedup": line_dedup.op7_line_dedup,
        "op8_quality_rules": quality_rules.op8_quality_rules,
        "op9_pii": pii.op9_pii,
        "op10_hnsw": hnsw.op10_hnsw,
    }


def oracle_sql() -> dict[str, str]:
    from . import license_scan, line_dedup, ngram_join, quality_rules

    return {
        "op5_ngram_join": ngram_join.SQL,
        "op6_license_scan": license_scan.SQL,
        "op7_line_dedup": line_dedup.SQL,
        "op8_quality_rules": quality_rules.SQL,
    }
