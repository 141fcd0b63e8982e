"""The queries of this subpackage, one an operator, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    op01_sentencepiece,
    op02_licenses,
    op03_ctw,
    op04_topk,
    op05_near_dedup,
    op06_mixing,
    op07_rules,
    op08_kneser_ney,
    op09_sharding,
    op10_pii,
    op11_whitening,
    op12_language,
    op13_resampling,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op01_sentencepiece.query,
    "op2_license_scan": op02_licenses.query,
    "op3_context_tree": op03_ctw.query,
    "op4_exact_topk": op04_topk.query,
    "op5_near_dedup": op05_near_dedup.query,
    "op6_mixing": op06_mixing.query,
    "op7_quality_rules": op07_rules.query,
    "op8_kneser_ney": op08_kneser_ney.query,
    "op9_sharding": op09_sharding.query,
    "op10_pii": op10_pii.query,
    "op11_whitening": op11_whitening.query,
    "op12_language": op12_language.query,
    "op13_resampling": op13_resampling.query,
}

#: SQL where it expresses the operator.
ORACLES: dict[str, str] = {
    "op4_exact_topk": op04_topk.SQL,
    "op6_mixing": op06_mixing.SQL,
    "op13_resampling": op13_resampling.SQL,
}
