"""Rejection waterfall (P3-P13): every row gets exactly one outcome.

The first failing test names the row; ``reason`` is null for rows that pass
all the row-local tests. The ``dup`` outcome needs all rows and is added by
``operators.dedup``. Everything here is a narrow projection (no shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_source_text, is_target_text, py_strip
from ..sources.specs import FilterCfg


def length_reason(ko: Column, en: Column, cfg: FilterCfg) -> Column:
    """len_ko, len_en, ratio (inclusive bounds, code points)."""
    lk, le = F.length(ko), F.length(en)
    ratio = le.cast("double") / F.greatest(lk, F.lit(1)).cast("double")
    return F.coalesce(
        F.when((lk < cfg.char_min) | (lk > cfg.char_max_ko), F.lit("len_ko")),
        F.when((le < cfg.char_min) | (le > cfg.char_max_en), F.lit("len_en")),
        F.when((ratio < cfg.ratio_min) | (ratio > cfg.ratio_max), F.lit("ratio")),
    )


def apply_waterfall(pairs: DataFrame, cfg: FilterCfg = FilterCfg()) -> DataFrame:
    """pairs(source, priority, ord, ko_raw, en_raw, score, ...) ->
    (..., ko, en, reason) with ko/en stripped; raw columns dropped.

    Stripping is its own projection: the optimizer keeps a non-trivial
    expression that is used several times above it from being inlined, so
    each side is stripped once per row."""
    keep = [c for c in pairs.columns if c not in ("ko_raw", "en_raw")]
    stripped = pairs.select(
        *keep,
        F.col("ko_raw").isNull().alias("_cf_kn"),
        F.col("en_raw").isNull().alias("_cf_en"),
        py_strip(F.col("ko_raw")).alias("ko"),
        py_strip(F.col("en_raw")).alias("en"),
    )
    reason = F.coalesce(
        F.when(F.col("_cf_kn") | F.col("_cf_en"), F.lit("schema")),
        F.when((F.length("ko") == 0) | (F.length("en") == 0), F.lit("empty")),
        F.when(~is_source_text(F.col("ko"), cfg.src_pattern), F.lit("not_ko")),
        F.when(~is_target_text(F.col("en"), cfg.tgt_pattern, cfg.src_pattern), F.lit("not_en")),
        length_reason(F.col("ko"), F.col("en"), cfg),
    )
    return stripped.select(*keep, "ko", "en", reason.alias("reason"))
