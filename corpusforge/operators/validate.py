"""Curated test-set validation (V1-V5, D3).

Dataset-level duplicate counts are ``sum(count - 1)`` over groups: one
aggregate with partial aggregation for all of them, and a null id forms one
group as in a Python set. Row-level checks are a narrow ``explode`` of up to three
messages per row; unlike the waterfall, every check runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import py_format
from ..sources.specs import TestsetBounds

ISSUE_COLUMNS = ("scope", "id", "check", "value", "message", "row_ord", "check_no")


def _fmt_bound(x: float) -> str:
    return repr(float(x))


def duplicate_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """D3: (col, n) with n = rows minus distinct values, for several columns in
    one pass. Values are compared by SHA-256, so whole sentences are no
    shuffle keys; nulls are one value. An empty table gives no rows."""
    values = [F.struct(F.lit(c).alias("col"), F.sha2(F.col(c).cast("string"), 256).alias("digest")) for c in cols]
    each = df.select(F.explode(F.array(*values)).alias("v")).groupBy("v.col", "v.digest").agg(F.count(F.lit(1)).alias("held"))
    return each.groupBy("col").agg(F.sum(F.col("held") - 1).alias("n"))


# column, check and label of the dataset-level checks, in order (fixed message labels)
_DATASET_CHECKS = (("id", "dup_id", "duplicate ids"), ("ko", "dup_ko", "duplicate korean sentences"))


def dataset_issues(df: DataFrame) -> DataFrame:
    """V1: duplicate ids and duplicate Korean sentences (exact text)."""
    found = duplicate_counts(df, [c for c, _, _ in _DATASET_CHECKS]).where(F.col("n") > 0)
    no = F.array_position(F.array(*[F.lit(c) for c, _, _ in _DATASET_CHECKS]), F.col("col")).cast("int")
    label = F.element_at(F.array(*[F.lit(x) for _, _, x in _DATASET_CHECKS]), no)
    return found.select(
        F.lit("dataset").alias("scope"),
        F.lit(None).cast("string").alias("id"),
        F.element_at(F.array(*[F.lit(x) for _, x, _ in _DATASET_CHECKS]), no).alias("check"),
        F.col("n").cast("double").alias("value"),
        F.concat(label, F.lit(": "), F.col("n").cast("string")).alias("message"),
        F.lit(None).cast("bigint").alias("row_ord"),
        (no - 1).alias("check_no"),
    )


def row_issues(df: DataFrame, bounds: TestsetBounds = TestsetBounds(), ord_col: str = "ord") -> DataFrame:
    """V2, V3: length range per side (not stripped) and en/ko ratio."""
    lk, le = F.length("ko"), F.length("en")
    ratio = le.cast("double") / F.greatest(lk, F.lit(1)).cast("double")
    lo, hi = bounds.len_min, bounds.len_max
    rng = f"[{_fmt_bound(bounds.ratio_min)}, {_fmt_bound(bounds.ratio_max)}]"

    def issue(no: int, check: str, bad: Column, value: Column, message: Column) -> Column:
        return F.when(
            bad,
            F.struct(
                F.lit(check).alias("check"),
                value.cast("double").alias("value"),
                message.alias("message"),
                F.lit(no).alias("check_no"),
            ),
        )

    # fixed message formats
    checks = F.array_compact(
        F.array(
            issue(2, "len_ko", ~lk.between(lo, hi), lk,
                  F.concat(F.col("id"), F.lit(": ko length out of range ("), lk.cast("string"), F.lit(")"))),
            issue(3, "len_en", ~le.between(lo, hi), le,
                  F.concat(F.col("id"), F.lit(": en length out of range ("), le.cast("string"), F.lit(")"))),
            issue(4, "ratio", ~ratio.between(bounds.ratio_min, bounds.ratio_max), ratio,
                  F.concat(F.col("id"), F.lit(": en/ko length ratio "), py_format(ratio, 2), F.lit(f" out of {rng}"))),
        )
    )
    return df.select(F.col(ord_col).alias("row_ord"), "id", F.explode(checks).alias("i")).select(
        F.lit("row").alias("scope"), "id", "i.check", "i.value", "i.message", "row_ord", "i.check_no"
    )


def validate_testset(df: DataFrame, bounds: TestsetBounds = TestsetBounds(), ord_col: str = "ord") -> DataFrame:
    """V4: all issues; order by (row_ord nulls first, check_no) gives the
    reference's message order (dataset-level first, then rows in order)."""
    return dataset_issues(df).unionByName(row_issues(df, bounds, ord_col))


def testset_passes(issues: DataFrame) -> bool:
    """V5: True when there is no issue (the reference exits 1 otherwise)."""
    return len(issues.take(1)) == 0
