"""Score distribution per source (A2) and the bottom-percent score cut."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import py_round
from .rank import grouped_order_statistics, order_statistics

#: 0-based floor indices of the sorted scores (no interpolation)
FLOOR_RANKS = {
    "p10": lambda n: F.floor(n / 10),
    "median": lambda n: F.floor(n / 2),
    "p90": lambda n: F.floor(n * 9 / 10),
}


def score_distribution(df: DataFrame, group_col: str = "source", score_col: str = "score") -> DataFrame:
    """A2: n, min, p10, median, p90, max per group, rounded to 4 as Python
    rounds. Groups without any score are absent."""
    stats = grouped_order_statistics(df, score_col, [group_col], FLOOR_RANKS)
    return stats.select(
        F.col(group_col).alias("source"), "n", *[py_round(F.col(c), 4).alias(c) for c in ("min", "p10", "median", "p90", "max")]
    )


def score_cutoff(df: DataFrame, drop_bottom_pct: float, score_col: str = "score") -> float | None:
    """W1 cutoff: sorted scored values at idx = int(n * pct / 100), or the last
    one when idx >= n. None when pct <= 0 or no row has a score."""
    if drop_bottom_pct <= 0:
        return None
    stats = order_statistics(
        df, score_col, [], lambda n: [("cut", min(int(n * drop_bottom_pct / 100), n - 1))]
    )
    if not stats:
        return None
    return stats[0].values["cut"]


def apply_score_cut(df: DataFrame, drop_bottom_pct: float, score_col: str = "score"):
    """Keep unscored rows and scored rows with score >= cutoff (ties at
    the cutoff stay). Returns (DataFrame, cutoff or None)."""
    cutoff = score_cutoff(df, drop_bottom_pct, score_col)
    if cutoff is None:
        return df, None
    c = F.col(score_col)
    return df.where(c.isNull() | (c >= F.lit(cutoff))), cutoff
