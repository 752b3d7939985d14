"""Build counters (A1, A3, A4). All are single aggregates with map-side combine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outcome_counts(annotated: DataFrame) -> DataFrame:
    """(source, reason, n); reason null = passed."""
    return annotated.groupBy("source", "reason").agg(F.count(F.lit(1)).alias("n"))


def source_stats(annotated: DataFrame) -> DataFrame:
    """A1: (source, loaded, passed, rejected MAP<reason, n>) with only non-zero
    reasons, keys sorted. Invariant: loaded = passed + sum(rejected)."""
    return source_stats_from_counts(outcome_counts(annotated))


def outcome_counts_from_winners(keyed: DataFrame, winners: DataFrame) -> DataFrame:
    """(source, reason, n) including 'dup' without joining rows back: per
    source, dup = rows that passed every row test - rows that won their key.
    ``keyed`` holds pre-dedup reasons; ``winners`` one row per key."""
    pre = outcome_counts(keyed)
    won = winners.groupBy("source").agg(F.count(F.lit(1)).alias("_cf_won"))
    passed = pre.where(F.col("reason").isNull()).join(won, "source", "left")
    dup = passed.select("source", F.lit("dup").alias("reason"),
                        (F.col("n") - F.coalesce("_cf_won", F.lit(0))).alias("n"))
    kept = passed.select("source", F.lit(None).cast("string").alias("reason"),
                         F.coalesce("_cf_won", F.lit(0)).alias("n"))
    return pre.where(F.col("reason").isNotNull()).unionByName(dup).unionByName(kept).where(F.col("n") > 0)


def source_stats_from_counts(counts: DataFrame) -> DataFrame:
    """A1 from (source, reason, n) rows."""
    rejected = F.map_from_entries(
        F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "n"))))
    )
    return counts.groupBy("source").agg(
        F.sum("n").alias("loaded"),
        F.coalesce(F.sum(F.when(F.col("reason").isNull(), F.col("n"))), F.lit(0)).alias("passed"),
        rejected.alias("rejected"),
    )


def final_distribution(kept: DataFrame) -> DataFrame:
    """A3: rows per source over train + val, sorted by name."""
    return kept.groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy("source")


def totals(before_cut: int, kept: DataFrame) -> DataFrame:
    """A4: before/after the score cut, dropped, train, val (one aggregate)."""
    return kept.agg(
        F.lit(before_cut).cast("bigint").alias("before_score_filter"),
        F.count(F.lit(1)).alias("after_score_filter"),
        (F.lit(before_cut) - F.count(F.lit(1))).cast("bigint").alias("dropped_by_score_filter"),
        F.count(F.when(F.col("split") == "train", 1)).alias("train"),
        F.count(F.when(F.col("split") == "val", 1)).alias("val"),
    )
