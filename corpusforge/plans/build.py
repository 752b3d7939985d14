"""Dataset build: union of sources -> waterfall -> priority dedup
-> per-source score distribution -> bottom-percent score cut -> exact seeded
split -> JSONL + stats.

Shuffles: one exchange of narrow row ids on the dedup key (aggregate with
map-side combine), one join on the unique row id, and small aggregates for the
order statistics and counters. The keyed frame is written once to the shared checkpoint folder so the
text work never runs twice and an executor loss never replays it.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import apply_waterfall
from ..operators.dedup import annotate_duplicates, dedup_winners, with_dedup_key
from ..operators.score import apply_score_cut, score_distribution
from ..operators.split import exact_split
from ..operators.stats import final_distribution, outcome_counts_from_winners, source_stats_from_counts, totals
from ..session import Scratch, ship_package
from ..sources.corpus import load_catalogue
from ..sources.jsonl import write_jsonl
from ..sources.specs import FilterCfg, SourceSpec


@dataclass
class BuildResult:
    keyed: DataFrame  # every loaded row: stripped sides, pre-dedup reason, dkey
    counts: DataFrame  # (source, reason, n) with 'dup'; reason null = kept
    winners: DataFrame  # kept rows before the score cut (one per key)
    kept: DataFrame  # rows after the score cut, with shuffle_key and split
    before_cut: int
    cutoff: float | None
    config: dict
    scratch: Scratch | None = None  # holds ``keyed`` and ``winners``

    def release(self) -> None:
        """Delete the intermediate tables; the frames can't be read afterwards."""
        if self.scratch is not None:
            self.scratch.drop()
        self.winners.unpersist()

    @property
    def annotated(self) -> DataFrame:
        """Every row with its final outcome ('dup' included); lazy, and the
        only consumer of the join back on the row id."""
        return annotate_duplicates(self.keyed, keyed=True)


PAYLOAD = ["source", "ko", "en", "score"]


def build_corpus(
    pairs: DataFrame,
    cfg: FilterCfg = FilterCfg(),
    drop_bottom_score_pct: float = 0.0,
    val_fraction: float = 0.05,
    seed: int = 42,
    checkpoint: bool = True,
) -> BuildResult:
    """pairs(source, priority, ord, ko_raw, en_raw, score) -> BuildResult.

    Plan: one narrow pass (waterfall + key) written to the shared checkpoint
    folder; one aggregate of narrow row ids on the key (partial aggregation,
    skew-safe) names the winners, whose rows a semi join on the unique row id
    fetches, also written once; counters, order statistics, the cut and the
    split then read those. ``BuildResult.release`` deletes both tables."""
    keyed = with_dedup_key(apply_waterfall(pairs, cfg))
    scratch = Scratch(pairs.sparkSession, "build") if checkpoint else None
    if checkpoint:
        keyed = scratch.cut(keyed, "keyed")
    winners = dedup_winners(keyed, PAYLOAD, keyed=True)
    # read by the counters, the order statistics, the cut and the split: write
    # it once (no executor memory held between calls) or, without a shared
    # folder, keep it on executors
    winners = scratch.cut(winners, "winners") if checkpoint else winners.persist(StorageLevel.MEMORY_AND_DISK)
    counts = outcome_counts_from_winners(keyed, winners)
    before_cut = winners.count()
    after_cut, cutoff = apply_score_cut(winners, drop_bottom_score_pct)
    n_after = before_cut if cutoff is None else after_cut.count()
    kept = exact_split(after_cut, "dkey", val_fraction, seed, n=n_after)
    config = {
        "seed": seed,
        "val_fraction": val_fraction,
        "drop_bottom_score_pct": drop_bottom_score_pct,
        "char_min": cfg.char_min,
        "char_max_ko": cfg.char_max_ko,
        "char_max_en": cfg.char_max_en,
        "ratio_min": cfg.ratio_min,
        "ratio_max": cfg.ratio_max,
    }
    return BuildResult(keyed, counts, winners, kept, before_cut, cutoff, config, scratch)


def build_stats(result: BuildResult, max_per_source: int | None = None) -> dict:
    """K2: the stats document. Only aggregate rows reach the driver."""
    per_source = {
        r["source"]: {"loaded": r["loaded"], "passed": r["passed"], "rejected": dict(sorted(r["rejected"].items()))}
        for r in source_stats_from_counts(result.counts).collect()
    }
    dist = {
        r["source"]: {k: r[k] for k in ("n", "min", "p10", "median", "p90", "max")}
        for r in score_distribution(result.winners.where(F.col("score").isNotNull())).collect()
    }
    final = {r["source"]: r["n"] for r in final_distribution(result.kept).collect()}
    tot = totals(result.before_cut, result.kept).first().asDict()
    config = dict(result.config)
    config["max_per_source"] = max_per_source
    return {
        "config": config,
        "per_source": dict(sorted(per_source.items())),
        "score_distribution": dist,
        "final_source_distribution": dict(sorted(final.items())),
        "total": tot,
    }


def in_split_order(kept: DataFrame, cols: list[str]) -> DataFrame:
    """Both splits in shuffled order from one sort: rows dealt by range of
    (split, shuffle key) and sorted there."""
    order = ["split", "shuffle_key"]
    return kept.select(*cols, *order).repartitionByRange(*order).sortWithinPartitions(*order).select(*cols, "split")


def build_dataset(
    spark: SparkSession,
    sources: list[SourceSpec],
    out_dir: str,
    cfg: FilterCfg = FilterCfg(),
    max_per_source: int | None = None,
    drop_bottom_score_pct: float = 0.0,
    val_fraction: float = 0.05,
    seed: int = 42,
) -> dict:
    """End to end: read, clean, cut, split; write train/val JSONL (K1, in
    shuffled order, under ``stage/split=train`` and ``stage/split=val``) and return the stats document (K2, also written)."""
    ship_package(spark)
    pairs = load_catalogue(spark, sources, max_per_source)
    result = build_corpus(pairs, cfg, drop_bottom_score_pct, val_fraction, seed)
    cols = ["ko", "en", "source", "score"]
    # part files in order by name, under a folder for each split
    write_jsonl(in_split_order(result.kept, cols), f"{out_dir}/stage", partition_by=["split"])
    stats = build_stats(result, max_per_source)
    stats_df = spark.createDataFrame([(json.dumps(stats, ensure_ascii=False),)], "value string")
    stats_df.coalesce(1).write.mode("overwrite").text(f"{out_dir}/stage_stats")
    result.release()
    return stats

