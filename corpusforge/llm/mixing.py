"""Mixing sources to target weights (operator 9), in DataFrame functions only.

Capped water-filling: sources share a budget by weight, a source is clamped
at its maximum epochs, and the excess is shared again by weight until no
source is above its cap. A source's target then becomes whole repetitions of
all its documents and a fractional one: documents in a seeded order until
the rest of the target is used up, the last of them in part.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
SEED = 17


def water_fill(sources: DataFrame, weights: Sequence[int], share: float, max_epochs: int) -> DataFrame:
    """``sources(source, source_size)`` with ``target`` added.

    With sources in order of cap over weight, clamping the first k leaves the
    level (budget - their caps) / (the other weights); the right k is the
    first whose level is not above the next source's cap over weight, which is
    also the highest such level. One row per source is sorted here, never the
    documents."""
    place = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    ranked = sources.withColumn("place", F.row_number().over(place)).withColumns(
        {
            "weight": F.element_at(cycle, ((F.col("place") - 1) % len(weights) + 1).cast("int")),
            "cap": F.col("source_size") * max_epochs,
        }
    )
    order = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    every = Window.partitionBy(F.lit(1)).orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = ranked.withColumns(
        {
            "before": F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "after": F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
            "total": F.sum("source_size").over(every),
        }
    ).withColumn("level", (F.lit(share) * F.col("total") - F.col("before")) / F.col("after"))
    level = F.max(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.col("level"))).over(every)
    return filled.withColumn("top", level).select(
        "source",
        "source_size",
        F.coalesce(F.least(F.col("cap").cast("double"), F.col("top") * F.col("weight")), F.col("cap").cast("double")).alias("target"),
    )


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
    key_col: str | None = None,
) -> DataFrame:
    """One row per row of ``docs``: id, source, size, source_size, target, taken, repeats.

    ``size`` counts the words of the text (null: 0). ``taken`` is the words
    the mix takes of the document, repetitions counted; a source's taken words
    add up to its target rounded to a word. ``repeats`` is the same in whole
    documents (the partly taken one is rounded). Null sources are one source,
    the last. A source without words has target 0 and takes nothing. The order
    is that of md5(seed|id), or of the seed and the text for a null id, then id,
    size and the text's hash, so reruns agree; rows equal in all are
    interchangeable. Columns other than the three are ignored; an empty table
    gives an empty result. ``key_col`` names a unique column that comes along
    and decides between equal rows.

    The fractional repetition needs running sums, but not over a whole source:
    documents fall into 4,096 blocks by the first digits of the md5, block
    sums locate the one block where the target ends, and only its rows (about
    1 in 4,096) are sorted."""
    scratch = Scratch(docs.sparkSession, "mix")
    rows = docs.select(*_row_columns(id_col, text_col, source_col, seed, F.lit(0) if key_col is None else F.col(key_col)))
    out = _mixed(scratch.cut(rows, "rows"), scratch, weights, share, max_epochs)
    return out.select(
        F.col("id").alias(id_col),
        F.col("source").alias(source_col),
        "size",
        "source_size",
        "target",
        "taken",
        "repeats",
        *([] if key_col is None else [F.col("key").alias(key_col)]),
    )


def _row_columns(id_col: str, text_col: str, source_col: str, seed: int, key: Column) -> list[Column]:
    """What ``_mixed`` reads of a row."""
    text_hash = F.coalesce(F.md5(F.col(text_col).cast("binary")), F.lit(""))
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("|"), text_hash))).cast("binary"))
    return [
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("bigint").alias("size"),
        h.alias("h"),
        F.xxhash64(text_col).alias("tie"),
        key.alias("key"),
        F.conv(F.substring(h, 1, 3), 16, 10).cast("int").alias("block"),
    ]


def _mixed(rows: DataFrame, scratch: Scratch, weights: Sequence[int], share: float, max_epochs: int) -> DataFrame:
    """``rows`` with source_size, target, taken and repeats. They may hold a column
    ``doc``, if ``key`` is unique; only those of a source's one block where its
    target ends move, and the sort there is of the other columns."""
    blocks = rows.groupBy("source", "block").agg(F.sum("size").alias("n"))
    up_to = Window.partitionBy("source").orderBy("block")
    blocks = scratch.cut(blocks.withColumn("upto", F.sum("n").over(up_to)), "blocks")
    sources = blocks.groupBy("source").agg(F.sum("n").alias("source_size"))
    goal = F.round("target").cast("bigint")
    wanted = water_fill(sources, weights, share, max_epochs).withColumns(
        {
            "whole": F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("bigint"),
        }
    )
    wanted = wanted.withColumn("rest", goal - F.col("whole") * F.col("source_size")).withColumnRenamed("source", "s")
    edges = (
        blocks.join(wanted.select("s", "rest"), F.col("source").eqNullSafe(F.col("s")))
        .where("upto > rest")
        .groupBy(F.col("source").alias("t"))
        .agg(F.min("block").alias("edge"), F.min(F.col("upto") - F.col("n")).alias("edge_before"))
    )
    plan = scratch.cut(wanted.join(edges, F.col("s").eqNullSafe(F.col("t")), "left").drop("t"), "plan")

    planned = rows.join(plan, F.col("source").eqNullSafe(F.col("s")))
    sure = planned.where("edge is null or block <> edge").withColumn(
        "extra", F.when(F.col("block") < F.col("edge"), F.col("size")).otherwise(0).cast("bigint")
    )
    prior = Window.partitionBy("source").orderBy("h", "id", "size", "tie", "key").rowsBetween(Window.unboundedPreceding, -1)
    split = planned.drop("doc").where("block = edge").withColumn(
        "extra",
        F.greatest(
            F.lit(0).cast("bigint"),
            F.least("size", F.col("rest") - F.col("edge_before") - F.coalesce(F.sum("size").over(prior), F.lit(0))),
        ),
    )
    if "doc" in rows.columns:
        split = split.join(planned.where("block = edge").select("key", "doc"), "key")
    return sure.unionByName(split).withColumns(
        {
            "taken": F.col("whole") * F.col("size") + F.col("extra"),
            "repeats": (F.col("whole") + F.when((F.col("extra") > 0) & (F.col("extra") * 2 >= F.col("size")), 1).otherwise(0)).cast("int"),
        }
    )


def apply_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    max_epochs: int = MAX_EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """``docs`` with every row repeated as the mix says; columns unchanged. Rows
    are written once with what the mix reads of them and a key, so repeated
    and null ids are rows like others, and no text is joined to its repeats."""
    scratch = Scratch(docs.sparkSession, "applymix")
    reads = _row_columns(id_col, text_col, source_col, seed, F.monotonically_increasing_id())
    whole = scratch.cut(docs.select(*reads, F.struct(*[F.col(c) for c in docs.columns]).alias("doc")), "keyed")
    times = _mixed(whole, scratch, weights, share, max_epochs).where("repeats > 0")
    return times.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("repeats")))).select("doc.*")
