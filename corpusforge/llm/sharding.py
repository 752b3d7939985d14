"""Sharding by jump consistent hashing (operator 3), in DataFrame functions only.

A key walks the published jump sequence: a 64-bit linear congruential
generator draws, for the shard the key is in, the next shard count at which
it would move. The last shard below the shard count is the key's. No ring
table exists, and one more shard moves keys only into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch

# Fixed values of the published generator and of its 31-bit draw.
_MULTIPLIER = "2862933555777941757"
_TWO_64 = "18446744073709551616"
_TWO_33 = "8589934592"
_TWO_31 = "2147483648D"

#: A key jumps about ln(shards) times. More jumps than this have a chance
#: below 1e-60 for any shard count, and raise instead of giving a wrong shard.
_MOST_JUMPS = 256

#: Slots are numbered in parallel blocks; this many (shard, block) pairs at most.
_BLOCK_ROWS = 65536


def jump_shard(key: Column, n_shards: int) -> Column:
    """The shard in [0, n_shards) of a bigint key (null counts as key 0)."""
    if n_shards < 1:
        raise ValueError("a key needs at least one shard")
    start = F.coalesce(key.cast("bigint"), F.lit(0)).cast("decimal(38,0)")
    start = F.expr(f"cast({_TWO_64} as decimal(38,0))") * F.when(start < 0, 1).otherwise(0) + start
    state = F.struct(
        F.lit(0).cast("bigint").alias("b"), F.lit(0).cast("bigint").alias("j"), start.cast("decimal(38,0)").alias("k")
    )

    def jump(s: Column, _: Column) -> Column:
        # 2^64 * multiplier < 10^38: the product is exact in a decimal
        k = F.pmod(
            s["k"] * F.expr(f"cast({_MULTIPLIER} as decimal(19,0))") + F.lit(1).cast("decimal(1,0)"),
            F.expr(f"cast({_TWO_64} as decimal(38,0))"),
        ).cast("decimal(38,0)")
        draw = F.floor(k / F.expr(f"cast({_TWO_33} as decimal(38,0))")).cast("double") + 1
        beyond = F.floor((s["j"] + 1).cast("double") * (F.expr(_TWO_31) / draw)).cast("bigint")
        moved = F.struct(s["j"].alias("b"), beyond.alias("j"), k.alias("k"))
        return F.when(s["j"] < n_shards, moved).otherwise(s)

    jumps = F.sequence(F.lit(1), F.lit(min(n_shards, _MOST_JUMPS)))
    last = F.aggregate(jumps, state, jump)
    ended = F.when(last["j"] < n_shards, F.raise_error(F.lit("a key jumped too often"))).otherwise(last["b"])
    return ended.cast("int")


def shard_documents(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, size, text_crc32, law, shard, slot, grown_shard.

    The law is ``key``: the id and the shard count alone decide the shard, and
    ``grown_shard`` is the shard with one shard more. A null id has key 0; a
    null text has size 1 and the CRC of no bytes (0). ``slot`` numbers a
    shard's rows from 0 without gaps, in an order that depends on the rows'
    values and their places in the table. Other columns are ignored; an empty
    table gives an empty result.

    Slots need no sort of a whole shard: rows fall into blocks by a hash of
    their values and their number (so copies of one row are spread as well), a
    block's first slot is the count of the blocks before it, and only blocks
    are sorted. Block counts are at most 65,536 rows (or one a shard) whatever
    the input, which bounds the broadcast."""
    scratch = Scratch(docs.sparkSession, "shards")
    text = F.coalesce(F.col(text_col), F.lit(""))
    blocks = max(1, _BLOCK_ROWS // n_shards)
    rows = docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text).cast("bigint") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = rows.withColumns(
        {
            "shard": jump_shard(F.col("id"), n_shards),
            "grown": jump_shard(F.col("id"), n_shards + 1),
            "block": F.pmod(F.xxhash64("id", "crc", "size", "row"), F.lit(blocks)).cast("int"),
        }
    )
    rows = scratch.cut(rows, "rows")
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("shard", "block").agg(F.count("*").alias("n"))
    firsts = counts.select("shard", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    place = Window.partitionBy("shard", "block").orderBy("id", "crc", "size", "row")
    return (
        rows.withColumn("place", F.row_number().over(place) - 1)
        .join(F.broadcast(firsts), ["shard", "block"])
        .select(
            F.col("id").alias(id_col),
            "size",
            F.col("crc").alias("text_crc32"),
            F.lit("key").alias("law"),
            "shard",
            (F.col("first") + F.col("place")).cast("bigint").alias("slot"),
            F.col("grown").alias("grown_shard"),
        )
    )
