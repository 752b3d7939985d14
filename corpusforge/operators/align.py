"""Positional joins (J1, J2) and in-row line splitting.

Alignment by index is an equi-join on (key, position): evenly spread keys,
so a plain shuffle join. A one-sided row means the inputs disagree in length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import split_lines


def lines_with_position(df: DataFrame, key_cols: list[str], text_col: str, line_col: str = "line") -> DataFrame:
    """(key..., pos, line): Python ``splitlines()`` of a text column."""
    return df.select(*key_cols, F.posexplode(split_lines(F.col(text_col))).alias("pos", line_col))


def align_texts(left: DataFrame, right: DataFrame, key_cols: list[str], left_text: str, right_text: str, left_line: str, right_line: str) -> DataFrame:
    """J1 of two texts a key: (key..., pos, left_line, right_line, one_sided).
    Texts meet whole, one row a key, and are split into lines after the join,
    so the shuffle and its sort handle documents and not single lines."""
    both = left.select(*key_cols, F.col(left_text).alias("_cf_l")).join(
        right.select(*key_cols, F.col(right_text).alias("_cf_r")), list(key_cols), "full_outer"
    )
    none = F.array().cast("array<string>")
    sides = both.select(
        *key_cols,
        F.coalesce(split_lines(F.col("_cf_l")), none).alias("_cf_l"),
        F.coalesce(split_lines(F.col("_cf_r")), none).alias("_cf_r"),
    )
    shared = F.least(F.size("_cf_l"), F.size("_cf_r")).alias("_cf_n")
    lines = sides.select(*key_cols, shared, F.posexplode(F.arrays_zip("_cf_l", "_cf_r")).alias("pos", "_cf_z"))
    return lines.select(
        *key_cols, "pos", F.col("_cf_z._cf_l").alias(left_line), F.col("_cf_z._cf_r").alias(right_line),
        (F.col("pos") >= F.col("_cf_n")).alias("one_sided"),
    )


def align_by_position(
    left: DataFrame, right: DataFrame, key_cols: list[str], pos_col: str = "pos"
) -> DataFrame:
    """Full outer join on (key..., pos); ``one_sided`` flags rows present
    on one side only."""
    on = list(key_cols) + [pos_col]
    lcols = [c for c in left.columns if c not in on]
    rcols = [c for c in right.columns if c not in on]
    joined = left.withColumn("_cf_l", F.lit(True)).join(
        right.withColumn("_cf_r", F.lit(True)), on, "full_outer"
    )
    return joined.select(
        *on, *lcols, *rcols,
        (F.col("_cf_l").isNull() | F.col("_cf_r").isNull()).alias("one_sided"),
    )


def require_aligned(aligned: DataFrame, what: str = "rows") -> DataFrame:
    """Strict zip: raise when any row is one-sided."""
    bad = aligned.where("one_sided").take(1)
    if bad:
        raise RuntimeError(f"{what} mismatch: inputs differ in length")
    return aligned.drop("one_sided")


def zip_by_id(left: DataFrame, right: DataFrame, id_col: str = "id") -> DataFrame:
    """Columns of two id-keyed tables side by side, strictly: an id that is
    null, repeated, or on one side only raises when the result is read.

    One full outer join, each side read once and dealt by id once: rows are
    numbered within their id on the sort that the join needs anyway, and a filter
    over the joined rows raises. Nothing runs before the result does."""
    number = F.row_number().over(Window.partitionBy(id_col).orderBy(id_col))
    lcols = [c for c in left.columns if c != id_col]
    rcols = [c for c in right.columns if c != id_col]
    one = left.withColumn("_cf_l", number).withColumnRenamed(id_col, "_cf_lid")
    two = right.withColumn("_cf_r", number).withColumnRenamed(id_col, "_cf_rid")
    joined = one.join(two, F.col("_cf_lid") == F.col("_cf_rid"), "full_outer")
    name = F.coalesce(F.col("_cf_lid").cast("string"), F.col("_cf_rid").cast("string"), F.lit("null"))
    fault = (
        F.when(F.col("_cf_l").isNull(), F.lit("is missing on the left"))
        .when(F.col("_cf_r").isNull(), F.lit("is missing on the right"))
        .when(F.col("_cf_l") > 1, F.lit("is repeated on the left"))
        .when(F.col("_cf_r") > 1, F.lit("is repeated on the right"))
    )
    strict = F.when(fault.isNull(), True).otherwise(F.raise_error(F.concat(F.lit("ids differ: "), name, F.lit(" "), fault)).cast("boolean"))
    return joined.where(strict).select(F.col("_cf_lid").alias(id_col), *lcols, *rcols)
