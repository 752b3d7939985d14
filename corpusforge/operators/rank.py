"""Exact order statistics at scale.

"The value at 0-based index k of the sorted values", exactly, without a sort
of all rows and without a window over a whole group in one task.

Radix selection over histograms: each pass buckets the rows inside the
current value range into a fixed number of buckets (one aggregate with
partial aggregation; its output is at most ``buckets`` rows per range, no
matter how large the data), and the driver walks the cumulative counts to
the bucket holding rank k. The next pass only looks inside that bucket.
Buckets are monotone in the value, and min and max of a range always land in
different buckets. A range that spans more than a factor of 4, or both signs,
is divided by sign and logarithm: at 4,096 buckets each is then about one
binary order wide. A narrower range is divided linearly, 12 bits of the
mantissa at a time. So 7 passes reach a single value whatever the
distribution, and continuous data needs about three at 10^12 rows.
The input is persisted once (memory and disk) for the passes.

The histogram of a pass (at most ``buckets`` rows per target range, never
more rows than that whatever the data size) is walked on the driver: a
Spark-side walk (window cumsum + join with the targets) was measured slower
here because its window needs one more shuffle stage per pass.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import Scratch

DEFAULT_BUCKETS = 4096
# ranges tables above this many rows are joined without a broadcast hint
_BROADCAST_RANGES = 100_000


@dataclass
class _Target:
    group: tuple
    name: str
    k: int
    lo: float
    hi: float
    value: float | None = None
    done: bool = False


@dataclass
class GroupStats:
    group: tuple
    n: int
    lo: float
    hi: float
    values: dict = field(default_factory=dict)


def _walk(buckets: list[tuple[int, int, object, object]], k: int):
    """buckets sorted by index: (b, count, min, max). Return (count_before, row)."""
    before = 0
    for row in buckets:
        if before + row[1] > k:
            return before, row
        before += row[1]
    raise AssertionError("rank outside histogram")


def _is_wide(lo: float, hi: float) -> bool:
    small, large = sorted((abs(lo), abs(hi)))
    return lo <= 0 <= hi or math.isinf(large) or large / 4 > small


def _place(value: str) -> Column:
    """Where a value lies on its range's axis, monotone in the value: by sign
    and logarithm (the least double is 2^-1074) in a wide range, as it is in others."""
    v = F.col(value)
    signed = F.signum(v) * (F.least(F.log2(F.abs(v)), F.lit(1025.0)) + 1076.0)
    return F.when(~F.col("_rwide"), v).when(v == 0, F.lit(0.0)).otherwise(signed)


def order_statistics(
    df: DataFrame,
    value_col: str,
    group_cols: list[str] | tuple = (),
    ranks=lambda n: [],
    buckets: int = DEFAULT_BUCKETS,
) -> list[GroupStats]:
    """For each group: n, min, max, and ``values[name]`` = sorted[k] for each
    ``(name, k)`` in ``ranks(n)`` (k outside [0, n) is skipped).

    Null values are ignored. Returns one ``GroupStats`` per non-empty group.
    NaN ranks after every number (Spark's order; Python's sort has no total
    order for NaN) and -0.0 equals 0.0, so either may be reported for a
    zero rank.
    """
    group_cols = list(group_cols)
    spark = df.sparkSession
    data = df.select(*group_cols, F.col(value_col).cast("double").alias("_v")).where(
        F.col("_v").isNotNull()
    )
    data = data.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        num = ~F.isnan("_v")
        base = data.groupBy(*group_cols).agg(
            F.count(F.lit(1)).alias("_n"),
            F.count(F.when(num, 1)).alias("_nn"),
            F.min(F.when(num, F.col("_v"))).alias("_lo"),
            F.max(F.when(num, F.col("_v"))).alias("_hi"),
        ).collect()
        out: list[GroupStats] = []
        targets: list[_Target] = []
        for r in base:
            if not r["_n"]:  # a global aggregate over no rows still yields one row
                continue
            g = tuple(r[c] for c in group_cols)
            n_num = r["_nn"]
            # NaN sorts after every number (Spark's order)
            lo = r["_lo"] if n_num else math.nan
            hi = r["_hi"] if n_num == r["_n"] else math.nan
            gs = GroupStats(g, r["_n"], lo, hi)
            out.append(gs)
            for name, k in ranks(gs.n):
                if 0 <= k < gs.n:
                    t = _Target(g, name, int(k), r["_lo"], r["_hi"])
                    if k >= n_num:
                        t.value, t.done = math.nan, True
                    targets.append(t)
        for t in targets:
            if not t.done and t.lo == t.hi:
                t.value, t.done = t.lo, True

        group_types = [data.schema[c].dataType for c in group_cols]
        while any(not t.done for t in targets):
            active = [t for t in targets if not t.done]
            ranges: dict[tuple, int] = {}
            for t in active:
                ranges.setdefault((t.group, t.lo, t.hi), len(ranges))
            schema = T.StructType(
                [T.StructField("_rid", T.IntegerType(), False)]
                + [T.StructField(f"_g{i}", dt, True) for i, dt in enumerate(group_types)]
                + [T.StructField("_rlo", T.DoubleType(), False), T.StructField("_rhi", T.DoubleType(), False)]
                + [T.StructField("_rwide", T.BooleanType(), False)]
            )
            rdf = spark.createDataFrame(
                [(rid, *g, lo, hi, _is_wide(lo, hi)) for (g, lo, hi), rid in ranges.items()], schema
            )
            rdf = rdf.withColumn("_from", _place("_rlo")).withColumn("_to", _place("_rhi"))
            if len(ranges) <= _BROADCAST_RANGES:
                rdf = F.broadcast(rdf)
            cond = (F.col("_v") >= F.col("_rlo")) & (F.col("_v") <= F.col("_rhi"))
            for i, c in enumerate(group_cols):
                cond = cond & F.col(c).eqNullSafe(F.col(f"_g{i}"))
            scaled = (_place("_v") - F.col("_from")) / (F.col("_to") - F.col("_from"))
            bucket = F.least(F.floor(scaled * F.lit(buckets)), F.lit(buckets - 1)).cast("int")
            hist = (
                data.join(rdf, cond)
                .groupBy("_rid", bucket.alias("_b"))
                .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_mn"), F.max("_v").alias("_mx"))
                .collect()
            )
            by_rid: dict[int, list] = {}
            for h in hist:
                by_rid.setdefault(h["_rid"], []).append((h["_b"], h["_c"], h["_mn"], h["_mx"]))
            for rows in by_rid.values():
                rows.sort()
            for t in active:
                rows = by_rid[ranges[(t.group, t.lo, t.hi)]]
                before, (_, _, mn, mx) = _walk(rows, t.k)
                if mn == mx:
                    t.value, t.done = mn, True
                else:
                    t.k -= before
                    t.lo, t.hi = mn, mx
        by_group = {gs.group: gs for gs in out}
        for t in targets:
            by_group[t.group].values[t.name] = t.value
        return out
    finally:
        data.unpersist()


_SALTS = 16  # shares of a group's rows that meet its ranges apart
_MOST_PASSES = 8


def _is_wide_col(lo: str, hi: str) -> Column:
    small, large = F.least(F.abs(lo), F.abs(hi)), F.greatest(F.abs(lo), F.abs(hi))
    return ((F.col(lo) <= 0) & (F.col(hi) >= 0)) | (large == F.lit(math.inf)) | (large / 4 > small)


def grouped_order_statistics(
    df: DataFrame,
    value_col: str,
    group_cols: list[str],
    ranks: dict[str, Callable[[Column], Column]],
    buckets: int = DEFAULT_BUCKETS,
) -> DataFrame:
    """One row per group that has a value: the group, ``n``, ``min``, ``max`` and
    a column per rank, the value at the 0-based index ``ranks[name](n)`` of the
    group's sorted values (null where the index is outside).

    The same histograms as ``order_statistics``, but everything stays in
    Spark: a pass counts (group, range, bucket), a running sum over a range's
    buckets (``buckets`` rows at most) finds the bucket of each rank, and the
    bucket's least and greatest value are the next range. Eight passes suffice
    for any doubles, so the number of jobs depends on neither rows nor groups, and
    the driver learns only whether a pass left anything open. Rows are read
    anew in each pass, without a persisted copy. A group of any size is met in
    shares (salted), counted partially before it moves.

    Nulls are ignored, NaN ranks last, and -0.0 equals 0.0. Null groups are a
    group. An empty input gives an empty result."""
    scratch = Scratch(df.sparkSession, "ranks")
    keys = [f"_g{i}" for i in range(len(group_cols))]
    data = df.select(*[F.col(c).alias(k) for c, k in zip(group_cols, keys, strict=True)], F.col(value_col).cast("double").alias("_v"))
    data = data.where("_v is not null")
    number = F.when(~F.isnan("_v"), F.col("_v"))
    base = data.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.count(number).alias("_nn"), F.min(number).alias("_lo"), F.max(number).alias("_hi")
    )
    base = scratch.cut(base, "base")
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("_n")).cast("bigint").alias("k")) for name, rank in ranks.items()]))
    targets = base.select("*", wanted.alias("_w")).select(*keys, "_n", "_nn", "_lo", "_hi", F.col("_w.name").alias("_name"), F.col("_w.k").alias("_k"))
    targets = targets.where("_k >= 0 and _k < _n").select(
        *keys,
        "_name",
        "_k",
        "_lo",
        "_hi",
        F.when(F.col("_k") >= F.col("_nn"), F.lit(math.nan)).when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias("_value"),
    )
    targets = scratch.cut(targets, "targets")

    def same(left: str, right: str, names: list[str]) -> Column:
        out = F.lit(True)
        for name in names:
            out = out & F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
        return out

    for _ in range(_MOST_PASSES):
        left = targets.where("_value is null")
        if not left.limit(1).count():
            break
        ranges = left.select(*keys, "_lo", "_hi").distinct()
        ranges = ranges.withColumn("_rwide", _is_wide_col("_lo", "_hi")).withColumnsRenamed({"_lo": "_rlo", "_hi": "_rhi"})
        ranges = ranges.withColumns({"_from": _place("_rlo"), "_to": _place("_rhi")})
        ranges = ranges.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        salted = data.withColumn("_salt", F.pmod(F.xxhash64("_v"), F.lit(_SALTS)).cast("int"))
        within = salted.alias("d").join(ranges.alias("r"), same("d", "r", [*keys, "_salt"]) & F.expr("d._v >= r._rlo and d._v <= r._rhi"))
        within = within.select(*[F.col(f"d.{k}").alias(k) for k in keys], "_v", "_rlo", "_rhi", "_rwide", "_from", "_to")
        scaled = (_place("_v") - F.col("_from")) / (F.col("_to") - F.col("_from"))
        bucket = F.least(F.floor(scaled * F.lit(buckets)), F.lit(buckets - 1)).cast("int")
        counts = within.groupBy(*keys, "_rlo", "_rhi", bucket.alias("_b")).agg(
            F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_mn"), F.max("_v").alias("_mx")
        )
        upto = F.sum("_c").over(Window.partitionBy(*keys, "_rlo", "_rhi").orderBy("_b"))
        counts = counts.withColumn("_upto", upto).withColumnsRenamed({"_rlo": "_lo", "_rhi": "_hi"})
        found = left.alias("t").join(counts.alias("c"), same("t", "c", [*keys, "_lo", "_hi"]) & F.expr("t._k < c._upto and t._k >= c._upto - c._c"))
        found = found.select(
            *[F.col(f"t.{k}").alias(k) for k in keys],
            "_name",
            (F.col("_k") - F.col("_upto") + F.col("_c")).alias("_k"),
            F.col("_mn").alias("_lo"),
            F.col("_mx").alias("_hi"),
            F.when(F.col("_mn") == F.col("_mx"), F.col("_mn")).alias("_value"),
        )
        step = scratch.cut(targets.where("_value is not null").unionByName(found), "targets")
        scratch.delete(targets)
        targets = step
    values = targets.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == name, F.col("_value"))).alias(f"_r_{name}") for name in ranks])
    out = base.alias("b").join(values.alias("v"), same("b", "v", keys), "left")
    numbers = F.col("_nn") > 0
    return out.select(
        *[F.col(f"b.{k}").alias(c) for c, k in zip(group_cols, keys, strict=True)],
        F.col("_n").alias("n"),
        F.when(numbers, F.col("_lo")).otherwise(F.lit(math.nan)).alias("min"),
        F.when(F.col("_nn") == F.col("_n"), F.col("_hi")).otherwise(F.lit(math.nan)).alias("max"),
        *[F.col(f"_r_{name}").alias(name) for name in ranks],
    )


def kth_smallest_hex(df: DataFrame, hex_col: str, k: int, digits: int = 4, unique: bool = False) -> str:
    """sorted(df[hex_col])[k] for fixed-length lowercase hex strings (hashes).
    With ``unique``, more rows up to that value than k + 1 raise.

    Level i buckets rows sharing the chosen prefix by their next ``digits``
    hex digits (16**digits buckets). Uniform hashes need two levels even at
    10^11 rows; the result is exact for any input.
    """
    data = df.select(F.col(hex_col).alias("_h")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        prefix = ""
        while True:
            level = data if not prefix else data.where(F.col("_h").startswith(prefix))
            b = F.conv(F.substring("_h", len(prefix) + 1, digits), 16, 10).cast("bigint")
            hist = (
                level.groupBy(b.alias("_b"))
                .agg(F.count(F.lit(1)).alias("_c"), F.min("_h").alias("_mn"), F.max("_h").alias("_mx"))
                .collect()
            )
            rows = sorted((h["_b"], h["_c"], h["_mn"], h["_mx"]) for h in hist)
            before, (bkt, held, mn, mx) = _walk(rows, k)
            if mn == mx:
                if unique and before + held > k + 1:
                    raise ValueError(f"{hex_col}: repeated value at the cut, {before + held - k - 1} rows too many")
                return mn
            k -= before
            prefix = prefix + format(bkt, f"0{digits}x")
    finally:
        data.unpersist()
