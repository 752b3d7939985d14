"""Corpus scans: ordinals, first-N caps, projection to the common pair schema,
and the prioritised union of several sources (S1, S2, S3, P1, P15, U1)."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import py_strip
from ..session import cut_lineage
from .loose import LINE, json_number, json_text
from .specs import SourceSpec

# split-offset tables up to this many rows (~200 bytes each) are broadcast
BROADCAST_SPLITS = 1_000_000


# ----------------------------------------------------------------- ordinals
def _has_row_index(df: DataFrame) -> bool:
    """The reader tells each row's place in its file (Parquet does)."""
    try:
        df.select("_metadata.row_index").schema
    except AnalysisException:
        return False
    return True


def with_file_ordinal(df: DataFrame, name: str = "ord", expand=None) -> DataFrame:
    """Add a 0-based arrival-order ordinal from file position, in order of
    file path and place in the file.

    Parquet rows carry their place in the file (``_metadata.row_index``), so a
    row count per file gives the ordinal, however the files are split. Other
    formats are written once with their split and task position; counts and
    rows then come from that one table, so a later scan with other splits
    can't lose rows.

    ``expand`` is an optional narrow, order-keeping step (e.g. an explode)
    applied to the scan before numbering, so its output rows get the ordinal.
    """
    file = F.col("_metadata.file_path").alias("_cf_file")
    if expand is None and _has_row_index(df):
        tagged = df.select("*", file, F.lit(0).cast("bigint").alias("_cf_block"), F.col("_metadata.row_index").alias("_cf_mid"))
        base = F.lit(0).cast("bigint")
    else:
        tagged = df.select("*", file, F.col("_metadata.file_block_start").alias("_cf_block"))
        if expand is not None:
            tagged = expand(tagged)
        tagged = cut_lineage(tagged.withColumn("_cf_mid", F.monotonically_increasing_id()), "ordinal")
        base = F.min("_cf_mid")
    splits = tagged.groupBy("_cf_file", "_cf_block").agg(base.alias("_cf_m0"), F.count(F.lit(1)).alias("_cf_n"))
    order = Window.orderBy("_cf_file", "_cf_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        "_cf_file",
        "_cf_block",
        "_cf_m0",
        F.coalesce(F.sum("_cf_n").over(order), F.lit(0)).alias("_cf_off"),
    )
    # one row per file or file split: about 800k rows for 100 TB at 128 MB.
    # Count it first; broadcast below a proven bound, shuffle-join above it.
    offsets = cut_lineage(offsets, "offsets")
    n_splits = offsets.count()
    side = F.broadcast(offsets) if n_splits <= BROADCAST_SPLITS else offsets
    out = tagged.join(side, ["_cf_file", "_cf_block"]).withColumn(
        name, F.col("_cf_off") + F.col("_cf_mid") - F.col("_cf_m0")
    )
    return out.drop("_cf_file", "_cf_block", "_cf_mid", "_cf_m0", "_cf_off")


def first_n(df: DataFrame, limit: int | None, ord_col: str = "ord") -> DataFrame:
    """S1 cap: the first ``limit`` rows in arrival order; None = all, 0 = none.
    A predicate on the ordinal, not ``limit()``, so it is exact and order-true."""
    if limit is None:
        return df
    return df.where(F.col(ord_col) < F.lit(int(limit)))


def first_n_by(df: DataFrame, limit: int | None, ord_col: str) -> DataFrame:
    """First ``limit`` rows by any unique numeric ordinal (not necessarily
    dense, e.g. an id column): keep ord <= the limit-th smallest ordinal,
    found exactly by histogram selection (no sort, no global window). A
    bigint is searched by its upper and then its lower 32 bits, which doubles
    hold exactly. Rows without an ordinal go; ordinals of other types raise."""
    if limit is None:
        return df
    kind = df.schema[ord_col].dataType
    if not isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)):
        raise TypeError(f"ordinal {ord_col!r} has type {kind.simpleString()}; an integer or double column is needed")
    if limit <= 0:
        return df.where(F.lit(False))
    from ..operators.rank import order_statistics

    c = F.col(ord_col)
    wide = isinstance(kind, T.LongType)
    parts = df.select(F.shiftright(c, 32).alias("hi"), c.bitwiseAND(F.lit(0xFFFFFFFF)).alias("lo")) if wide else df.select(c.alias("hi"))
    stats = order_statistics(parts, "hi", [], lambda n: [("cut", min(int(limit), n) - 1)])
    if not stats:
        return df.where(F.lit(False))
    cut = stats[0].values["cut"]
    if not wide:
        return df.where(c <= F.lit(cut))
    cut = int(cut)
    k = min(int(limit), stats[0].n) - 1 - parts.where(F.col("hi") < cut).count()
    low = order_statistics(parts.where(F.col("hi") == cut), "lo", [], lambda n: [("cut", k)])[0].values["cut"]
    return df.where(c <= F.lit((cut << 32) + int(low)))


def first_n_at_least_one(df: DataFrame, limit: int, ord_col: str = "ord") -> DataFrame:
    """S3 / S5 cap: the loop appends before testing, so a cap <= 1 keeps one row."""
    return df.where(F.col(ord_col) < F.lit(max(int(limit), 1)))


def first_n_per_group(df: DataFrame, group_cols, ord_col: str, limit: int) -> DataFrame:
    """First ``limit`` rows per group by ordinal. Spark plans a partial
    WindowGroupLimit before the shuffle, so each task sends at most ``limit``
    rows per group: a group holding a third of all rows stays cheap."""
    w = Window.partitionBy(*group_cols).orderBy(ord_col)
    return df.withColumn("_cf_rn", F.row_number().over(w)).where(
        F.col("_cf_rn") <= limit
    ).drop("_cf_rn")


# --------------------------------------------------------------- projection
def _resolve(schema: T.DataType, path: str):
    """Walk a dotted path through structs and maps. Returns (column, leaf type)
    or (None, None) when the path cannot exist (missing key / non-container)."""
    parts = path.split(".")
    col: Column | None = None
    dtype = schema
    for i, part in enumerate(parts):
        if isinstance(dtype, T.StructType):
            names = {f.name: f for f in dtype.fields}
            if part not in names:
                return None, None
            col = F.col(f"`{part}`") if col is None else col.getField(part)
            dtype = names[part].dataType
        elif isinstance(dtype, T.MapType) and i > 0:
            col = col[part]
            dtype = dtype.valueType
        else:
            return None, None
    return col, dtype


def _is_loose(df: DataFrame) -> bool:
    return LINE in df.columns and isinstance(df.schema[LINE].dataType, T.VariantType)


def get_field(df: DataFrame, path: str) -> Column:
    """Value at a dotted path as a string column; null when the path is
    missing or the value is not text (that row then fails the schema test). In
    a loose JSON source this is decided row by row."""
    if _is_loose(df):
        return json_text(F.col(LINE), path)
    col, dtype = _resolve(df.schema, path)
    if col is None or not isinstance(dtype, T.StringType):
        return F.lit(None).cast("string")
    return col


def get_score(df: DataFrame, path: str | None) -> Column:
    """Numeric (or boolean) score as double, else null."""
    if path is None:
        return F.lit(None).cast("double")
    if _is_loose(df):
        return json_number(F.col(LINE), path)
    col, dtype = _resolve(df.schema, path)
    if col is None or not isinstance(dtype, _PY_NUMBER_TYPES):
        return F.lit(None).cast("double")
    return col.cast("double")


# types whose values arrive in Python as int, float or bool (decimals do not)
_PY_NUMBER_TYPES = (
    T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.BooleanType,
)


def project_pairs(df: DataFrame, spec: SourceSpec, priority: int, ord_col: str = "ord") -> DataFrame:
    """Project one source to (source, priority, ord, ko_raw, en_raw, score)."""
    return df.select(
        F.lit(spec.name).alias("source"),
        F.lit(int(priority)).alias("priority"),
        F.col(ord_col).cast("bigint").alias("ord"),
        get_field(df, spec.ko_field).alias("ko_raw"),
        get_field(df, spec.en_field).alias("en_raw"),
        get_score(df, spec.score_field).alias("score"),
    )


def _reader(spark: SparkSession, fmt: str, schema: str | None):
    r = spark.read.format(fmt)
    return r.schema(schema) if schema else r


def head_files(spark: SparkSession, fmt: str, path, limit: int, schema: str | None = None, keep: Column | None = None) -> list[str]:
    """The first files, in path order, that together hold at least ``limit``
    rows. Files are counted in doubling batches (1, 2, 4, ...), so a cap of
    a few rows on a 100 TB source touches one file, never every split.
    Pass ``schema`` for formats that would otherwise infer it from the data
    (JSON): listing files must not scan them. Only rows that ``keep`` holds for
    count."""
    source = _reader(spark, fmt, schema).load(path)
    files = sorted(source.inputFiles())
    chosen: list[str] = []
    total, i, step = 0, 0, 1
    while total < max(limit, 1) and i < len(files):
        batch = files[i:i + step]
        rows = of_files(source, batch)
        total += (rows if keep is None else rows.where(keep)).count()
        chosen += batch
        i, step = i + step, step * 2
    return chosen


def of_files(source: DataFrame, files: list[str]) -> DataFrame:
    """The rows of some of a source's files. The source is the one that was
    loaded, so its partition columns stay; Spark skips the other files."""
    if not files:
        return source
    names = {*files, *(f.replace("file:///", "file:/", 1) for f in files)}  # Spark spells local paths both ways
    return source.where(F.col("_metadata.file_path").isin(sorted(names)))


def read_loose(spark: SparkSession, path, limit: int | None = None, strict: bool = True) -> DataFrame:
    """(ord, line): JSON lines of unknown types, each a VARIANT; blank lines are
    skipped and not counted. A malformed line raises, or is null if not
    ``strict``. With a limit only the head files that can hold it are read."""
    raw = spark.read.text(path)
    filled = F.length(py_strip(F.col("value"))) > 0
    if limit is not None:
        raw = of_files(raw, head_files(spark, "text", path, limit, keep=filled))
    lines = with_file_ordinal(raw, expand=lambda df: df.where(filled))
    parse = F.parse_json if strict else F.try_parse_json
    return lines.select("ord", parse("value").alias(LINE))


def read_source(spark: SparkSession, spec: SourceSpec, limit: int | None = None) -> DataFrame:
    """Read a source with an ``ord`` column. With a file ordinal and a cap,
    only the head files that can hold the first ``limit`` rows are read. JSON
    without a schema is read as loose JSON."""
    if spec.fmt == "json" and spec.schema is None:
        df = read_loose(spark, spec.path, limit if spec.ordinal is None else None)
        if spec.ordinal is None:
            return df
        return df.withColumn("ord", json_number(F.col(LINE), spec.ordinal).cast("bigint"))
    df = _reader(spark, spec.fmt, spec.schema).load(spec.path)
    if spec.ordinal is None and limit is not None:
        df = of_files(df, head_files(spark, spec.fmt, spec.path, limit, spec.schema))
    if spec.ordinal is None:
        df = with_file_ordinal(df)
    elif spec.ordinal != "ord":
        df = df.withColumn("ord", F.col(spec.ordinal))
    return df


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """Union of projected sources; the priority column keeps order
    (rows carry their own ordinal, so later repartitioning is harmless)."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def load_catalogue(
    spark: SparkSession, specs: list[SourceSpec], limit: int | None = None
) -> DataFrame:
    """Read every source, cap each at ``limit`` rows, project, union."""
    frames = []
    for priority, spec in enumerate(specs):
        raw = read_source(spark, spec, limit)
        # file ordinals are dense (0..n-1); a given ordinal column may not be
        raw = first_n(raw, limit) if spec.ordinal is None else first_n_by(raw, limit, "ord")
        frames.append(project_pairs(raw, spec, priority))
    return union_sources(frames)
