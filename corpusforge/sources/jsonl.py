"""JSON-lines readers (S5, S6) and writer (K1, K4)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import py_strip
from .corpus import first_n_at_least_one, head_files, of_files, with_file_ordinal

# Required keys of a curated test-set row (fixed values).
TESTSET_FIELDS = ("id", "ko", "en", "source", "date", "category")
CLEAN_PAIR_SCHEMA = "ko string, en string, source string, score double"


def read_jsonl(spark: SparkSession, path: str, schema: str = CLEAN_PAIR_SCHEMA, limit: int | None = None) -> DataFrame:
    """JSON lines with an explicit schema; blank lines are skipped,
    malformed lines raise. ``limit`` counts non-blank rows and, as in the
    reference loop (test after append), ``limit=0`` still yields one row.
    Adds ``ord`` (0-based arrival order)."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    if limit is not None:  # only the head files that can hold the first rows
        df = of_files(df, head_files(spark, "json", path, limit, schema))
    df = with_file_ordinal(df)
    if limit is None:
        return df
    return first_n_at_least_one(df, limit)


def read_required_jsonl(spark: SparkSession, path: str, required=TESTSET_FIELDS) -> DataFrame:
    """Every non-blank line must hold all ``required`` keys (a JSON null
    counts as present); extra keys are dropped; a missing key raises; a
    missing file raises FileNotFoundError. Values arrive as text."""
    try:
        raw = spark.read.text(path)
        raw.schema  # resolve the path now
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" in str(exc):
            raise FileNotFoundError(path) from exc
        raise

    def expand(df: DataFrame) -> DataFrame:
        return df.where(F.length(py_strip(F.col("value"))) > 0)

    lines = with_file_ordinal(raw, expand=expand)
    m = F.from_json(F.col("value"), "map<string,string>", {"mode": "FAILFAST"})
    # a filter, so that the check runs whatever columns are read, also for a count
    missing = F.array_except(F.array(*[F.lit(k) for k in required]), F.map_keys("m"))
    complete = F.when(F.size(missing) == 0, F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("row "), F.col("ord").cast("string"), F.lit(" lacks "), F.array_join(missing, ", "))).cast("boolean")
    )
    parsed = lines.select("ord", m.alias("m")).where(complete)
    return parsed.select("ord", *required_columns(F.col("m"), required, F.col("ord")))


def required_columns(m: Column, required, row_id: Column) -> list[Column]:
    """One column per required key of a JSON map; a missing key raises
    (KeyError in the reference). Key presence is tested, so null is legal."""
    return [
        F.when(F.map_contains_key(m, k), m[k])
        .otherwise(F.raise_error(F.concat(F.lit(f"missing key '{k}' in row "), row_id.cast("string"))))
        .cast("string")
        .alias(k)
        for k in required
    ]


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """K1/K4: JSON lines, UTF-8 kept raw, null fields omitted (so an absent
    score stays absent). A directory of part files, or one for each value of
    the columns ``partition_by``, which are then not in the lines."""
    writer = df.write.mode(mode).option("ignoreNullFields", "true")
    (writer.partitionBy(*partition_by) if partition_by else writer).json(path)
