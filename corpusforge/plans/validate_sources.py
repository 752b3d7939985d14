"""Source report as a DataFrame: one row per candidate corpus.

What can fail is kept apart: counting, opening and reading. Each is a small
job over footers or over the first files, and its failure becomes a value of
the candidate's row. Rates and states are then computed in Spark from the
sampled rows of all candidates together.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import py_round
from ..functions.text import HANGUL, LATIN, py_strip
from ..operators.report import SAMPLE_LIMIT, probe_json, probe_schema, sanity_ok, status_col
from ..session import ship_package
from ..sources.corpus import get_field, of_files, read_loose, with_file_ordinal
from ..sources.loose import LINE
from ..sources.specs import SourceSpec

#: Fields of a report row (fixed names), in order.
REPORT = (
    "name string, path string, license string, notes string, num_rows bigint, num_rows_error string, columns array<string>, "
    "schema string, samples array<struct<ko:string,en:string,ok:boolean>>, sanity_pass_rate double, status string, error string"
)
_FOUND = "place int, name string, path string, license string, notes string, num_rows bigint, num_rows_error string, columns array<string>, failed string, error string"
_SAMPLES = "place int, i int, ko string, en string, schema string"


def error_text(exc: Exception) -> str:
    """``Type: message``, its first line; the JVM's own where it raised."""
    java = getattr(exc, "java_exception", None)
    if java is None:
        return f"{type(exc).__name__}: {exc}".splitlines()[0]
    kind, _, message = str(java.toString()).partition(": ")
    return f"{kind.rpartition('.')[2]}: {message}".splitlines()[0]


def is_loose(spec: SourceSpec) -> bool:
    return spec.fmt == "json" and spec.schema is None


def counted_rows(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    """The number of rows, as a frame. Columnar files tell it by their
    footers: no column is read. JSON has a row for each line that is not blank,
    so its lines are counted and nothing is parsed or inferred."""
    if spec.fmt == "json":
        lines = spark.read.text(spec.path)
        return lines.where(F.length(py_strip(F.col("value"))) > 0).agg(F.count(F.lit(1)).alias("num_rows"))
    return _opened(spark, spec).agg(F.count(F.lit(1)).alias("num_rows"))


def _opened(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    reader = spark.read.format(spec.fmt)
    return (reader.schema(spec.schema) if spec.schema else reader).load(spec.path)


@dataclass
class _Found:
    """What reading a candidate has given until now."""

    num_rows: int | None = None
    num_rows_error: str | None = None
    columns: list[str] | None = None
    failed: str | None = None  # the state that a failure gives
    error: str | None = None
    samples: list[tuple] = field(default_factory=list)  # (ko, en, schema)


def _samples_of_files(source: DataFrame, limit: int, read: Callable[[DataFrame, int], list]):
    """The rows of the first files in path order, file by file, up to the limit.
    A file that can't be read ends it; what came before stays (as given on)."""
    for name in sorted(source.inputFiles()):
        if limit <= 0:
            return
        rows = read(of_files(source, [name]), limit)
        limit -= len(rows)
        yield from rows


def _head_rows(source: DataFrame, limit: int) -> list:
    ko, en, desc = probe_schema(source.schema)
    none = F.lit(None).cast("string")
    head = with_file_ordinal(source).where(F.col("ord") < limit)
    head = head.select("ord", (get_field(head, ko) if ko else none).alias("ko"), (get_field(head, en) if en else none).alias("en"))
    return [(r.ko, r.en, desc) for r in head.orderBy("ord").collect()]


def _loose_rows(spark: SparkSession, path: str, limit: int, found: _Found) -> None:
    """Rows until the limit or the first line that is no JSON."""
    head = read_loose(spark, path, limit, strict=False).where(F.col("ord") < limit)
    head = head.select("ord", F.col(LINE).isNull().alias("bad"), probe_json(F.col(LINE)).alias("p"), F.expr(f"map_keys(try_variant_get({LINE}, '$', 'map<string,variant>'))").alias("keys"))
    for r in head.orderBy("ord").collect():  # at most ``limit`` rows
        if r.bad:
            found.failed, found.error = "iter_failed", f"malformed JSON in row {r.ord}"
            return
        found.columns = found.columns or r["keys"]
        found.samples.append((r.p.ko, r.p.en, r.p.schema))


def read_candidate(spark: SparkSession, spec: SourceSpec, limit: int = SAMPLE_LIMIT) -> _Found:
    found = _Found()
    try:
        found.num_rows = counted_rows(spark, spec).first().num_rows
    except Exception as exc:  # noqa: BLE001 - a value of the report
        found.num_rows_error = error_text(exc)
    limit = max(limit, 1)  # the first row is taken before the limit is tested
    try:
        source = spark.read.text(spec.path) if is_loose(spec) else _opened(spark, spec)
    except Exception as exc:  # noqa: BLE001
        found.failed, found.error = "load_failed", error_text(exc)
        return found
    try:
        if is_loose(spec):
            _loose_rows(spark, spec.path, limit, found)
        else:
            for row in _samples_of_files(source, limit, _head_rows):
                found.samples.append(row)
                found.columns = source.columns
    except Exception as exc:  # noqa: BLE001
        found.failed, found.error = "iter_failed", error_text(exc)
    return found


def source_report(
    spark: SparkSession, candidates: list[SourceSpec], limit: int = SAMPLE_LIMIT, src_pattern: str = HANGUL, tgt_pattern: str = LATIN
) -> DataFrame:
    """A row of ``REPORT`` for each candidate, in their order, and
    ``selected`` (its state is ok).

    A source that can't be opened is ``load_failed``; one that fails while it is
    read is ``iter_failed`` and keeps the rows read until then, without rate
    or schema; one without rows is ``empty`` with schema ``?``; a candidate that
    makes the reader itself fail is ``validator_crash``."""
    ship_package(spark)
    found, samples = [], []
    for place, spec in enumerate(candidates):
        try:
            f = read_candidate(spark, spec, limit)
        except Exception as exc:  # noqa: BLE001
            f = _Found(failed="validator_crash", error=error_text(exc))
        columns = None if f.failed else f.columns
        found.append((place, spec.name, spec.path, spec.license, spec.notes, f.num_rows, f.num_rows_error, columns, f.failed, f.error))
        samples += [(place, i, *row) for i, row in enumerate(f.samples)]
    heads = spark.createDataFrame(found, _FOUND)
    rows = spark.createDataFrame(samples, _SAMPLES).withColumn("ok", sanity_ok(F.col("ko"), F.col("en"), src_pattern, tgt_pattern))
    tested = rows.groupBy("place").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.col("ok").cast("int")).alias("n_ok"),
        F.max_by("schema", "i").alias("last_schema"),
        F.sort_array(F.collect_list(F.struct("i", "ko", "en", "ok"))).alias("s"),
    )
    whole = F.col("failed").isNull()
    n = F.coalesce("n", F.lit(0))
    rate = F.coalesce(py_round(F.col("n_ok") / F.col("n"), 2), F.lit(0.0))
    none = F.array().cast("array<struct<ko:string,en:string,ok:boolean>>")
    shown = F.coalesce(F.transform("s", lambda x: F.struct(x["ko"], x["en"], x["ok"])), none)
    out = heads.join(tested, "place", "left").select(
        "place",
        "name",
        "path",
        "license",
        "notes",
        "num_rows",
        "num_rows_error",
        "columns",
        F.when(whole, F.coalesce("last_schema", F.lit("?"))).alias("schema"),
        F.when(whole | (F.col("failed") == "iter_failed"), shown).alias("samples"),
        F.when(whole, rate).alias("sanity_pass_rate"),
        F.when(whole, status_col(n, rate)).otherwise(F.col("failed")).alias("status"),
        "error",
    )
    return out.withColumn("selected", F.col("status") == "ok").orderBy("place").drop("place")


def validate_sources(spark: SparkSession, candidates: list[SourceSpec], limit: int = SAMPLE_LIMIT, output: str | None = None, **patterns) -> dict:
    """The report as a document (K3): ``candidates`` with the fields that are
    known of each, and the names of the ``selected``; also written if asked."""
    rows = [r.asDict(recursive=True) for r in source_report(spark, candidates, limit, **patterns).collect()]
    selected = [r["name"] for r in rows if r.pop("selected")]
    optional = ("num_rows_error", "error")
    report = {
        "candidates": [{k: v for k, v in r.items() if v is not None or (k not in optional and r["error"] is None)} for r in rows],
        "selected": selected,
    }
    if output:
        text = json.dumps(report, ensure_ascii=False, indent=2)
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(output)
    return report
