"""Source validation report pieces.

Schema probing reads the DataFrame schema once (a file format has one
schema); ``probe_map`` is the per-row form for loose JSON maps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numeric import py_round
from ..functions.text import HANGUL, LATIN, has_script, null_safe
from ..sources.loose import json_has, json_keys, json_text

# Probe precedence and descriptions (fixed values).
LAYOUTS = (
    ("translation.ko", "translation.en", "translation.{ko,en}"),
    ("ko", "en", "{ko,en}"),
    ("korean", "english", "{korean,english}"),
    ("src", "tgt", "{src,tgt}"),
)
UNKNOWN_PREFIX = "unknown_schema: keys="
SAMPLE_LIMIT = 10


def _has_path(schema: T.StructType, path: str) -> bool:
    dtype: T.DataType = schema
    for part in path.split("."):
        if isinstance(dtype, T.StructType) and part in dtype.fieldNames():
            dtype = dtype[part].dataType
        elif isinstance(dtype, T.MapType):
            return True  # key presence is decided per row; see probe_map
        else:
            return False
    return True


def _py_list_repr(names: list[str]) -> str:
    return "[" + ", ".join(repr(n) for n in names) + "]"


def probe_schema(schema: T.StructType) -> tuple[str | None, str | None, str]:
    """P2 on a schema: (ko path, en path, description)."""
    for ko, en, desc in LAYOUTS:
        if _has_path(schema, ko) and _has_path(schema, en):
            return ko, en, desc
    return None, None, UNKNOWN_PREFIX + _py_list_repr(schema.fieldNames()[:6])


def probe_map(m: Column) -> Column:
    """P2 per row on MAP<STRING,STRING>: struct(ko, en, schema). Key presence,
    not non-null, decides; unknown rows list their first six keys."""
    keys = F.map_keys(m)
    quoted = F.transform(F.slice(keys, 1, 6), lambda k: F.concat(F.lit("'"), k, F.lit("'")))
    unknown = F.concat(F.lit(UNKNOWN_PREFIX + "["), F.array_join(quoted, ", "), F.lit("]"))
    ko = en = desc = None
    for k_name, e_name, d in reversed(LAYOUTS):
        holder = m
        if "." in k_name:  # an object inside the map arrives as its JSON text
            outer, k_name = k_name.split(".")
            e_name = e_name.split(".")[1]
            holder = F.from_json(m[outer], "map<string,string>")
        cond = F.map_contains_key(holder, k_name) & F.map_contains_key(holder, e_name)
        ko = F.when(cond, holder[k_name]) if ko is None else F.when(cond, holder[k_name]).otherwise(ko)
        en = F.when(cond, holder[e_name]) if en is None else F.when(cond, holder[e_name]).otherwise(en)
        desc = F.when(cond, F.lit(d)).otherwise(unknown if desc is None else desc)
    return F.struct(ko.alias("ko"), en.alias("en"), desc.alias("schema"))


def probe_json(row: Column) -> Column:
    """P2 per row of a loose JSON source: struct(ko, en, schema). Keys that are
    there decide, whatever their values; values that are not text are null.
    Unknown rows list their first six keys (sorted)."""
    quoted = F.transform(F.slice(json_keys(row), 1, 6), lambda k: F.concat(F.lit("'"), k, F.lit("'")))
    unknown = F.concat(F.lit(UNKNOWN_PREFIX + "["), F.array_join(quoted, ", "), F.lit("]"))
    none = F.lit(None).cast("string")
    found = F.struct(none.alias("ko"), none.alias("en"), unknown.alias("schema"))
    for ko, en, desc in reversed(LAYOUTS):
        here = F.struct(json_text(row, ko).alias("ko"), json_text(row, en).alias("en"), F.lit(desc).alias("schema"))
        found = F.when(json_has(row, ko) & json_has(row, en), here).otherwise(found)
    return found


def sanity_ok(ko: Column, en: Column, src_pattern: str = HANGUL, tgt_pattern: str = LATIN) -> Column:
    """A5 row test (validator form): text not stripped, null/empty is False."""
    is_ko = null_safe(has_script(ko, src_pattern), ko)
    is_en = null_safe(has_script(en, tgt_pattern) & ~has_script(en, src_pattern), en)
    return is_ko & is_en


def status_col(n: Column, rate: Column) -> Column:
    """A6 for a sample that was read: empty / ok / low_sanity."""
    return F.when(n == 0, "empty").when(rate >= 0.5, "ok").otherwise("low_sanity")


def sanity_summary(samples: DataFrame, group_cols: list[str], src_pattern: str = HANGUL, tgt_pattern: str = LATIN) -> DataFrame:
    """A5/A6 per group of sampled rows (ko, en): n, n_ok, rate, status."""
    agg = samples.groupBy(*group_cols).agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.sum(sanity_ok(F.col("ko"), F.col("en"), src_pattern, tgt_pattern).cast("int")).alias("n_ok"),
    )
    rate = py_round(F.col("n_ok").cast("double") / F.greatest(F.col("n_samples"), F.lit(1)), 2)
    return agg.withColumn("sanity_pass_rate", rate).withColumn(
        "status", status_col(F.col("n_samples"), F.col("sanity_pass_rate"))
    )
