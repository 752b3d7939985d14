"""Registered queries over the driver's tables, each with its DuckDB oracle.

Every query reads the given parquet tables (whole tables, whole texts) and
returns a DataFrame whose column names match its oracle SQL. The test data
holds no Hangul, so the adapters below use accented Latin as the "source
script" and plain ASCII Latin as the "target script" (the patterns are
parameters of the operators).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import LATIN, WHITESPACE
from ..session import balanced
from ..sources.specs import FilterCfg

# Adapter patterns for the Latin-script test tables (parameters, not reference values).
ACCENTED = r"[\x{c0}-\x{ff}]"
NON_ASCII = r"[^\x{0}-\x{7f}]"
DOC_CFG = FilterCfg(src_pattern=ACCENTED, tgt_pattern=LATIN)


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    inventory: str


REGISTRY: dict[str, Query] = {}


def register(name: str, inventory: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = Query(name, fn, sql, inventory)
        return fn

    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --------------------------------------------------------------- adapters
def doc_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a multi-source parallel corpus: one source per
    ``srcN`` (priority N), ordinal doc_id, ko = text, en = text without
    non-ASCII characters."""
    d = balanced(table(spark, sf_dir, "documents"))
    return d.select(
        "source",
        F.regexp_extract("source", r"(\d+)$", 1).cast("int").alias("priority"),
        F.col("doc_id").alias("ord"),
        F.col("text").alias("ko_raw"),
        F.regexp_replace("text", NON_ASCII, "").alias("en_raw"),
        F.lit(None).cast("double").alias("score"),
    )


DOC_PAIRS_SQL = f"""
    SELECT source,
           CAST(regexp_extract(source, '(\\d+)$', 1) AS INTEGER) AS priority,
           doc_id AS ord, text AS ko_raw,
           regexp_replace(text, '{NON_ASCII}', '', 'g') AS en_raw
    FROM documents"""

def strip_sql(x: str) -> str:
    """Python str.strip() in DuckDB (its trim() has a different blank set)."""
    return "regexp_replace(" + x + ", '^" + WHITESPACE + "+|" + WHITESPACE + "+$', '', 'g')"


def waterfall_sql(pairs_sql: str, cfg: FilterCfg = DOC_CFG) -> str:
    """SQL text of the waterfall (schema .. ratio) over a pairs relation."""
    return f"""
    WITH p AS ({pairs_sql}),
    s AS (SELECT *, {strip_sql('ko_raw')} AS ko, {strip_sql('en_raw')} AS en FROM p)
    SELECT *,
      CASE WHEN ko_raw IS NULL OR en_raw IS NULL THEN 'schema'
           WHEN length(ko) = 0 OR length(en) = 0 THEN 'empty'
           WHEN NOT regexp_matches(ko, '{cfg.src_pattern}') THEN 'not_ko'
           WHEN NOT (regexp_matches(en, '{cfg.tgt_pattern}')
                     AND NOT regexp_matches(en, '{cfg.src_pattern}')) THEN 'not_en'
           WHEN length(ko) < {cfg.char_min} OR length(ko) > {cfg.char_max_ko} THEN 'len_ko'
           WHEN length(en) < {cfg.char_min} OR length(en) > {cfg.char_max_en} THEN 'len_en'
           WHEN CAST(length(en) AS DOUBLE) / greatest(length(ko), 1) < {cfg.ratio_min}
             OR CAST(length(en) AS DOUBLE) / greatest(length(ko), 1) > {cfg.ratio_max} THEN 'ratio'
      END AS reason
    FROM s"""


def annotated_sql(pairs_sql: str, cfg: FilterCfg = DOC_CFG) -> str:
    """Waterfall + priority dedup ('dup' for losing claimants)."""
    return f"""
    WITH w AS ({waterfall_sql(pairs_sql, cfg)}),
    k AS (SELECT *, CASE WHEN reason IS NULL THEN md5(nfc_normalize(lower({strip_sql('ko')}))) END AS dkey FROM w)
    SELECT * EXCLUDE (reason),
      CASE WHEN dkey IS NOT NULL
                AND row_number() OVER (PARTITION BY dkey ORDER BY priority, ord) > 1 THEN 'dup'
           ELSE reason END AS reason
    FROM k"""
