"""Registered queries that go through whole readers and programs: loose JSON,
the capped catalogue, the source report, strict zip, evaluation. Their inputs
are files that Spark writes from the given tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import LATIN
from ..operators.align import zip_by_id
from ..operators.clean import apply_waterfall
from ..operators.stats import final_distribution
from ..session import Scratch
from ..sources.corpus import load_catalogue
from ..sources.lines import load_eval_pairs
from ..sources.specs import FilterCfg, SourceSpec
from .build import build_corpus, build_stats
from .evaluate import evaluate
from .queries import conv_pairs, finished
from .registry import ACCENTED, DOC_CFG, NON_ASCII, annotated_sql, register, strip_sql, table, waterfall_sql
from .validate_sources import source_report

# --------------------------------------------------------------- loose_json
#: What ``ko`` and ``score`` are in a line, by turn: text and numbers of every
#: JSON kind, objects, arrays, truth values, nulls, and no key at all.
_KO_KINDS = ("text", "number", "object", "null", "none", "truth", "array", "digits")


def loose_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, value): a JSON line for each row of conversations."""
    c = table(spark, sf_dir, "conversations")
    kind = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(_KO_KINDS)))
    text = F.to_json(F.struct(F.col("text").alias("x")))
    quoted = F.substring(text, 6, F.length(text) - 6)  # the JSON string between {"x": and }
    ko = (
        F.when(kind == 0, quoted)
        .when(kind == 1, F.col("conv_id").cast("string"))
        .when(kind == 2, F.concat(F.lit('{"ko":'), quoted, F.lit("}")))
        .when(kind == 3, "null")
        .when(kind == 5, "true")
        .when(kind == 6, F.concat(F.lit("["), quoted, F.lit("]")))
        .when(kind == 7, F.concat(F.lit('"'), F.col("conv_id").cast("string"), F.lit('"')))
    )
    score = F.when(kind == 0, "0.5").when(kind == 1, "7").when(kind == 2, "false").when(kind == 3, '"0.5"').when(kind == 4, "null").when(kind == 5, "1e2")
    en = F.concat(F.lit('"en":"row '), F.col("conv_id").cast("string"), F.lit(" of turn "), F.col("turn").cast("string"), F.lit('"'))
    fields = F.concat_ws(",", F.concat(F.lit('"ko":'), ko), en, F.concat(F.lit('"score":'), score))
    return c.select("conv_id", "turn", F.concat(F.lit('{"p":{'), fields, F.lit("}}")).alias("value"))


def write_in_order(df: DataFrame, path: str, *order: str) -> None:
    """Text lines, in this order over the files by name."""
    df.orderBy(*order).select("value").write.text(path)


LOOSE_SQL = """
    SELECT 'loose' AS source, 0 AS priority, conv_id, turn,
           CASE (conv_id + turn) % 8 WHEN 0 THEN text WHEN 7 THEN CAST(conv_id AS VARCHAR) END AS ko_raw,
           'row ' || conv_id || ' of turn ' || turn AS en_raw,
           CASE (conv_id + turn) % 8 WHEN 0 THEN 0.5::DOUBLE WHEN 1 THEN 7.0::DOUBLE WHEN 2 THEN 0.0::DOUBLE WHEN 5 THEN 100.0::DOUBLE END AS score
    FROM conversations"""


@register("loose_json", "P1 P3 P4 P15 U1", f"SELECT ko, en, score, coalesce(reason, 'passed') AS reason FROM ({waterfall_sql(LOOSE_SQL)})")
def loose_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "loose")
    path = scratch.new_folder("lines")
    write_in_order(loose_lines(spark, sf_dir), path, "conv_id", "turn")
    spec = SourceSpec("loose", path, fmt="json", ko_field="p.ko", en_field="p.en", score_field="p.score")
    rows = apply_waterfall(load_catalogue(spark, [spec]), DOC_CFG)
    return rows.select("ko", "en", "score", F.coalesce("reason", F.lit("passed")).alias("reason"))


# --------------------------------------------------------- capped_catalogue
CATALOGUE_CAP = 300
#: Other numbers than the defaults.
TIGHT_CFG = FilterCfg(char_min=20, char_max_ko=2000, char_max_en=1500, ratio_min=0.5, ratio_max=1.0, src_pattern=ACCENTED, tgt_pattern=LATIN)

CATALOGUE_SQL = f"""
    SELECT source, priority, ord, ko_raw, en_raw, score FROM (
      SELECT 'loose' AS source, 0 AS priority, row_number() OVER (ORDER BY conv_id, turn) - 1 AS ord, ko_raw, en_raw, score FROM ({LOOSE_SQL}))
    WHERE ord < {CATALOGUE_CAP}
    UNION ALL
    SELECT * FROM (
      SELECT 'by_lang' AS source, 1 AS priority, row_number() OVER (ORDER BY lang, doc_id) - 1 AS ord, text AS ko_raw,
             regexp_replace(text, '{NON_ASCII}', '', 'g') AS en_raw, NULL::DOUBLE AS score FROM documents)
    WHERE ord < {CATALOGUE_CAP}
    UNION ALL
    SELECT * FROM (
      SELECT 'by_id' AS source, 2 AS priority, row_number() OVER (ORDER BY doc_id) - 1 AS rn, text AS ko_raw,
             regexp_replace(text, '{NON_ASCII}', '', 'g') AS en_raw, NULL::DOUBLE AS score FROM documents)
    WHERE rn < {CATALOGUE_CAP}"""


def catalogue(spark: SparkSession, sf_dir: str, scratch: Scratch) -> list[SourceSpec]:
    """Loose JSON lines, a source partitioned by language, and one with its own ordinal."""
    docs = table(spark, sf_dir, "documents").withColumn("en", F.regexp_replace("text", NON_ASCII, ""))
    lines, parts, own = (scratch.new_folder(n) for n in ("lines", "parts", "own"))
    write_in_order(loose_lines(spark, sf_dir), lines, "conv_id", "turn")
    docs.select("doc_id", "lang", F.struct(F.col("text").alias("ko"), "en").alias("translation")).orderBy("doc_id").write.partitionBy("lang").parquet(parts)
    docs.select("doc_id", F.col("text").alias("ko"), "en").write.parquet(own)
    return [
        SourceSpec("loose", lines, fmt="json", ko_field="p.ko", en_field="p.en", score_field="p.score"),
        SourceSpec("by_lang", parts, ko_field="translation.ko", en_field="translation.en"),
        SourceSpec("by_id", own, ordinal="doc_id"),
    ]


@register(
    "capped_catalogue",
    "S1 S2 P13 U1 D2",
    f"""
    WITH a AS ({annotated_sql(CATALOGUE_SQL, TIGHT_CFG)})
    SELECT source, coalesce(reason, 'passed') AS reason, count(*) AS n FROM a GROUP BY 1, 2""",
)
def capped_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "catalogue")
    pairs = load_catalogue(spark, catalogue(spark, sf_dir, scratch), CATALOGUE_CAP)
    b = build_corpus(pairs, TIGHT_CFG)
    out = b.counts.select("source", F.coalesce("reason", F.lit("passed")).alias("reason"), "n")
    return finished(out, b.scratch, scratch)


@register(
    "build_statistics",
    "K2 A1 A3 A4",
    f"""
    WITH a AS ({annotated_sql(CATALOGUE_SQL, TIGHT_CFG)})
    SELECT source, count(*) AS loaded, count(*) FILTER (reason IS NULL) AS passed,
           count(*) FILTER (reason IS NULL) AS final, (SELECT count(*) FROM a WHERE reason IS NULL) AS before_score_filter,
           CAST(floor((SELECT count(*) FROM a WHERE reason IS NULL) * 0.05::DOUBLE) AS BIGINT) AS val
    FROM a GROUP BY source""",
)
def build_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The statistics document of a build over the capped catalogue, as rows."""
    scratch = Scratch(spark, "catalogue")
    b = build_corpus(load_catalogue(spark, catalogue(spark, sf_dir, scratch), CATALOGUE_CAP), TIGHT_CFG)
    stats = json.loads(json.dumps(build_stats(b, CATALOGUE_CAP)))
    final = {r.source: r.n for r in final_distribution(b.kept).collect()}
    rows = [
        (name, s["loaded"], s["passed"], final.get(name, 0), stats["total"]["before_score_filter"], stats["total"]["val"])
        for name, s in stats["per_source"].items()
    ]
    b.release()
    scratch.drop()
    return spark.createDataFrame(rows, "source string, loaded bigint, passed bigint, final bigint, before_score_filter bigint, val bigint")


# ------------------------------------------------------------ source_report
REPORT_LIMIT = 10
BROKEN_AT = 3  # the first line of the broken source that is no JSON


def _sane_sql(ko: str, en: str) -> str:
    return f"(length({ko}) > 0 AND regexp_matches({ko}, '{ACCENTED}') AND length({en}) > 0 AND regexp_matches({en}, '{LATIN}') AND NOT regexp_matches({en}, '{ACCENTED}'))"


@register(
    "source_report",
    "S3 S4 P2 P8 A5 A6 A7 K3",
    f"""
    WITH d AS (SELECT text AS ko, regexp_replace(text, '{NON_ASCII}', '', 'g') AS en, row_number() OVER (ORDER BY doc_id) AS rn FROM documents),
    head AS (SELECT *, {_sane_sql('ko', 'en')} AS ok FROM d WHERE rn <= {REPORT_LIMIT}),
    r AS (SELECT count(*) AS n, CAST(printf('%.2f', count(*) FILTER (ok) / greatest(count(*), 1)) AS DOUBLE) AS rate FROM head),
    n AS (SELECT count(*) AS docs, (SELECT count(*) FROM benchmark) AS items FROM documents),
    rows AS (
      SELECT 'plain' AS name, docs AS num_rows, '{{ko,en}}' AS schema, n AS n_samples, rate AS sanity_pass_rate FROM r, n
      UNION ALL SELECT 'lines', docs, '{{src,tgt}}', n, rate FROM r, n
      UNION ALL SELECT 'unknown', items, 'unknown_schema: keys=[''item_id'', ''text'']', least(items, {REPORT_LIMIT}), 0.0 FROM n)
    SELECT name, num_rows, schema, n_samples, sanity_pass_rate,
           CASE WHEN n_samples = 0 THEN 'empty' WHEN sanity_pass_rate >= 0.5 THEN 'ok' ELSE 'low_sanity' END AS status,
           (n_samples > 0 AND sanity_pass_rate >= 0.5) AS selected, false AS has_error FROM rows
    UNION ALL SELECT 'missing', NULL, NULL, NULL, NULL, 'load_failed', false, true
    UNION ALL SELECT 'empty', 0, '?', 0, 0.0, 'empty', false, false
    UNION ALL SELECT 'broken', docs, NULL, least(docs, {BROKEN_AT}), NULL, 'iter_failed', false, true FROM n""",
)
def q_source_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of every state: readable ones of three layouts, a missing, an
    empty and a broken one (whose rows before the broken line are kept)."""
    scratch = Scratch(spark, "candidates")
    docs = table(spark, sf_dir, "documents").orderBy("doc_id").select(F.col("text").alias("ko"), F.regexp_replace("text", NON_ASCII, "").alias("en"))
    plain, lines, empty, broken = (scratch.new_folder(n) for n in ("plain", "lines", "empty", "broken"))
    docs.write.parquet(plain)
    docs.limit(0).write.parquet(empty)
    value = F.to_json(F.struct(F.col("ko").alias("src"), F.col("en").alias("tgt")))
    docs.select(value.alias("value")).write.text(lines)
    least = table(spark, sf_dir, "documents").agg(F.min("doc_id")).first()[0] or 0
    whole = F.to_json(F.struct(F.col("text").alias("ko")))
    cut = F.when(F.col("doc_id") - F.lit(least) >= BROKEN_AT, F.left(whole, F.lit(9))).otherwise(whole)
    table(spark, sf_dir, "documents").orderBy("doc_id").select(cut.alias("value")).write.text(broken)
    candidates = [
        SourceSpec("plain", plain),
        SourceSpec("lines", lines, fmt="json"),
        SourceSpec("unknown", f"{sf_dir}/benchmark.parquet"),
        SourceSpec("missing", f"{scratch.path}/none"),
        SourceSpec("empty", empty),
        SourceSpec("broken", broken, fmt="json"),
    ]
    report = source_report(spark, candidates, REPORT_LIMIT, ACCENTED, LATIN)
    out = report.select(
        "name",
        "num_rows",
        "schema",
        F.when(F.col("samples").isNotNull(), F.size("samples")).cast("bigint").alias("n_samples"),
        "sanity_pass_rate",
        "status",
        "selected",
        F.col("error").isNotNull().alias("has_error"),
    )
    return finished(out, scratch)


# ---------------------------------------------------------------- zip_by_id
@register("zip_strict", "J2", "SELECT CAST(doc_id AS VARCHAR) AS id, text AS ref, replace(text, 'the', 'a') AS pred FROM documents")
def zip_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References and predictions of whole documents, paired by id."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("ref"))
    return zip_by_id(d, d.select("id", F.replace(F.col("ref"), F.lit("the"), F.lit("a")).alias("pred")))


# ------------------------------------------------------------------ evaluate
_ONE_LINE = "[\\n\\r\\x{b}\\x{c}\\x{1c}\\x{1d}\\x{1e}\\x{85}\\x{2028}\\x{2029}]+"


class _Swap:
    """A stand-in model: a prediction of each source, in batches."""

    def __call__(self, batch: list[str]) -> list[str]:
        return [f" {s.replace('the', 'a')} " for s in batch]


@register(
    "evaluate_predictions",
    "S8 T1 T3 K4 K5 W5 A11",
    f"""
    WITH p AS (SELECT conv_id, turn, regexp_replace(text, '{_ONE_LINE}', ' ', 'g') AS src,
                      replace(regexp_replace(text, '{_ONE_LINE}', ' ', 'g'), 'e', 'E') AS ref,
                      row_number() OVER (ORDER BY conv_id, turn) - 1 AS ord, count(*) OVER () AS n_pairs FROM conversations)
    SELECT src, ref, {strip_sql("replace(src, 'the', 'a')")} AS pred, n_pairs, ((src, ref) IN (SELECT (src, ref) FROM p WHERE ord < 20)) AS sampled FROM p""",
)
def evaluate_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation rows as a line-aligned test set on disk, read by name,
    translated and scored; the predictions file read back, with what the result
    document says of them."""
    scratch = Scratch(spark, "evaluation")
    root, out = scratch.new_folder("testset"), scratch.new_folder("result")
    line = F.regexp_replace("text", _ONE_LINE, " ")
    c = table(spark, sf_dir, "conversations").orderBy("conv_id", "turn")
    c.select(line.alias("value")).write.text(f"{root}/devtest/kor_Hang.devtest")
    c.select(F.replace(line, F.lit("e"), F.lit("E")).alias("value")).write.text(f"{root}/devtest/eng_Latn.devtest")
    pairs = load_eval_pairs(spark, "flores", root)
    result = evaluate(spark, pairs, "ko2en", _Swap(), batch_size=64, output=f"{out}/result", dataset="flores", split="devtest")
    written = json.loads("\n".join(r.value for r in spark.read.text(f"{out}/result").collect()))
    assert written["n_pairs"] == result["n_pairs"] and written["translate_seconds"] >= 0
    sampled = spark.createDataFrame([(s["src"], s["ref"]) for s in written["samples"]], "src string, ref string").distinct()
    rows = spark.read.schema("src string, ref string, pred string").json(f"{out}/result.preds")
    rows = rows.join(F.broadcast(sampled.withColumn("sampled", F.lit(True))), ["src", "ref"], "left")
    return rows.select("src", "ref", "pred", F.lit(result["n_pairs"]).cast("bigint").alias("n_pairs"), F.coalesce("sampled", F.lit(False)).alias("sampled"))
