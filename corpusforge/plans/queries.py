"""The registered queries. Importing this module fills
``registry.REGISTRY``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numeric import py_round
from ..functions.text import LATIN, LINE_BREAK, WHITESPACE
from ..operators import chat, infer, metrics, report, validate
from ..operators.align import align_texts
from ..operators.clean import apply_waterfall
from ..operators.dedup import annotate_duplicates, dedup_winners, with_dedup_key
from ..operators.score import apply_score_cut, score_distribution
from ..operators.split import exact_split
from ..operators.stats import final_distribution, outcome_counts_from_winners, totals
from ..session import Scratch, balanced, checkpoint_dir, cut_lineage
from ..sources.corpus import first_n, first_n_per_group, get_field, get_score, with_file_ordinal
from ..sources.jsonl import read_jsonl, read_required_jsonl, required_columns, write_jsonl
from ..sources.lines import read_parallel_lines
from ..sources.specs import SourceSpec, TestsetBounds
from .build import build_corpus
from .validate_sources import counted_rows
from .registry import (
    ACCENTED,
    DOC_CFG,
    DOC_PAIRS_SQL,
    NON_ASCII,
    annotated_sql,
    doc_pairs,
    register,
    strip_sql,
    table,
)


def doc_keyed(spark: SparkSession, sf_dir: str, scratch: Scratch) -> DataFrame:
    """Waterfall + key computed once into the shared checkpoint folder; the
    dedup aggregate and the outcome counts then read narrow columns of it."""
    return scratch.cut(with_dedup_key(apply_waterfall(doc_pairs(spark, sf_dir), DOC_CFG)), "doc_keyed")


# ------------------------------------------------------------ clean_stats
@register(
    "clean_stats",
    "P3-P12 D1 D2 A1",
    f"""
    WITH a AS ({annotated_sql(DOC_PAIRS_SQL)})
    SELECT source, coalesce(reason, 'passed') AS reason, count(*) AS n
    FROM a GROUP BY 1, 2""",
)
def clean_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "stats")
    keyed = doc_keyed(spark, sf_dir, scratch)
    counts = outcome_counts_from_winners(keyed, dedup_winners(keyed, ["source"], keyed=True))
    return finished(counts.select("source", F.coalesce("reason", F.lit("passed")).alias("reason"), "n"), scratch)


# --------------------------------------------------------- dedup_priority
@register(
    "dedup_priority",
    "D1 D2",
    f"""
    WITH a AS ({annotated_sql(DOC_PAIRS_SQL)})
    SELECT ord AS doc_id, source, dkey FROM a WHERE reason IS NULL""",
)
def dedup_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "stats")
    won = dedup_winners(doc_keyed(spark, sf_dir, scratch), ["source"], keyed=True)
    return finished(won.select(F.col("ord").alias("doc_id"), "source", "dkey"), scratch)


# ----------------------------------------------------- score_distribution
@register(
    "score_distribution",
    "A2",
    """
    WITH r AS (
      SELECT event_type AS source, value,
             row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i,
             count(*) OVER (PARTITION BY event_type) AS n
      FROM events WHERE value IS NOT NULL)
    SELECT source, any_value(n) AS n,
           CAST(printf('%.4f', min(value)) AS DOUBLE) AS min,
           CAST(printf('%.4f', max(value) FILTER (WHERE i = n // 10)) AS DOUBLE) AS p10,
           CAST(printf('%.4f', max(value) FILTER (WHERE i = n // 2)) AS DOUBLE) AS median,
           CAST(printf('%.4f', max(value) FILTER (WHERE i = n * 9 // 10)) AS DOUBLE) AS p90,
           CAST(printf('%.4f', max(value)) AS DOUBLE) AS max
    FROM r GROUP BY source""",
)
def q_score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return score_distribution(ev.select(F.col("event_type").alias("source"), F.col("value").alias("score")))


# -------------------------------------------------------------- score_cut
SCORE_CUT_PCT = 10.0


@register(
    "score_cut",
    "W1 U2",
    f"""
    WITH s AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i FROM events WHERE value IS NOT NULL),
    n AS (SELECT count(*) AS n FROM s),
    c AS (SELECT value AS cutoff FROM s, n
          WHERE i = least(CAST(floor(n * {SCORE_CUT_PCT}::DOUBLE / 100) AS BIGINT), n - 1))
    SELECT event_id, value FROM events, c WHERE value IS NULL OR value >= cutoff""",
)
def score_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id", "value")
    kept, _ = apply_score_cut(ev, SCORE_CUT_PCT, "value")
    return kept


# ------------------------------------------------------------ exact_split
SEED = 42
VAL_FRACTION = 0.05


@register(
    "exact_split",
    "W2 W3",
    f"""
    WITH h AS (SELECT doc_id, md5('{SEED}' || '|' || CAST(doc_id AS VARCHAR)) AS shuffle_key FROM documents),
    r AS (SELECT *, row_number() OVER (ORDER BY shuffle_key) AS rn, count(*) OVER () AS n FROM h)
    SELECT doc_id, shuffle_key,
           CASE WHEN rn <= CAST(floor(n * {VAL_FRACTION}::DOUBLE) AS BIGINT) THEN 'val' ELSE 'train' END AS split
    FROM r""",
)
def q_exact_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id")
    return exact_split(d, "doc_id", VAL_FRACTION, SEED).select("doc_id", "shuffle_key", "split")


# ===================================================== conversation pairs


def conv_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J2 on the test data: each user turn with the assistant turn right after
    it in the same conversation -> (conv_id, turn, src, tgt)."""
    c = table(spark, sf_dir, "conversations")
    user = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("src"))
    asst = c.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("tgt")
    )
    return user.join(asst, ["conv_id", "turn"])


CONV_PAIRS_SQL = """
    SELECT u.conv_id, u.turn, u.text AS src, a.text AS tgt
    FROM conversations u JOIN conversations a
      ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
    WHERE u.role = 'user' AND a.role = 'assistant'"""


@register("pairs_from_conversations", "J1", CONV_PAIRS_SQL)
def pairs_from_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv_pairs(spark, sf_dir)


# -------------------------------------------------------- reject_waterfall
CONV_AS_CORPUS_SQL = f"""
    SELECT 'conversations' AS source, 0 AS priority, struct_pack(c := conv_id, t := turn) AS ord,
           conv_id, turn, src AS ko_raw, tgt AS en_raw
    FROM ({CONV_PAIRS_SQL})"""


@register(
    "reject_waterfall",
    "P3-P12 D2",
    f"""
    WITH a AS ({annotated_sql(CONV_AS_CORPUS_SQL)})
    SELECT conv_id, turn, reason, dkey FROM a""",
)
def reject_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = conv_pairs(spark, sf_dir).select(
        F.lit("conversations").alias("source"),
        F.lit(0).alias("priority"),
        F.struct(F.col("conv_id").alias("c"), F.col("turn").alias("t")).alias("ord"),
        "conv_id",
        "turn",
        F.col("src").alias("ko_raw"),
        F.col("tgt").alias("en_raw"),
    )
    # the annotating form reads the keyed rows twice (winners + join back on
    # the row id): write them once so the text work and the UDF run once
    keyed = cut_lineage(with_dedup_key(apply_waterfall(p, DOC_CFG)), "conv_keyed")
    a = annotate_duplicates(keyed, keyed=True)
    return a.select("conv_id", "turn", "reason", "dkey")


# ------------------------------------- source_distribution / totals (A3 A4)
LABELED_DOC_PAIRS_SQL = f"""
    SELECT p.*, CAST(l.quality AS DOUBLE) AS score
    FROM ({DOC_PAIRS_SQL}) p LEFT JOIN labels l ON l.doc_id = p.ord"""
BUILD_CUT_PCT = 10.0


def labeled_doc_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a corpus whose rows carry a score when labelled."""
    labels = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("ord"), F.col("quality").cast("double").alias("score")
    )
    return doc_pairs(spark, sf_dir).drop("score").join(labels, "ord", "left")


def _built_sql() -> str:
    return f"""
    WITH a AS ({annotated_sql(LABELED_DOC_PAIRS_SQL)}),
    kept AS (SELECT * FROM a WHERE reason IS NULL),
    sc AS (SELECT score, row_number() OVER (ORDER BY score) - 1 AS i FROM kept WHERE score IS NOT NULL),
    n AS (SELECT count(*) AS n FROM sc),
    cut AS (SELECT score AS cutoff FROM sc, n
            WHERE i = least(CAST(floor(n * {BUILD_CUT_PCT}::DOUBLE / 100) AS BIGINT), n - 1)),
    after AS (SELECT kept.* FROM kept LEFT JOIN cut ON true
              WHERE kept.score IS NULL OR cut.cutoff IS NULL OR kept.score >= cut.cutoff),
    h AS (SELECT *, md5('{SEED}' || '|' || dkey) AS shuffle_key FROM after),
    r AS (SELECT *, row_number() OVER (ORDER BY shuffle_key) AS rn, count(*) OVER () AS cnt FROM h),
    s AS (SELECT *, CASE WHEN rn <= CAST(floor(cnt * {VAL_FRACTION}::DOUBLE) AS BIGINT)
                         THEN 'val' ELSE 'train' END AS split FROM r)"""


def doc_build(spark: SparkSession, sf_dir: str):
    return build_corpus(labeled_doc_pairs(spark, sf_dir), DOC_CFG, BUILD_CUT_PCT, VAL_FRACTION, SEED)


def finished(df: DataFrame, *scratches: Scratch | None) -> DataFrame:
    """A small result, written, after which the job's own tables go."""
    out = cut_lineage(df, "result")
    for scratch in scratches:
        if scratch is not None:
            scratch.drop()
    return out


@register(
    "source_distribution",
    "A3 U3",
    _built_sql() + " SELECT source, count(*) AS n FROM s GROUP BY source",
)
def source_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = doc_build(spark, sf_dir)
    return finished(final_distribution(b.kept), b.scratch)


@register(
    "totals",
    "A4 W1 W3",
    _built_sql()
    + """
    SELECT (SELECT count(*) FROM kept) AS before_score_filter,
           count(*) AS after_score_filter,
           (SELECT count(*) FROM kept) - count(*) AS dropped_by_score_filter,
           count(*) FILTER (WHERE split = 'train') AS train,
           count(*) FILTER (WHERE split = 'val') AS val
    FROM s""",
)
def q_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = doc_build(spark, sf_dir)
    return finished(totals(b.before_cut, b.kept), b.scratch)


# ------------------------------------------------------------ sanity_report
SAMPLE_N = 10


@register(
    "sanity_report",
    "P2 P8 A5 A7",
    f"""
    WITH s AS (SELECT source, text AS ko, regexp_replace(text, '{NON_ASCII}', '', 'g') AS en,
                      row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn
               FROM documents),
    g AS (SELECT source AS name, count(*) AS n_samples,
                 CAST(sum(CASE WHEN coalesce(length(ko), 0) > 0 AND regexp_matches(ko, '{ACCENTED}')
                           AND coalesce(length(en), 0) > 0 AND regexp_matches(en, '{LATIN}')
                           AND NOT regexp_matches(en, '{ACCENTED}') THEN 1 ELSE 0 END) AS BIGINT) AS n_ok
          FROM s WHERE rn <= {SAMPLE_N} GROUP BY source),
    r AS (SELECT *, CAST(printf('%.2f', n_ok / greatest(n_samples, 1)) AS DOUBLE) AS sanity_pass_rate FROM g)
    SELECT name, '{{ko,en}}' AS schema, n_samples, n_ok, sanity_pass_rate,
           CASE WHEN n_samples = 0 THEN 'empty' WHEN sanity_pass_rate >= 0.5 THEN 'ok' ELSE 'low_sanity' END AS status,
           (n_samples > 0 AND sanity_pass_rate >= 0.5) AS selected
    FROM r""",
)
def sanity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(
        "source", "doc_id", F.col("text").alias("ko"), F.regexp_replace("text", NON_ASCII, "").alias("en")
    )
    _, _, desc = report.probe_schema(d.select("ko", "en").schema)
    sample = first_n_per_group(d, ["source"], "doc_id", SAMPLE_N)
    summary = report.sanity_summary(sample, ["source"], ACCENTED, LATIN)
    return summary.select(
        F.col("source").alias("name"),
        F.lit(desc).alias("schema"),
        "n_samples",
        "n_ok",
        "sanity_pass_rate",
        "status",
        (F.col("status") == "ok").alias("selected"),
    )


# --------------------------------------------------------------- row_counts
TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


@register(
    "row_counts",
    "S4",
    " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS num_rows FROM {t}" for t in TABLES),
)
def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = [
        counted_rows(spark, SourceSpec(t, f"{sf_dir}/{t}.parquet")).select(F.lit(t).alias("table_name"), "num_rows") for t in TABLES
    ]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# ----------------------------------------------------------- validate_issues
def _testset_issue_sql(rows_sql: str, with_ord: bool = False) -> str:
    """Oracle of V1-V5 over rows (id, ko, en[, ord])."""
    b = TestsetBounds()
    # the first SELECT of each UNION names the column, the others follow it
    ds_ord, ds_ord2 = (", NULL::BIGINT AS row_ord", ", NULL") if with_ord else ("", "")
    row_ord, row_ord2 = (", ord AS row_ord", ", ord") if with_ord else ("", "")
    ratio = "CAST(length(en) AS DOUBLE) / greatest(length(ko), 1)"
    rng = f"[{float(b.ratio_min)!r}, {float(b.ratio_max)!r}]"
    return f"""
    WITH t AS ({rows_sql}),
    dups AS (
      SELECT 'dataset' AS scope, NULL::VARCHAR AS id, 'dup_id' AS "check", CAST(n AS DOUBLE) AS value,
             'duplicate ids: ' || n AS message{ds_ord}, 0 AS check_no
      FROM (SELECT count(*) - count(DISTINCT id) AS n FROM t) WHERE n > 0
      UNION ALL
      SELECT 'dataset', NULL, 'dup_ko', CAST(n AS DOUBLE), 'duplicate korean sentences: ' || n{ds_ord2}, 1
      FROM (SELECT count(*) - count(DISTINCT ko) AS n FROM t) WHERE n > 0),
    rows AS (
      SELECT 'row' AS scope, id, 'len_ko' AS "check", CAST(length(ko) AS DOUBLE) AS value,
             id || ': ko length out of range (' || length(ko) || ')' AS message{row_ord}, 2 AS check_no
      FROM t WHERE NOT (length(ko) BETWEEN {b.len_min} AND {b.len_max})
      UNION ALL
      SELECT 'row', id, 'len_en', CAST(length(en) AS DOUBLE),
             id || ': en length out of range (' || length(en) || ')'{row_ord2}, 3
      FROM t WHERE NOT (length(en) BETWEEN {b.len_min} AND {b.len_max})
      UNION ALL
      SELECT 'row', id, 'ratio', {ratio},
             id || ': en/ko length ratio ' || printf('%.2f', {ratio}) || ' out of {rng}'{row_ord2}, 4
      FROM t WHERE NOT ({ratio} BETWEEN {b.ratio_min} AND {b.ratio_max}))
    SELECT * FROM dups UNION ALL SELECT * FROM rows"""


@register(
    "validate_issues",
    "V1-V5 D3",
    _testset_issue_sql(
        """SELECT doc_id AS ord, CAST(doc_id AS VARCHAR) AS id, text AS ko,
                  replace(text, 'the', 'a') AS en FROM documents""",
        with_ord=True,
    ),
)
def validate_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("ord"),
        F.col("doc_id").cast("string").alias("id"),
        F.col("text").alias("ko"),
        F.replace(F.col("text"), F.lit("the"), F.lit("a")).alias("en"),
    )
    return validate.validate_testset(d, TestsetBounds())


# --------------------------------------------------------------- line_align
def _lines_sql(side: str, pair_expr: str, col: str) -> str:
    return f"""
      SELECT {pair_expr} AS pair_id, unnest(generate_series(0, len(parts) - 1)) AS pos,
             unnest(parts) AS {col}
      FROM (SELECT doc_id, CASE WHEN raw[-1] = '' THEN raw[1:len(raw) - 1] ELSE raw END AS parts
            FROM (SELECT doc_id, regexp_split_to_array(text, '{LINE_BREAK}') AS raw FROM documents))"""


@register(
    "line_align",
    "S7 J1",
    f"""
    WITH l AS ({_lines_sql('l', 'doc_id', 'src_line')}),
         r AS ({_lines_sql('r', 'doc_id - 1', 'tgt_line')})
    SELECT coalesce(l.pair_id, r.pair_id) AS pair_id, CAST(coalesce(l.pos, r.pos) AS INTEGER) AS pos,
           src_line, tgt_line, (l.pair_id IS NULL OR r.pair_id IS NULL) AS one_sided
    FROM l FULL OUTER JOIN r ON l.pair_id = r.pair_id AND l.pos = r.pos""",
)
def line_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    left = d.select(F.col("doc_id").alias("pair_id"), "text")
    right = d.select((F.col("doc_id") - 1).alias("pair_id"), "text")
    return align_texts(left, right, ["pair_id"], "text", "text", "src_line", "tgt_line")


# -------------------------------------------------------- nested_projection
@register(
    "nested_projection",
    "P1 P14 P15",
    f"""
    SELECT conv_id, turn, tgt AS src, src AS ref, CAST(turn AS DOUBLE) AS score
    FROM ({CONV_PAIRS_SQL})""",
)
def nested_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = conv_pairs(spark, sf_dir).select(
        "conv_id", "turn",
        F.struct(F.col("src").alias("ko"), F.col("tgt").alias("en")).alias("translation"),
        F.col("turn").alias("score"),
    )
    flat = nested.select(
        "conv_id", "turn",
        get_field(nested, "translation.ko").alias("ko"),
        get_field(nested, "translation.en").alias("en"),
        get_score(nested, "score").alias("score"),
    )
    src, ref = chat.direction_columns("en2ko")
    return flat.select("conv_id", "turn", src.alias("src"), ref.alias("ref"), "score")


# ------------------------------------------------------------- schema_probe
def _role_map_sql() -> str:
    k1 = "CASE role WHEN 'user' THEN 'ko' WHEN 'assistant' THEN 'src' ELSE 'korean' END"
    k2 = "CASE role WHEN 'user' THEN 'en' WHEN 'assistant' THEN 'tgt' ELSE 'note' END"
    return f"SELECT conv_id, turn, map([{k1}, {k2}], [text, text]) AS m FROM conversations"


@register(
    "schema_probe",
    "P2",
    f"""
    WITH t AS ({_role_map_sql()})
    SELECT conv_id, turn,
      CASE WHEN map_contains(m, 'ko') AND map_contains(m, 'en') THEN m['ko']
           WHEN map_contains(m, 'korean') AND map_contains(m, 'english') THEN m['korean']
           WHEN map_contains(m, 'src') AND map_contains(m, 'tgt') THEN m['src'] END AS ko,
      CASE WHEN map_contains(m, 'ko') AND map_contains(m, 'en') THEN m['en']
           WHEN map_contains(m, 'korean') AND map_contains(m, 'english') THEN m['english']
           WHEN map_contains(m, 'src') AND map_contains(m, 'tgt') THEN m['tgt'] END AS en,
      CASE WHEN map_contains(m, 'ko') AND map_contains(m, 'en') THEN '{{ko,en}}'
           WHEN map_contains(m, 'korean') AND map_contains(m, 'english') THEN '{{korean,english}}'
           WHEN map_contains(m, 'src') AND map_contains(m, 'tgt') THEN '{{src,tgt}}'
           ELSE 'unknown_schema: keys=[' ||
                array_to_string(list_transform(map_keys(m)[1:6], lambda k: '''' || k || ''''), ', ') || ']'
      END AS schema
    FROM t""",
)
def schema_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    role = F.col("role")
    k1 = F.when(role == "user", "ko").when(role == "assistant", "src").otherwise("korean")
    k2 = F.when(role == "user", "en").when(role == "assistant", "tgt").otherwise("note")
    t = c.select("conv_id", "turn", F.create_map(k1, F.col("text"), k2, F.col("text")).alias("m"))
    return t.select("conv_id", "turn", report.probe_map(F.col("m")).alias("p")).select(
        "conv_id", "turn", "p.ko", "p.en", "p.schema"
    )


# ----------------------------------------------------------- jsonl_required
@register(
    "jsonl_required",
    "S6",
    "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events",
)
def jsonl_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    m = F.from_json(F.col("props"), "map<string,string>", {"mode": "FAILFAST"})
    parsed = ev.select("event_id", m.alias("m"))
    return parsed.select("event_id", *required_columns(F.col("m"), ("k",), F.col("event_id")))


# ------------------------------------------------------------- sft_messages
@register(
    "sft_messages",
    "T1 T2",
    f"""
    WITH p AS ({CONV_PAIRS_SQL})
    SELECT conv_id, turn, 0 AS pos, 'system' AS role, '{chat.DEFAULT_SYSTEM["ko2en"]}' AS content FROM p
    UNION ALL SELECT conv_id, turn, 1, 'user', src FROM p
    UNION ALL SELECT conv_id, turn, 2, 'assistant', tgt FROM p""",
)
def sft_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = conv_pairs(spark, sf_dir).select("conv_id", "turn", F.col("src").alias("ko"), F.col("tgt").alias("en"))
    src, tgt = chat.direction_columns("ko2en")
    msgs = chat.prompt_messages(src, "ko2en")
    full = F.concat(msgs, F.array(F.struct(F.lit("assistant").alias("role"), tgt.alias("content"))))
    return p.select("conv_id", "turn", F.posexplode(full).alias("pos", "m")).select(
        "conv_id", "turn", "pos", "m.role", "m.content"
    )


# ------------------------------------------------------- bleu_13a / bleu_char / chrf
def doc_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ref = document text, hypothesis = text with 'the' replaced by 'a'."""
    d = balanced(table(spark, sf_dir, "documents"))
    return d.select(F.col("text").alias("ref"), F.replace(F.col("text"), F.lit("the"), F.lit("a")).alias("pred"))


def _rstrip_sql(x: str) -> str:
    return f"regexp_replace({x}, '{WHITESPACE}+$', '', 'g')"


def _ws_split_sql(x: str) -> str:
    return f"list_filter(regexp_split_to_array({strip_sql(x)}, '{WHITESPACE}+'), lambda t: length(t) > 0)"


def _tok13a_sql(x: str) -> str:
    y = _rstrip_sql(x)
    y = f"replace(replace(replace({y}, '<skipped>', ''), '-' || chr(10), ''), chr(10), ' ')"
    for a, b in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        y = f"replace({y}, '{a}', '{b}')"
    y = f"' ' || {y} || ' '"
    rules = (
        (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "),
        (r"([^0-9])([\.,])", r"\1 \2 "),
        (r"([\.,])([^0-9])", r" \1 \2"),
        (r"([0-9])(-)", r"\1 \2 "),
    )
    for pat, rep in rules:
        y = f"regexp_replace({y}, '{pat}', '{rep}', 'g')"
    return _ws_split_sql(y)


def _nows_sql(x: str) -> str:
    return f"regexp_replace({x}, '{WHITESPACE}+', '', 'g')"


def _ngram_ctes(units: str, max_n: int, sep: str) -> str:
    """Oracle CTEs for per-segment clipped n-gram matches. ``units`` defines
    d(sid, h, r) and u(sid, side, pos, c); n-grams come from lead() windows
    over the units (linear; substring() on UTF-8 text is quadratic)."""
    j = f" || '{sep}' || " if sep else " || "
    leads = ", ".join(
        "c" + "".join(f"{j}lead(c, {k}) OVER x" for k in range(1, n)) + f" AS g{n}" for n in range(1, max_n + 1)
    )
    unpivot = " UNION ALL ".join(
        f"SELECT sid, side, {n} AS n, g{n} AS g FROM wg WHERE g{n} IS NOT NULL" for n in range(1, max_n + 1)
    )
    return f"""{units},
    wg AS (SELECT sid, side, {leads} FROM u WINDOW x AS (PARTITION BY sid, side ORDER BY pos)),
    g AS ({unpivot}),
    hc AS (SELECT sid, n, g, count(*) AS c FROM g WHERE side = 0 GROUP BY ALL),
    rc AS (SELECT sid, n, g, count(*) AS c FROM g WHERE side = 1 GROUP BY ALL),
    m AS (SELECT hc.n, sum(least(hc.c, rc.c)) AS m FROM hc JOIN rc USING (sid, n, g) GROUP BY hc.n)"""


def _token_units(tok) -> str:
    return f"""
    d AS (SELECT row_number() OVER () AS sid, {tok('pred')} AS h, {tok('text')} AS r
          FROM (SELECT text, replace(text, 'the', 'a') AS pred FROM documents)),
    u AS (SELECT sid, 0 AS side, unnest(h) AS c, unnest(generate_series(1, len(h))) AS pos FROM d WHERE len(h) > 0
          UNION ALL
          SELECT sid, 1, unnest(r), unnest(generate_series(1, len(r))) FROM d WHERE len(r) > 0),
    lens AS (SELECT len(h) AS hl, len(r) AS rl FROM d)"""


def _char_units() -> str:
    """Whitespace-free text split into code points (char BLEU tokens and
    chrF characters)."""
    return f"""
    d AS (SELECT row_number() OVER () AS sid, {_nows_sql('pred')} AS h, {_nows_sql('text')} AS r
          FROM (SELECT text, replace(text, 'the', 'a') AS pred FROM documents)),
    u AS (SELECT sid, 0 AS side, unnest(string_split(h, '')) AS c, unnest(generate_series(1, length(h))) AS pos
          FROM d WHERE length(h) > 0
          UNION ALL
          SELECT sid, 1, unnest(string_split(r, '')), unnest(generate_series(1, length(r))) FROM d WHERE length(r) > 0),
    lens AS (SELECT length(h) AS hl, length(r) AS rl FROM d)"""


def _bleu_sql(units: str, sep: str) -> str:
    """Oracle for BLEU over the units of ``_token_units`` / ``_char_units``."""
    return f"""
    WITH {_ngram_ctes(units, 4, sep)},
    t AS (SELECT n, sum(greatest(hl - n + 1, 0)) AS t FROM lens, range(1, 5) o(n) GROUP BY n),
    L AS (SELECT sum(hl) AS sys_len, sum(rl) AS ref_len FROM lens),
    w AS (SELECT
        coalesce((SELECT m FROM m WHERE n = 1), 0)::BIGINT AS m1, coalesce((SELECT m FROM m WHERE n = 2), 0)::BIGINT AS m2,
        coalesce((SELECT m FROM m WHERE n = 3), 0)::BIGINT AS m3, coalesce((SELECT m FROM m WHERE n = 4), 0)::BIGINT AS m4,
        (SELECT t FROM t WHERE n = 1)::BIGINT AS t1, (SELECT t FROM t WHERE n = 2)::BIGINT AS t2,
        (SELECT t FROM t WHERE n = 3)::BIGINT AS t3, (SELECT t FROM t WHERE n = 4)::BIGINT AS t4,
        sys_len::BIGINT AS sys_len, ref_len::BIGINT AS ref_len FROM L),
    z AS (SELECT *,
        (CASE WHEN m1 = 0 THEN 1 ELSE 0 END) AS z1,
        (CASE WHEN m1 = 0 THEN 1 ELSE 0 END) + (CASE WHEN m2 = 0 THEN 1 ELSE 0 END) AS z2,
        (CASE WHEN m1 = 0 THEN 1 ELSE 0 END) + (CASE WHEN m2 = 0 THEN 1 ELSE 0 END) + (CASE WHEN m3 = 0 THEN 1 ELSE 0 END) AS z3,
        (CASE WHEN m1 = 0 THEN 1 ELSE 0 END) + (CASE WHEN m2 = 0 THEN 1 ELSE 0 END) + (CASE WHEN m3 = 0 THEN 1 ELSE 0 END)
          + (CASE WHEN m4 = 0 THEN 1 ELSE 0 END) AS z4 FROM w)
    SELECT m1, m2, m3, m4, t1, t2, t3, t4, sys_len, ref_len,
      CAST(printf('%.2f', CASE WHEN m1 + m2 + m3 + m4 = 0 OR t1 = 0 OR t2 = 0 OR t3 = 0 OR t4 = 0 THEN 0.0 ELSE
        (CASE WHEN sys_len < ref_len THEN (CASE WHEN sys_len > 0 THEN exp(1 - ref_len / sys_len) ELSE 0.0 END) ELSE 1.0 END)
        * exp((ln(CASE WHEN m1 = 0 THEN 100.0 / (pow(2, z1) * t1) ELSE 100.0 * m1 / t1 END)
             + ln(CASE WHEN m2 = 0 THEN 100.0 / (pow(2, z2) * t2) ELSE 100.0 * m2 / t2 END)
             + ln(CASE WHEN m3 = 0 THEN 100.0 / (pow(2, z3) * t3) ELSE 100.0 * m3 / t3 END)
             + ln(CASE WHEN m4 = 0 THEN 100.0 / (pow(2, z4) * t4) ELSE 100.0 * m4 / t4 END)) / 4.0)
      END) AS DOUBLE) AS bleu
    FROM z"""


def _bleu_query(spark: SparkSession, sf_dir: str, tok: str) -> DataFrame:
    stats = metrics.bleu_stats(doc_eval(spark, sf_dir), "pred", "ref", tok)
    return stats.select("*", py_round(metrics.bleu_score(stats), 2).alias("bleu"))


@register("bleu_13a", "A8 (13a)", _bleu_sql(_token_units(_tok13a_sql), " "))
def bleu_13a(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bleu_query(spark, sf_dir, "13a")


@register("bleu_char", "A8 (char)", _bleu_sql(_char_units(), ""))
def bleu_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bleu_query(spark, sf_dir, "char")


def _chrf_sql() -> str:
    cols_m = ", ".join(f"coalesce((SELECT m FROM m WHERE n = {n}), 0)::BIGINT AS m{n}" for n in range(1, 7))
    cols_h = ", ".join(f"(SELECT h FROM t WHERE n = {n})::BIGINT AS h{n}" for n in range(1, 7))
    cols_r = ", ".join(f"(SELECT r FROM t WHERE n = {n})::BIGINT AS r{n}" for n in range(1, 7))
    both = lambda n: f"(h{n} > 0 AND r{n} > 0)"
    sp = " + ".join(f"(CASE WHEN {both(n)} THEN m{n} / h{n} ELSE 0 END)" for n in range(1, 7))
    sr = " + ".join(f"(CASE WHEN {both(n)} THEN m{n} / r{n} ELSE 0 END)" for n in range(1, 7))
    eff = " + ".join(f"(CASE WHEN {both(n)} THEN 1 ELSE 0 END)" for n in range(1, 7))
    return f"""
    WITH {_ngram_ctes(_char_units(), 6, "")},
    t AS (SELECT n, sum(CASE WHEN rl >= n THEN greatest(hl - n + 1, 0) ELSE 0 END) AS h, sum(greatest(rl - n + 1, 0)) AS r
          FROM lens, range(1, 7) o(n) GROUP BY n),
    w AS (SELECT {cols_m}, {cols_h}, {cols_r}),
    a AS (SELECT *, CASE WHEN ({eff}) > 0 THEN ({sp}) / ({eff}) ELSE 0 END AS ap,
                    CASE WHEN ({eff}) > 0 THEN ({sr}) / ({eff}) ELSE 0 END AS ar FROM w)
    SELECT * EXCLUDE (ap, ar),
      CAST(printf('%.2f', CASE WHEN ap + ar > 0 THEN 100.0 * 5.0 * ap * ar / (4.0 * ap + ar) ELSE 0.0 END) AS DOUBLE) AS chrf
    FROM a"""


@register("chrf", "A9", _chrf_sql())
def chrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = metrics.chrf_stats(doc_eval(spark, sf_dir), "pred", "ref")
    return stats.select("*", py_round(metrics.chrf_score(), 2).alias("chrf"))


# -------------------------------------------------- system_score / head20 / batch_infer
def conv_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, src, ref, pred): pred = ref with 'the' -> 'a'."""
    p = conv_pairs(spark, sf_dir)
    return p.select(
        "conv_id", "turn", "src", F.col("tgt").alias("ref"),
        F.replace(F.col("tgt"), F.lit("the"), F.lit("a")).alias("pred"),
    )


def _length_ratio_scorer(rows: list[dict]) -> list[float]:
    # stand-in segment scorer (a neural scorer plugs in the same way)
    return [len(r["mt"]) / max(len(r["src"]), 1) for r in rows]


@register(
    "system_score",
    "T4 A10",
    f"""
    SELECT CAST(printf('%.4f', avg(length(replace(tgt, 'the', 'a')) / greatest(length(src), 1))) AS DOUBLE)
           AS system_score
    FROM ({CONV_PAIRS_SQL})""",
)
def system_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = infer.score_segments(conv_eval(spark, sf_dir), _length_ratio_scorer)
    return infer.system_score(scored)


@register(
    "head20",
    "W5",
    f"""
    SELECT conv_id, turn, src, tgt AS ref, replace(tgt, 'the', 'a') AS pred
    FROM ({CONV_PAIRS_SQL}) ORDER BY conv_id, turn LIMIT 20""",
)
def head20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv_eval(spark, sf_dir).orderBy("conv_id", "turn").limit(20)


def _stub_translate(batch: list[str]) -> list[str]:
    # deterministic stand-in for a model; padded so the operator's strip shows
    return ["  " + s.replace("the", "a") + " \n" for s in batch]


@register(
    "batch_infer",
    "T3",
    f"""
    SELECT conv_id, turn, {strip_sql("'  ' || replace(src, 'the', 'a') || ' ' || chr(10)")} AS pred
    FROM ({CONV_PAIRS_SQL})""",
)
def batch_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = conv_pairs(spark, sf_dir).select("conv_id", "turn", "src")
    return infer.batch_predict(p, _stub_translate, "src", "pred", batch_size=4).select("conv_id", "turn", "pred")


# ------------------------------------------------------------- first_n_scan
FIRST_N = 500  # the cap is the operator (S1): first N rows in file order


@register(
    "first_n_scan",
    "S1 W4",
    f"""
    SELECT ord, doc_id, source
    FROM (SELECT row_number() OVER () - 1 AS ord, doc_id, source FROM documents)
    WHERE ord < {FIRST_N}""",
)
def first_n_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = with_file_ordinal(table(spark, sf_dir, "documents").select("doc_id", "source"))
    return first_n(d, FIRST_N).select("ord", "doc_id", "source")


@register(
    "testset_jsonl",
    "K1 S6 V1-V5",
    _testset_issue_sql(
        f"""SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, src AS ko, tgt AS en
            FROM ({CONV_PAIRS_SQL})"""
    ),
)
def testset_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated test set round trip: conversation pairs written as JSON lines
    (K1) into the shared checkpoint folder, read back through the
    required-keys reader (S6), then validated (V1-V5)."""
    p = conv_pairs(spark, sf_dir).select(
        F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"),
        F.col("src").alias("ko"),
        F.col("tgt").alias("en"),
        F.lit("conversations").alias("source"),
        F.lit("").alias("date"),
        F.col("turn").cast("string").alias("category"),
    )
    path = f"{checkpoint_dir(spark).rstrip('/')}/corpusforge-testset-{uuid.uuid4().hex}"
    write_jsonl(p, path)
    rows = read_required_jsonl(spark, path)
    issues = validate.validate_testset(rows, TestsetBounds(), ord_col="ord")
    return issues.drop("row_ord")  # file order depends on the writer's part files


# ------------------------------------------------------- parallel_text_files
@register(
    "parallel_text_files",
    "S7 J1",
    f"""
    WITH p AS (SELECT regexp_split_to_array(text || chr(10), '{LINE_BREAK}') AS parts FROM documents),
    l AS (SELECT unnest(parts[1:len(parts) - 1]) AS line FROM p)
    SELECT count(*) AS n_lines, count(*) AS n_equal,
           CAST(sum(length(line)) AS BIGINT) AS src_chars
    FROM l""",
)
def parallel_text_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S7 on real files: document texts and their 'the'->'a' variant written
    as two line-oriented text files (one document after another, same
    order), read back with the strict line aligner. Order-independent output:
    every aligned pair must satisfy tgt == replace(src), so a misaligned
    reader shows as n_equal < n_lines."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text").orderBy("doc_id")
    base = f"{checkpoint_dir(spark).rstrip('/')}/corpusforge-lines-{uuid.uuid4().hex}"
    d.select("text").write.text(f"{base}/ko")
    d.select(F.replace(F.col("text"), F.lit("the"), F.lit("a"))).write.text(f"{base}/en")
    pairs = read_parallel_lines(spark, f"{base}/ko", f"{base}/en")
    return pairs.agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count(F.when(F.replace(F.col("ko"), F.lit("the"), F.lit("a")) == F.col("en"), 1)).alias("n_equal"),
        F.sum(F.length("ko")).cast("bigint").alias("src_chars"),
    )


# ------------------------------------------------------------ sft_from_jsonl
@register(
    "sft_from_jsonl",
    "K1 S5 T2",
    _built_sql()
    + f"""
    SELECT 0 AS pos, 'system' AS role, '{chat.DEFAULT_SYSTEM["ko2en"]}' AS content FROM s
    UNION ALL SELECT 1, 'user', ko FROM s
    UNION ALL SELECT 2, 'assistant', en FROM s""",
)
def sft_from_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """§3.4 data half on the build output: kept rows written as JSON lines
    (K1; a null score is omitted), read back with the clean-pair reader (S5),
    turned into chat rows (T2), one output row per message."""
    b = doc_build(spark, sf_dir)
    path = f"{checkpoint_dir(spark).rstrip('/')}/corpusforge-clean-{uuid.uuid4().hex}"
    write_jsonl(b.kept.select("ko", "en", "source", "score"), path)
    b.release()
    msgs = chat.sft_messages(read_jsonl(spark, path), "ko2en")
    return msgs.select(F.posexplode("messages").alias("pos", "m")).select("pos", "m.role", "m.content")
