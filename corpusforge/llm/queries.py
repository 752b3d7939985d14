"""The registered queries of this subpackage, and their DuckDB SQL where SQL
can express them. Each query applies its operator with production parameters
to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch
from . import ann, bpe, fingerprint, language_id, mixing, near_dup, pii, quality, repair, resample, sharding, toxicity, warc
from .sampling import remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

BPE_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PIECE_FILE = public_tokenizers.path("piece_bpe_32k.model")
LANG_FOLDS, LANG_HELD_OUT = 5, 0


QUALITY_FOLDS, QUALITY_HELD_OUT = 3, 1
TOXIC_FOLDS, TOXIC_HELD_OUT = 5, 0


def vocabulary(path: str = BPE_FILE) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def token_digests(docs: DataFrame) -> DataFrame:
    """Per document: the digests of its token ids and of what they decode to."""
    data = vocabulary()
    coded = bpe.with_round_trip(docs.select("doc_id", "text"), data, public_tokenizers.PATTERN).drop("text")
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@_query
def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(_table(spark, sf_dir, "documents"))


def held_out(folds: int, fold: int) -> Column:
    """Rows that no training reads; rows without an id are among them."""
    return F.coalesce(remainder("doc_id", folds) == fold, F.lit(True))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.ToxicityModel:
    learn = _table(spark, sf_dir, "labels").where(~held_out(TOXIC_FOLDS, TOXIC_HELD_OUT))
    return toxicity.train(_table(spark, sf_dir, "documents"), learn)


@_query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.with_toxicity(docs, toxicity_model(spark, sf_dir))
    return scored.select(
        "doc_id",
        held_out(TOXIC_FOLDS, TOXIC_HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@_query
def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


@_query
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    path = scratch.new_folder("archives")
    warc.write_archives(_table(spark, sf_dir, "pages"), path, "page_id", "url", "html")
    read = warc.read_archives(spark, path)

    def row_id(name: str) -> Column:
        return F.expr(f"try_cast(regexp_extract({name}, '^<urn:row:(.*)>$', 1) as bigint)")

    return read.select(
        row_id("record_id").alias("page_id"),
        "payload_bytes",
        F.coalesce(F.sha1("payload"), F.col("payload_digest")).alias("payload_digest"),
        "record_type",
        row_id("refers_to").alias("refers_to"),
    )


SQL["op4_warc"] = f"""
    WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
    d AS (SELECT page_id, octet_length(payload) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
    k AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS kept FROM d)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN payload_bytes >= {warc.LEAST_REVISIT} AND kept <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN payload_bytes >= {warc.LEAST_REVISIT} AND kept <> page_id THEN kept END AS refers_to
    FROM k"""


@_query
def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(_table(spark, sf_dir, "documents"))


@_query
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    learn = _table(spark, sf_dir, "labels").where(~held_out(QUALITY_FOLDS, QUALITY_HELD_OUT))
    scored = quality.with_quality(docs, quality.train(docs, learn))
    return scored.select(
        "doc_id",
        held_out(QUALITY_FOLDS, QUALITY_HELD_OUT).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def language_model(docs: DataFrame) -> language_id.LanguageModel:
    learn = docs.where(~held_out(LANG_FOLDS, LANG_HELD_OUT))
    return language_id.train(learn, language_id.read_vocabulary(PIECE_FILE))


@_query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = language_id.with_language(docs.select("doc_id", "text"), language_model(docs))
    return found.select("doc_id", held_out(LANG_FOLDS, LANG_HELD_OUT).alias("held_out"), "lang_pred", "score")


@_query
def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return ann.nearest_neighbours(rows, "vec_id", "embedding", F.col("vec_id") % 50 == 0)


@_query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


SQL["op9_mixing"] = f"""
    WITH d AS (
      SELECT doc_id, source,
             CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '{mixing.WORD}')) END AS size,
             md5('{mixing.SEED}|' || CAST(doc_id AS VARCHAR)) AS h
      FROM documents),
    s AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
    p AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM s),
    w AS (SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
                 source_size * {mixing.MAX_EPOCHS} AS cap FROM p),
    f AS (SELECT *, CAST(cap AS DOUBLE) / weight AS r,
                 coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, place
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                 sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, place
                                   ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS after,
                 sum(source_size) OVER () AS total FROM w),
    l AS (SELECT *, (CAST({mixing.SHARE} AS DOUBLE) * total - before) / after AS level FROM f),
    t AS (SELECT *, max(CASE WHEN level <= r THEN level END) OVER () AS top FROM l),
    g AS (SELECT source, source_size, least(CAST(cap AS DOUBLE), top * weight) AS target FROM t),
    k AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS whole FROM g),
    c AS (SELECT d.doc_id, d.size, k.*, CAST(round(k.target) AS BIGINT) - k.whole * k.source_size AS rest,
                 coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size
                          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS prior
          FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source)
    SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
           CAST(whole * size + greatest(0, least(size, rest - prior)) AS BIGINT) AS taken
    FROM c"""


@_query
def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"))


@_query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damaged(_table(spark, sf_dir, "conversations")))


@_query
def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_spans(_table(spark, sf_dir, "documents"))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    found = found.withColumn("base", F.filter("spans", lambda s: s["base"]))
    return found.select(
        "doc_id",
        *[number(k) for k in pii.KINDS],
        F.sha2(listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )


@_query
def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


SQL["op13_resampling"] = f"""
    WITH bytes AS (SELECT list(c ORDER BY i) AS crc FROM (
      SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k:
                 CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
      FROM range(256) t(i))),
    words AS (SELECT doc_id, true AS raw, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
              UNION ALL
              SELECT NULL, false, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
    spelt AS (SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT word FROM words)),
    hashed AS (SELECT word, xor(list_reduce(
                 list_prepend(4294967295, list_transform(range(length(x) // 2),
                   lambda k: CAST('0x' || substr(x, 2 * k + 1, 2) AS BIGINT))),
                 lambda c, b: xor(c // 256, crc[xor(c, b) % 256 + 1])), 4294967295) % {resample.BUCKETS} AS bucket
               FROM spelt, bytes),
    counts AS (SELECT bucket, CAST(count(*) FILTER (raw) AS DOUBLE) AS s, CAST(count(*) FILTER (NOT raw) AS DOUBLE) AS t
               FROM words JOIN hashed USING (word) GROUP BY bucket),
    gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (sum(s) OVER () + {resample.BUCKETS})
                / ((s + 1) * (sum(t) OVER () + {resample.BUCKETS})))) AS BIGINT) AS gain FROM counts),
    weights AS (SELECT doc_id, count(*) AS n, CAST(floor(sum(gain) / count(*)) AS BIGINT) AS weight
                FROM words JOIN hashed USING (word) JOIN gains USING (bucket) WHERE raw GROUP BY doc_id),
    scored AS (SELECT d.doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
                 coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{resample.SEED}:' || d.doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE)
                   / 4294967296::DOUBLE))) AS BIGINT) AS score
               FROM documents d LEFT JOIN weights USING (doc_id)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY n_features >= {resample.LEAST_WORDS} ORDER BY score DESC, doc_id) AS place,
                 count(*) OVER (PARTITION BY n_features >= {resample.LEAST_WORDS}) AS eligible FROM scored)
    SELECT doc_id, n_features, weight, score,
           CASE WHEN n_features >= {resample.LEAST_WORDS} AND place <= {resample.PERCENT} * eligible // 100 THEN place END AS rank
    FROM ranked"""
