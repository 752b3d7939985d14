"""The training-data pipeline: five operators of ``corpusforge.llm`` in turn.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
every stage's result as Parquet in the shared checkpoint folder and reads it
again as the next one's ``docs``. All stages but the last return the columns
of ``documents``; texts and ids are never changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusforge.llm import language_id, mixing, near_dup, queries, toxicity
from corpusforge.session import Scratch, scratch_scope

#: A language guess below this posterior rejects the document.
LEAST_LANGUAGE_SCORE = 0.5


def _unused(docs: DataFrame, name: str) -> str:
    """``name``, or a longer one that is no column of ``docs``."""
    held = {c.lower() for c in docs.columns}
    while name in held:
        name = f"_{name}"
    return name


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined; null and letterless texts go.
    Repeated rows and null ids are judged by their texts like others."""
    lang, score = _unused(docs, "lang_pred"), _unused(docs, "score")
    found = language_id.with_language(docs, queries.language_model(docs), out_cols=(lang, score))
    known = (F.col(lang) != language_id.UNDETERMINED) & (F.col(score) >= LEAST_LANGUAGE_SCORE)
    return found.where(known).select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are scored below 0.5. Null and empty texts are scored as no
    words; repeated rows and null ids by their texts like others."""
    learn = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learn = learn.where(~queries.held_out(queries.TOXIC_FOLDS, queries.TOXIC_HELD_OUT))
    score = _unused(docs, "score")
    scored = toxicity.with_toxicity(docs, toxicity.train(docs, learn), out_col=score)
    return scored.where(F.col(score) < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document of smallest id of each near-duplicate component; of repeated
    rows one, null ids last."""
    return near_dup.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or left out, as their sources' weights ask. A null
    source is one source; a null or empty text has no words and is left out
    only with its source's whole repetitions."""
    return mixing.apply_mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each document of the mix: its tokens' number and digests (of no
    token for a null or empty text)."""
    return queries.token_digests(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: SQL can't express the classifiers; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        with scratch_scope():
            docs = scratch.cut(stage(spark, docs, sf_dir), name)
        scratch.drop(keep=[docs])
    return docs
