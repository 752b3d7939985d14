"""Bounded samples of labelled rows, chosen by a hash of the id."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bytesops import forget

_MOST_BROADCAST = 100_000  # classes, or sampled rows


def remainder(id_col: str, m: int) -> Column:
    """crc32 of the id as text, modulo m; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(m))


def hash_sample(rows: DataFrame, id_col: str, class_col: str, per_class: int, weight_col: str = "_weight") -> DataFrame:
    """At most ``per_class`` ids of each class, by the hash of their ids, and
    in ``weight_col`` how many rows of its class each stands for (``_place``:
    its number in the class).

    A class's count sets a hash threshold that about 1.5 times as many rows
    pass, so what is then ranked per class is bounded whatever the input."""
    rows = rows.where(F.col(id_col).isNotNull() & F.col(class_col).isNotNull())
    counts = rows.groupBy(F.col(class_col).alias("_class")).agg(F.count("*").alias("_n"))
    drawn = rows.withColumn("_draw", F.pmod(F.xxhash64(F.col(id_col), F.lit(20240607)), F.lit(1 << 40)))
    if counts.count() <= _MOST_BROADCAST:  # so that the threshold holds before rows are dealt by class
        counts = F.broadcast(counts)
    near = drawn.join(counts, F.col(class_col) == F.col("_class")).where(
        F.col("_draw") < F.lit((1.5 * per_class + 50) * (1 << 40)) / F.col("_n")
    )
    near = near.dropDuplicates([id_col, class_col])  # copies of one row are drawn together
    place = Window.partitionBy("_class").orderBy("_draw", id_col)
    ranked = near.withColumns({"_place": F.row_number().over(place), "_near": F.count("*").over(Window.partitionBy("_class"))})
    weight = F.col("_n") / F.least(F.col("_near"), F.lit(per_class))
    return ranked.where(F.col("_place") <= per_class).select(*rows.columns, weight.alias(weight_col), "_place")


def one_label(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    """(id, label) of the ids that ``labels`` gives one label of 0 and 1, however
    often; ids that are labelled both ways are left out."""
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
    found = known.groupBy(id_col).agg(F.min(label_col).alias("_y"), F.max(label_col).alias("_other"))
    return found.where("_y = _other").select(id_col, "_y")


def with_texts(sample: DataFrame, docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """The sample's rows with their whole texts (``_text``) and the columns
    ``more``, one row for each: of documents that share the id, the one whose
    text has the smallest hash. Copies are folded before they move."""
    held = [F.col(c).alias(f"_{c}") for c in more]
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_text_id"), F.col(text_col).alias("_text"), *held)
    if sample.count() <= _MOST_BROADCAST:
        sample = F.broadcast(sample)
    found = texts.join(sample, F.col("_text_id") == F.col(id_col))
    one = F.min(F.struct(F.xxhash64("_text").alias("_hash"), "_text", *[f"_{c}" for c in more])).alias("_one")
    return found.groupBy(*sample.columns).agg(one).select(*sample.columns, "_one._text", *[f"_one._{c}" for c in more])


def fit_in_task(sample: DataFrame, fit: Callable[[list[tuple]], object], keep: Callable[[Iterator[tuple]], list[tuple]] = list) -> object:
    """``fit`` on the rows of a bounded sample, sorted, in one executor's task;
    the driver receives the model only. ``keep`` sees the rows one by one, by
    ``_place`` where they have one, and decides which are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        rows = keep(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        rows.sort(key=lambda r: [(v is not None, v) for v in r])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows))], pa.binary())], names=["model"])

    dealt = sample.repartition(1)
    if "_place" in sample.columns:
        dealt = dealt.sortWithinPartitions("_place")
    found = dealt.mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0][0]) if found else fit([])
