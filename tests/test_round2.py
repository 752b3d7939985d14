"""Strict readers and joins, capped reads of partitioned sources, untouched columns."""

import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from corpusforge.operators.align import zip_by_id
from corpusforge.operators.infer import batch_predict, score_segments
from corpusforge.operators.rank import order_statistics
from corpusforge.operators.report import probe_map
from corpusforge.operators.split import exact_split
from corpusforge.plans.evaluate import evaluate
from corpusforge.sources.corpus import first_n_by, load_catalogue, read_source, with_file_ordinal
from corpusforge.sources.jsonl import read_required_jsonl
from corpusforge.sources.lines import load_eval_pairs
from corpusforge.sources.specs import SourceSpec


def test_missing_key_raises_under_any_projection(spark, tmp_dir):
    with open(f"{tmp_dir}/t.jsonl", "w") as f:
        f.write('{"id":"1","ko":"a","en":"b"}\n')
    df = read_required_jsonl(spark, f"{tmp_dir}/t.jsonl")
    for action in (lambda: df.count(), lambda: df.select("id").collect()):
        with pytest.raises(Exception, match="lacks source, date, category"):
            action()


def test_zip_by_id_sees_repeated_and_one_sided_ids(spark):
    left = spark.createDataFrame([("a",), ("a",), ("b",)], "id string")
    right = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, v int")
    for read in (lambda df: df.collect(), lambda df: df.count(), lambda df: df.select("v").collect()):
        with pytest.raises(Exception, match="ids differ"):
            read(zip_by_id(left, right))
        with pytest.raises(Exception, match="ids differ: c is missing on the left"):
            read(zip_by_id(left.distinct(), right))
    with pytest.raises(Exception, match="ids differ: a is repeated on the left"):
        zip_by_id(left, right.where("v < 3")).collect()
    with pytest.raises(Exception, match="ids differ: null"):
        zip_by_id(spark.createDataFrame([("a",), (None,)], "id string"), right.where("v = 1")).collect()
    assert zip_by_id(left.distinct(), right.where("v < 3")).count() == 2


def test_capped_read_keeps_partition_columns_and_odd_paths(spark, tmp_dir):
    path = f"{tmp_dir}/a b"
    spark.range(20).selectExpr("id", "cast(id % 4 as int) lvl").repartition(2).write.partitionBy("lvl").parquet(path)
    spec = SourceSpec(name="s", path=path, fmt="parquet", ko_field="id", en_field="id")
    got = read_source(spark, spec, limit=7)
    assert "lvl" in got.columns
    rows = got.where("ord < 7").collect()
    assert len(rows) == 7 and all(r.lvl is not None for r in rows)


def test_only_text_goes_to_python(spark):
    rows = [(2**60 + 1, Decimal("1.10"), {"k": 1}, "x ", "y", "z"), (None, None, None, None, "y", "z")]
    df = spark.createDataFrame(rows, "n bigint, d decimal(10,2), m map<string,int>, src string, pred string, ref string")
    out = score_segments(batch_predict(df, lambda xs: [x and x + "!" for x in xs], out_col="p"), lambda r: [1.0] * len(r))
    assert [tuple(r)[:6] for r in out.collect()] == rows
    with pytest.raises(Exception, match="scorer returned"):
        score_segments(df, lambda r: []).collect()


@pytest.mark.parametrize("fmt", ["parquet", "json"])
def test_ordinals_hold_when_splits_change(spark, tmp_dir, fmt):
    spark.range(20000).selectExpr("id", "repeat('x', 20) pad").repartitionByRange(3, "id").write.format(fmt).save(f"{tmp_dir}/t")
    df = with_file_ordinal(spark.read.format(fmt).load(f"{tmp_dir}/t"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
        got = df.agg(F.count("*"), F.countDistinct("ord"), F.min("ord"), F.max("ord"), F.sum((F.col("ord") != F.col("id")).cast("int"))).first()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert tuple(got) == (20000, 20000, 0, 19999, 0)


def test_caps_by_wide_ordinals(spark):
    df = spark.range(100).selectExpr("cast(1152921504606846976 + (id * 37) % 100 as bigint) k")
    got = sorted(r.k - 2**60 for r in first_n_by(df, 5, "k").collect())
    assert got == [0, 1, 2, 3, 4]
    spread = spark.createDataFrame([(v,) for v in (-(2**62), -1, 0, 1, 2**33, 2**62)], "k bigint")
    assert sorted(r.k for r in first_n_by(spread, 4, "k").collect()) == [-(2**62), -1, 0, 1]
    assert first_n_by(spread, 0, "k").count() == 0 and first_n_by(spread, 99, "k").count() == 6
    with pytest.raises(TypeError, match="needed"):
        first_n_by(df.withColumn("k", F.col("k").cast("string")), 5, "k")


def test_heavy_tails_need_few_passes(spark):
    values = [s * 2 ** (i / 2) for i in range(1000) for s in (-1.0, 1.0)] + [0.0, 5e-324, 1e-323, 1.5e-323, float("inf"), float("-inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ks = [0, 1, 500, 999, 1001, 1002, 1003, 1004, 1005, 1500, 2004, 2005]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("heavy-tails", "order statistics")
    try:
        got = order_statistics(df, "v", [], lambda n: [(str(k), k) for k in ks])[0].values
        jobs = len(tracker.getJobIdsForGroup("heavy-tails"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [got[str(k)] for k in ks] == [sorted(values)[k] for k in ks]
    assert jobs <= 30


def test_split_refuses_a_repeated_key_at_the_cut(spark):
    df = spark.range(20).selectExpr("id % 2 k")
    with pytest.raises(ValueError, match="repeated value"):
        exact_split(df, "k", 0.05)


def test_row_probe_takes_the_nested_layout_first(spark):
    df = spark.createDataFrame([({"translation": '{"ko":"k","en":"e"}', "ko": "x", "en": "y"},), ({"translation": "text", "ko": "x", "en": "y"},)], "m map<string,string>")
    got = [tuple(r[0]) for r in df.select(probe_map(F.col("m"))).collect()]
    assert got == [("k", "e", "translation.{ko,en}"), ("x", "y", "{ko,en}")]


def test_dataset_reader_feeds_the_evaluation(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/dev")
    for code, lines in (("kor_Hang", "하나\n둘\n"), ("eng_Latn", "one two three four\nfive six seven eight\n")):
        with open(f"{tmp_dir}/dev/{code}.dev", "w") as f:
            f.write(lines)
    pairs = load_eval_pairs(spark, "flores", tmp_dir, "dev")
    right = {"하나": "one two three four", "둘": "five six seven eight"}
    got = evaluate(spark, pairs, translate=lambda xs: [right[x] for x in xs], dataset="flores", split="dev", model="m")
    assert (got["n_pairs"], got["dataset"], got["split"], got["model"], got["adapter"]) == (2, "flores", "dev", "m", None)
    assert got["metrics"]["bleu"] == 100.0 and got["samples"][0]["src"] == "하나"


def test_catalogue_caps_each_source(spark, tmp_dir):
    specs = []
    for i, n in enumerate((3, 9)):
        spark.range(n).selectExpr("cast(id as string) ko", "cast(id as string) en").coalesce(1).write.parquet(f"{tmp_dir}/{i}")
        specs.append(SourceSpec(name=f"s{i}", path=f"{tmp_dir}/{i}", fmt="parquet", ko_field="ko", en_field="en"))
    got = sorted(tuple(r) for r in load_catalogue(spark, specs, 4).select("priority", "ord", "ko_raw").collect())
    assert got == [(0, i, str(i)) for i in range(3)] + [(1, i, str(i)) for i in range(4)]
