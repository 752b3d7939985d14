import json
import os

import pytest
from pyspark.sql import functions as F

from corpusforge.sources.corpus import first_n, load_catalogue, with_file_ordinal
from corpusforge.sources.jsonl import read_jsonl, read_required_jsonl, write_jsonl
from corpusforge.sources.lines import load_eval_pairs, read_lines
from corpusforge.sources.specs import SourceSpec


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)


def test_read_lines_matches_splitlines(spark, tmp_dir):
    text = "first\nsecond third\n\nfifth\r\nsixth\x1cseventh\nbreak\u2028inside\nlast\n"
    p = f"{tmp_dir}/a.txt"
    write(p, text)
    got = [r.line for r in read_lines(spark, p).orderBy("line_no").collect()]
    assert got == text.splitlines()


def test_read_lines_many_splits(spark, tmp_dir):
    lines = [f"line {i} " + "x" * (i % 50) for i in range(20000)]
    p = f"{tmp_dir}/big.txt"
    write(p, "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "65536")
    try:
        df = read_lines(spark, p)
        assert df.rdd.getNumPartitions() > 1
        got = [r.line for r in df.orderBy("line_no").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == lines


def test_parallel_lines_strict(spark, tmp_dir):
    root = f"{tmp_dir}/flores"
    write(f"{root}/devtest/kor_Hang.devtest", "가\n나\n다\n")
    write(f"{root}/devtest/eng_Latn.devtest", "a\nb\nc")
    pairs = load_eval_pairs(spark, "flores", root, "devtest").orderBy("ord").collect()
    assert [(r.id, r.ko, r.en) for r in pairs] == [("0", "가", "a"), ("1", "나", "b"), ("2", "다", "c")]
    write(f"{root}/dev/kor_Hang.dev", "가\n나\n")
    write(f"{root}/dev/eng_Latn.dev", "a\n")
    with pytest.raises(RuntimeError):
        load_eval_pairs(spark, "flores", root, "dev")
    with pytest.raises(ValueError):
        load_eval_pairs(spark, "flores", root, "test")
    with pytest.raises(ValueError):
        load_eval_pairs(spark, "news", root, "devtest")


def test_read_jsonl_blank_lines_and_cap(spark, tmp_dir):
    p = f"{tmp_dir}/rows.jsonl"
    rows = [{"ko": f"가{i}", "en": f"e{i}", "source": "s"} for i in range(5)]
    write(p, "\n".join(["", json.dumps(rows[0], ensure_ascii=False), "   "] + [json.dumps(r, ensure_ascii=False) for r in rows[1:]]) + "\n")
    df = read_jsonl(spark, p)
    assert [r.ko for r in df.orderBy("ord").collect()] == [r["ko"] for r in rows]
    assert read_jsonl(spark, p, limit=2).count() == 2
    assert read_jsonl(spark, p, limit=0).count() == 1  # the loop appends before testing
    assert read_jsonl(spark, p, limit=None).count() == 5


def test_required_jsonl(spark, tmp_dir):
    good = {"id": "1", "ko": "가", "en": "a", "source": "s", "date": "2024", "category": "c", "extra": 1}
    p = f"{tmp_dir}/t.jsonl"
    write(p, json.dumps(good, ensure_ascii=False) + "\n\n" + json.dumps({**good, "id": "2", "date": None}) + "\n")
    df = read_required_jsonl(spark, p)
    assert df.columns == ["ord", "id", "ko", "en", "source", "date", "category"]
    assert [(r.id, r.date) for r in df.orderBy("ord").collect()] == [("1", "2024"), ("2", None)]
    bad = f"{tmp_dir}/bad.jsonl"
    write(bad, json.dumps({"id": "1", "ko": "x"}) + "\n")
    with pytest.raises(Exception):
        read_required_jsonl(spark, bad).collect()
    with pytest.raises(FileNotFoundError):
        read_required_jsonl(spark, f"{tmp_dir}/missing.jsonl")


def test_file_ordinal_and_catalogue(spark, tmp_dir):
    a = spark.createDataFrame([(i, f"가나다라마바사아자{i}", f"english {i}", float(i)) for i in range(30)], "i int, korean string, english string, score double")
    a.repartition(3).write.parquet(f"{tmp_dir}/a")
    b = spark.createDataFrame([({"ko": f"한국어 문장 {i}", "en": f"sentence {i}"},) for i in range(10)], "translation struct<ko:string,en:string>")
    b.write.parquet(f"{tmp_dir}/b")
    ords = with_file_ordinal(spark.read.parquet(f"{tmp_dir}/a"))
    assert sorted(r.ord for r in ords.collect()) == list(range(30))
    assert first_n(ords, 0).count() == 0 and first_n(ords, 7).count() == 7
    specs = [
        SourceSpec("scored", f"{tmp_dir}/a", ko_field="korean", en_field="english", score_field="score"),
        SourceSpec("nested", f"{tmp_dir}/b", ko_field="translation.ko", en_field="translation.en"),
    ]
    cat = load_catalogue(spark, specs, limit=5)
    got = cat.groupBy("source", "priority").agg(F.count("*").alias("n"), F.count("score").alias("ns")).collect()
    assert {(r.source, r.priority, r.n, r.ns) for r in got} == {("scored", 0, 5, 5), ("nested", 1, 5, 0)}


def test_write_jsonl_omits_null_score(spark, tmp_dir):
    df = spark.createDataFrame([("가", "a", "s", None), ("나", "b", "s", 0.5)], "ko string, en string, source string, score double")
    write_jsonl(df.coalesce(1), f"{tmp_dir}/out")
    part = [f for f in os.listdir(f"{tmp_dir}/out") if f.startswith("part-")][0]
    lines = open(f"{tmp_dir}/out/{part}", encoding="utf-8").read().splitlines()
    assert lines == ['{"ko":"가","en":"a","source":"s"}', '{"ko":"나","en":"b","source":"s","score":0.5}']


def test_parquet_ordinal_across_row_group_splits(spark, tmp_dir):
    n = 50000
    df = spark.range(n).select(F.col("id").alias("pos"), F.sha2(F.col("id").cast("string"), 256).alias("pad"))
    df.coalesce(1).write.option("parquet.block.size", 64 * 1024).parquet(f"{tmp_dir}/rg")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(256 * 1024))
    try:
        raw = spark.read.parquet(f"{tmp_dir}/rg")
        assert raw.rdd.getNumPartitions() > 2
        got = with_file_ordinal(raw).select("pos", "ord").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert all(r.pos == r.ord for r in got) and len(got) == n


def test_first_n_by_sparse_ordinal(spark):
    from corpusforge.sources.corpus import first_n_by

    df = spark.createDataFrame([(i * 7 + 3,) for i in range(100)], "ord long")
    assert sorted(r.ord for r in first_n_by(df, 5, "ord").collect()) == [3, 10, 17, 24, 31]
    assert first_n_by(df, 0, "ord").count() == 0 and first_n_by(df, 500, "ord").count() == 100


def test_head_files_reads_only_what_the_cap_needs(spark, tmp_dir):
    from corpusforge.sources.corpus import head_files

    for k in range(6):
        spark.createDataFrame([(k * 10 + i,) for i in range(10)], "v int").coalesce(1).write.parquet(f"{tmp_dir}/h/part{k}")
    files = sorted(spark.read.parquet(f"{tmp_dir}/h/part*").inputFiles())
    assert head_files(spark, "parquet", f"{tmp_dir}/h/part*", 5) == files[:1]
    assert head_files(spark, "parquet", f"{tmp_dir}/h/part*", 25) == files[:3]
    spec = SourceSpec("h", f"{tmp_dir}/h/part*", ko_field="v", en_field="v")
    cat = load_catalogue(spark, [spec], limit=25)
    assert cat.count() == 25
