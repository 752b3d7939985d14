import glob
import hashlib
import json
import unicodedata

from corpusforge.plans.build import in_split_order, build_dataset
from corpusforge.session import checkpoint_dir
from corpusforge.plans.evaluate import evaluate
from corpusforge.plans.finetune_data import prepare_sft
from corpusforge.plans.validate_sources import counted_rows, source_report, validate_sources
from corpusforge.sources.specs import SourceSpec


def corpora(spark, d):
    a = spark.createDataFrame(
        [(f"한국어 문장 번호 {i % 40}", f"korean sentence number {i}", 0.5 + (i % 10) / 20) for i in range(60)],
        "korean string, english string, score double")
    a.write.parquet(f"{d}/a")
    b = spark.createDataFrame([({"ko": f"다른 문장 번호 {i}", "en": f"other sentence {i}"},) for i in range(30)],
                              "translation struct<ko:string,en:string>")
    b.write.parquet(f"{d}/b")
    return [SourceSpec("scored", f"{d}/a", ko_field="korean", en_field="english", score_field="score"),
            SourceSpec("nested", f"{d}/b", ko_field="translation.ko", en_field="translation.en")]


def test_build_dataset_accounting(spark, tmp_dir):
    specs = corpora(spark, tmp_dir)
    stats = build_dataset(spark, specs, f"{tmp_dir}/out", drop_bottom_score_pct=10, val_fraction=0.1)
    assert not glob.glob(checkpoint_dir(spark).removeprefix("file:") + "/corpusforge-build-*/*")  # nothing is left behind
    for s in stats["per_source"].values():
        assert s["loaded"] == s["passed"] + sum(s["rejected"].values())
    t = stats["total"]
    assert t["before_score_filter"] == t["after_score_filter"] + t["dropped_by_score_filter"]
    assert t["after_score_filter"] == t["train"] + t["val"] and t["val"] == int(t["after_score_filter"] * 0.1)
    assert stats["per_source"]["scored"]["rejected"] == {"dup": 20}
    assert stats["score_distribution"]["scored"]["n"] == 40
    def lines(split):
        rows = []
        for name in sorted(glob.glob(f"{tmp_dir}/out/stage/split={split}/part-*")):
            with open(name, encoding="utf-8") as f:
                rows += [json.loads(x) for x in f]
        return rows

    def shuffle_key(row):
        dkey = hashlib.md5(unicodedata.normalize("NFC", row["ko"].strip().lower()).encode()).hexdigest()
        return hashlib.md5(f"42|{dkey}".encode()).hexdigest()

    train, val = lines("train"), lines("val")
    assert (len(train), len(val)) == (t["train"], t["val"])
    keys = [[shuffle_key(r) for r in part] for part in (val, train)]
    assert keys[0] + keys[1] == sorted(keys[0] + keys[1])  # each file in order, and the smallest keys are val
    assert all(set(r) <= {"ko", "en", "source", "score"} for r in train)


def test_splits_are_written_from_one_sort(spark):
    kept = spark.range(100).selectExpr("id as ko", "if(id % 7 = 0, 'val', 'train') as split", "md5(cast(id as string)) as shuffle_key")
    plan = in_split_order(kept, ["ko"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Sort [") == 1 and plan.count("RepartitionByExpression") == 1


def test_validate_sources_report(spark, tmp_dir):
    specs = corpora(spark, tmp_dir) + [SourceSpec("missing", f"{tmp_dir}/nope")]
    rep = validate_sources(spark, specs, limit=10)
    by = {c["name"]: c for c in rep["candidates"]}
    assert by["scored"]["status"] == "ok" and by["scored"]["schema"] == "{korean,english}"
    assert by["nested"]["schema"] == "translation.{ko,en}" and len(by["nested"]["samples"]) == 10
    assert by["missing"]["status"] == "load_failed"
    assert rep["selected"] == ["scored", "nested"]


def test_evaluate_and_sft(spark, tmp_dir):
    pairs = spark.createDataFrame([(str(i), f"문장 {i}", f"the sentence number {i} here", i) for i in range(25)],
                                  "id string, ko string, en string, ord long")
    res = evaluate(spark, pairs, "ko2en", translate=lambda b: [f"the sentence number {s.split()[-1]} here " for s in b],
                   scorer=lambda rows: [1.0 for _ in rows], output=f"{tmp_dir}/eval")
    assert res["n_pairs"] == 25 and res["metrics"]["bleu"] == 100.0 and res["metrics"]["chrf"] == 100.0
    assert res["metrics"]["comet"] == 1.0 and len(res["samples"]) == 20 and res["samples"][0]["src"] == "문장 0"
    with open(f"{tmp_dir}/rows.jsonl", "w", encoding="utf-8") as f:
        for i in range(7):
            f.write(json.dumps({"ko": f"가 {i}", "en": f"a {i}", "source": "s"}, ensure_ascii=False) + "\n")
    counts = prepare_sft(spark, f"{tmp_dir}/rows.jsonl", f"{tmp_dir}/rows.jsonl", "ko2en", f"{tmp_dir}/sft", max_val=3)
    assert counts == {"train": 7, "val": 3}


def test_iter_failed_status(spark, tmp_dir):
    import os

    good = spark.createDataFrame([("한국어 문장", "english")], "ko string, en string")
    good.coalesce(1).write.parquet(f"{tmp_dir}/broken")
    with open(os.path.join(tmp_dir, "broken", "part-zzzz-corrupt.parquet"), "wb") as f:
        f.write(b"PAR1 this is not a parquet file PAR1")
    spec = SourceSpec("broken", f"{tmp_dir}/broken")
    rep = validate_sources(spark, [spec], limit=10)
    assert rep["candidates"][0]["status"] in ("iter_failed", "load_failed")
    assert rep["selected"] == []


def test_report_keeps_rows_before_a_fault(spark, tmp_dir):
    """The files before a corrupt one, the lines before a malformed one; states of odd sources."""
    import os

    good = spark.createDataFrame([(f"한국어 문장 {i}", "english text") for i in range(4)], "ko string, en string")
    good.coalesce(1).write.parquet(f"{tmp_dir}/broken")
    first = next(f for f in os.listdir(f"{tmp_dir}/broken") if f.endswith(".parquet"))
    os.rename(f"{tmp_dir}/broken/{first}", f"{tmp_dir}/broken/part-00000.parquet")
    with open(f"{tmp_dir}/broken/part-zzzz.parquet", "wb") as f:
        f.write(b"PAR1 this is not a parquet file PAR1")
    with open(f"{tmp_dir}/loose.jsonl", "w", encoding="utf-8") as f:
        f.write('{"translation":{"ko":"한국어","en":"abc"}}\n\n{"ko":5,"en":"abc"}\n{"src":"한국어","tgt":null}\n{"b":1,"a":2}\n{"ko": "x"\n{"ko":"한","en":"a"}\n')
    with open(f"{tmp_dir}/fine.jsonl", "w", encoding="utf-8") as f:
        f.write('{"ko":"한국어","en":"abc"}\n' * 3 + '{"ko":["한"],"en":"abc"}\n')
    open(f"{tmp_dir}/none.jsonl", "w").close()
    schema = "ko string, en string"
    specs = [
        SourceSpec("broken", f"{tmp_dir}/broken", schema=schema),
        SourceSpec("loose", f"{tmp_dir}/loose.jsonl", fmt="json"),
        SourceSpec("fine", f"{tmp_dir}/fine.jsonl", fmt="json"),
        SourceSpec("typed", f"{tmp_dir}/fine.jsonl", fmt="json", schema=schema),
        SourceSpec("none", f"{tmp_dir}/none.jsonl", fmt="json"),
        SourceSpec("odd", f"{tmp_dir}/fine.jsonl", fmt="no.such.format"),
    ]
    by = {r.name: r for r in source_report(spark, specs, 10).collect()}
    assert list(by) == [s.name for s in specs]
    assert by["broken"].status == "iter_failed" and [s.ko for s in by["broken"].samples] == [f"한국어 문장 {i}" for i in range(4)]
    assert by["broken"].sanity_pass_rate is None and by["broken"].schema is None and by["broken"].error
    loose = by["loose"]
    assert loose.status == "iter_failed" and loose.num_rows == 6 and "row 4" in loose.error
    assert [(s.ko, s.en, s.ok) for s in loose.samples] == [("한국어", "abc", True), (None, "abc", False), ("한국어", None, False), (None, None, False)]
    fine = by["fine"]
    assert (fine.status, fine.sanity_pass_rate, fine.schema, fine.num_rows, fine.columns) == ("ok", 0.75, "{ko,en}", 4, ["en", "ko"])
    assert by["typed"].status == "ok" and by["typed"].num_rows == 4
    assert (by["none"].status, by["none"].schema, by["none"].columns, by["none"].num_rows, by["none"].sanity_pass_rate) == ("empty", "?", None, 0, 0.0)
    assert by["odd"].status == "load_failed" and by["odd"].num_rows is None and by["odd"].num_rows_error
    assert [r.selected for r in by.values()] == [False, False, True, True, False, False]
    # one row is taken before the limit is tested
    assert len(source_report(spark, specs[2:3], 0).first().samples) == 1


def test_counts_read_no_column(spark, tmp_dir):
    spark.range(50).selectExpr("id", "cast(id as string) as text").write.parquet(f"{tmp_dir}/t")
    df = counted_rows(spark, SourceSpec("t", f"{tmp_dir}/t"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in plan and df.first().num_rows == 50
