"""Loose JSON: each row's types are its own (compared with Python's json)."""

import json

from pyspark.sql import functions as F

from corpusforge.operators.clean import apply_waterfall
from corpusforge.sources.corpus import load_catalogue, read_loose
from corpusforge.sources.loose import LINE, json_has, json_type
from corpusforge.sources.specs import SourceSpec

VALUES = ['"한국어 문장입니다. 길이"', '""', "5", "0.25", "1e3", "-7", "true", "false", "null", "{}", '{"x":1}', "[]", '["a"]', '"5"', '"null"', "12345678901234567890", None]


def test_types_row_by_row(spark, tmp_dir):
    lines = []
    for ko in VALUES:
        for score in VALUES:
            fields = [f'"ko":{ko}' if ko is not None else None, '"en":"some plain english text"', f'"s":{score}' if score is not None else None]
            lines.append('{"p":{' + ",".join(f for f in fields if f) + "}}")
    lines += ['{"p":null}', '{"p":3}', "{}", "[1]", "7", '"text"']
    with open(f"{tmp_dir}/rows.jsonl", "w", encoding="utf-8") as f:
        f.write("\n".join([*lines[:5], "", "  ", *lines[5:]]))
    spec = SourceSpec("s", f"{tmp_dir}/rows.jsonl", fmt="json", ko_field="p.ko", en_field="p.en", score_field="p.s")
    got = load_catalogue(spark, [spec]).orderBy("ord").collect()
    assert [r.ord for r in got] == list(range(len(lines)))

    def at(row, *path):
        for key in path:
            row = row.get(key) if isinstance(row, dict) else None
        return row

    for r, line in zip(got, lines, strict=True):
        row = json.loads(line)
        ko, en, score = (at(row, "p", k) for k in ("ko", "en", "s"))
        assert r.ko_raw == (ko if isinstance(ko, str) else None) and r.en_raw == (en if isinstance(en, str) else None), line
        assert r.score == (float(score) if isinstance(score, (int, float)) else None), line
    reasons = [r.reason for r in apply_waterfall(load_catalogue(spark, [spec])).orderBy("ord").collect()]
    for reason, line in zip(reasons, lines, strict=True):
        row = json.loads(line)
        text = isinstance(at(row, "p", "ko"), str) and isinstance(at(row, "p", "en"), str)
        assert (reason == "schema") == (not text), line
    capped = load_catalogue(spark, [spec], 8).collect()
    assert sorted(r.ord for r in capped) == list(range(8))


def test_missing_key_and_null_are_told_apart(spark, tmp_dir):
    with open(f"{tmp_dir}/a.jsonl", "w") as f:
        f.write('{"a":null}\n{"b":1}\n{"a":{"c":"x"}}\n')
    rows = read_loose(spark, f"{tmp_dir}/a.jsonl").orderBy("ord")
    assert [r[0] for r in rows.select(json_has(F.col(LINE), "a")).collect()] == [True, False, True]
    assert [r[0] for r in rows.select(json_type(F.col(LINE), "a.c")).collect()] == [None, None, "STRING"]
