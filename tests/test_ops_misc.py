import pytest
from pyspark.sql import functions as F

from corpusforge.operators import infer, report
from corpusforge.operators.align import align_by_position, align_texts, lines_with_position, require_aligned, zip_by_id
from corpusforge.sources.corpus import first_n_per_group


def test_align_by_position_flags_one_sided(spark):
    left = spark.createDataFrame([(1, "a\nb\nc")], "k int, t string")
    right = spark.createDataFrame([(1, "x\ny")], "k int, t string")
    lines_l = lines_with_position(left, ["k"], "t", "src")
    lines_r = lines_with_position(right, ["k"], "t", "tgt")
    got = sorted(tuple(r) for r in align_by_position(lines_l, lines_r, ["k"]).collect())
    assert got == sorted(tuple(r) for r in align_texts(left, right, ["k"], "t", "t", "src", "tgt").collect())
    assert got == [(1, 0, "a", "x", False), (1, 1, "b", "y", False), (1, 2, "c", None, True)]
    with pytest.raises(RuntimeError):
        require_aligned(align_by_position(lines_l, lines_r, ["k"]))
    same = align_by_position(lines_l, lines_with_position(left, ["k"], "t", "tgt"), ["k"])
    assert require_aligned(same).count() == 3


def test_zip_by_id_requires_same_ids(spark):
    a = spark.createDataFrame([("1", "s1"), ("2", "s2")], "id string, src string")
    b = spark.createDataFrame([("1", "p1"), ("2", "p2")], "id string, pred string")
    assert zip_by_id(a, b).count() == 2
    with pytest.raises(Exception, match="ids differ: 2 is missing on the right"):
        zip_by_id(a, b.where("id = '1'")).collect()


def test_probe_map_precedence(spark):
    rows = [
        ({"ko": "가", "en": "a", "src": "s", "tgt": "t"},),  # {ko,en} wins over {src,tgt}
        ({"korean": "나", "english": "b"},),
        ({"src": "다", "tgt": "c"},),
        ({"ko": "라"},),  # key presence of both is required
        ({"a": "1", "b": "2", "c": "3", "d": "4", "e": "5", "f": "6", "g": "7"},),
    ]
    df = spark.createDataFrame(rows, "m map<string,string>")
    got = [tuple(r) for r in df.select(report.probe_map(F.col("m")).alias("p")).select("p.*").collect()]
    assert got[0] == ("가", "a", "{ko,en}")
    assert got[1] == ("나", "b", "{korean,english}")
    assert got[2] == ("다", "c", "{src,tgt}")
    assert got[3] == (None, None, "unknown_schema: keys=['ko']")
    assert got[4][2] == "unknown_schema: keys=['a', 'b', 'c', 'd', 'e', 'f']"


def test_first_n_per_group_is_exact_and_partial(spark):
    data = [("hot", i) for i in range(300)] + [("cold", i) for i in range(5)]
    df = spark.createDataFrame(data, "g string, o long").repartition(6)
    out = first_n_per_group(df, ["g"], "o", 10)
    got = sorted(tuple(r) for r in out.collect())
    assert got == sorted([("hot", i) for i in range(10)] + [("cold", i) for i in range(5)])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_timed():
    out, secs = infer.timed(lambda: 41 + 1)
    assert out == 42 and secs >= 0.0
