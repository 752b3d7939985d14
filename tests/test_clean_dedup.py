import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusforge.operators.clean import apply_waterfall
from corpusforge.operators.dedup import annotate_duplicates, dedup_winners
from corpusforge.operators.stats import source_stats
from corpusforge.sources.specs import FilterCfg

KO10 = "가나다라마바사아자차"  # 10 Hangul syllables
EN = "abcdefghij"


NFD10 = unicodedata.normalize("NFD", KO10)

# (expected reason, ko, en): one case per outcome and boundary, worked by hand
CASES = [
    ("schema", None, EN),
    ("empty", "\u3000\xa0", EN),
    ("not_ko", "abcdefghijk", EN),
    ("not_ko", NFD10, EN),  # conjoining letters are not syllables
    ("not_en", KO10, "abc 가 defghij"),
    ("not_en", KO10, "1234567890"),
    ("len_ko", "가" * 9, "a" * 10),
    (None, "가" * 10, "a" * 10),
    (None, "가" * 800, "a" * 800),
    ("len_ko", "가" * 801, "a" * 801),
    ("len_en", KO10, "a" * 9),
    (None, "가" * 400, "a" * 1600),  # ratio 4
    ("len_en", "가" * 400, "a" * 1601),
    ("ratio", "가" * 100, "a" * 29 + " "),
    (None, "가" * 100, "a" * 30),  # ratio 0.3
    (None, "가" * 100, "a" * 31),
    (None, "가" * 20, "a" * 100),  # ratio 5
    ("ratio", "가" * 20, "a" * 101),
    ("not_en", "가" * 9, "가"),  # too short as well: the first reason counts
    (None, "  " + KO10 + "  ", "\u3000" + EN),
]


def waterfall_rows():
    return [(ko, en) for _, ko, en in CASES]


def frame(spark, rows, source="s", priority=0):
    data = [(source, priority, i, ko, en, None) for i, (ko, en) in enumerate(rows)]
    return spark.createDataFrame(
        data, "source string, priority int, ord bigint, ko_raw string, en_raw string, score double"
    )


def test_waterfall_reasons(spark):
    got = {r.ord: r.reason for r in apply_waterfall(frame(spark, waterfall_rows())).collect()}
    assert [got[i] for i in range(len(CASES))] == [reason for reason, _, _ in CASES]


def test_changed_thresholds(spark):
    cfg = FilterCfg(char_min=3, char_max_ko=4, char_max_en=8, ratio_min=1.0, ratio_max=2.0)
    rows = [("가나다", "abc"), ("가나", "abc"), ("가나다라마", "abcde"), ("가나다", "ab"), ("가나다라", "abcdefghi"), ("가나다라", "abc"), ("가나다", "abcdefg")]
    got = {r.ord: r.reason for r in apply_waterfall(frame(spark, rows), cfg).collect()}
    assert [got[i] for i in range(7)] == [None, "len_ko", "len_ko", "len_en", "len_en", "ratio", "ratio"]


def test_non_string_side_is_schema(spark):
    df = spark.createDataFrame([("s", 0, 0, 5, EN, None)], "source string, priority int, ord bigint, ko_raw int, en_raw string, score double")
    from corpusforge.sources.corpus import get_field

    p = df.select("source", "priority", "ord", get_field(df, "ko_raw").alias("ko_raw"), "en_raw", "score")
    assert apply_waterfall(p).first().reason == "schema"


def dedup_rows():
    base = "한국어 문장입니다 테스트"
    return [
        # (priority, ord, ko, en)
        (1, 0, base, "english text one"),
        (0, 5, base, "english text two"),  # same key, higher priority source wins
        (0, 7, base, "english text three"),  # twice in one source: lower ord won
        (0, 1, base.upper() + "  ", "english text four"),  # case/padding: same key
        (2, 0, unicodedata.normalize("NFD", "한") + "국어 문장입니다 테스트", "english"),  # partly decomposed: not_ko? no: has 국
        (0, 2, "짧은", "too short ko"),  # rejected (len_ko) ...
        (1, 3, "짧은 문장이지만 충분히 길다", "english text five"),
        (1, 4, "짧은 문장이지만 충분히 길다", "english text six"),  # dup within source
        (2, 1, "완전히 다른 문장입니다", "x" * 9),  # rejected len_en first copy
        (2, 2, "완전히 다른 문장입니다", "english text seven"),  # second copy survives
    ]


# (priority, ord) -> reason, worked by hand
DEDUP_REASONS = {
    (0, 1): None, (0, 2): "len_ko", (0, 5): "dup", (0, 7): "dup", (1, 0): "dup",
    (1, 3): None, (1, 4): "dup", (2, 0): "len_en", (2, 1): "len_en", (2, 2): None,
}


def test_dedup_priority_and_first_writer(spark):
    rows = dedup_rows()
    df = spark.createDataFrame(
        [("src%d" % p, p, o, ko, en, None) for p, o, ko, en in rows],
        "source string, priority int, ord bigint, ko_raw string, en_raw string, score double",
    )
    got = {(r.priority, r.ord): r.reason for r in annotate_duplicates(apply_waterfall(df)).collect()}
    assert got == DEDUP_REASONS


def test_dedup_aggregates_narrow_rows_by_hashing(spark):
    rows = apply_waterfall(frame(spark, waterfall_rows()))
    for df in (annotate_duplicates(rows), dedup_winners(rows, ["source", "ko", "en"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_dedup_needs_row_ids(spark):
    df = apply_waterfall(frame(spark, [(KO10, EN)])).withColumn("ord", F.lit(None).cast("bigint"))
    with pytest.raises(Exception, match="no priority or no ordinal"):
        dedup_winners(df, ["source"]).collect()


def test_dedup_partition_independent(spark):
    rows = dedup_rows() * 1
    df = spark.createDataFrame(
        [("src%d" % p, p, o, ko, en, None) for p, o, ko, en in rows],
        "source string, priority int, ord bigint, ko_raw string, en_raw string, score double",
    )
    a = sorted(tuple(r) for r in annotate_duplicates(apply_waterfall(df.repartition(1))).select("priority", "ord", "reason").collect())
    b = sorted(tuple(r) for r in annotate_duplicates(apply_waterfall(df.repartition(8))).select("priority", "ord", "reason").collect())
    assert a == b
    w = sorted((r.priority, r.ord) for r in dedup_winners(apply_waterfall(df.repartition(8)), ["source"]).collect())
    assert w == [(0, 1), (1, 3), (2, 2)]


def test_source_stats_invariant(spark):
    rows = waterfall_rows()
    df = frame(spark, rows).unionByName(frame(spark, rows, "t", 1))
    st = source_stats(annotate_duplicates(apply_waterfall(df)))
    stats = st.withColumn("keys", F.map_keys("rejected")).collect()
    for r in stats:
        assert r.loaded == r.passed + sum(r.rejected.values())
        assert list(r["keys"]) == sorted(r["keys"])
    t = [r for r in stats if r.source == "t"][0]
    assert t.passed == 0 and t.rejected["dup"] > 0  # every passing row of t was seen in s first


def test_patterns_are_parameters(spark):
    cfg = FilterCfg(src_pattern=r"[\x{c0}-\x{ff}]", tgt_pattern=r"[A-Za-z]")
    rows = [("café au lait!!", "coffee with milk")]
    assert apply_waterfall(frame(spark, rows), cfg).first().reason is None
