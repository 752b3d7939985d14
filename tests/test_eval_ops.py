import random

import pytest
from pyspark.sql import functions as F

import pyref
from corpusforge.operators import chat, infer, metrics, report, validate


def test_validate_testset_messages_and_order(spark):
    rows = [
        ("1", "가" * 4, "abcde"), ("2", "가" * 5, "a" * 26), ("2", "가" * 500, "a" * 500),
        ("3", "가" * 501, "a" * 149), ("4", "가" * 5, "ab"), ("5", "가" * 8, "a" * 8), ("6", "가" * 8, "b" * 8),
    ]
    df = spark.createDataFrame([(n, i, ko, en) for n, (i, ko, en) in enumerate(rows)], "ord long, id string, ko string, en string")
    issues = validate.validate_testset(df).orderBy(F.col("row_ord").asc_nulls_first(), "check_no")
    assert [r.message for r in issues.collect()] == [
        "duplicate ids: 1",
        "duplicate korean sentences: 2",
        "1: ko length out of range (4)",
        "2: en/ko length ratio 5.20 out of [0.3, 5.0]",
        "3: ko length out of range (501)",
        "3: en/ko length ratio 0.30 out of [0.3, 5.0]",
        "4: en length out of range (2)",
    ]
    assert not validate.testset_passes(issues)
    clean = df.where("id = '5'")
    assert validate.testset_passes(validate.validate_testset(clean))


def test_bleu_chrf_properties(spark):
    df = spark.createDataFrame(
        [("the cat sat on the mat .", "the cat sat on the mat ."), ("a b c d e", "a b c d e")], "pred string, ref string"
    )
    assert round(metrics.corpus_bleu(df)["score"], 6) == 100.0
    assert round(metrics.corpus_chrf(df)["score"], 6) == 100.0
    none = spark.createDataFrame([("xyz", "abc def")], "pred string, ref string")
    assert metrics.corpus_bleu(none)["score"] == 0.0
    assert metrics.corpus_chrf(none)["score"] == 0.0
    short = spark.createDataFrame([("a b", "a b c d")], "pred string, ref string")  # < 4 tokens: order 3/4 totals 0
    assert metrics.corpus_bleu(short)["score"] == 0.0
    empty = spark.createDataFrame([("", "a b c d e")], "pred string, ref string")
    assert metrics.corpus_bleu(empty)["score"] == 0.0


def test_brevity_penalty(spark):
    import math

    df = spark.createDataFrame([("a b c d e f", "a b c d e f g h i j")], "pred string, ref string")
    got = metrics.corpus_bleu(df)
    assert (got["sys_len"], got["ref_len"]) == (6, 10)
    assert abs(got["score"] - 100 * math.exp(1 - 10 / 6)) < 1e-9


def test_bleu_matches_brute_force(spark):
    rnd = random.Random(11)
    vocab = "the a cat dog sat on mat , . 3.5 x-ray 10-20 (yes) &amp; don't".split()
    segs = []
    for _ in range(60):
        ref = " ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 25)))
        hyp = " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 25)))
        segs.append((hyp, ref))
    df = spark.createDataFrame(segs, "pred string, ref string")
    got = metrics.corpus_bleu(df)
    m, t, sl, rl = [0] * 4, [0] * 4, 0, 0
    for h, r in segs:
        ht, rt = metrics.lines_13a([h])[:-1], metrics.lines_13a([r])[:-1]
        for i, c in enumerate(pyref.match_counts(ht, rt, 4)):
            m[i] += c
            t[i] += max(len(ht) - i, 0)
        sl, rl = sl + len(ht), rl + len(rt)
    assert got["matches"] == m and got["totals"] == t and (got["sys_len"], got["ref_len"]) == (sl, rl)
    # the column form of the closing formula agrees with the Python one
    stats = metrics.bleu_stats(df)
    assert abs(stats.select(metrics.bleu_score(stats)).first()[0] - got["score"]) < 1e-9
    # and the JVM tokeniser gives the same tokens as the UDF's
    jv = [list(r[0]) for r in df.select(metrics.tokenize_13a(F.col("pred"))).collect()]
    assert jv == [metrics.lines_13a([h])[:-1] for h, _ in segs]


def test_chrf_matches_brute_force(spark):
    rnd = random.Random(5)
    segs = [("".join(rnd.choice("abé 한") for _ in range(rnd.randint(0, 40))), "".join(rnd.choice("abé 한") for _ in range(rnd.randint(1, 40)))) for _ in range(40)]
    df = spark.createDataFrame(segs, "pred string, ref string")
    got = metrics.corpus_chrf(df)
    m, h, r = [0] * 6, [0] * 6, [0] * 6
    for hy, re_ in segs:
        hs, rs = "".join(hy.split()), "".join(re_.split())
        for n in range(1, 7):
            hg = pyref.ngrams(list(hs), n)
            rg = pyref.ngrams(list(rs), n)
            m[n - 1] += sum((hg & rg).values())
            h[n - 1] += sum(hg.values()) if rg else 0
            r[n - 1] += sum(rg.values())
    assert (got["matches"], got["hyp"], got["ref"]) == (m, h, r)
    stats = metrics.chrf_stats(df)
    assert abs(stats.select(metrics.chrf_score()).first()[0] - got["score"]) < 1e-9


def test_chrf_short_reference(spark):
    """The first reference has 3 characters: of the first hypothesis only orders
    1 to 3 count (10 + 9 + 8), and the second segment adds 9, 8, ... 4."""
    df = spark.createDataFrame([("abcdefghij", "abc"), ("the cat sat", "the cat sat")], "pred string, ref string")
    got = metrics.corpus_chrf(df)
    assert got["hyp"] == [19, 17, 15, 6, 5, 4]
    assert got["ref"] == [12, 10, 8, 6, 5, 4] == got["matches"]
    p, r = (12 / 19 + 10 / 17 + 8 / 15 + 3) / 6, 1.0
    assert abs(got["score"] - 100 * 5 * p * r / (4 * p + r)) < 1e-9
    assert round(got["score"], 2) == 95.02


def test_tokenizer_dispatch():
    assert metrics.tokenizer_for("en") == "13a" and metrics.tokenizer_for("ko") == "char"
    assert metrics.tokenizer_for("de") == "13a"
    with pytest.raises(NotImplementedError):
        metrics.tokenize(F.lit("x"), "ja-mecab")


def test_batch_predict_and_scoring(spark):
    df = spark.createDataFrame([(i, f"src {i}") for i in range(23)], "id int, src string").repartition(3)
    calls = []

    def fn(batch):
        calls.append(len(batch))
        return [f"  {s.upper()}\n" for s in batch]

    out = infer.batch_predict(df, fn, batch_size=4).collect()
    assert {(r.id, r.pred) for r in out} == {(i, f"SRC {i}") for i in range(23)}
    with pytest.raises(Exception):
        infer.batch_predict(df, lambda b: b[:-1]).collect()
    scored = infer.score_segments(
        df.withColumn("pred", F.col("src")).withColumn("ref", F.col("src")), lambda rows: [len(r["mt"]) for r in rows]
    )
    assert infer.system_score(scored).first()[0] == round(sum(len(f"src {i}") for i in range(23)) / 23, 4)


def test_chat_rows(spark):
    df = spark.createDataFrame([("가나", "ab", 1)], "ko string, en string, other int")
    row = chat.sft_messages(df, "en2ko", system="SYS").first()
    assert [(m.role, m.content) for m in row.messages] == [("system", "SYS"), ("user", "ab"), ("assistant", "가나")]
    assert chat.sft_messages(df, "ko2en").columns == ["messages"]
    with pytest.raises(ValueError):
        chat.sft_messages(df, "ko2ja")
    src, ref = chat.direction_columns("ko2en")
    assert df.select(src.alias("s"), ref.alias("r")).first() == ("가나", "ab")


def test_schema_probe_and_status(spark):
    from pyspark.sql import types as T

    s1 = T.StructType([T.StructField("translation", T.StructType([T.StructField("ko", T.StringType()), T.StructField("en", T.StringType())]))])
    assert report.probe_schema(s1) == ("translation.ko", "translation.en", "translation.{ko,en}")
    s2 = T.StructType([T.StructField(n, T.StringType()) for n in ("korean", "english", "score")])
    assert report.probe_schema(s2)[2] == "{korean,english}"
    s3 = T.StructType([T.StructField(n, T.StringType()) for n in "abcdefgh"])
    assert report.probe_schema(s3)[2] == "unknown_schema: keys=['a', 'b', 'c', 'd', 'e', 'f']"
    samples = spark.createDataFrame(
        [("s", "한국어", "English")] * 5 + [("s", "abc", "def")] * 5 + [("t", "x", None)], "src string, ko string, en string"
    )
    got = {r.src: (r.n_samples, r.n_ok, r.sanity_pass_rate, r.status) for r in report.sanity_summary(samples, ["src"]).collect()}
    assert got == {"s": (10, 5, 0.5, "ok"), "t": (1, 0, 0.0, "low_sanity")}


def plain_block(hyp, ref, max_n):
    per_row = [pyref.match_counts(list(h), list(r), max_n) for h, r in zip(hyp, ref, strict=True)]
    return [sum(x) for x in zip(*per_row, strict=True)]


def test_block_matches_count_rows_apart():
    rnd = random.Random(9)
    for alphabet, rows in (("ab", 50), ("abcdefgh é中😀", 40), ([chr(0x4E00 + i) for i in range(3000)], 6), ("x", 3)):
        hyp = ["".join(rnd.choice(alphabet) for _ in range(rnd.randrange(0, 700))).replace(" ", "") for _ in range(rows)]
        ref = [h[5:300] + "".join(rnd.choice(alphabet) for _ in range(rnd.randrange(80))).replace(" ", "") for h in hyp]
        ref[0], hyp[-1] = "", ""
        x, y, n = metrics._char_tokens(hyp, ref)
        for order in (1, 4, 6):
            assert metrics.block_matches(x, y, rows, n, order) == plain_block(hyp, ref, order)
    big = "".join(chr(0x4E00 + i) for i in range(3000))  # windows of this alphabet don't fit in one number
    x, y, n = metrics._char_tokens([big + "abcabc", big], [big[100:] + "abc", big[:50] + big])
    assert (n + 1) ** 6 > 2**62 and metrics.block_matches(x, y, 2, n, 6) == plain_block([big + "abcabc", big], [big[100:] + "abc", big[:50] + big], 6)


def test_lines_as_one_text_have_their_own_tokens():
    rnd = random.Random(4)
    bits = ["a", "B", "1", "2.5", ".", ",", "-", "\n", "-\n", " ", "\ue000", "&quot;", "&amp;lt;", "<skipped>", "(x)", "é", "\u2028", "$", ""]
    lines = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 12))) for _ in range(300)]
    mark = metrics.lines_13a(lines)[-1]
    got = " ".join(metrics.lines_13a(lines)[:-1]).split(mark)
    assert [g.split() for g in got] == [metrics.lines_13a([x])[:-1] for x in lines]


def test_one_pass_gives_both_metrics(spark):
    rows = [("the cat sat.", "the cat sat down."), (None, "x y"), ("a-b 1,5", None), ("", ""), ("한국어 문장", "한국어  문장")]
    df = spark.createDataFrame(rows, "pred string, ref string").repartition(3)
    for tok in ("13a", "char"):
        both = metrics.metric_stats(df, bleu=tok).first().asDict()
        assert {k.removeprefix("bleu_"): v for k, v in both.items() if k.startswith("bleu_")} == metrics.bleu_stats(df, tokenizer=tok).first().asDict()
        assert {k.removeprefix("chrf_"): v for k, v in both.items() if k.startswith("chrf_")} == metrics.chrf_stats(df).first().asDict()
    assert metrics.metric_stats(df.limit(0)).first()["bleu_sys_len"] == 0


def test_a_model_is_loaded_once_in_a_worker(spark, tmp_dir):
    import os
    import uuid

    from corpusforge.operators.infer import batch_predict, score_segments

    def loader(kind, model):
        def setup():
            open(f"{tmp_dir}/{kind}-{os.getpid()}-{uuid.uuid4().hex}", "w").close()
            return model

        return setup

    df = spark.range(3000).selectExpr("cast(id as string) as src").repartition(60)
    out = batch_predict(df, setup=loader("predict", lambda batch: [f" {x}! " for x in batch]))
    out = score_segments(out.withColumn("ref", out.src), setup=loader("score", lambda rows: [float(len(r["mt"])) for r in rows]))
    assert all(r.pred == f"{r.src}!" and r.segment_score == len(r.pred) for r in out.collect())
    for kind in ("predict", "score"):
        loads = [x for x in os.listdir(tmp_dir) if x.startswith(kind)]
        workers = {x.split("-")[1] for x in loads}
        assert 1 <= len(loads) == len(workers) <= 16  # 60 tasks
    with pytest.raises(ValueError):
        batch_predict(df)
