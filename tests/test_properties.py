"""Property checks against Python on random text (hypothesis), batched so
each example set is one Spark job."""

import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import pyref
from corpusforge.functions import text
from corpusforge.operators import metrics

ALPHABET = (
    list(text.WHITESPACE_CHARS)
    + list("\r\n\x0b\x0c\x1c\x1d\x1e\x85  ")
    + list("abcXYZ09.,-&;")
    + list("가힣한국")
    + [unicodedata.normalize("NFD", "한"), "é", "ᄀ", "ᅡ", "\U0001F600", "İ", "Σ"]
)
def strings(max_size):
    # pieces may be several code points (decomposed syllables), so join them
    return st.lists(st.sampled_from(ALPHABET), max_size=max_size).map("".join)


texts = st.lists(strings(30), min_size=50, max_size=120)
SETTINGS = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


@SETTINGS
@given(texts)
def test_text_functions_match_python(spark, xs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, s string")
    rows = df.select(
        "i",
        text.py_strip(F.col("s")).alias("strip"),
        text.py_split(F.col("s")).alias("split"),
        text.split_lines(F.col("s")).alias("lines"),
        text.nfc(F.col("s")).alias("nfc"),
        text.dedup_key(F.col("s")).alias("key"),
    ).collect()
    for r in rows:
        x = xs[r.i]
        assert r.strip == x.strip()
        assert list(r.split) == x.split()
        assert list(r.lines) == x.splitlines()
        assert r.nfc == unicodedata.normalize("NFC", x)
        assert len(r.key) == 32


@SETTINGS
@given(texts)
def test_keys_ignore_padding_and_case(spark, xs):
    """Padding never matters, nor case or composition; other texts differ."""
    rows = [(x, "\u3000 " + x + "\n", x.lower()) for x in xs]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    keys = df.select(*[text.dedup_key(F.col(c)).alias(c) for c in "abc"]).collect()
    assert all(r.a == r.b for r in keys)
    plain = [(x.strip(), r) for x, r in zip(xs, keys) if x.isascii()]
    assert all(r.a == r.c for _, r in plain)
    assert len({x.lower() for x, _ in plain}) == len({r.a for _, r in plain})


def test_key_values(spark):
    df = spark.createDataFrame([("  ABC ",), ("\ud55c",), ("\u1112\u1161\u11ab",), ("",)], "s string")
    got = [r[0] for r in df.select(text.dedup_key(F.col("s"))).collect()]
    assert got[0] == "900150983cd24fb0d6963f7d28e17f72" and got[1] == got[2] != got[0]
    assert got[3] == "d41d8cd98f00b204e9800998ecf8427e"


@SETTINGS
@given(st.lists(st.tuples(strings(40), strings(40)), min_size=20, max_size=60))
def test_metric_counts_partition_independent(spark, pairs):
    df = spark.createDataFrame(pairs, "pred string, ref string")
    a = metrics.corpus_chrf(df.repartition(1))
    b = metrics.corpus_chrf(df.repartition(7))
    assert a == b
    c = metrics.corpus_bleu(df.repartition(1), tokenizer="char")
    d = metrics.corpus_bleu(df.repartition(5), tokenizer="char")
    assert c == d
    m = [0] * 4
    for h, r in pairs:
        ht, rt = list("".join(h.rstrip().split())), list("".join(r.rstrip().split()))
        for i, v in enumerate(pyref.match_counts(ht, rt, 4)):
            m[i] += v
    assert c["matches"] == m
