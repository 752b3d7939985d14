import unicodedata

from pyspark.sql import functions as F

from corpusforge.functions import text
from corpusforge.functions.numeric import py_format, py_round

SAMPLES = [
    "  a b ", "　\xa0x 　", "\x1c\x1dkey\x85", "", "   ", "한국　", "\U0001F600 x \U0001F600",
    "a​b", "​ a ​", "\t\n\x0b\x0c\r line   ", "      mid dle  ",
]


def test_whitespace_set_is_pythons():
    ws = {chr(c) for c in range(0x110000) if chr(c).isspace()}
    assert set(text.WHITESPACE_CHARS) == ws and len(ws) == 29


def test_py_strip_matches_python(spark):
    df = spark.createDataFrame([(s,) for s in SAMPLES], "s string")
    got = [r[0] for r in df.select(text.py_strip(F.col("s"))).collect()]
    assert got == [s.strip() for s in SAMPLES]


def test_py_split_matches_python(spark):
    df = spark.createDataFrame([(s,) for s in SAMPLES], "s string")
    got = [list(r[0]) for r in df.select(text.py_split(F.col("s"))).collect()]
    assert got == [s.split() for s in SAMPLES]


def test_split_lines_matches_python(spark):
    cases = ["a\nb", "a\nb\n", "a\r\nb\rc", "", "\n", "x\n\ny", "a b\x85c\x1cd", "a\x0bb\x0c", "one"]
    df = spark.createDataFrame([(s,) for s in cases], "s string")
    got = [list(r[0]) for r in df.select(text.split_lines(F.col("s"))).collect()]
    assert got == [s.splitlines() for s in cases]


def test_nfc_and_stable_set(spark):
    decomposed = unicodedata.normalize("NFD", "한국어 café")
    cases = [decomposed, "plain ascii", "é composed", None, "각"]
    df = spark.createDataFrame([(s,) for s in cases], "s string")
    got = [r[0] for r in df.select(text.nfc(F.col("s"))).collect()]
    assert got == [None if s is None else unicodedata.normalize("NFC", s) for s in cases]


def test_nfc_stable_range_never_composes():
    # no character of the fast-path set is the second half of a canonical
    # composition, and each is NFC-stable on its own
    seconds = set()
    for cp in range(0x110000):
        d = unicodedata.decomposition(chr(cp))
        if d and not d.startswith("<"):
            parts = d.split()
            if len(parts) == 2:
                seconds.add(int(parts[1], 16))
    stable = list(range(0x0, 0x300)) + list(range(0xAC00, 0xD7A4))
    assert not seconds.intersection(stable)
    assert all(unicodedata.is_normalized("NFC", chr(c)) for c in stable)


def test_python_rounding(spark):
    xs = [0.125, 0.285, 2.675, 0.375, 1234.565, 0.005, 99 / 200, 12345.5, 0.86585]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    rows = df.select(py_format(F.col("x"), 2).alias("f"), py_round(F.col("x"), 4).alias("r")).collect()
    assert [r.f for r in rows] == [f"{x:.2f}" for x in xs]
    assert [r.r for r in rows] == [round(x, 4) for x in xs]
