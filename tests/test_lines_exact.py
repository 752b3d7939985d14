"""Line readers against Python on files with every kind of break."""

import os
import random

from corpusforge.sources.lines import read_lines

PIECES = ["a", "bc", "", " ", "é", "日", "\n", "\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", " ", " ", "﻿"]
CASES = [
    "a\nb\x1c", "a\nb\x1c\n", "a\nb\r", "a\nb\r\r", "a\nb\x1c\r", "a\x85", "\x85", "\n", "\r\n", "\n\n", "a", "a\r\nb\r\n", "﻿a\nb",
    "﻿a\nb\n", "﻿\x1c", "a\n\x1c\x1c", "é ", "a\n \n", "\x1c\n", "x\x0b\x0c",
]


def lines_of(spark, path):
    return [r.line for r in read_lines(spark, path).orderBy("line_no").collect()], sorted(r.line_no for r in read_lines(spark, path).collect())


def test_lines_of_files_match_python(spark, tmp_dir):
    rng = random.Random(11)
    texts = CASES + ["".join(rng.choice(PIECES) for _ in range(rng.randrange(1, 30))) for _ in range(60)]
    texts = [t for t in texts if t != "\ufeff"]  # a lone mark is no line to Spark's reader
    for i, t in enumerate(texts):
        with open(f"{tmp_dir}/{i:04d}.txt", "wb") as f:
            f.write(t.encode())
    want = [line for t in texts for line in t.splitlines()]  # all files, in path order
    got, numbers = lines_of(spark, tmp_dir)
    assert got == want and numbers == list(range(len(want)))


def test_single_files_and_small_splits(spark, tmp_dir):
    rng = random.Random(5)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    cost = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "16")
    try:
        for i in range(6):
            text = "".join(rng.choice(PIECES) for _ in range(600)) + rng.choice(["", "\n", "\x1c", "\x85\r", " "])
            path = os.path.join(tmp_dir, f"f{i}.txt")
            with open(path, "wb") as f:
                f.write(text.encode())
            got, numbers = lines_of(spark, path)
            assert got == text.splitlines() and numbers == list(range(len(got)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.set("spark.sql.files.openCostInBytes", cost)


def test_empty_file(spark, tmp_dir):
    open(f"{tmp_dir}/none.txt", "w").close()
    assert read_lines(spark, f"{tmp_dir}/none.txt").count() == 0
