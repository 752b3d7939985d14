"""Importance resampling against a plain version."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from corpusforge.llm import resample
from corpusforge.session import Scratch

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text, order, buckets):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    runs = [" ".join(words[i : i + n]) for n in range(1, order + 1) for i in range(len(words) - n + 1)]
    return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]


def plain_resample(rows, target, order=1, buckets=10_000, least=20, percent=10, seed=2024):
    s, t = [0] * buckets, [0] * buckets
    bags = [(i, *plain_features(text, order, buckets)) for i, text in rows]
    for _, _, bag in bags:
        for b in bag:
            s[b] += 1
    for text in target:
        for b in plain_features(text, order, buckets)[1]:
            t[b] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for i, n_words, bag in bags:
        weight = math.floor(sum(gain[b] for b in bag) / len(bag)) if bag else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(bag), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words])
    eligible = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    drawn = eligible[: len(eligible) * percent // 100]
    rest = sorted((r for r in out if not any(r is d for d in drawn)), key=str)
    return [(*r[:4], k + 1) for k, r in enumerate(drawn)], [(*r[:4], None) for r in rest]


def texts(n, seed=5):
    rng = random.Random(seed)
    words = ["the", "The", "cat", "Ünder", "日本語のことば", "x" * 90, "r2d2", "--", "a.b", "\x00null", "É"]
    return [" ".join(rng.choice(words) for _ in range(rng.randrange(60))) + rng.choice(["", ".", "\n"]) for _ in range(n)]


@pytest.mark.parametrize("order,percent", [(1, 10), (1, 100), (3, 37), (2, 0)])
def test_against_plain(spark, order, percent):
    body = texts(120)
    rows = [(i, x) for i, x in enumerate(body)] + [(3, body[3])] * 4 + [(5, body[6])] * 3
    rows += [(None, body[8])] * 3 + [(None, None), (900, None), (901, ""), (902, "...")]
    target = [body[1], "the the cat", None, ""]
    docs = spark.createDataFrame([(*r, 1, 2, "z") for r in rows], "doc_id long, text string, rank int, score int, _row string").repartition(5)
    goal = spark.createDataFrame([(x,) for x in target], "text string")
    got = resample.resample(docs, goal, max_order=order, n_buckets=500, percent=percent).collect()
    drawn, rest = plain_resample(rows, target, order, 500, percent=percent)
    assert sorted((tuple(r) for r in got if r.rank), key=lambda r: r[4]) == drawn
    assert sorted((tuple(r) for r in got if not r.rank), key=str) == sorted(rest, key=str)
    assert [f.dataType.simpleString() for f in resample.resample(docs, goal).schema] == ["bigint"] * 5


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b c " * 10), (2, "d " * 30)], "doc_id long, text string")
    assert resample.resample(none, some).count() == 0
    assert {(r.doc_id, r.rank is None) for r in resample.resample(some, none, percent=50).collect()} in ({(1, False), (2, True)}, {(1, True), (2, False)})


@pytest.mark.parametrize("order", [1, 2, 4])
def test_long_rows_in_blocks(monkeypatch, order):
    """Blocks of a few bytes give the features of whole texts, each once."""
    body = [*texts(40, seed=9), None, "", "word " * 300, "x" * 500, "y" * 30 + " " + "z" * 300 + " end"]

    def bags(limit):
        monkeypatch.setattr(resample, "_PIECE", limit)
        out = [[] for _ in body]
        words = [0] * len(body)
        for word_rows, rows, found in resample.features(pa.array(body, pa.string()), order, 1000):
            for r in word_rows:
                words[r] += 1
            for r, b in zip(rows, found, strict=True):
                out[r].append(int(b))
        return words, [sorted(x) for x in out]

    want = [plain_features(x, order, 1000) for x in body]
    for limit in (1, 7, 64, 1 << 20):
        words, found = bags(limit)
        assert words == [n for n, _ in want]
        assert found == [sorted(b) for _, b in want]


def test_threshold_counts(spark):
    rng = random.Random(3)
    for values in ([5], [7] * 20, [rng.randrange(-(2**63), 2**63) for _ in range(50)] + [-(2**63), 2**63 - 1], [rng.randrange(4) for _ in range(60)]):
        df = spark.createDataFrame([(v,) for v in values], "v long").cache()
        for wanted in {1, len(values) // 2 or 1, len(values)}:
            v = sorted(values)[wanted - 1]
            assert resample.threshold(df, "v", wanted) == (v, sum(x < v for x in values), sum(x <= v for x in values))


def test_ranks_over_ranges(spark):
    df = spark.range(1000).selectExpr("id * 7919 % 1000 as k").repartition(7)
    got = resample.with_ranks(df, ["k"], Scratch(spark, "ranks")).collect()
    assert sorted((r.k, r["rank"]) for r in got) == [(i, i + 1) for i in range(1000)]


def test_crc_of_words():
    raw = np.frombuffer(b"Ab" + bytes(range(128, 256)), np.uint8)
    starts, ends = np.array([0, 0, 1, 2]), np.array([2, 1, 2, 130])
    assert resample.crc32_words(raw, starts, ends).tolist() == [zlib.crc32(x) for x in (b"ab", b"a", b"b", bytes(range(128, 256)))]
