"""Personal data: base spans against the stated patterns, the model against a plain version."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusforge.llm import pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    return sum((int(c) * 2 - 9 if int(c) > 4 else int(c) * 2) if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10 == 0


def plain_base(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": lambda m=m: True,
                "ip": lambda m=m: all(int(x) <= 255 for x in m.group().split(".")),
                "card": lambda d=digits: 12 <= len(d) <= 19 and plain_luhn(d),
                "phone": lambda d=digits: 9 <= len(d) <= 15,
            }[kind]
            if good():
                out.append((m.start(), order, m.end()))
    return sorted(out)


def listed(spans):
    return ",".join(f"{pii.KINDS[o]}:{a}:{e}" for a, o, e in spans)


def noise(seed, n):
    rng = random.Random(seed)
    bits = ["a", "B9", "@", ".", "..", "-", "+", "+1", " ", "(", ")", "12", "255", "256", "0007", "1.2.3.4", "x@y.z", "%", "_", "é", "😀", "\n", "4111111111111111", "4111 1111 1111 1111", "555-1234", "#"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(n)]


CASES = [
    "a@b.c%d@e.f", "😀a@b.co 😀 x@y", "1.2.3.4.5.6.7.8", "001.002.003.0000255 1.2.3.99999999999999999999", "1.2.3.256 256.1.1.1.1",
    "+1 (826) 555-4081 190.137.223.20", "4111111111111111 4111111111111111", "+1", "+12", "+1 2 3 4 5 6 7 8 9 10 11 12 13 14", "a@b a@b. a@.b .@b.c",
    "4111-1111-1111-1111,4111  1111", "@@@", "++1 (017) 555-7713+1 (017) 555-7713", "", " ",
]


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, "x", 5) for i, t in enumerate(texts)], "doc_id long, text string, kind string, start int")


def test_base_against_the_patterns(spark):
    texts = [*CASES, *noise(1, 1500)]
    got = {r.doc_id: r.spans for r in pii.personal_spans(rows_of(spark, texts).repartition(4)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        base = [(s.start, s.order, s.end) for s in got[i] if s.base]
        assert base == plain_base(t), t
        for s in got[i]:
            assert t[s.start : s.end] == s.hit and s.kind == pii.KINDS[s.order]
            if not s.base:  # added spans are sound, likely, and overlap no base span
                assert s.p >= pii.LEAST and all(s.end <= a or e <= s.start for a, _, e in base)
        assert [(s.start, s.order) for s in got[i]] == sorted((s.start, s.order) for s in got[i])


def test_added_spans(spark):
    """What the strict patterns drop or never see, among many plain spans and clean texts."""
    plain = [f"word of.{i}@mail{i % 9}.example.com and +1 ({i % 900 + 100}) 555-{i % 9000 + 1000} or 4111111111111111 at {i % 200 + 11}.2.3.4 end" for i in range(300)]
    clean = [f"Version {i}.0 of {2000 + i % 30}, 12 {i} 400 pages; no. 10992847249{i:03d}" for i in range(200)]
    hard = ["call +1 (826) 555-4081 190.137.223.20 now", "pay 4111111111111111 4111111111111111 soon"]
    got = {r.doc_id: r.spans for r in pii.personal_spans(rows_of(spark, plain + clean + hard)).collect()}
    assert [s.hit for s in got[500]] == ["+1 (826) 555-4081", "190.137.223.20"]
    assert [s.hit for s in got[501]] == ["4111111111111111"] * 2
    assert all(not s.base for s in got[501])
    assert sum(any(not s.base for s in got[i]) for i in range(300, 500)) <= 4


def test_query(spark, tmp_dir):
    texts = [*CASES, None, *noise(5, 100)]
    rows = rows_of(spark, texts)
    rows.union(rows.where("doc_id < 4")).union(rows.where("doc_id in (0, 5)").withColumn("doc_id", F.lit(None).cast("bigint"))).write.parquet(f"{tmp_dir}/documents.parquet")
    out = queries.op12_personal_data(spark, tmp_dir)
    assert [f"{f.name} {f.dataType.simpleString()}" for f in out.schema] == [
        "doc_id bigint", *[f"n_{k} bigint" for k in pii.KINDS], "base_sha256 string", "spans string"
    ]
    got = out.collect()
    assert len(got) == len(texts) + 4 + 2
    for r in got:
        if r.doc_id is not None:
            base = plain_base(texts[r.doc_id])
            assert r.base_sha256 == hashlib.sha256(listed(base).encode()).hexdigest()
            n = Counter(o for _, o, _ in base)
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(n[o] for o in range(4))
            assert not base or set(listed(base).split(",")) <= set(r.spans.split(","))
    assert sorted(r.base_sha256 for r in got if r.doc_id is None) == sorted(
        hashlib.sha256(listed(plain_base(texts[i])).encode()).hexdigest() for i in (0, 5)
    )


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert pii.personal_spans(none).count() == 0
    assert [r.spans for r in pii.personal_spans(spark.createDataFrame([(1, None), (2, ""), (3, "no data")], "doc_id long, text string")).collect()] == [[]] * 3


@pytest.mark.parametrize(
    "text,n",
    [
        ("7" * 300_000, 0),
        ("7 " * 100_000, 0),
        ("a" * 300_000 + "@b" + ".c" * 100_000, 1),
        ("1." * 100_000, 25_000),
        ("+1" + "(" * 200_000, 0),
        ("x@" * 100_000, 0),
        ("word " * 60_000 + "me@here.org", 1),
    ],
)
def test_very_long_texts(spark, text, n):
    got = pii.personal_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert sum(s.base for s in got[0].spans) == n


def test_expectation_maximisation(spark):
    rng = random.Random(4)
    rows = []
    for kind in (0, 2):
        for _ in range(800):
            true = rng.random() < 0.3
            rows.append((kind, [rng.choices([0, 1, 2], [1, 8, 2] if true else [6, 1, 4])[0] for _ in range(3)]))
    got = {r.kind: r.em for r in pii.reliabilities(spark.createDataFrame(rows, "kind int, votes array<int>")).collect()}
    for kind in (0, 2):
        seen = Counter(tuple(v) for k, v in rows if k == kind)
        prior, yes, no = 0.5, [0.1, 0.7, 0.2] * 3, [0.5, 0.2, 0.3] * 3
        for _ in range(pii.EM_ROUNDS):
            q = {}
            for v in seen:
                a = prior * math.prod(yes[3 * j + x] for j, x in enumerate(v))
                b = (1 - prior) * math.prod(no[3 * j + x] for j, x in enumerate(v))
                q[v] = a / (a + b)
            n1, n = sum(seen[v] * q[v] for v in seen), sum(seen.values())
            prior = (n1 + 1) / (n + 2)
            yes = [(sum(seen[v] * q[v] for v in seen if v[k // 3] == k % 3) + 1) / (n1 + 3) for k in range(9)]
            no = [(sum(seen[v] * (1 - q[v]) for v in seen if v[k // 3] == k % 3) + 1) / (n - n1 + 3) for k in range(9)]
        assert got[kind].prior == pytest.approx(prior, rel=1e-9) and 0.2 < prior < 0.4
        assert got[kind].yes == pytest.approx(yes, rel=1e-9)
        assert got[kind].no == pytest.approx(no, rel=1e-9)
