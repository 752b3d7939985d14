"""Classifiers against plain loops, and the pipeline's rows against a plain chain."""

import base64
import hashlib
import os
import random
import re
import sys

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
import tiktoken
from pyspark.sql.types import StructType

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402

from corpusforge.llm import language_id, mixing, quality, queries, toxicity  # noqa: E402
from corpusforge.llm.bytesops import word_hashes  # noqa: E402
from corpusforge.session import checkpoint_dir  # noqa: E402

SF = "/root/testdata/sf0.001"
TEXTS = ["", None, "one", "Two words", "x " * 50 + "bad bad WORD!", "éa, b-c " * 9, "w" * 300, "\n \t", "a b"]


def plain_toxicity(model, text):
    words = re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode())
    pairs = []
    for w in words:
        raw = np.frombuffer(w, np.uint8)
        h = int(word_hashes(raw, np.array([0]), np.array([len(w)]))[0])
        pairs.append((h & (toxicity.BUCKETS - 1), (h >> 40) & (toxicity.BUCKETS - 1)))
    padding = (toxicity.BUCKETS, toxicity.BUCKETS)
    n = max(len(pairs), 1)
    pairs = (pairs or [padding]) + [padding] * (max(toxicity.WIDTHS) - 1)
    vectors = [model.tables[0][a].astype(float) + model.tables[1][b] for a, b in pairs]
    pooled = []
    for width, f in zip(toxicity.WIDTHS, model.filters, strict=True):
        for j in range(toxicity.FILTERS):
            pooled.append(max(sum(float(vectors[i + k] @ f[k][:, j]) for k in range(width)) for i in range(n)))
    z = sum(max(a + b, 0.0) * w for a, b, w in zip(pooled, model.bias, model.weights, strict=True)) + model.intercept
    logs = sum(model.language_logs[a].astype(float) for a, _ in pairs[:n])
    return 1 / (1 + np.exp(-(z - model.thresholds[int(np.argmax(logs))])))


def test_toxicity_scores_are_those_of_a_plain_convolution():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 30))) for _ in range(400)]
    labels = [int("w7 " in t + " " or "w11 w12" in t) for t in texts]
    model = toxicity.fit(texts, labels, [rng.choice(["en", "fr", None]) for _ in texts])
    model.tables = model.tables.astype(np.float32)
    some = [t for t in TEXTS if t != ""] + texts[:40]
    got = toxicity._Scorer(model).scores(pa.array(some, pa.string()))
    assert got == pytest.approx([plain_toxicity(model, t) for t in some], abs=1e-3)
    assert np.mean([(s >= 0.5) == bool(y) for s, y in zip(toxicity._Scorer(model).scores(pa.array(texts)), labels, strict=True)]) > 0.9


def test_quality_scores_are_those_of_plain_trees():
    rng = np.random.default_rng(3)
    x = rng.random((600, len(quality.STATISTICS)))
    y = ((x[:, 3] > 0.5) ^ (x[:, 9] > 0.7)).astype(int)
    model = quality.fit(x, y.tolist())

    def plain(row):
        z = model.base
        for feature, threshold, leaf in zip(model.feature, model.threshold, model.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            z += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-z))

    assert model.scores(x[:200]) == pytest.approx([plain(r) for r in x[:200]])
    assert np.mean((model.scores(x) >= 0.5) == y) > 0.95


def test_quality_statistics_of_small_texts():
    names = quality.STATISTICS
    text = "Go go, stop!\nGo go, stop!\n| x"
    got = dict(zip(names, quality.statistics(pa.array([text, "", None]))[0], strict=True))
    words = text.lower().split()
    lines = [tuple(x.split()) for x in text.lower().split("\n")]
    want = {
        "log_words": np.log1p(8), "share_upper": 2 / len(text), "share_break": 2 / len(text), "longest_word": np.log1p(5),
        "share_different_words": len(set(words)) / 8, "commonest_word": 2 / 8, "share_repeated_lines": 1 - len(set(lines)) / 3,
        "share_sign_words": 3 / 8, "share_letterless_words": 1 / 8, "words_per_line": 8 / 3, "log_lines": np.log1p(3), "share_long_words": 0.0,
    }
    assert {k: got[k] for k in want} == pytest.approx(want)
    assert not quality.statistics(pa.array(["", None])).any()


def plain_mix(rows):
    """rows: (id, text, source) in their order -> how often each is taken."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    names = sorted({s for _, _, s in rows if s is not None}, key=lambda s: s.encode()) + [None] * any(s is None for _, _, s in rows)
    total = {s: sum(n for n, r in zip(size, rows, strict=True) if r[2] == s) for s in names}
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    budget, target, free = mixing.SHARE * sum(size), {}, set(names)
    while free:
        level = budget / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > mixing.MAX_EPOCHS * total[s]]
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        for s in over:
            target[s] = float(mixing.MAX_EPOCHS * total[s])
            budget -= target[s]
            free.discard(s)

    def key(i):
        id_, text, _ = rows[i]
        about = f"|{hashlib.md5((text or '').encode()).hexdigest()}" if id_ is None else id_
        return (hashlib.md5(f"{mixing.SEED}|{about}".encode()).hexdigest(), id_ is not None, id_ or 0, size[i], i)

    times = [0] * len(rows)
    for s in names:
        goal = int(target[s] + 0.5)
        whole = goal // total[s] if total[s] else 0
        rest = goal - whole * total[s]
        for i in sorted((i for i in range(len(rows)) if rows[i][2] == s), key=key):
            extra = max(0, min(size[i], rest))
            rest -= size[i]
            times[i] = whole + (extra > 0 and 2 * extra >= size[i])
    return times


def test_pipeline_rows_against_a_plain_chain(spark, tmp_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    base = docs.orderBy("doc_id").collect()
    copy = base[4].asDict()
    odd = [copy, copy, {**copy, "doc_id": None}, {**copy, "doc_id": None, "text": copy["text"] + " and so on"}]
    odd += [{**copy, "doc_id": 10**6 + i, "text": t} for i, t in enumerate((None, "", "12 34", "  "))]
    rows = [r.asDict() for r in base] + odd
    columns = docs.columns
    schema = StructType(list(docs.schema.fields)).add("score", "double").add("lang_pred", "string").add("_mix_copy", "integer")
    frame = spark.createDataFrame([(*[r[c] for c in columns], -7.0, "xx", 3) for r in rows], schema)
    frame.coalesce(1).write.parquet(f"{tmp_dir}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_dir}/labels.parquet")

    def written(rows):
        return spark.createDataFrame([(*[r[c] for c in columns], -7.0, "xx", 3) for r in rows], schema)

    model = queries.language_model(frame)
    best, score = language_id.predict(pa.array([r["text"] for r in rows], pa.string()), model)
    now = [r for r, s in zip(rows, score, strict=True) if r["text"] and regex.search(r"\p{L}", r["text"]) and s >= p.LEAST_LANGUAGE_SCORE]
    first = p.keep_known_languages(spark, frame, tmp_dir)
    assert first.columns == frame.columns
    assert {(r.score, r.lang_pred, r._mix_copy) for r in first.collect()} == {(-7.0, "xx", 3)} and first.count() == len(now)

    learn = spark.read.parquet(f"{SF}/labels.parquet").where(~queries.held_out(queries.TOXIC_FOLDS, queries.TOXIC_HELD_OUT))
    scores = toxicity._Scorer(toxicity.train(written(now), learn)).scores(pa.array([r["text"] for r in now]))
    now = [r for r, s in zip(now, scores, strict=True) if s < 0.5]
    found = brute.near_duplicates([(i, r["text"]) for i, r in enumerate(now)])
    groups = {}
    for i, (_, component, _) in found.items():
        groups.setdefault(component, []).append(i)
    kept = sorted(min(g, key=lambda i: (now[i]["doc_id"] is None, now[i]["doc_id"] or 0, i)) for g in groups.values())
    now = [now[i] for i in kept]
    times = plain_mix([(r["doc_id"], r["text"], r["source"]) for r in now])
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for r, n in zip(now, times, strict=True):
        ids = coder.encode_ordinary(r["text"])
        digest = hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        want += [(r["doc_id"], len(ids), digest, hashlib.sha256(r["text"].encode()).hexdigest())] * n
    folder = checkpoint_dir(spark).removeprefix("file:")
    before = {x for x in os.listdir(folder) if os.listdir(f"{folder}/{x}")}
    got = p.run(spark, tmp_dir)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))
    after = {x for x in os.listdir(folder) if os.path.isdir(f"{folder}/{x}") and os.listdir(f"{folder}/{x}")} - before
    assert [x.split("-")[1] for x in after] == ["pipeline"]  # the last stage's table alone is left
    none = frame.where("false")
    none.write.parquet(f"{tmp_dir}/empty/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_dir}/empty/labels.parquet")
    assert p.run(spark, f"{tmp_dir}/empty").count() == 0
