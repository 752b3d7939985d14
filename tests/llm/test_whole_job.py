"""Operators that do the whole job: priors, whole texts, repeated rows, short texts."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusforge.llm import fingerprint, language_id, mixing, near_dup, quality, queries, sampling, toxicity
from corpusforge.llm.bytesops import flat_utf8


def test_sampled_classes_keep_their_prior(spark):
    labels = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(2000)], "doc_id long, y int")
    drawn = sampling.hash_sample(labels, "doc_id", "y", 40).groupBy("y").agg(F.count("*").alias("n"), F.sum("_weight").alias("w"))
    assert sorted(map(tuple, drawn.collect())) == [(0, 40, pytest.approx(1800)), (1, 40, pytest.approx(200))]
    few = sampling.hash_sample(labels, "doc_id", "y", 5000).agg(F.count("*"), F.min("_weight"), F.max("_weight")).first()
    assert tuple(few) == (2000, 1.0, 1.0)


@pytest.mark.parametrize("module,label,train,score", [
    (toxicity, "toxic", toxicity.train, toxicity.with_toxicity), (quality, "quality", quality.train, quality.with_quality),
])
def test_cut_at_a_half_does_not_move_with_the_sample(spark, monkeypatch, module, label, train, score):
    """One row in ten has label 1 and texts say nothing of it."""
    monkeypatch.setattr(module, "SAMPLE_DOCS", 150)
    rng = random.Random(5)
    words = [f"w{k}" for k in range(30)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(12)), "en") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(10)) == 0).cast("int").alias(label))
    got = np.array([r.score for r in score(docs, train(docs, labels)).select("score").collect()])
    assert (got >= 0.5).mean() < 0.1


def frame(spark, texts, langs):
    return spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(zip(texts, langs, strict=True))], "doc_id long, text string, lang string")


def test_toxicity_learns_from_the_end_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "STEP", 500)  # parts of a document, too
    rng = random.Random(6)
    words = [f"w{k}" for k in range(50)]
    texts = [" ".join(rng.choice(words) for _ in range(4000)) + (" vile vile scum" if i % 2 else " kind") for i in range(160)]
    assert min(map(len, texts)) > 10_000
    docs = frame(spark, texts, ["en"] * len(texts))
    model = toxicity.train(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")))
    got = toxicity.with_toxicity(docs, model).select("doc_id", "score").collect()
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 2 == 1) for r in got]) > 0.95


def test_parts_of_long_documents_have_the_same_maxima(monkeypatch):
    rng = np.random.default_rng(1)
    places = np.array([1, 7, 400, 33])
    first = np.cumsum(places + 2) - (places + 2)
    ids = rng.integers(0, 50, (2, int((places + 2).sum())))
    tables, filters = rng.normal(size=(2, 51, toxicity.DIMS)), [rng.normal(size=(w, toxicity.DIMS, toxicity.FILTERS)) for w in toxicity.WIDTHS]
    whole = toxicity._best_places(ids, tables, filters, first, places)
    monkeypatch.setattr(toxicity, "STEP", 16)
    parts = toxicity._best_places(ids, tables, filters, first, places)
    assert np.allclose(whole[0], parts[0]) and all((a == b).all() for a, b in zip(whole[1], parts[1], strict=True))


def test_a_budget_of_bytes_leaves_out_documents_and_keeps_the_prior(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 1000)
    seen = {}
    monkeypatch.setattr(toxicity, "fit_in_task", lambda rows, learn, keep: seen.update(kept=keep(tuple(r) for r in rows.orderBy("_place").collect())))
    docs = frame(spark, ["abcd " * 20] * 300, ["en"] * 300)
    toxicity.train(docs, docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic")))
    for y, n in ((0, 200), (1, 100)):
        mine = [r for r in seen["kept"] if r[2] == y]
        assert len(mine) == 10 and all(len(r[1]) == 100 for r in mine) and sum(r[4] for r in mine) == pytest.approx(n)


def test_quality_learns_from_the_end_of_long_texts(spark):
    texts = ["plain words here " * 3200 + ("12345 " if i % 2 else "fine ") * 3000 for i in range(60)]
    docs = frame(spark, texts, ["en"] * len(texts))
    model = quality.train(docs, docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality")))
    got = quality.with_quality(docs, model).select("doc_id", "score").collect()
    assert all((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in got)


def test_language_is_learned_from_the_end_of_long_texts(spark):
    texts = ["0 " * 10_500 + ("the cat sat on the mat " if i % 2 else "le chat est sur la table ") * 20 for i in range(20)]
    docs = frame(spark, texts, ["en" if i % 2 else "fr" for i in range(20)])
    model = language_id.train(docs, language_id.read_vocabulary(queries.PIECE_FILE))
    new = frame(spark, ["the mat the cat", "la table le chat", " "], ["?"] * 3)
    assert [r.lang_pred for r in language_id.with_language(new, model).orderBy("doc_id").collect()] == ["en", "fr", "und"]


def test_mix_repeats_rows_of_repeated_and_null_ids_by_themselves(spark):
    texts = [f"word{k} " * (1 + k % 5) for k in range(120)]
    rows = [(None if k % 3 == 0 else k // 4, t, "ab"[k % 2]) for k, t in enumerate(texts)] + [(None, "same copy", "a")] * 6
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.apply_mix(docs)
    assert got.columns == docs.columns
    once = sum(r.repeats for r in mixing.mix(docs).collect())
    words = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in "ab"}
    taken = {s: 0 for s in "ab"}
    for r in got.collect():
        taken[r.source] += len(r.text.split())
    targets = {r.source: r.target for r in mixing.mix(docs).collect()}
    assert got.count() == once and all(abs(taken[s] - targets[s]) <= 5 for s in "ab") and max(taken.values()) <= 2 * max(words.values())
    again = mixing.apply_mix(docs.repartition(7))
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))


def test_null_ids_are_dealt_to_many_blocks(spark):
    """The order of null ids is that of their texts, not one md5 for all."""
    docs = spark.createDataFrame([(None, f"text {k}", "a") for k in range(300)], "doc_id long, text string, source string")
    keyed = docs.withColumn("k", F.regexp_extract("text", r"(\d+)", 1).cast("long"))
    got = {r.k: r.taken for r in mixing.mix(keyed, share=0.5, key_col="k").collect()}
    taken = [k for k in range(300) if got[k]]
    assert sum(got.values()) == 300 and taken != list(range(len(taken)))


def test_near_duplicates_keep_one_row_of_repeated_and_null_ids(spark):
    long = [" ".join(f"{c}{k}" for k in range(40)) for c in "abcd"]
    near = long[0] + " more"
    rows = [(5, long[0]), (5, long[0]), (5, near), (9, near), (None, long[0]), (None, long[1]), (None, long[1]), (7, long[2]), (7, long[3]), (None, None), (None, ""), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    got = near_dup.drop_near_duplicates(docs)
    kept = [(r.doc_id, r.text) for r in got.collect()]
    assert got.columns == docs.columns and len(kept) == 7
    assert sum(t in (long[0], near) for _, t in kept) == 1 and all(i == 5 for i, t in kept if t in (long[0], near))
    assert kept.count((None, long[1])) == 1 and {(7, long[2]), (7, long[3]), (None, None), (None, ""), (3, None)} <= set(kept)


def alike(a, b):
    return fingerprint.likeness(*(fingerprint.PrefixHashes(t).fingerprint() for t in (a, b)))


def test_half_edited_texts_are_half_alike():
    rng = random.Random(9)
    for n in [*range(2, 64), 100, 300, 1000, 5000, 20_000]:
        a, b = ("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for _ in range(2))
        near = alike(a, fingerprint.edited(a, b))
        assert near > 0 and (n > 65 or near >= (n - n // 2) / n) and (n < 300 or 0.42 < near < 0.51)


def test_long_texts_that_share_a_passage_are_found():
    rng = random.Random(10)
    found = []
    for _ in range(40):
        a, b = ("".join(rng.choice("abcdefgh ") for _ in range(20_000)) for _ in range(2))
        at = rng.randrange(19_000)
        found.append(alike(a, b[:at] + a[at : at + 500] + b[at + 500 :]))
        assert alike(a, a[:at] + "!" + a[at:]) > 0.95 and alike(a, b) < 0.001
    assert sum(x > 0 for x in found) >= 36 and max(found) <= 500 / 20_000


def test_repeated_and_null_ids_stay_linear(spark):
    """Thousands of copies of an id, or rows without one, are one set and one training row."""
    text = " ".join(f"w{i}" for i in range(60))
    near = text + " more"
    rows = [(None, t) for t in (text, near) for _ in range(3000)] + [(4, text)] * 3000 + [(9, near.upper())] * 500 + [(i, f"other {i} a b c d") for i in range(20, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    seen = []
    confirm = near_dup._confirmed

    def counting(pairs, sets):
        seen.append((pairs.count(), sets.count()))
        return confirm(pairs, sets)

    near_dup._confirmed = counting
    try:
        got = near_dup.near_duplicates(docs).groupBy("doc_id", "component_id", "kept").count().collect()
    finally:
        near_dup._confirmed = confirm
    assert seen[0] == (1, 2) and all(p <= 1 and s <= 2 for p, s in seen)
    assert {(r.doc_id, r.component_id, r.kept, r["count"]) for r in got if r.doc_id not in range(20, 40)} == {(None, 4, False, 6000), (4, 4, True, 3000), (9, 4, False, 500)}

    nulls = spark.createDataFrame([(None, t) for t in (text, near) for _ in range(1000)], "doc_id long, text string").repartition(4)
    assert {(r.component_id, r.kept) for r in near_dup.near_duplicates(nulls).collect()} == {(None, True)}


def test_training_rows_of_repeated_ids(spark):
    rows = [(1, f"copy {i % 2}", "en") for i in range(4000)] + [(i, f"text {i}", "fr") for i in range(2, 60)] + [(None, "none", "en")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 60)] * 3 + [(7, 0), (8, None), (None, 1), (9, 5)], "doc_id long, y int")
    one = sampling.one_label(labels, "doc_id", "y")
    assert {r.doc_id for r in one.collect()} == set(range(1, 60)) - {7}
    drawn = sampling.hash_sample(one, "doc_id", "_y", 1000)
    found = sampling.with_texts(drawn, docs, "doc_id", "text", "lang").collect()
    assert sorted(r.doc_id for r in found) == sorted(set(range(1, 60)) - {7})
    assert len({r._text for r in found if r.doc_id == 1}) == 1
    langs = sampling.hash_sample(docs.select("doc_id", "lang"), "doc_id", "lang", 1000).collect()
    assert len(langs) == 59 and {r._weight for r in langs if r.lang == "en"} == {4000.0 + 0}


def test_toxicity_learns_from_rows_outside_the_sample(spark, monkeypatch):
    """Each toxic word has its own documents, most of which no sample holds, and
    so has each language's commonest word."""
    monkeypatch.setattr(toxicity, "SAMPLE_DOCS", 12)
    rng = random.Random(8)
    words = [f"w{k}" for k in range(40)]
    rows = []
    for i in range(2400):
        lang = ["aa", "bb", "cc"][i % 3]
        text = [rng.choice(words) for _ in range(12)] + [f"is{lang}"] + ([f"vile{rng.randrange(30)}"] if i % 4 == 0 else [])
        rows.append((i, " ".join(text), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    truth = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    model = toxicity.train(docs, truth.where("doc_id < 2000"))
    got = toxicity.with_toxicity(docs, model).where("doc_id >= 2000").collect()
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 4 == 0) for r in got]) > 0.97
    raw, offsets = flat_utf8(pa.array([f"is{x}" for x in ("aa", "bb", "cc")], pa.string()))
    ids, first, _ = toxicity._words(raw, offsets)
    total = np.array([sum(len(t.split()) for i, t, x in rows[:2000] if x == lang) for lang in ("aa", "bb", "cc")])
    logs = np.log((np.eye(3) * [[667, 667, 666]] + 0.1) / (total + 0.1 * (toxicity.BUCKETS + 1)))
    assert np.allclose(model.language_logs[ids[0][first]], logs, atol=1e-3)


def test_pipeline_stages_join_no_text(spark):
    """Rows that a stage keeps are not dealt anew by their keys."""
    texts = [" ".join(f"w{(i * 31 + k * 7) % 1000}" for k in range(9)) for i in range(60)] + ["one two three four five six"] * 3 + ["", None]
    docs = frame(spark, texts, ["en"] * len(texts)).withColumn("source", F.concat(F.lit("s"), F.col("doc_id") % 3))
    kept = near_dup.drop_near_duplicates(docs)
    mixed = mixing.apply_mix(docs)
    for out in (kept, mixed):
        rows = out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "text" not in "".join(line for line in plan.split("== Initial Plan ==")[0].splitlines() if "SortMergeJoin" in line or "Exchange hashpartitioning(_" in line)
        assert "SortMergeJoin [_near_key" not in plan.split("== Initial Plan ==")[0] and "SortMergeJoin [_mix_key" not in plan
        assert out.columns == docs.columns and {(r.doc_id, r.text) for r in rows} <= set(enumerate(texts))
    assert kept.count() == 63
    times = {r.doc_id: r.repeats for r in mixing.mix(docs).collect()}
    held = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert held == {k: n for k, n in times.items() if n}
