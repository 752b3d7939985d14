"""Sharding, mixing, WARC archives, nearest neighbours and the pipeline."""

import gzip
import hashlib
import os
import random
import sys
import zlib

import numpy as np
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.abspath(__file__)), "..", "..", "tools"))

from check_oracle import digest, duck  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from corpusforge.llm import ann, mixing, queries, sharding, warc  # noqa: E402

SF = "/root/testdata/sf0.001"


# ------------------------------------------------------------ sharding
def plain_jump(key, n):
    key, b, j = key % 2**64, -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_jump_shard_matches_the_published_rule(spark):
    rng = random.Random(1)
    keys = [0, 1, -1, 256, 2**63 - 1, -(2**63)] + [rng.randrange(-(2**63), 2**63) for _ in range(200)]
    df = spark.createDataFrame([(k,) for k in keys], "k bigint")
    for n in (1, 2, 16, 17, 1000):
        got = {r.k: r.s for r in df.select("k", sharding.jump_shard(F.col("k"), n).alias("s")).collect()}
        assert got == {k: plain_jump(k, n) for k in keys}
    assert plain_jump(256, 1024) == 520  # a published test value
    assert df.limit(0).select(sharding.jump_shard(F.col("k"), 3)).count() == 0


def test_shard_documents(spark):
    rows = [(i, f"text {i % 7} é", 1, 2, 3) for i in range(500)] + [(None, None, 1, 2, 3), (None, "", 1, 2, 3), (7, "text 0 é", 1, 2, 3), (7, "text 0 é", 1, 2, 3)]
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string, shard int, block int, size int")).collect()
    assert len(got) == len(rows)
    want = sorted(((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), plain_jump(i or 0, 16), plain_jump(i or 0, 17)) for i, t, *_ in rows), key=str)
    assert sorted(((r.doc_id, r["size"], r.text_crc32, r.shard, r.grown_shard) for r in got), key=str) == want
    for s in range(16):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert all(r.grown_shard in (r.shard, 16) and r.law == "key" for r in got)
    assert sharding.shard_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ------------------------------------------------------------ mixing
def plain_targets(sizes, weights, share, cap):
    budget, free, out = share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while free:
        level = budget / sum(weights[i] for i in free)
        over = [i for i in free if level * weights[i] > cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = level * weights[i]
            break
        for i in over:
            out[i] = float(cap * sizes[i])
            budget -= cap * sizes[i]
            free.discard(i)
    return out


def test_mix_meets_its_targets(spark):
    rng = random.Random(3)
    rows = [(i, " ".join("w" for _ in range(rng.randrange(0, 40))), rng.choice(["b", "a", None, "é", "c"]), 1, 2) for i in range(800)]
    rows += [(900 + i, "w " * 3000, "huge", 1, 2) for i in range(3)] + [(None, "w w", "b", 1, 2), (2000, None, "b", 1, 2), (2001, "", "none", 1, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, s int, block int")
    got = mixing.mix(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(df.repartition(5)).collect()))
    names = sorted({r[2] for r in rows if r[2] is not None}, key=lambda x: x.encode()) + [None]
    sizes = [sum(r["size"] for r in got if r.source == s) for s in names]
    want = plain_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(names))], 1.5, 2)
    for s, size, target in zip(names, sizes, want):
        mine = [r for r in got if r.source == s]
        assert all(r.source_size == size and r.target == pytest.approx(target) and 0 <= r.taken <= 2 * r["size"] for r in mine)
        assert abs(sum(r.taken for r in mine) - target) <= 0.5
    assert len(got) == len(rows) and mixing.mix(df.limit(0)).count() == 0
    same = mixing.apply_mix(df.where("doc_id < 800"))
    assert same.columns == df.columns and same.subtract(df).count() == 0


# ------------------------------------------------------------ WARC
def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, id int, digest string")


def test_archives_round_trip(spark, tmp_dir, monkeypatch):
    rng = random.Random(4)
    noise = ["".join(chr(rng.randrange(32, 0x2FFF)) for _ in range(rng.randrange(1, 9000))) for _ in range(120)]
    big = "y" * 1000
    rows = [(i, f"http://a/{i}\r\nX: y", t, 1, "d") for i, t in enumerate(noise)]
    rows += [(500, None, big, 1, "d"), (501, "u", big, 1, "d"), (501, "u", big, 1, "d"), (None, "u", big, 1, "d"), (502, "u", "y" * 999, 1, "d")]
    rows += [(503, "u", "y" * 999, 1, "d"), (504, "u", None, 1, "d"), (505, "u", "", 1, "d")]
    warc.write_archives(pages(spark, rows), f"{tmp_dir}/a", "page_id", "url", "html")
    want = sorted((None if i is None else f"<urn:row:{i}>", len((t or "").encode()), hashlib.sha1((t or "").encode()).hexdigest()) for i, _, t, *_ in rows if i is not None)
    for size in (1 << 20, 997, 10_000):
        got = warc.read_archives(spark, f"{tmp_dir}/a", size).collect()
        assert len(got) == len(rows) and len({(r.path, r.offset) for r in got}) == len(rows)
        named = [r for r in got if r.record_id != "<urn:row:null>"]
        assert sorted((r.record_id, r.payload_bytes, r.payload_digest) for r in named) == want
        kinds = {(r.record_id, r.record_type, r.refers_to) for r in got if r.record_id in ("<urn:row:500>", "<urn:row:501>", "<urn:row:null>", "<urn:row:502>")}
        assert kinds == {
            ("<urn:row:500>", "revisit", "<urn:row:501>"), ("<urn:row:501>", "response", None),
            ("<urn:row:null>", "revisit", "<urn:row:501>"), ("<urn:row:502>", "response", None),
        }
        assert all(hashlib.sha1(bytes(r.payload)).hexdigest() == r.payload_digest for r in got if r.record_type == "response")
    for name in os.listdir(f"{tmp_dir}/a"):  # other tools read them too
        if name.startswith("part-"):
            with gzip.open(f"{tmp_dir}/a/{name}") as f:
                f.read()


def test_reader_skips_magic_inside_members_and_raises_on_a_cut(spark, tmp_dir):
    """Uncompressed members hold their payload, a false magic too, as it is."""
    os.makedirs(f"{tmp_dir}/b")
    body = warc.MAGIC * 40 + bytes(range(256)) * 3
    block = b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    member = gzip.compress(block, compresslevel=0, mtime=0)
    with open(f"{tmp_dir}/b/x.warc.gz", "wb") as f:
        f.write(member * 30)
    open(f"{tmp_dir}/b/empty.warc.gz", "wb").close()
    for size in (100, 1500, 1 << 20):
        got = warc.read_archives(spark, f"{tmp_dir}/b", size).collect()
        assert len(got) == 30 and all(bytes(r.payload) == body for r in got)
    with open(f"{tmp_dir}/b/x.warc.gz", "wb") as f:
        f.write(member + member[:-10])
    with pytest.raises(Exception, match="cut off"):
        warc.read_archives(spark, f"{tmp_dir}/b", 1 << 20).collect()


def test_empty_archive(spark, tmp_dir):
    warc.write_archives(pages(spark, []), f"{tmp_dir}/c", "page_id", "url", "html")
    assert warc.read_archives(spark, f"{tmp_dir}/c").count() == 0


# ------------------------------------------------------------ nearest neighbours
def plain_nearest(rows, k=5):
    ok = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and any(v):
            ok[i] = np.array(v, float)
    ids, out = np.array(sorted(ok)), {}
    for q in ids[ids % 50 == 0]:
        near = sorted((-float(ann.cosine(ok[q], ok[i][None])[0]), i) for i in ids if i != q and len(ok[i]) == len(ok[q]))
        out[q] = near[:k]
    return out


def test_neighbours_of_few_rows_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=6)]) for i in range(201)]
    hot = rows[0][1]
    rows += [(1000 + i, hot) for i in range(60)] + [(2000, [0.0] * 6), (2050, None), (2100, [1.0, None] + [0.0] * 4), (2150, [float("nan")] * 6)]
    rows += [(2200, []), (None, hot), (3, rows[3][1]), (2250, [1.0, 2.0]), (2300, [2.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<float>, shard int, vkey int")
    got = ann.nearest_neighbours(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0, shard_rows=64).collect()
    want = plain_nearest(rows)
    found = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        found.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert found == want
    assert ann.nearest_neighbours(df.limit(0), "vec_id", "embedding", F.col("vec_id") % 50 == 0).count() == 0


def test_recall(spark):
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = plain_nearest(rows)
    got = queries.QUERIES["op8_nearest_neighbours"](spark, sf).collect()
    hits = sum(r.vec_id in {i for _, i in want[r.query_id]} for r in got)
    assert hits / sum(map(len, want.values())) >= 0.9


# ------------------------------------------------------------ SQL, pipeline
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    res = duck(SF).execute(queries.SQL[name])
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest([d[0] for d in res.description], res.fetchall())[0]


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "12 34", "en", "s", 5)], docs.schema)
    now, seen = docs.unionByName(extra), {}
    for name, stage in p.STAGES:
        before = now
        now = stage(spark, before, SF)
        seen[name] = now
        if name != "byte_bpe":
            assert now.columns == docs.columns and now.exceptAll(before).count() == (0 if name != "mixing" else now.exceptAll(before).count())
            assert now.subtract(before).count() == 0
    ids = {r.doc_id for r in seen["language_id"].collect()}
    assert 10**6 not in ids and 10**6 + 1 not in ids and len(ids) >= 0.95 * docs.count()
    kept = seen["near_dedup"]
    from corpusforge.llm.near_dup import near_duplicates

    assert near_duplicates(kept).where("not kept").count() == 0
    mixed = mixing.mix(kept).collect()
    assert seen["mixing"].count() == sum(r.repeats for r in mixed)
    assert seen["byte_bpe"].count() == seen["mixing"].count()
    assert p.run(spark, SF).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
