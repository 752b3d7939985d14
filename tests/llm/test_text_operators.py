"""Near-duplicates, BPE, fingerprints, language ID and the classifiers."""

import base64
import hashlib
import os
import random
import sys
import weakref

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
import public_tokenizers  # noqa: E402

from corpusforge.llm import bpe, fingerprint, language_id, near_dup, quality, queries, toxicity  # noqa: E402
from corpusforge.llm.bytesops import BLANKS, flat_utf8, forget, held, word_hashes, word_spans  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, source string, id string, node int, label int, n int"
ODD = [None, "", " \t\n", "x", "É 中文 字", "a b c d e f g h " * 4000, "w" * 5000]


def frame(spark, rows):
    """Extra columns have names that operators use inside."""
    return spark.createDataFrame([(i, t, "s", "x", 1, 2, 3) for i, t in rows], SCHEMA)


# ------------------------------------------------------------ words
def test_word_spans_match_split():
    texts = ["a b", "", None, "c", "  d\te\x0bf ", "é中 g", "x" * 300 + " y"]
    raw, offsets = flat_utf8(pa.array(texts))
    starts, ends, rows = word_spans(raw, offsets, BLANKS)
    got = [[] for _ in texts]
    for s, e, r in zip(starts, ends, rows):
        got[r].append(raw[s:e].tobytes())
    assert got == [(t or "").encode().split() for t in texts]
    assert len(set(word_hashes(raw, starts, ends).tolist())) == len({w for ws in got for w in ws})


# ------------------------------------------------------------ near-duplicates
def near_copies(rng, n=400):
    base = [" ".join(rng.choice(["ab", "cd", "Ef", "gh", "ij", "kl"]) + str(rng.randint(0, 40)) for _ in range(rng.choice([3, 5, 30, 80]))) for _ in range(20)]
    out = []
    for _ in range(n):
        words = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 2, 3, 6])):
            words[rng.randrange(len(words))] = rng.choice(["zz", "yy", "xx", "ab1"])
        out.append(" ".join(words))
    return out


def test_near_duplicates_match_brute_force(spark):
    texts = near_copies(random.Random(5)) + ["A b C d e", "a B c D e"] + ODD
    rows = list(zip(random.Random(1).sample(range(10_000), len(texts)), texts))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute.near_duplicates(rows)


def test_large_keys_take_the_prefix_join_and_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "SMALL_KEY", 2)
    rows = list(enumerate(near_copies(random.Random(9), 300)))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute.near_duplicates(rows)


def test_near_duplicates_null_ids_repeats_and_empty_table(spark):
    rows = [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (2, "q r s t u v"), (None, "only here it is now"), (9, None)]
    got = sorted(map(tuple, near_dup.near_duplicates(frame(spark, rows)).collect()), key=str)
    want = [(None, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (2, 2, 2, True), (None, 1, None, True), (9, 0, 9, True)]
    assert got == sorted(want, key=str)
    assert near_dup.near_duplicates(frame(spark, [])).count() == 0


# ------------------------------------------------------------ BPE
@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_encoder_equals_tiktoken(name):
    import tiktoken

    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.Bpe(ranks)
    encoder = bpe.TextEncoder(own, public_tokenizers.PATTERN)
    rng = random.Random(3)
    texts = ["", "a" * 20_000, " " * 9999, "=" * 7001, "ab" * 9000, "<|endoftext|> it's", "the\r\n\n  The 12345 ½² 中文 🎉‍ é́"]
    texts += ["".join(rng.choice("abehtinors   \n\t.,'129éßñ中🎉Ā-#%&=_\x1c\x85　") for _ in range(rng.choice([1, 5, 40]))) for _ in range(3000)]
    texts += [t.decode("utf8", "ignore") * 2 for t in list(ranks)[::37]]
    for t in texts:
        ids = np.frombuffer(encoder.encode(t), np.int32)
        assert ids.tolist() == other.encode_ordinary(t)
        assert own.decode(ids) == t.encode()


def test_long_texts_are_encoded_in_parts(monkeypatch):
    own = bpe.Bpe(bpe.parse_ranks(queries.vocabulary()))
    text = "The word, again and\n again " * 200
    whole = bpe.TextEncoder(own, public_tokenizers.PATTERN).encode(text)
    monkeypatch.setattr(bpe, "_LONG", 100)
    monkeypatch.setattr(bpe, "_PIECES_AT_ONCE", 7)
    assert bpe.TextEncoder(own, public_tokenizers.PATTERN).encode(text) == whole


def test_token_digests(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "null id"), (1, ""), (1, "")]
    own = bpe.Bpe(bpe.parse_ranks(queries.vocabulary()))
    encoder = bpe.TextEncoder(own, public_tokenizers.PATTERN)
    want = []
    for i, t in rows:
        ids = np.frombuffer(encoder.encode(t or ""), np.int32).tolist()
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    got = [tuple(r) for r in queries.token_digests(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert queries.token_digests(frame(spark, [])).count() == 0


def test_round_trips_leave_the_worker_in_bounded_batches(spark):
    own = bpe.Bpe(bpe.parse_ranks(queries.vocabulary()))
    encoder = bpe.TextEncoder(own, public_tokenizers.PATTERN)
    rng = random.Random(8)
    texts = [*ODD, *(" ".join(rng.choice(["and", "the", "é中", "it's", "12"]) for _ in range(700)) for _ in range(3000)), None, "", "lone " * 400_000, None, "last"]
    size = sum(len((t or "").encode()) for t in texts)
    want = []
    for t in texts:
        ids = np.frombuffer(encoder.encode(t or ""), np.int32).tolist()
        want.append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    given = [pa.array(texts, pa.string()), pa.array([], pa.string()), pa.array([None], pa.string())]
    parts = list(bpe._round_trips(iter(given), encoder, bpe.Decoder(own.ranks)))
    rows = [r for p in parts for r in p.to_pylist()]
    assert [(len(r["ids"]), hashlib.sha256(r["decoded"]).hexdigest()) for r in rows[:-1]] == [(n, d) for n, _, d in want]
    assert rows[-1] == {"ids": [], "decoded": b""}
    assert len(parts) > size >> 20 and max(p.nbytes for p in parts if len(p) > 1) < 6 << 20
    frames = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for df in (frames.coalesce(1), frames.where("doc_id % 7 = 0").repartition(5, "doc_id"), frames.where("doc_id < 0").repartition(3)):
        got = {r[0]: tuple(r)[1:] for r in queries.token_digests(df).collect()}
        assert got == {r.doc_id: want[r.doc_id] for r in df.select("doc_id").collect()}


def test_a_replaced_model_leaves_memory_at_once():
    class Model:
        def __init__(self):
            self.own = self

    gone = weakref.ref(held("first of two", Model))
    assert gone() is not None
    held("second of two", Model)
    assert gone() is None
    gone = weakref.ref(held("second of two", Model))
    forget()
    assert gone() is None


def test_merge_edges_share_the_vocabularys_tokens():
    own = bpe.Bpe(bpe.parse_ranks(queries.vocabulary()))
    for edges in (own._left_edge, own._right_edge):
        assert len({id(x) for e in edges.values() for x in e if isinstance(x, bytes)}) <= len(own.ranks)


def test_decode_of_odd_ids(spark):
    df = spark.createDataFrame([([0, None, -1, 10**6],), (None,), ([],)], "ids array<int>")
    got = [bytes(r.decoded) for r in bpe.with_decoded(df, queries.vocabulary()).collect()]
    assert got == [b"!" + "��".encode(), b"", b""]


# ------------------------------------------------------------ fingerprints
def test_prefix_hashes_answer_spans():
    rng = random.Random(4)
    a = "".join(rng.choice("abé中") for _ in range(500))
    b = a[:200] + "X" + a[200:]
    x, y = fingerprint.PrefixHashes(a), fingerprint.PrefixHashes(b)
    assert x.common_extension(0, y, 0) == 200 and x.common_extension(200, y, 201) == 300
    for _ in range(300):
        i, j, n = rng.randrange(500), rng.randrange(501), rng.randrange(6)
        assert x.equal(i, y, j, n) == (i + n <= 500 and j + n <= 501 and a[i : i + n] == b[j : j + n])


def plain_kept(text):
    """(places, levels, lowest level) by plain numbers."""
    n, most = len(text), min(256, max(64, len(text) // 16))

    def level(i):
        h = 0
        for k, c in enumerate(text[i : i + 4]):
            h += (ord(c) + 1) * pow(1_103_515_245, k, 2**31 - 1)
        h %= 2**31 - 1
        for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B), (16, 1)):
            h = (h ^ (h >> shift)) * factor % 2**32
        return sum(int(2.0 ** (32 - k / 4)) > h for k in range(128)) - 1

    levels = {i: level(i) for i in range(1, n)}
    low = next(x for x in range(130) if sum(v >= x for v in levels.values()) <= most)
    kept = [i for i in levels if levels[i] >= low]
    if low == 0 or 8 * len(kept) >= most:
        return kept, [levels[i] for i in kept], low
    step = 1
    while step * most < n:
        step *= 2
    kept = list(range(step, n, step))
    return kept, [160 + (i & -i).bit_length() - 1 for i in kept], 160 + step.bit_length() - 1


def plain_fingerprint(text):
    kept, levels, low = plain_kept(text)
    p, out = 2**31 - 1, []
    for i, v in zip([0, *kept, len(text)], [low, *levels, 255], strict=True):
        sums = [sum((ord(c) + 1) * pow(b, k, p) for k, c in enumerate(text[:i])) % p for b in (1_103_515_245, 69_069_133)]
        out.append(f"{i:08x}{v:02x}{sums[0]:08x}{sums[1]:08x}")
    return "".join(out) if text else out[0]


def plain_likeness(a, b):
    """Greedy common runs of the texts' own pieces."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    (x, u, low), (y, v, other) = plain_kept(a), plain_kept(b)
    if (low >= 160) == (other >= 160):
        x = [i for i, k in zip(x, u, strict=True) if k >= max(low, other)]
        y = [i for i, k in zip(y, v, strict=True) if k >= max(low, other)]
    x, y = ([t[i:j] for i, j in zip([0, *c], [*c, len(t)], strict=True)] for t, c in ((a, x), (b, y)))
    used, i, matched = [False] * len(y), 0, 0
    while i < len(x):
        j = next((j for j, piece in enumerate(y) if piece == x[i] and not used[j]), None)
        if j is None:
            i += 1
            continue
        low, high = 0, min(len(x) - i, len(y) - j)
        while low < high:
            m = (low + high + 1) // 2
            low, high = (m, high) if "".join(x[i : i + m]) == "".join(y[j : j + m]) else (low, m - 1)
        m = next((k for k in range(low) if used[j + k]), low)
        while "".join(x[i : i + m]) != "".join(y[j : j + m]):
            m -= 1
        used[j : j + m] = [True] * m
        matched, i = matched + len("".join(x[i : i + m])), i + m
    return 2 * matched / (len(a) + len(b))


def test_fingerprints_match_a_plain_pass(spark):
    rng = random.Random(8)
    texts = [t if t is None else t[:3000] for t in ODD] + [" ".join(rng.choice("ab cd ef".split()) for _ in range(rng.randrange(60))) for _ in range(120)]
    texts += ["😀" * 70, "ab" * 300, texts[-1] + " more", "".join(chr(rng.randrange(97, 110)) for _ in range(1500))]
    rows = list(zip(rng.sample(range(10**6), len(texts)), texts))
    got = {r.doc_id: r for r in fingerprint.fingerprints(frame(spark, rows).repartition(7)).collect()}
    order = sorted(rows, reverse=True)
    assert len(got) == len(rows)
    for (i, t), (_, u) in zip(order, order[1:] + order[:1], strict=True):
        t, u = t or "", u or ""
        k = len(t) // 2
        e = t[: len(t) - k] + u[:k]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (plain_fingerprint(t), plain_fingerprint(e))
        assert (r.near_edited, r.near_next) == pytest.approx((plain_likeness(t, e), plain_likeness(t, u)))
        assert 0 <= r.near_next <= 1


def test_fingerprints_of_many_copies(spark):
    """Copies of one row over all ranges: each is followed by another, the last by the next document."""
    rows = [(5, "copy of it")] * 300 + [(None, "no id")] * 200 + [(i, f"text {i}") for i in range(6, 30)] + [(1, "last one")]
    got = fingerprint.fingerprints(frame(spark, rows).repartition(5)).collect()
    assert len(got) == len(rows)
    follower = [hashlib.sha256(fingerprint.edited("copy of it", x).encode()).hexdigest() for x in ("copy of it", "last one")]
    assert sorted(r.edited_sha256 for r in got if r.doc_id == 5) == sorted([follower[0]] * 299 + [follower[1]])
    assert [r.edited_sha256 for r in got if r.doc_id == 1] == [hashlib.sha256(fingerprint.edited("last one", "no id").encode()).hexdigest()]
    follower = [hashlib.sha256(fingerprint.edited("no id", x).encode()).hexdigest() for x in ("no id", "text 29")]
    assert sorted(r.edited_sha256 for r in got if r.doc_id is None) == sorted([follower[0]] * 199 + [follower[1]])


def test_fingerprints_null_and_repeated_ids(spark):
    got = fingerprint.fingerprints(frame(spark, [(None, "abcd"), (3, "wxyz"), (3, "wxyz"), (None, None)])).collect()
    assert sorted((r.doc_id is None, r.n_chars) for r in got) == [(False, 4), (False, 4), (True, 0), (True, 4)]
    assert len({r.fingerprint for r in got if r.doc_id == 3}) == 1
    lone = fingerprint.fingerprints(frame(spark, [(1, "abcdef")])).collect()[0]
    assert lone.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and lone.near_next == 1.0
    assert fingerprint.fingerprints(frame(spark, [])).count() == 0


# ------------------------------------------------------------ language ID
TINY = [bytes([b]) for b in range(256)] + [b"\x00ab", b"ab", b"ba", b"aba", b"\x00a", "é".encode()]


def test_forward_sums_all_segmentations():
    rng = np.random.default_rng(1)
    vocabulary = sorted(set(TINY))
    p = rng.random((len(vocabulary), 2))
    p /= p.sum(axis=0)
    index = {v: i for i, v in enumerate(vocabulary)}

    def mass(data):
        if not data:
            return np.ones(2)
        return sum(p[index[data[:n]]] * mass(data[n:]) for n in range(1, len(data) + 1) if data[:n] in index)

    raw, offsets = flat_utf8(pa.array(["ababa aéb b"]))
    starts, ends, _, first = language_id._units(raw, offsets)
    got = language_id.unit_scores(raw, starts, ends, first, language_id._Trie(vocabulary), p)
    want = [np.log(mass(b"\x00" + w)) for w in "ababa aéb b".encode().split()]
    assert np.allclose(got, want)


def test_long_words_are_scored_whole():
    """Words beyond a unit, by plain log sums over all places."""
    rng = np.random.default_rng(2)
    vocabulary = sorted(set(TINY))
    p = rng.random((len(vocabulary), 3)) ** 4
    p /= p.sum(axis=0)
    index = {v: i for i, v in enumerate(vocabulary)}

    def log_mass(data):
        m = [np.zeros(3)]
        for e in range(1, len(data) + 1):
            steps = [m[e - n] + np.log(p[index[data[e - n : e]]]) for n in range(1, min(e, 4) + 1) if data[e - n : e] in index]
            m.append(np.logaddexp.reduce(steps, axis=0))
        return m[-1]

    words = ["ab" * 20, "ab" * 24, "ab" * 25, "aba" * 400, "é" * 900 + "ab", "a" * 49, "b" * 1000, "日本" * 200]
    raw, offsets = flat_utf8(pa.array([" ".join(words), "", words[3]]))
    starts, ends, rows = word_spans(raw, offsets, BLANKS)
    assert rows.tolist() == [0] * len(words) + [2]
    got = language_id.word_scores(raw, starts, ends, language_id._Trie(vocabulary), p)
    assert np.allclose(got, [log_mass(b"\x00" + w.encode()) for w in [*words, words[3]]])
    starts, ends, _, first = language_id._units(raw, offsets)  # to fit: parts of whole characters, nothing lost
    assert b"".join(raw[a:b].tobytes() for a, b in zip(starts, ends, strict=True)).decode() == "".join([*words, words[3]])
    assert first.sum() == len(words) + 1 and (ends - starts).max() <= language_id.UNIT + 3
    for a, b in zip(starts, ends, strict=True):
        raw[a:b].tobytes().decode()


def test_trie_steps():
    vocabulary = language_id.read_vocabulary(queries.PIECE_FILE)
    trie = language_id._Trie(vocabulary)
    for i in range(0, len(vocabulary), 97):
        node = np.array([1])
        for b in vocabulary[i]:
            node = trie.step(node, np.array([b], np.uint8))
        assert trie.piece[node[0]] == i
    assert trie.step(np.array([1]), np.array([65], np.uint8))[0] and not trie.step(np.array([0]), np.array([65], np.uint8))[0]
    inner = set(vocabulary)
    for word in (b"\xff\xff", b"zqzqzq", b"\x00the", b"tion"):
        node = np.array([1])
        for b in word:
            node = trie.step(node, np.array([b], np.uint8))
        assert (trie.piece[node[0]] >= 0) == (word in inner)


def test_language_prediction(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = queries.language_model(docs)
    found = language_id.with_language(docs, model).select("lang", "lang_pred", "score", queries.held_out(5, 0).alias("h")).collect()
    held = [r for r in found if r.h]
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.95 and all(0 <= r.score <= 1 for r in found)
    odd = language_id.with_language(frame(spark, list(enumerate(ODD + ["123 ..."]))), model)
    got = {r.doc_id: r.lang_pred for r in odd.collect()}
    assert [got[i] == "und" for i in range(8)] == [True, True, True, False, False, False, False, True]
    assert language_id.with_language(frame(spark, []), model).count() == 0
    none = language_id.train(docs.where("false"), language_id.read_vocabulary(queries.PIECE_FILE))
    assert {tuple(r) for r in language_id.with_language(docs, none).select("lang_pred", "score").collect()} == {("und", 0.0)}


# ------------------------------------------------------------ classifiers
def test_toxicity_learns_words():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    texts, labels = [], []
    for i in range(1500):
        t = [rng.choice(words) for _ in range(rng.randrange(5, 80))]
        y = i % 3 == 0
        if y:
            t.insert(rng.randrange(len(t)), rng.choice(["vile", "nasty"]))
        texts.append(" ".join(t))
        labels.append(int(y))
    model = toxicity.fit(texts[:1000], labels[:1000], ["en"] * 1000)
    s = toxicity._Scorer(model).scores(pa.array(texts[1000:]))
    assert ((s >= 0.5) == np.array(labels[1000:])).mean() > 0.97
    odd = toxicity._Scorer(model).scores(pa.array(ODD))
    assert ((odd >= 0) & (odd <= 1)).all() and odd[0] == odd[1] == odd[2]
    for labels, most in (([], 0.02), ([0, 0], 0.02), ([1, 1], 1.0)):
        one = toxicity._Scorer(toxicity.fit(["a b"] * len(labels), labels, [None] * len(labels)))
        assert (one.scores(pa.array(["a", None])) <= most).all()


def test_quality_trees_and_statistics():
    rng = random.Random(6)
    good = [" ".join(rng.choice(["one", "two", "three", "four,"]) for _ in range(rng.randrange(20, 90))) for _ in range(300)]
    bad = [" | ".join(rng.choice(["a%%", "b##", "c"]) for _ in range(rng.randrange(20, 90))) for _ in range(300)]
    x = quality.statistics(pa.array(good + bad))
    y = [1] * 300 + [0] * 300
    model = quality.fit(x[::2], y[::2])
    assert ((model.scores(x[1::2]) >= 0.5) == np.array(y[1::2])).all()
    odd = quality.statistics(pa.array(ODD))
    assert odd.shape == (len(ODD), len(quality.STATISTICS)) and np.isfinite(odd).all() and (odd[0] == odd[1]).all()
    # statistics do not depend on what else is in a batch
    assert np.allclose(odd, np.concatenate([quality.statistics(pa.array([t], pa.string())) for t in ODD]))
    assert quality.fit(x[:0], []).scores(odd).tolist() == [0.5] * len(ODD)
    assert (quality.fit(x[:3], [1, 1, 1]).scores(odd) > 0.98).all()


@pytest.mark.parametrize("name,label", [("op2_toxicity", "toxic"), ("op6_quality", "quality")])
def test_held_out_accuracy(spark, name, label):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES[name](spark, sf)
    known = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert got.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert np.mean([r.predicted == r[label] for r in known]) > 0.9
    assert all((r.score >= 0.5) == bool(r.predicted) and 0 <= r.score <= 1 for r in known)
