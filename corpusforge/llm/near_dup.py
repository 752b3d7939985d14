"""MinHash near-duplicates with tensored banding (operator 10).

A document's set holds its distinct five-word shingles. Instead of L tables
of K hashes each, a small collection of ``N_HASHES`` minhashes is computed
and every *pair* of them forms a table key: 16 minhashes give 120 tables, so
the minhash work is about the square root of what separate tables cost. Two
documents of similarity 0.75 share a table key unless 15 or more of 16
minhashes differ (chance 1.1e-8).

Candidates come from the tables in two rounds; every link is confirmed on
the full sets.

1. Each table key's documents are compared with the key's most central
   document (a star, linear in the key's size), and components are formed.
2. A key that still holds several components is not resolved. Small keys
   compare all their pairs across components. The documents of large keys
   go to an exact prefix join: with shingles ordered rarest first, two sets
   of similarity s share one of their first n - ceil(s n) + 1 shingles, and
   the position where they meet bounds the overlap. No key is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .bytesops import BLANKS, flat_utf8, forget, mix64, pieces, row_slices, word_hashes, word_spans
from .components import components

SHINGLE_WORDS = 5
SIMILAR_PERCENT = 75
N_HASHES = 16
SMALL_KEY = 32  # a larger unresolved key goes to the prefix join
MOST_BROADCAST = 2_000_000  # row keys (16 MB); more are joined by a shuffle

_seeds = np.random.default_rng(20240607).integers(1, 2**63, size=2 * N_HASHES, dtype=np.uint64)
_MULTIPLY, _ADD = _seeds[:N_HASHES] | np.uint64(1), _seeds[N_HASHES:]
_CHAIN = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each row of a text column."""
    raw, offsets = flat_utf8(column)
    for lo, hi in pieces(offsets):
        starts, ends, rows = word_spans(raw, offsets[lo : hi + 1], BLANKS)
        words = word_hashes(raw, starts, ends)
        own = row_slices(rows, hi - lo)
        for first, last in zip(own[:-1], own[1:], strict=True):
            w = words[first:last]
            n = max(len(w) - SHINGLE_WORDS + 1, min(len(w), 1))
            h = np.full(n, np.uint64(min(len(w), SHINGLE_WORDS)))
            for k in range(min(len(w), SHINGLE_WORDS)):
                h = h * _CHAIN + w[k : k + n]
            yield np.unique(mix64(h))


def _identity(shingles: np.ndarray) -> bytes | None:
    """16 bytes that stand for a whole set; None for the empty one."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest() if len(shingles) else None


def _signature(shingles: np.ndarray) -> np.ndarray:
    low = np.full(N_HASHES, np.uint64(2**64 - 1))
    for lo in range(0, len(shingles), 4096):
        part = shingles[None, lo : lo + 4096] * _MULTIPLY[:, None] + _ADD[:, None]
        low = np.minimum(low, mix64(part).min(axis=1))
    return low


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()
    for batch in batches:
        nodes, sizes, signatures = [], [], []
        for shingles in shingle_sets(batch.column(1)):
            nodes.append(_identity(shingles))
            sizes.append(len(shingles))
            signatures.append(_signature(shingles).view(np.int64) if len(shingles) else np.zeros(N_HASHES, np.int64))
        flat = pa.array(np.concatenate(signatures) if signatures else np.zeros(0, np.int64), pa.int64())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(nodes) + 1) * N_HASHES, pa.int32()), flat)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(nodes, pa.binary()), pa.array(sizes, pa.int64()), lists, batch.column(2), batch.column(3)],
            names=["id", "node", "n", "sig", "key", "hash"],
        )


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets, each once in a task, in batches of bounded size: a set is about as
    large as its text."""
    schema = pa.schema([("node", pa.binary()), ("shingles", pa.list_(pa.int64()))])
    given = set()
    for batch in batches:
        nodes, sets, held = [], [], 0
        for shingles in shingle_sets(batch.column(0)):
            node = _identity(shingles)
            if node in given:
                continue
            given.add(node)
            nodes.append(node)
            sets.append(shingles.view(np.int64))
            held += len(shingles)
            if held > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], schema=schema)
                nodes, sets, held = [], [], 0
        if nodes:
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], schema=schema)


def _size_ratio_fits(n: str, m: str):
    """Sets of these sizes can reach the similarity."""
    return F.expr(f"100 * least({n}, {m}) >= {SIMILAR_PERCENT} * greatest({n}, {m})")


def _table_keys(nodes: DataFrame) -> DataFrame:
    """(key, node, n, rank) for every tensored table key that could be shared.

    A minhash value that only one set has can't be part of a shared key, so
    values are counted first and keys are formed of shared values only.
    ``rank`` orders a key's sets by how common their minhashes are: near
    copies of one text meet around the text with the commonest values."""
    values = nodes.select("node", "n", F.posexplode("sig").alias("i", "h"))
    shared = values.groupBy("i", "h").agg(F.count("*").alias("times")).where("times > 1")
    held = (
        values.join(shared, ["i", "h"])
        .groupBy("node", "n")
        .agg(F.sort_array(F.collect_list(F.struct("i", "h"))).alias("v"), F.sum(F.log2("times")).alias("common"))
        .where("size(v) > 1")
    )
    pairs = F.expr(
        "flatten(transform(v, (x, k) -> transform(slice(v, k + 2, size(v)), y -> xxhash64(x.i, x.h, y.i, y.h))))"
    )
    rank = F.expr("shiftleft(cast(common * 64 as bigint), 46) | (xxhash64(node) & 70368744177663)")
    return held.select("node", "n", rank.alias("rank"), F.explode(pairs).alias("key"))


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of candidate pairs (a, b), those whose full sets are similar."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("s")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("t")), "b"
    )
    both = both.withColumn("common", F.size(F.array_intersect("s", "t")))
    return both.where(f"100 * common >= {SIMILAR_PERCENT} * (size(s) + size(t) - common)").select("a", "b")


def _prefix_pairs(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Candidate pairs across components among ``members(node, label)``, exactly:
    no pair that reaches the similarity is missing."""
    tokens = sets.join(members, "node").select("node", "label", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    counts = tokens.groupBy("s").agg(F.count("*").alias("df"))
    # what a set shares with any other is at most its shingles of df > 1
    shareable = tokens.join(counts.where("df > 1"), "s")
    worth = (
        shareable.groupBy("node").agg(F.count("*").alias("c"), F.first("n").alias("m"))
        .where(f"100 * c >= {SIMILAR_PERCENT} * m")
        .select("node", (F.col("m") - F.col("c")).alias("own"))
    )
    from pyspark.sql import Window

    place = Window.partitionBy("node").orderBy("df", "s")
    prefix = (
        shareable.join(worth, "node")
        .withColumn("pos", F.row_number().over(place) + F.col("own"))  # shingles of df 1 come first
        .where(f"pos <= n - ceil({SIMILAR_PERCENT} * n / 100D) + 1")
        .select("s", "node", "label", "n", "pos")
    )
    x, y = prefix.alias("x"), prefix.alias("y")
    met = x.join(
        y,
        (F.col("x.s") == F.col("y.s"))
        & (F.col("x.node") < F.col("y.node"))
        & (F.col("x.label") != F.col("y.label"))
        & _size_ratio_fits("x.n", "y.n")
        # overlap is at most 1 + what follows, and must be s / (1 + s) of the sum
        & F.expr(
            f"{100 + SIMILAR_PERCENT} * (1 + least(x.n - x.pos, y.n - y.pos)) >= {SIMILAR_PERCENT} * (x.n + y.n)"
        ),
    )
    return met.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def _sets_of(wanted: DataFrame, texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, shingles) of the wanted nodes, one row each (and of others that
    repeat a wanted id). A node's text is found by its smallest id, or, where no
    row of it has an id, by the smallest hash of its texts. Copies of it are
    folded in each task, and over all tasks where any are left."""
    by_id = texts.where("id is not null").join(wanted.select(F.col("first_id").alias("id")).distinct(), "id").select("text")
    none = wanted.where("first_id is null").select(F.col("least_hash").alias("hash")).distinct()
    by_text = texts.where("id is null").join(none, "hash").select("text")
    sets = by_id.union(by_text).mapInArrow(_full_sets, "node binary, shingles array<bigint>")
    sets = scratch.cut(sets.where("node is not null"), "sets")
    if sets.groupBy("node").count().where("count > 1").limit(1).count():
        once = scratch.cut(sets.groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")
        scratch.delete(sets)
        return once
    return sets


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each near-duplicate component of ``docs``, of the smallest id
    (null ids come last); of rows that share it, one. Rows without words stay.
    Columns unchanged.

    Rows are known by a key that is written with them. Of a component with
    repeated rows of the kept id, a hash aggregate finds the smallest key, so
    copies of any number cost no sort."""
    scratch = Scratch(docs.sparkSession, "dropnear")
    keyed = scratch.cut(docs.withColumn("_near_key", F.monotonically_increasing_id()), "keyed")
    found = near_duplicates(keyed, id_col, text_col, key_col="_near_key").where("component is not null")
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("_near_key").alias("key")))
    winners = found.groupBy("component").agg(first.alias("first")).select(F.col("first.key").alias("key"))
    gone = found.select("_near_key").join(winners, F.col("_near_key") == F.col("key"), "left_anti")
    gone = scratch.cut(gone, "gone")
    if gone.count() <= MOST_BROADCAST:  # so that no text moves
        gone = F.broadcast(gone)
    return keyed.join(gone, "_near_key", "left_anti").select(*docs.columns)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id, kept.

    Words are `[^\\x20\\x09-\\x0D]+`, with A-Z lower-cased; a text of fewer than
    five words has its whole word sequence as its one shingle. Null and empty
    texts, or texts without words, have an empty set: n_shingles 0, linked
    with nothing, kept. ``component_id`` is the smallest id reachable over
    links of similarity 0.75 or more. Equal sets are one node, so repeated
    rows and groups of copies of any size cost one set. A null id takes part
    by its text and never names a component (component_id is null where no
    id is known; such rows are kept). Other columns are ignored.

    ``key_col`` names a unique bigint column that comes along, with
    ``component``: equal on rows of one component, whatever their ids, and null
    where the set is empty."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "neardup")
    id_type = docs.schema[id_col].dataType.simpleString()
    key = F.lit(0).cast("bigint") if key_col is None else F.col(key_col)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), key.alias("key"), F.xxhash64(text_col).alias("hash"))
    rows = texts.mapInArrow(_summaries, f"id {id_type}, node binary, n bigint, sig array<bigint>, key bigint, hash bigint")
    rows = scratch.cut(rows, "rows")
    known = rows.where("node is not null").groupBy("node", "n", "sig")
    nodes = scratch.cut(known.agg(F.min("id").alias("first_id"), F.min("hash").alias("least_hash")), "nodes")

    keyed = scratch.cut(_table_keys(nodes), "keyed")
    tops = keyed.groupBy("key").agg(F.count("*").alias("held"), F.max("rank").alias("top")).where("held > 1")
    members = scratch.cut(keyed.join(tops, "key"), "members")
    scratch.delete(keyed)

    sets = _sets_of(members.select("node").distinct().join(nodes, "node"), texts, scratch)

    stars = members.where("rank = top").select("key", F.col("node").alias("a"), F.col("n").alias("m"))
    stars = members.where("rank <> top").join(stars, "key").where(_size_ratio_fits("n", "m"))
    stars = stars.select("a", F.col("node").alias("b")).distinct()
    links = scratch.cut(_confirmed(stars, sets), "links")
    labels = components(links, scratch)

    labelled = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = scratch.cut(labelled.withColumn("lab", F.xxhash64("label")), "labelled")
    scratch.delete(members)
    open_keys = labelled.groupBy("key").agg(F.min("lab").alias("x"), F.max("lab").alias("y")).where("x <> y").select("key")
    left = scratch.cut(labelled.join(open_keys, "key").drop("lab", "rank", "top"), "open")
    scratch.delete(labelled)
    small = left.where(f"held <= {SMALL_KEY}").select("key", "node", "label", "n")
    small = (
        small.alias("x")
        .join(small.alias("y"), "key")
        .where((F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label")) & _size_ratio_fits("x.n", "y.n"))
        .select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    )
    large = left.where(f"held > {SMALL_KEY}").select("node", "label").distinct()
    large = scratch.cut(_prefix_pairs(large, sets), "prefix")
    more = _confirmed(small.union(large).distinct(), sets)
    # links between the components so far: few, so that passes are short
    first = labels.select("node", "label")
    more = more.join(first.toDF("a", "x"), "a", "left").join(first.toDF("b", "y"), "b", "left")
    more = scratch.cut(more.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")).distinct(), "links")
    scratch.delete(left, large, sets)
    joined = components(more, scratch).toDF("old", "joined")
    named = nodes.join(first, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = named.join(joined, F.col("label") == F.col("old"), "left").withColumn("label", F.coalesce("joined", "label"))
    smallest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = named.select("node", "label").join(smallest, "label").select("node", "component_id", F.col("label").alias("component"))
    out = rows.select("id", "node", "n", "key").join(named, "node", "left")
    out = out.withColumn("component_id", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")))
    out = scratch.cut(
        out.select(
            F.col("id").alias(id_col),
            F.col("n").alias("n_shingles"),
            "component_id",
            F.coalesce(F.col("id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"),
            *([] if key_col is None else [F.col("key").alias(key_col), "component"]),
        ),
        "result",
    )
    scratch.drop(keep=[out])
    return out
