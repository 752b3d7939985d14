"""Importance resampling towards a target distribution (operator 13).

Every text is a bag of hashed features: runs of consecutive words, each in
the bucket of its CRC-32. A bucket's gain compares how common it is in the
target table and in the raw one. A document's weight is the mean gain of its
features, its score the weight plus seeded Gumbel noise, so that the highest
scores are a sample without replacement by weight.

The gains are an array that scores whole batches. The drawn rows are found by
bisecting numeric thresholds: exact count jobs over the written scores close
in on the cutoff, then on the ids tied there. Only the drawn rows are sorted,
by range, and their ranks are a partition's offset plus the place in it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Scratch
from .bytesops import LOWER, NOT_ALNUM, flat_utf8, pieces, word_spans

BUCKETS = 10_000
MAX_ORDER = 1
LEAST_WORDS = 20
PERCENT = 10
SEED = 2024

_PROBES = 15  # thresholds counted by one job
_PIECE = 1 << 20  # bytes of text handled at a time
_LONG_WORD = 64  # bytes; longer words are hashed one by one


def _crc_table() -> np.ndarray:
    """The byte table of the reflected CRC-32 polynomial."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1)
    return c


_CRC = _crc_table()


def crc32_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
    """CRC-32 of each word's bytes, A-Z lower-cased, continuing from ``before``."""
    sizes = ends - starts
    state = np.zeros(len(starts), np.uint32) if before is None else before.copy()
    order = np.argsort(-np.minimum(sizes, _LONG_WORD + 1), kind="stable")
    n_long = int(np.count_nonzero(sizes > _LONG_WORD))
    for i in order[:n_long]:
        state[i] = zlib.crc32(LOWER[raw[starts[i] : ends[i]]].tobytes(), int(state[i]))
    order = order[n_long:]
    c = ~state[order]
    first, size = starts[order], sizes[order]
    more = len(order) - np.cumsum(np.bincount(size, minlength=1))  # words longer than k bytes
    for k in range(int(size[0]) if len(size) else 0):
        m = int(more[k])
        c[:m] = _CRC[(c[:m] ^ LOWER[raw[first[:m] + k]]) & 0xFF] ^ (c[:m] >> np.uint32(8))
    state[order] = ~c
    return state


def _blocks(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first row, past the last row, start byte, end byte) of bounded blocks:
    whole rows, or parts of one long row that end at a separator."""
    for lo, hi in pieces(offsets, _PIECE):
        start, end = int(offsets[lo]), int(offsets[hi])
        while hi == lo + 1 and end - start > _PIECE:
            cut, step = start + _PIECE, _PIECE
            while cut < end:
                gap = np.flatnonzero(NOT_ALNUM[raw[cut : cut + step]])
                if len(gap):
                    cut += int(gap[0])
                    break
                cut += step
            if cut >= end:
                break
            yield lo, hi, start, cut
            start = cut
        yield lo, hi, start, end


def features(column: pa.Array, max_order: int, n_buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of words, rows of features, buckets of features) of a text column,
    in blocks of bounded size. A long row comes in several blocks; runs of
    words that reach from one into the next belong to the later one."""
    raw, offsets = flat_utf8(column)
    none = np.zeros(0, np.int64)
    carried = (-1, none, none)  # the last words of a long row's earlier block
    for lo, hi, start, end in _blocks(raw, offsets):
        inner = offsets[lo : hi + 1].copy()
        inner[0], inner[-1] = start, end
        starts, ends, rows = word_spans(raw, inner, NOT_ALNUM)
        rows = rows + lo
        held = len(carried[1]) if carried[0] == lo else 0
        if held:
            starts, ends = np.concatenate((carried[1], starts)), np.concatenate((carried[2], ends))
            rows = np.concatenate((np.full(held, lo), rows))
        run = crc32_words(raw, starts, ends)
        found_rows, found = [rows[held:]], [run[held:]]
        for order in range(2, max_order + 1):
            run = ~run[: max(len(starts) - order + 1, 0)]
            run = ~(_CRC[(run ^ np.uint32(0x20)) & 0xFF] ^ (run >> np.uint32(8)))  # one space
            run = crc32_words(raw, starts[order - 1 :], ends[order - 1 :], run)
            last = np.arange(order - 1, len(starts))
            new = (rows[order - 1 :] == rows[: len(last)]) & (last >= held)
            found_rows.append(rows[order - 1 :][new])
            found.append(run[new])
        keep = min(max_order - 1, len(starts)) if end < offsets[hi] else 0
        carried = (lo, starts[len(starts) - keep :], ends[len(ends) - keep :]) if keep else (-1, none, none)
        yield rows[held:], np.concatenate(found_rows), np.concatenate(found) % np.uint32(n_buckets)


def bucket_counts(texts: DataFrame, max_order: int, n_buckets: int) -> np.ndarray:
    """How many features of the one text column fall in each bucket. A task
    counts into one array; at most ``n_buckets`` rows reach the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for _, _, found in features(batch.column(0), max_order, n_buckets):
                total += np.bincount(found, minlength=n_buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["bucket", "n"])

    counts = np.zeros(n_buckets)
    for bucket, n in texts.mapInArrow(count, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n")).collect():
        counts[bucket] = n
    return counts


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """A bucket's gain in thousandths: the log ratio of its smoothed shares."""
    n = len(raw)
    ratio = ((target + 1) * (raw.sum() + n)) / ((raw + 1) * (target.sum() + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def with_weights(docs: DataFrame, gains: np.ndarray, id_col: str, text_col: str, max_order: int) -> DataFrame:
    """(id, n_words, n_features, weight) of every row."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for word_rows, rows, found in features(batch.column(1), max_order, len(gains)):
                words += np.bincount(word_rows, minlength=batch.num_rows)
                if len(rows):
                    n += np.bincount(rows, minlength=batch.num_rows)
                    # float sums of whole numbers below 2^53 are exact
                    total += np.bincount(rows, weights=gains[found], minlength=batch.num_rows).astype(np.int64)
            weight = np.floor_divide(total, np.maximum(n, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(x, pa.int64()) for x in (words, n, weight))], names=["id", "n_words", "n_features", "weight"]
            )

    return docs.select(id_col, text_col).mapInArrow(weigh, f"id {id_type}, n_words bigint, n_features bigint, weight bigint")


def threshold(rows: DataFrame, key: str, wanted: int) -> tuple[int, int, int]:
    """(v, below, upto): v is the smallest value of the bigint ``key`` that
    ``wanted`` rows (1 or more, and not more than there are) reach, below the
    rows under v, upto those up to v.

    Each job counts exactly at 15 thresholds, a sixteenth of the interval
    apart, and leaves one of the sixteenths: 16 jobs for any 64-bit values."""
    low, high, upto = rows.agg(F.min(key), F.max(key), F.count("*")).first()
    below = 0
    while low < high:
        step = -(-(high - low + 1) // (_PROBES + 1))
        probes = [p for k in range(1, _PROBES + 1) if (p := low + k * step - 1) < high]
        counts = rows.agg(*[F.sum((F.col(key) <= F.lit(p)).cast("bigint")) for p in probes]).first()
        for probe, n in zip(probes, counts, strict=True):
            if n >= wanted:
                high, upto = probe, n
                break
            low, below = probe + 1, n
    return low, below, upto


def smallest_rows(rows: DataFrame, keys: list[str], wanted: int) -> Column:
    """A condition that holds for the ``wanted`` first rows in the order of
    the bigint ``keys``, the last of them unique. Thresholds are found key by
    key among the rows that are tied so far."""
    taken, tied = F.lit(False), F.lit(True)
    for key in keys:
        if wanted <= 0:
            return taken
        value, below, upto = threshold(rows.where(tied), key, wanted)
        taken = taken | (tied & (F.col(key) < F.lit(value)))
        tied = tied & (F.col(key) == F.lit(value))
        wanted -= below
        if upto - below == wanted:
            return taken | tied
    return taken | tied


def with_ranks(rows: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """``rows`` with their number, from 1, in the order of ``keys``. Ranges are
    sorted apart; a row's rank is its range's offset plus its place in it. The
    offsets have one row a range."""
    dealt = scratch.cut(
        rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()), "drawn"
    )
    part = F.shiftright("_at", 33)
    sizes = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    ranked = dealt.join(F.broadcast(offsets), part == F.col("_part"))
    return ranked.withColumn("rank", F.col("_before") + place + 1).drop("_at", "_part", "_before")


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    max_order: int = MAX_ORDER,
    n_buckets: int = BUCKETS,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """One row per row of ``docs``: id, n_features, weight, score, rank.

    ``percent`` of the rows with ``least_words`` words or more are drawn,
    rounded down: those of highest score, ties to the smaller id, then to
    fewer features; rows equal in all are interchangeable. ``rank`` numbers
    the drawn rows from 1 and is null for the others. A null or empty text has
    no feature, weight 0 and is never drawn. The id is a bigint; a null id is
    seeded as an empty text and comes last among ties. Repeated rows are
    weighed, scored and drawn each by itself. An empty target leaves all gains to
    how common a bucket is in ``docs``. Other columns are ignored; an empty
    table gives an empty result. Long texts are read whole, in blocks."""
    scratch = Scratch(docs.sparkSession, "resample")
    gains = bucket_gains(
        bucket_counts(docs.select(text_col), max_order, n_buckets), bucket_counts(target.select(target_text_col), max_order, n_buckets)
    )
    seeded = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(seeded.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = with_weights(docs, gains, id_col, text_col, max_order).withColumn("score", F.col("weight") + noise)
    scored = scratch.cut(
        scored.withColumns(
            {
                "_down": -F.col("score"),
                "_no_id": F.col("id").isNull().cast("bigint"),
                "_id": F.coalesce(F.col("id").cast("bigint"), F.lit(0)),
                "_row": F.monotonically_increasing_id(),
            }
        ),
        "scored",
    )
    keys = ["_down", "_no_id", "_id", "n_features", "_row"]
    eligible = scored.where(F.col("n_words") >= least_words)
    drawn = smallest_rows(eligible, keys, eligible.count() * percent // 100)
    drawn = (F.col("n_words") >= least_words) & drawn
    ranked = with_ranks(scored.where(drawn), keys, scratch)
    out = ranked.unionByName(scored.where(~drawn).withColumn("rank", F.lit(None).cast("bigint")))
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
