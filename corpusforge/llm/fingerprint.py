"""Document fingerprints from prefix polynomial hashes (operator 5).

A text's code points c0, c1, ... give prefix sums of (c+1) * B^i modulo the
prime 2^31 - 1, for two bases. The difference of two prefix values, divided by
a power of B, is the hash of a span wherever it stands: any two spans compare
in constant time, and the longest common extension of two places is found
by binary search.

A fingerprint keeps the prefix values at a bounded number of places: the
start, the end, and cuts that the text itself chooses (where the hash of the
next code points is small enough), so that a moved passage is cut alike. Spans between kept places of two fingerprints can still be compared and
extended; likeness is the share of both texts that lies in common spans.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch

#: Cuts of a text of n code points: one in 16, between these.
LEAST_CUTS, MOST_CUTS, CUT_EVERY = 64, 256, 16
WINDOW = 4  # code points that choose a cut


def cuts_kept(n: int) -> int:
    return min(MOST_CUTS, max(LEAST_CUTS, n // CUT_EVERY))


_P = np.uint64((1 << 31) - 1)
_BITS = np.uint64(31)
_BASES = (1_103_515_245, 69_069_133)


def _reduced(x: np.ndarray) -> np.ndarray:
    """x modulo 2^31 - 1, for x below 2^62 or so: fold the high bits twice."""
    x = (x & _P) + (x >> _BITS)
    x = (x & _P) + (x >> _BITS)
    return np.where(x >= _P, x - _P, x)


class _Powers:
    """Powers of the bases and of their inverses, grown on demand by doubling."""

    def __init__(self):
        self.up = [np.ones(1, np.uint64) for _ in _BASES]
        self.down = [np.ones(1, np.uint64) for _ in _BASES]

    def need(self, n: int) -> None:
        for table, bases in ((self.up, _BASES), (self.down, [pow(b, -1, int(_P)) for b in _BASES])):
            for k, base in enumerate(bases):
                while len(table[k]) < n:
                    step = np.uint64(pow(base, len(table[k]), int(_P)))
                    table[k] = np.concatenate((table[k], _reduced(table[k] * step)))


_POWERS = _Powers()


class PrefixHashes:
    """Prefix arrays of one text."""

    def __init__(self, text: str):
        self.codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32).astype(np.uint64)
        self._add_up(0, [np.zeros(1, np.uint64)] * len(_BASES))

    def edited(self, following: PrefixHashes) -> PrefixHashes:
        """The arrays of the edited text: those of what it keeps, added up further."""
        keep = self.n - self.n // 2
        out = PrefixHashes.__new__(PrefixHashes)
        out.codes = np.concatenate((self.codes[:keep], following.codes[: self.n // 2]))
        out._add_up(keep, [s[: keep + 1] for s in self.sums])
        return out

    def _add_up(self, start: int, known: list[np.ndarray]) -> None:
        self.n = len(self.codes)
        _POWERS.need(self.n + 1)
        self.sums = []
        for up, before in zip(_POWERS.up, known, strict=True):
            # up to 2^32 terms below 2^31 add up without overflow
            more = np.cumsum(_reduced((self.codes[start:] + np.uint64(1)) * up[start : self.n]))
            self.sums.append(np.concatenate((before, _reduced(more + before[-1]))))

    def spans(self, starts: np.ndarray, length: int, base: int = 0) -> np.ndarray:
        """The hash of each span of that length, wherever it starts."""
        s = self.sums[base]
        return _reduced(_reduced(s[starts + length] + _P - s[starts]) * _POWERS.down[base][starts])

    def span(self, start: int, length: int) -> tuple[int, int]:
        at = np.array([start])
        return int(self.spans(at, length, 0)[0]), int(self.spans(at, length, 1)[0])

    def equal(self, start: int, other: PrefixHashes, at: int, length: int) -> bool:
        """The spans of that length at two places are the same."""
        if start + length > self.n or at + length > other.n:
            return False
        return self.span(start, length) == other.span(at, length)

    def common_extension(self, start: int, other: PrefixHashes, at: int) -> int:
        """Length of the longest common text from two places on."""
        low, high = 0, min(self.n - start, other.n - at)
        while low < high:
            middle = (low + high + 1) // 2
            if self.equal(start, other, at, middle):
                low = middle
            else:
                high = middle - 1
        return low

    def cuts(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Places inside the text that are kept, their levels, and the level from
        which on all are kept. A place's level tells how small the hash of the code
        points from it on is (at the text's end they are fewer): each level has
        2^(-1/4) of the places of the one before. All places from some level on are
        kept, the lowest at which there are few enough. Where nearly all
        places are alike (one repeated character), every so many are, by a power of
        two. A text with fewer places than may be kept keeps them all, at level 0."""
        most = cuts_kept(self.n)
        at = np.arange(1, max(self.n, 1))
        stop = np.minimum(at + WINDOW, self.n)
        s = self.sums[0]
        h = _scrambled(_reduced(_reduced(s[stop] + _P - s[at]) * _POWERS.down[0][at]))
        levels = len(_BOUNDS) - 1 - np.searchsorted(_BOUNDS, h, side="right")
        found = np.bincount(levels, minlength=len(_BOUNDS) + 1)
        level = int(np.argmax(np.cumsum(found[::-1])[::-1] <= most))
        some = levels >= level
        if level == 0 or 8 * int(some.sum()) >= most:
            return at[some], levels[some], level
        step = 1 << int(np.ceil(np.log2(self.n / most)))
        at = np.arange(step, self.n, step)
        return at, _GRID + np.bitwise_count((at & -at) - 1).astype(np.int64), _GRID + step.bit_length() - 1

    def fingerprint(self) -> str:
        """Hex: for the start, each kept cut and the end 8 digits of the place, 2 of
        its level (for the start, of the level from which on all are kept) and 8
        of either prefix value."""
        at, level, lowest = self.cuts()
        at = np.concatenate(([0], at, [self.n])) if self.n else np.zeros(1, np.int64)
        packed = np.empty((len(at), 13), np.uint8)
        packed[:, :4] = at.astype(">u4").view(np.uint8).reshape(-1, 4)
        packed[:, 4] = [lowest, *level, *[_EDGE] * (len(at) > 1)]
        for k, s in enumerate(self.sums):
            packed[:, 5 + 4 * k : 9 + 4 * k] = s[at].astype(">u4").view(np.uint8).reshape(-1, 4)
        return packed.tobytes().hex()


_GRID, _EDGE = 160, 255  # levels of places by count (and above), and of a text's start and end


def _scrambled(hashes: np.ndarray) -> np.ndarray:
    h = hashes.astype(np.uint32)
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x7FEB352D)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x846CA68B)
    return h ^ (h >> np.uint32(16))


#: A hash's level is the number of these above it, less one.
_BOUNDS = np.array([int(2.0 ** (32 - k / 4)) for k in range(128)][::-1], dtype=np.int64)


class Kept:
    """A fingerprint's places and prefix values: spans between them compare."""

    def __init__(self, fingerprint: str):
        packed = np.frombuffer(bytes.fromhex(fingerprint), np.uint8).reshape(-1, 13)
        self.at = np.ascontiguousarray(packed[:, :4]).view(">u4").ravel().astype(np.int64)
        self.level = packed[:, 4].astype(np.int64)
        self.sums = [np.ascontiguousarray(packed[:, c : c + 4]).view(">u4").ravel().astype(np.uint64) for c in (5, 9)]
        self.lowest, self.level[0] = int(self.level[0]), _EDGE
        self.n = int(self.at[-1])

    def cut_from(self, level: int) -> None:
        some = self.level >= level
        self.at, self.level, self.sums = self.at[some], self.level[some], [s[some] for s in self.sums]

    def prepare(self) -> list[int]:
        """Get ready for ``span``; returns a key of the span from each kept place to the next."""
        _POWERS.need(self.n + 1)
        down = [t[self.at] for t in _POWERS.down]
        one, two = ((s[1:] + _P - s[:-1]) % _P * d[:-1] % _P for s, d in zip(self.sums, down, strict=True))
        self.down = [d.tolist() for d in down]
        self.values = [s.tolist() for s in self.sums]
        self.places = self.at.tolist()
        return ((one << _BITS) | two).tolist()

    def span(self, i: int, j: int) -> tuple[int, int, int]:
        """Length and hashes of the text from the i-th to the j-th kept place."""
        (x, y), (u, v), p = self.values, self.down, int(_P)
        return self.places[j] - self.places[i], (x[j] - x[i]) * u[i] % p, (y[j] - y[i]) * v[i] % p


def common_extension(a: Kept, i: int, b: Kept, j: int) -> int:
    """How many spans between kept places are the same from two places on."""
    low, high = 0, min(len(a.places) - i, len(b.places) - j) - 1
    while low < high:
        middle = (low + high + 1) // 2
        if a.span(i, i + middle) == b.span(j, j + middle):
            low = middle
        else:
            high = middle - 1
    return low


def likeness(one: str, other: str) -> float:
    """Share (0 to 1) of two texts that lies in common spans, from two
    fingerprints alone: twice the length of what is matched over both lengths.

    Both are cut from the higher of their levels on, where equal passages have
    equal cuts. From each place of the first on, an unmatched span of the second
    that starts with the same one is extended as far as they agree. A change
    costs the span it is in: about 16 to 32 code points where the text has 1,024
    to 4,096, else n / 64 or n / 256, to twice that. Texts of up to 65 code points
    are compared by single ones."""
    if one == other:
        return 1.0
    a, b = Kept(one), Kept(other)
    if not a.n or not b.n:
        return 0.0
    level = max(a.lowest, b.lowest)
    if (a.lowest >= _GRID) == (b.lowest >= _GRID):
        a.cut_from(level)
        b.cut_from(level)
    of_a, of_b = a.prepare(), b.prepare()
    common = set(of_a) & set(of_b)
    if not common:
        return 0.0
    starts: dict[int, list[int]] = {}
    for j in range(len(of_b) - 1, -1, -1):
        if of_b[j] in common:
            starts.setdefault(of_b[j], []).append(j)  # the first place comes last
    used = bytearray(len(of_b))
    done = matched = 0
    for i, key in enumerate(of_a):
        if i < done or key not in common:
            continue
        free = starts[key]
        while free and used[free[-1]]:
            free.pop()
        if not free:
            continue
        j = free.pop()
        n = common_extension(a, i, b, j)
        taken = used.find(1, j, j + n)
        n = n if taken < 0 else taken - j
        while a.span(i, i + n) != b.span(j, j + n):  # only where a text's end cuts otherwise
            n -= 1
        used[j : j + n] = b"\1" * n
        matched += a.places[i + n] - a.places[i]
        done = i + n
    return 2.0 * matched / (a.n + b.n)


def edited(text: str, following: str) -> str:
    """The last half of a text (rounded down) replaced by as many code points
    of the start of another, or all it has."""
    n = len(text)
    return text[: n - n // 2] + following[: n // 2]


_COLUMNS = [
    ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
    ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()),
]
_SPARK_COLUMNS = "n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _described(text: str, arrays: PrefixHashes, print_: str, following: str, next_arrays: PrefixHashes, next_print: str) -> tuple:
    changed_print = arrays.edited(next_arrays).fingerprint()
    sha = hashlib.sha256(edited(text, following).encode("utf-8", "replace")).hexdigest()
    return (len(text), sha, print_, changed_print, likeness(print_, changed_print), likeness(print_, next_print))


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of the order, each with the first row of the next range at its
    end (``extra``): every row but those is described with the one after it."""
    held = None  # (range, id, text, prefix arrays, fingerprint)
    for batch in batches:
        ids, done = [], []
        for id_, text, at, extra in zip(*batch.columns, strict=True):
            text, at = text.as_py() or "", at.as_py()
            arrays = PrefixHashes(text)
            print_ = arrays.fingerprint()
            if held is not None and held[0] == at:
                ids.append(held[1].as_py())
                done.append(_described(*held[2:], text, arrays, print_))
            held = None if extra.as_py() else (at, id_, text, arrays, print_)
        columns = list(zip(*done, strict=True)) or [()] * len(_COLUMNS)
        made = [pa.array(ids, batch.schema.field(0).type), *[pa.array(list(c), t) for c, (_, t) in zip(columns, _COLUMNS, strict=True)]]
        yield pa.RecordBatch.from_arrays(made, names=["id", *[n for n, _ in _COLUMNS]])


def _with_range(rows: DataFrame, firsts: list[tuple]) -> DataFrame:
    """``range`` of each row: the last of ``firsts`` (descending) that is not
    below it; a range's first row comes once more, as the ``extra`` last one of
    the range before (of the last range, for the first of all)."""
    rising = firsts[::-1]
    n = len(firsts)

    @F.arrow_udf("array<int>")
    def place(id_: pa.Array, tie: pa.Array, row: pa.Array) -> pa.Array:
        out = []
        for key in zip(id_.to_pylist(), tie.to_pylist(), row.to_pylist(), strict=True):
            key = (key[0] is not None, *key) if key[0] is not None else (False, *key[1:])
            at = max(n - bisect.bisect_left(rising, key) - 1, 0)
            out.append([at, (at - 1) % n] if key == firsts[at] else [at])
        return pa.array(out, pa.list_(pa.int32()))

    placed = rows.withColumn("_at", place("id", "tie", "row"))
    return placed.select("*", F.posexplode("_at").alias("extra", "range")).drop("_at").withColumn("extra", F.col("extra") > 0)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    The next document is the one after in descending id order; the first
    follows the last (a lone document follows itself). Null ids come last; rows
    of equal id are in the order of their texts' hashes, so each still has one
    follower. A null text is an empty one; an empty text's fingerprint has one
    place. Other columns are ignored; an empty table gives an empty result.

    Texts move once. A pass over ids and text hashes, written with a row number,
    finds the first row of each range of the order (as many as shuffle
    partitions); texts are then dealt by range, with the first of the next range
    beside, and sorted there. Copies of one row are told apart by the row number."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "fingerprints")
    id_type = docs.schema[id_col].dataType.simpleString()
    keys = [F.col(id_col).alias("id"), F.bitwise_not(F.xxhash64(text_col)).alias("tie"), F.monotonically_increasing_id().alias("row")]
    order = [F.col("id").desc_nulls_last(), F.desc("tie"), F.desc("row")]
    n_ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    narrow = scratch.cut(docs.select(*keys), "keys").repartitionByRange(n_ranges, *order)
    first = F.max(F.struct(F.col("id").isNotNull().alias("known"), "id", "tie", "row")).alias("first")
    found = [r.first for r in narrow.groupBy(F.spark_partition_id().alias("part")).agg(first).collect()]
    scratch.drop()
    firsts = sorted([(True, *r[1:]) if r.known else (False, *r[2:]) for r in found], reverse=True)
    if not firsts:
        return docs.select(id_col).where("false").mapInArrow(lambda b: iter(()), f"{id_col} {id_type}, {_SPARK_COLUMNS}")
    rows = _with_range(docs.select(*keys, F.coalesce(F.col(text_col), F.lit("")).alias("text")), firsts)
    dealt = rows.repartition("range").sortWithinPartitions("range", "extra", *order).select("id", "text", "range", "extra")
    return dealt.mapInArrow(_in_order, f"id {id_type}, {_SPARK_COLUMNS}").withColumnRenamed("id", id_col)
