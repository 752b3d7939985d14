"""Byte-level BPE encoding and decoding (operator 1).

Merging is replaced by a search for the one valid token sequence: a sequence
is what the merges produce exactly if each adjacent pair is, alone, encoded as
that pair. The encoder takes the longest vocabulary match at a position
(found by an Aho-Corasick automaton over the bytes read as Latin-1), keeps it if it is compatible with the token before,
tries the next shorter match otherwise, and backtracks when none is left.
Pair compatibility is memoised, and an end position that failed once is never
tried again, so the work is linear in the piece's length.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Callable, Iterator
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytesops import flat_utf8, held, pieces

#: Bounds of a worker's memory: pieces and pairs remembered, characters of a piece remembered.
CACHED_PIECES, CACHED_PAIRS, CACHED_LENGTH = 120_000, 200_000, 64
_PIECES_AT_ONCE = 200_000
_LONG = 1_000_000  # characters
_REPLACEMENT = "\ufffd".encode()
_NEVER = 1 << 62


def parse_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file (base64 token, space, rank)."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


class Decoder:
    """Bytes of each id; one entry more, for ids that are no token."""

    def __init__(self, ranks: dict[bytes, int]):
        tokens = {rank: token for token, rank in ranks.items()}
        self._parts = [tokens.get(i, _REPLACEMENT) for i in range(max(tokens) + 2)]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for; an id outside the vocabulary gives U+FFFD."""
        unknown = len(self._parts) - 1
        ids = np.where((ids < 0) | (ids > unknown), unknown, ids)
        of = self._parts.__getitem__
        return b"".join(b"".join(map(of, ids[lo : lo + _PIECES_AT_ONCE].tolist())) for lo in range(0, len(ids), _PIECES_AT_ONCE))


class Bpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError("a byte-level vocabulary needs a token for each byte")
        self.automaton = ahocorasick.Automaton()
        self._pairs: dict[int, bool] = {}  # of left * base + right
        self._base = max(ranks.values()) + 1
        #: Per token the tokens that form its left and its right edge while it
        #: is merged, each followed by the rank of the merge that ends it. A
        #: worker holds these for the whole vocabulary: flat, of shared tokens.
        self._left_edge: dict[int, tuple[bytes | int, ...]] = {}
        self._right_edge: dict[int, tuple[bytes | int, ...]] = {}
        shared = {token: token for token in ranks}
        #: The next shorter token that starts a token, or -1, and the place of a
        #: token's last byte. Tokens that the merges can't build are no matches.
        self.shorter = [-1] * self._base
        self.last_byte = [0] * self._base
        usable = set()
        for token in sorted(ranks, key=lambda t: (len(t) > 1, ranks[t])):
            left, right = self._edges(token)
            if left[-1][0] == token:
                usable.add(token)
                self._left_edge[ranks[token]] = tuple(x for part, end in left for x in (shared[part], end))
                self._right_edge[ranks[token]] = tuple(x for part, end in right for x in (shared[part], end))
        for token in usable:
            rank = ranks[token]
            cut = next((n for n in range(len(token) - 1, 0, -1) if token[:n] in usable), 0)
            self.shorter[rank] = ranks[token[:cut]] if cut else -1
            self.last_byte[rank] = len(token) - 1
            self.automaton.add_word(token.decode("latin-1"), rank)
        self.automaton.make_automaton()
        self.decode = Decoder(ranks).decode

    def _edges(self, token: bytes) -> tuple[list[tuple[bytes, int]], list[tuple[bytes, int]]]:
        """Merge a token's bytes (the adjacent parts whose union has the lowest
        rank first, the leftmost of equals) and note what its edges were."""
        parts = [token[i : i + 1] for i in range(len(token))]
        left, right = [], []
        while len(parts) > 1:
            unions = [self.ranks.get(x + y, _NEVER) for x, y in zip(parts, parts[1:], strict=False)]
            rank = min(unions)
            if rank == _NEVER:
                break
            at = unions.index(rank)
            if at == 0:
                left.append((parts[0], rank))
            if at == len(parts) - 2:
                right.append((parts[-1], rank))
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [*left, (parts[0], _NEVER)], [*right, (parts[-1], _NEVER)]

    def compatible(self, left: int, right: int) -> bool:
        """The merges of the two tokens' joined bytes end in these two tokens."""
        known = self._pairs.get(left * self._base + right)
        if known is None:
            if len(self._pairs) >= CACHED_PAIRS:
                self._pairs.clear()
            known = self._never_joined(self._right_edge[left], self._left_edge[right])
            self._pairs[left * self._base + right] = known
        return known

    def _never_joined(self, xs: tuple[bytes | int, ...], ys: tuple[bytes | int, ...]) -> bool:
        """No merge crosses the border between tokens whose edges there are,
        in time, ``xs`` and ``ys``: each edge lasts until the rank of the merge
        that ends it. Of merges of equal rank the leftmost comes first."""
        i = j = 0
        while True:
            x, x_end, y, y_end = xs[i], xs[i + 1], ys[j], ys[j + 1]
            joined = self.ranks.get(x + y, _NEVER)
            if joined < x_end and joined <= y_end and joined != _NEVER:
                return False
            if x_end == y_end == _NEVER:
                return True
            if x_end <= y_end:
                i += 2
            else:
                j += 2

    def encode_piece(self, data: bytes) -> list[int]:
        """The ids of one piece (no merges cross its ends)."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        size, text, longest_from = len(data), data.decode("latin-1"), self.automaton.iter_long
        last_byte, shorter, pairs, base = self.last_byte, self.shorter, self._pairs, self._base
        dead = bytearray(size + 1)
        tokens: list[int] = []
        at, before = 0, -1
        matches = longest_from(text)  # the longest match at a place, then at its end, and so on
        longest = token = next(matches)[1] if size else -1
        while at < size:
            while token >= 0:
                end = at + last_byte[token] + 1
                if not dead[end]:
                    if before < 0:
                        break
                    known = pairs.get(before * base + token)
                    if known or (known is None and self.compatible(before, token)):
                        break
                token = shorter[token]
            if token < 0:  # nothing goes on from here: replace the last token by a shorter one
                dead[at] = 1
                at -= last_byte[before] + 1
                token, longest = shorter[tokens.pop()], -1
                before = tokens[-1] if tokens else -1
            else:
                tokens.append(token)
                before, at = token, end
                if at < size:
                    if token != longest:
                        matches = longest_from(text, at)
                    longest = token = next(matches)[1]
        return tokens


class _Remembered(dict):
    """Text -> its ids as int32 bytes; filled on demand and bounded: when it is
    full its entries become the older half, from which those in use come back."""

    def __init__(self, compute: Callable[[str], bytes]):
        super().__init__()
        self.compute = compute
        self.older: dict[str, bytes] = {}

    def __missing__(self, text: str) -> bytes:
        packed = self.older.get(text)
        if packed is None:
            packed = self.compute(text)
        if len(text) <= CACHED_LENGTH:
            if len(self) >= CACHED_PIECES:
                self.older = dict(self)
                self.clear()
            self[text] = packed
        return packed


class TextEncoder:
    """Whole texts to ids: pieces by the pattern, each encoded alone."""

    def __init__(self, bpe: Bpe, pattern: str):
        self.pattern = regex.compile(pattern)
        self.pieces = _Remembered(lambda p: array("i", bpe.encode_piece(p.encode("utf-8", "replace"))).tobytes())

    def encode(self, text: str) -> bytes:
        """The ids as int32 bytes, from a bounded number of pieces at a time."""
        if len(text) < _LONG:
            return b"".join(map(self.pieces.__getitem__, self.pattern.findall(text)))
        found, out = self.pattern.finditer(text), []
        while part := b"".join(self.pieces[m.group()] for m in islice(found, _PIECES_AT_ONCE)):
            out.append(part)
        return b"".join(out)


def with_token_ids(
    df: DataFrame,
    vocabulary: bytes,
    pattern: str,
    text_col: str = "text",
    out_col: str = "ids",
) -> DataFrame:
    """``df`` with the token ids (array<int>) of every whole text added.

    ``vocabulary`` is a rank file's content, ``pattern`` splits a text into
    pieces; no special tokens. Null and empty texts have no ids. The vocabulary is
    broadcast (its size does not depend on the data); texts are never
    shuffled, and all other columns stay on the JVM side."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        data = shared.value
        encoder = held((hash(data), pattern), lambda: TextEncoder(Bpe(parse_ranks(data)), pattern))
        flat, ends = bytearray(), [0]
        for text in texts:
            flat += encoder.encode(text.as_py() or "")
            ends.append(len(flat) // 4)
        ids = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(flat)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)

    return df.withColumn(out_col, encode.asNondeterministic()(F.col(text_col)))


def with_decoded(df: DataFrame, vocabulary: bytes, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the bytes (binary) that the ids stand for added.

    Null and empty lists give no bytes; a null id gives none, an id outside
    the vocabulary gives U+FFFD."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("binary")
    def decode(lists: pa.Array) -> pa.Array:
        data = shared.value
        decoder = held(hash(data), lambda: Decoder(parse_ranks(data)))
        rows = []
        for ids in lists:
            values = ids.values
            if values is None or not len(values):
                rows.append(b"")
                continue
            flat = values.drop_null().to_numpy(zero_copy_only=False)
            rows.append(decoder.decode(flat))
        return pa.array(rows, pa.binary())

    return df.withColumn(out_col, decode.asNondeterministic()(F.col(ids_col)))


def _round_trips(batches: Iterator[pa.Array], encoder: TextEncoder, decoder: Decoder) -> Iterator[pa.Array]:
    """Ids and decoded bytes of every text. They are larger than the texts, so a
    batch gives several: each of a bounded part of its texts, or one longer text."""
    for batch in batches:
        for lo, hi in pieces(flat_utf8(batch)[1]):
            flat, ends, decoded = bytearray(), [0], []
            for text in batch[lo:hi]:
                ids = encoder.encode(text.as_py() or "")
                flat += ids
                ends.append(len(flat) // 4)
                decoded.append(decoder.decode(np.frombuffer(ids, np.int32)) if ids else b"")
            values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(flat)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
            yield pa.StructArray.from_arrays([lists, pa.array(decoded, pa.binary())], ["ids", "decoded"])


def with_round_trip(
    df: DataFrame, vocabulary: bytes, pattern: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str = "decoded"
) -> DataFrame:
    """``df`` with the token ids of every whole text, as ``with_token_ids``, and
    the bytes that these ids decode to. Both happen in the same Python worker, so
    a task needs one and the ids travel once, in batches of bounded size."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    @F.arrow_udf("struct<ids:array<int>,decoded:binary>")
    def there_and_back(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        data = shared.value

        def make() -> tuple[TextEncoder, Decoder]:
            ranks = parse_ranks(data)
            return TextEncoder(Bpe(ranks), pattern), Decoder(ranks)

        yield from _round_trips(batches, *held((hash(data), pattern, "both"), make))

    both = df.withColumn("_both", there_and_back.asNondeterministic()(F.col(text_col)))
    return both.withColumns({ids_col: F.col("_both.ids"), decoded_col: F.col("_both.decoded")}).drop("_both")
