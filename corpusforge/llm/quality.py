"""Quality: histogram gradient-boosted trees over document statistics (operator 6).

A document becomes a row of statistics of its whole text (character classes,
word and line shapes, repetition). Trees of fixed depth are boosted on the
statistics' histogram bins in numpy, from a bounded sample, and flattened into
arrays of split features, thresholds and leaf values; scoring walks one level
of one tree for all rows of a batch at a time.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .bytesops import BLANKS, flat_utf8, mix64, pieces, word_hashes, word_spans
from .sampling import hash_sample, one_label, with_texts

#: Bound of the training sample: documents of a class.
SAMPLE_DOCS = 6000
TREES, DEPTH, BINS, RATE, SHRINK, LEAST_HESSIAN = 80, 4, 64, 0.15, 1.0, 2.0

# Character classes by byte; a class's share of the text is a statistic.
_CLASSES = ("lower", "upper", "digit", "blank", "break", "comma_stop", "bar", "sign", "bracket", "quote", "colon", "other_ascii", "beyond_ascii")
_CLASS = np.full(256, _CLASSES.index("other_ascii"), dtype=np.int64)
for _name, _chars in {
    "lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "blank": " \t\x0b\x0c",
    "break": "\n\r", "comma_stop": ",.", "bar": "|", "sign": "#$%&*!=+~^@_", "bracket": "()[]{}<>", "quote": "'\"`", "colon": ":;/?-",
}.items():
    _CLASS[[ord(c) for c in _chars]] = _CLASSES.index(_name)
_CLASS[128:] = _CLASSES.index("beyond_ascii")
_SIGNS = np.isin(_CLASS, [_CLASSES.index(x) for x in ("bar", "sign", "bracket")])
_LETTERS = np.isin(_CLASS, [_CLASSES.index(x) for x in ("lower", "upper", "beyond_ascii")])

STATISTICS = (
    *(f"share_{c}" for c in _CLASSES),
    "log_bytes", "log_words", "word_bytes", "longest_word", "share_short_words", "share_long_words", "share_sign_words",
    "share_letterless_words", "words_per_line", "share_different_words", "commonest_word", "share_repeated_next",
    "share_repeated_lines", "log_lines", "share_different_letters",
)


def _runs(row: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: the number of different values, and the commonest one's count."""
    if not len(row):
        return np.zeros(n), np.zeros(n)
    key = (row.astype(np.uint64) << np.uint64(40)) | (mix64(value) >> np.uint64(24))
    key.sort()
    start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.append(start, len(key)))
    of = (key[start] >> np.uint64(40)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, of, size)
    return np.bincount(of, minlength=n), most


def statistics(column: pa.Array) -> np.ndarray:
    """A row of ``STATISTICS`` for each row of a text column; an empty or null
    text has zeros."""
    raw, offsets = flat_utf8(column)
    parts = [_statistics(raw, offsets[lo : hi + 1]) for lo, hi in pieces(offsets, 1 << 20)]
    return np.concatenate(parts) if parts else np.zeros((0, len(STATISTICS)))


def _statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n, lo, hi = len(offsets) - 1, int(offsets[0]), int(offsets[-1])
    data = raw[lo:hi]
    size = np.diff(offsets).astype(float)
    row_of = np.repeat(np.arange(n), np.diff(offsets))
    classes = np.bincount(row_of * len(_CLASSES) + _CLASS[data], minlength=n * len(_CLASSES)).reshape(n, -1)
    starts, ends, rows = word_spans(raw, offsets, BLANKS)
    length = ends - starts
    words = np.bincount(rows, minlength=n)
    per_word, per_byte = np.maximum(words, 1), np.maximum(size, 1)

    def share(mask: np.ndarray) -> np.ndarray:
        return np.bincount(rows[mask], minlength=n) / per_word

    h = word_hashes(raw, starts, ends)
    longest = np.zeros(n)
    np.maximum.at(longest, rows, length)
    signs = np.concatenate(([0], np.cumsum(_SIGNS[data])))
    letters = np.concatenate(([0], np.cumsum(_LETTERS[data])))
    breaks = np.concatenate(([0], np.cumsum(data == 10)))
    line = breaks[starts - lo]  # a line's number; rows start new lines below
    next_same = np.zeros(len(h), dtype=bool)
    next_same[1:] = (h[1:] == h[:-1]) & (rows[1:] == rows[:-1])
    different, commonest = _runs(rows, h, n)
    # lines: a line's hash is the sum of its words' hashes
    first = np.flatnonzero(np.concatenate(([True], (line[1:] != line[:-1]) | (rows[1:] != rows[:-1])))) if len(h) else np.zeros(0, np.int64)
    line_hash = np.add.reduceat(mix64(h), first) if len(h) else h
    lines = np.bincount(rows[first], minlength=n) if len(h) else np.zeros(n)
    different_lines, _ = _runs(rows[first], line_hash, n) if len(h) else (np.zeros(n), None)
    small = np.bincount(np.unique(row_of * 256 + data) // 256, minlength=n) if len(data) else np.zeros(n)
    return np.column_stack(
        [
            classes / per_byte[:, None],
            np.log1p(size),
            np.log1p(words),
            np.bincount(rows, weights=length, minlength=n) / per_word,
            np.log1p(longest),
            share(length <= 3),
            share(length > 15),
            share(signs[ends - lo] - signs[starts - lo] > 0),
            share(letters[ends - lo] - letters[starts - lo] == 0),
            words / np.maximum(lines, 1),
            different / per_word,
            commonest / per_word,
            share(next_same),
            (1 - different_lines / np.maximum(lines, 1)) * (lines > 0),
            np.log1p(lines),
            small / 256,
        ]
    )


@dataclass
class QualityModel:
    """Flattened trees: node k's children are 2k+1 and 2k+2; leaves by place."""

    base: float
    feature: np.ndarray  # tree x inner node
    threshold: np.ndarray
    leaf: np.ndarray  # tree x 2^DEPTH

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        rows = np.arange(len(x))
        inner = (1 << DEPTH) - 1
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            z += leaf[node - inner]
        return 1.0 / (1.0 + np.exp(-np.clip(z, -50, 50)))


def fit(x: np.ndarray, y: Sequence[int], weights: Sequence[float] | None = None) -> QualityModel:
    """Boost on statistics and labels 0 and 1, each standing for ``weights`` rows
    (default: one). With one label only, the score is that label softened (0.01
    or 0.99); without rows it is 0.5."""
    y = np.asarray(y, dtype=float)
    w = np.ones(len(y)) if weights is None else np.asarray(weights, dtype=float)
    none = (np.zeros((0, (1 << DEPTH) - 1), np.int64), np.zeros((0, (1 << DEPTH) - 1)), np.zeros((0, 1 << DEPTH)))
    if not len(y) or y.min() == y.max():
        return QualityModel(float(np.log(99) * (2 * y[0] - 1)) if len(y) else 0.0, *none)
    edges = [np.unique(np.quantile(col, np.linspace(0, 1, BINS + 1)[1:-1])) for col in x.T]
    binned = np.column_stack([np.searchsorted(e, col, side="left") for e, col in zip(edges, x.T, strict=True)])
    n, m = binned.shape
    w = w / w.mean()
    prior = np.average(y, weights=w)
    base = float(np.log(prior / (1 - prior)))
    z = np.full(n, base)
    inner, leaves = (1 << DEPTH) - 1, 1 << DEPTH
    features, thresholds, values = [], [], []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        g, h = w * (y - p), w * np.maximum(p * (1 - p), 1e-6)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, dtype=np.int64)
        for depth in range(DEPTH):
            width, level = 1 << depth, (1 << depth) - 1
            at = node - level
            best = np.full(width, 1e-9)
            cut = np.full(width, BINS)
            for j in range(m):
                cell = at * BINS + binned[:, j]
                sg = np.bincount(cell, weights=g, minlength=width * BINS).reshape(width, BINS).cumsum(axis=1)
                sh = np.bincount(cell, weights=h, minlength=width * BINS).reshape(width, BINS).cumsum(axis=1)
                tg, th = sg[:, -1:], sh[:, -1:]
                gain = sg**2 / (sh + SHRINK) + (tg - sg) ** 2 / (th - sh + SHRINK) - tg**2 / (th + SHRINK)
                gain[(sh < LEAST_HESSIAN) | (th - sh < LEAST_HESSIAN)] = 0
                gain[:, len(edges[j]) :] = 0
                k = gain.argmax(axis=1)
                top = gain[np.arange(width), k]
                better = top > best
                best[better], cut[better] = top[better], k[better]
                feature[level : level + width][better] = j
            for k in np.flatnonzero(cut < BINS):
                threshold[level + k] = edges[feature[level + k]][cut[k]]
            node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > cut[at])
        sg = np.bincount(node - inner, weights=g, minlength=leaves)
        sh = np.bincount(node - inner, weights=h, minlength=leaves)
        leaf = RATE * sg / (sh + SHRINK)
        z += leaf[node - inner]
        features.append(feature)
        thresholds.append(threshold)
        values.append(leaf)
    return QualityModel(base, np.array(features), np.array(thresholds), np.array(values))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Fit on a sample of the rows that ``labels`` (id, label 0 or 1) covers: at
    most ``SAMPLE_DOCS`` documents of each label, by the hash of their ids. The
    statistics are those of whole texts; the driver receives only them.
    A sampled row counts for as many as its label has per sampled one, so the
    labels' prior is that of all rows. Rows with a null in id, label or text, and
    ids labelled both ways, are left out; of documents that share an id one is
    read. Without labelled rows every score is the same."""
    scratch = Scratch(docs.sparkSession, "quality")
    drawn = scratch.cut(hash_sample(one_label(labels, id_col, label_col), id_col, "_y", SAMPLE_DOCS), "sample")
    texts = with_texts(drawn, docs.select(id_col, text_col), id_col, text_col)

    @F.arrow_udf("array<double>")
    def measure(column: pa.Array) -> pa.Array:
        return pa.array(list(statistics(column)), pa.list_(pa.float64()))

    rows = texts.select(id_col, "_y", measure.asNondeterministic()("_text").alias("x"), "_weight").collect()
    scratch.drop()
    rows.sort(key=lambda r: (r[0], r[2]))
    return fit(np.array([r["x"] for r in rows]).reshape(len(rows), -1), [r["_y"] for r in rows], [r["_weight"] for r in rows])


def with_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text added (0 to 1, higher: label 1
    likelier). Null and empty texts have the statistics of no text. The model
    is a few KB; rows are not moved."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array(model.scores(statistics(texts)), pa.float64())

    return docs.withColumn(out_col, score.asNondeterministic()(F.col(text_col)))
