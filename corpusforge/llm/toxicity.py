"""Toxicity: a convolutional text classifier over hashed words (operator 2).

A word's embedding is the sum of two rows, picked by two hashes, of small
embedding tables (two words rarely share both). Filters of several widths
slide over a document's words; each filter's maximum over the document, after
a rectifier, feeds a logistic output. ``train`` learns from every labelled
document: Spark counts how often words occur by label and by language, a network
is started on a bounded sample, then trained in rounds over all documents, each
part of the table from the same model, after which the parts' changes are
averaged. Thresholds are calibrated by language on every document that training
does not see, one in five. The language is guessed from the same hashed words,
so a score depends on the text alone; scores are shifted so that a language's
threshold lies at 0.5.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .bytesops import NOT_ALNUM, flat_utf8, forget, held, pieces, row_slices, word_hashes, word_spans
from .sampling import fit_in_task, hash_sample, one_label, remainder, with_texts

#: Bounds of the sample that starts the network: documents of a class, and bytes
#: of a class after which no further document is taken (texts are never cut).
SAMPLE_DOCS, SAMPLE_BYTES = 3000, 32 << 20
STEP = 1 << 17  # places that training holds activations of at a time
BUCKETS = 1 << 17  # rows of each embedding table; the last row is the padding
DIMS = 8
WIDTHS = (1, 2, 3)
FILTERS = 8  # of each width
EPOCHS, BATCH, RATE = 6, 64, 0.05
ROUNDS = 2  # over all labelled documents, after the start
PARTS = 1 << 24  # of one, in which changes are summed, so that no order matters
BINS = 256  # of a logit, in which thresholds are counted
CALIBRATION = 5  # one document in so many calibrates the thresholds
#: A language's threshold counts as much as that of all where its calibration
#: documents of the rarer label are so many, less where they are fewer.
SHRINK = 25


@dataclass
class ToxicityModel:
    tables: np.ndarray  # 2 x (BUCKETS + 1) x DIMS
    filters: list[np.ndarray]  # per width: width x DIMS x FILTERS
    bias: np.ndarray  # of each filter
    weights: np.ndarray
    intercept: float
    language_logs: np.ndarray = field(default_factory=lambda: np.zeros((BUCKETS + 1, 1), np.float32))
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(1))  # logits, by language


def _words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket pairs of the words laid out row after row, each row followed by
    padding so that no filter reaches into the next; first place and number of
    places (1 at least) of each row."""
    starts, ends, rows = word_spans(raw, offsets, NOT_ALNUM)
    h = word_hashes(raw, starts, ends)
    n_rows = len(offsets) - 1
    own = row_slices(rows, n_rows)
    count = np.diff(own)
    places = np.maximum(count, 1)
    first = np.cumsum(places + max(WIDTHS) - 1) - (places + max(WIDTHS) - 1)
    ids = np.full((2, int((places + max(WIDTHS) - 1).sum())), BUCKETS, dtype=np.int32)
    at = np.arange(len(h)) - own[rows] + first[rows]
    ids[0, at] = (h & np.uint64(BUCKETS - 1)).astype(np.int32)
    ids[1, at] = (h >> np.uint64(40)).astype(np.int32) & np.int32(BUCKETS - 1)
    return ids, first, places


def _maxima(per_place: np.ndarray, first: np.ndarray, places: np.ndarray) -> np.ndarray:
    cuts = np.stack([first, first + places], axis=1).ravel()
    return np.maximum.reduceat(per_place, cuts, axis=0)[::2]


def _best_places(
    ids: np.ndarray, tables: np.ndarray, filters: list[np.ndarray], first: np.ndarray, places: np.ndarray
) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each filter's maximum over each document, and by width the places where
    they start. Long documents are walked in parts of ``STEP`` places, each with
    the places that follow it."""
    parts = -(-places // STEP)
    of = np.repeat(np.arange(len(places)), parts)
    begin = np.cumsum(parts) - parts
    k = np.arange(len(of)) - begin[of]
    lo, n = first[of] + k * STEP, np.minimum(places[of] - k * STEP, STEP)
    tops = np.empty((len(of), FILTERS * len(WIDTHS)))
    at = np.empty(tops.shape, dtype=np.int64)
    group = np.cumsum(n + max(WIDTHS) - 1) // STEP
    for part in np.split(np.arange(len(of)), np.flatnonzero(np.diff(group)) + 1):
        span = n[part] + max(WIDTHS) - 1
        start = np.cumsum(span) - span
        own = ids[:, np.repeat(lo[part] - start, span) + np.arange(int(span.sum()))]
        x = tables[0][own[0]] + tables[1][own[1]]
        for i, (width, f) in enumerate(zip(WIDTHS, filters, strict=True)):
            total = x @ f[0]
            for j in range(1, width):
                total[:-j] += x[j:] @ f[j]
            columns = slice(i * FILTERS, (i + 1) * FILTERS)
            tops[part, columns] = _maxima(total, start, n[part])
            for r, s in zip(part, start, strict=True):
                at[r, columns] = lo[r] + total[s : s + n[r]].argmax(axis=0)
    if len(of) > len(places):
        highest = np.maximum.reduceat(tops, begin, axis=0)
        where = at[begin]
        for r in range(len(of) - 1, -1, -1):  # the first of equal ones stays
            same = tops[r] == highest[of[r]]
            where[of[r], same] = at[r, same]
        tops, at = highest, where
    return tops, np.split(at, len(WIDTHS), axis=1)


class _Scorer:
    """Filters applied to the embedding tables once, so that a place costs sums."""

    def __init__(self, model: ToxicityModel):
        self.model = model
        self.products = [
            np.stack([np.concatenate([t @ w for w in f], axis=1) for t in model.tables]).astype(np.float32) for f in model.filters
        ]

    def activations(self, ids: np.ndarray, first: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Each filter's maximum over each row, before bias and rectifier."""
        out = []
        for width, product in zip(WIDTHS, self.products, strict=True):
            both = product[0][ids[0]] + product[1][ids[1]]
            total = both[:, :FILTERS].copy()
            for k in range(1, width):
                total[:-k] += both[k:, k * FILTERS : (k + 1) * FILTERS]
            out.append(_maxima(total, first, places))
        return np.concatenate(out, axis=1)

    def unshifted(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's logit before its language's threshold, and that language."""
        m = self.model
        out, guessed = np.empty(len(offsets) - 1), np.empty(len(offsets) - 1, dtype=np.int64)
        for lo, hi in pieces(offsets, 1 << 20):
            ids, first, places = _words(raw, offsets[lo : hi + 1])
            z = np.maximum(self.activations(ids, first, places) + m.bias, 0) @ m.weights + m.intercept
            cuts = np.stack([first, first + places], axis=1).ravel()
            out[lo:hi] = z
            guessed[lo:hi] = np.add.reduceat(m.language_logs[ids[0]], cuts, axis=0)[::2].argmax(axis=1)
        return out, guessed

    def logits(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        z, guessed = self.unshifted(raw, offsets)
        return z - self.model.thresholds[guessed]

    def scores(self, column: pa.Array) -> np.ndarray:
        raw, offsets = flat_utf8(column)
        return 1.0 / (1.0 + np.exp(-np.clip(self.logits(raw, offsets), -50, 50)))


class _Trainer:
    """Gradient steps (Adagrad) on batches of rows, on a copy of the model."""

    def __init__(self, model: ToxicityModel):
        self.tables = model.tables.astype(float)
        self.filters = [f.astype(float) for f in model.filters]
        self.bias, self.weights = model.bias.astype(float), model.weights.astype(float)
        self.intercept = np.array([model.intercept], dtype=float)
        self.rest = [*self.filters, self.bias, self.weights, self.intercept]
        self.squares = [np.full(p.shape, 1e-3) for p in (self.tables, *self.rest)]

    def step(self, ids: np.ndarray, first: np.ndarray, places: np.ndarray, y: np.ndarray, share: np.ndarray) -> None:
        """One step on the rows that start at ``first``, counted by ``share``."""
        tables, weights = self.tables, self.weights
        top, best = _best_places(ids, tables, self.filters, first, places)
        pooled = np.maximum(top + self.bias, 0)
        p = 1 / (1 + np.exp(-np.clip(pooled @ weights + self.intercept, -30, 30)))
        d = (p - y) * share / len(y)
        g_w, g_pool = pooled.T @ d, np.outer(d, weights) * (pooled > 0)
        g_filters, touched, g_touched = [], [[], []], []
        for i, (width, f) in enumerate(zip(WIDTHS, self.filters, strict=True)):
            g = g_pool[:, i * FILTERS : (i + 1) * FILTERS]
            g_f = np.zeros_like(f)
            for k in range(width):
                own = ids[:, best[i] + k]
                g_f[k] = np.einsum("rf,rfd->df", g, tables[0][own[0]] + tables[1][own[1]])
                for t in range(2):
                    touched[t].append(own[t].ravel())
                g_touched.append((g[:, :, None] * f[k].T[None]).reshape(-1, DIMS))
            g_filters.append(g_f)
        g_touched = np.concatenate(g_touched)
        for t in range(2):
            where, back = np.unique(np.concatenate(touched[t]), return_inverse=True)
            g = np.zeros((len(where), DIMS))
            np.add.at(g, back, g_touched)
            self.squares[0][t, where] += g * g
            tables[t, where] -= RATE * g / np.sqrt(self.squares[0][t, where])
        tables[:, BUCKETS] = 0
        gradients = [*g_filters, g_pool.sum(axis=0), g_w, d.sum(keepdims=True)]
        for value, g, square in zip(self.rest, gradients, self.squares[1:], strict=True):
            square += g * g
            value -= RATE * g / np.sqrt(square)

    def rows(self) -> np.ndarray:
        """All parameters, in rows of ``DIMS``: the tables', then the others'."""
        rest = np.concatenate([p.ravel() for p in self.rest])
        rest = np.concatenate((rest, np.zeros(-len(rest) % DIMS)))
        return np.concatenate((self.tables.reshape(-1, DIMS), rest.reshape(-1, DIMS)))

    def put(self, model: ToxicityModel, rows: np.ndarray | None = None) -> None:
        """Give ``model`` these parameters, or those in ``rows``."""
        if rows is not None:
            n = 2 * (BUCKETS + 1)
            self.tables[:] = rows[:n].reshape(self.tables.shape)
            left = rows[n:].ravel()
            for value in self.rest:
                value[...] = left[: value.size].reshape(value.shape)
                left = left[value.size :]
        model.tables, model.filters, model.bias, model.weights = self.tables, self.filters, self.bias, self.weights
        model.intercept = float(self.intercept[0])


def _documents_with(ids: np.ndarray, rows: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Documents of label 0, and of label 1, that hold each bucket."""
    seen = np.unique(rows.astype(np.int64) * (BUCKETS + 1) + ids)
    of, bucket = seen // (BUCKETS + 1), seen % (BUCKETS + 1)
    return np.stack([np.bincount(bucket[y[of] == label], minlength=BUCKETS + 1) for label in (0, 1)])


def _evidence(documents_with: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Per bucket: how much commoner it is in documents of label 1 (log odds,
    shrunk by one document of each label), of ``n`` documents by label. The start
    of the embeddings; shares within a label, so the labels' weights do not
    matter."""
    (c0, c1), (n0, n1) = documents_with, np.maximum(n, 1)
    out = np.log((c1 + 1) / (n1 + 2)) - np.log((c0 + 1) / (n0 + 2))
    out *= (c1 + c0) / (c1 + c0 + 5.0)
    out[BUCKETS] = 0
    return out


def fit(
    texts: Sequence[str], labels: Sequence[int], langs: Sequence[str | None], weights_: Sequence[float] | None = None, seed: int = 7
) -> ToxicityModel:
    """Train on texts with labels 0 and 1, each standing for ``weights_`` rows
    (default: one). Without both labels the score is the label that all have,
    softened (0.01 or 0.99), or 0.01 without texts."""
    held = np.random.default_rng(seed).random(len(labels)) < 1.0 / CALIBRATION
    share = np.ones(len(labels)) if weights_ is None else np.asarray(weights_, dtype=float)
    y = np.asarray(labels, dtype=np.int64)
    model = _network(texts, y, share, held, None, seed)
    if len(y) and y.min() < y.max():
        _calibrate(model, texts, y, share / share.mean(), held, langs)
    return model


def _network(texts: Sequence[str], y: np.ndarray, share: np.ndarray, held: np.ndarray, evidence: np.ndarray | None, seed: int = 7) -> ToxicityModel:
    """The network, trained on the rows that are not ``held``; its embeddings
    start from ``evidence`` of both tables, or that of these rows."""
    rng = np.random.default_rng(seed)
    n_filters = FILTERS * len(WIDTHS)
    tables = rng.normal(0, 0.05, (2, BUCKETS + 1, DIMS))
    filters = [rng.normal(0, 0.1, (w, DIMS, FILTERS)) for w in WIDTHS]
    model = ToxicityModel(tables, filters, np.zeros(n_filters), np.zeros(n_filters), 0.0)
    if not len(y) or y.min() == y.max():
        model.intercept = float(np.log(99) * (1 if len(y) and y[0] == 1 else -1))
        return model
    ids, places, first, row_of = _laid_out(texts)
    learn = np.flatnonzero(~held)
    for t in range(2):
        chosen = ~held[row_of]
        if evidence is not None:
            tables[t, :, 0] += evidence[t] / 4
        else:
            tables[t, :, 0] += _evidence(_documents_with(ids[t][chosen], row_of[chosen], y), np.bincount(y, minlength=2)) / 4
    for f in filters:
        f[:, 0, : FILTERS // 2] += 0.5  # half of the filters start as detectors of that evidence
    tables[:, BUCKETS] = 0
    model.weights[:] = 0.1
    model.bias -= 0.5
    share = share / share.mean()
    prior = np.clip(np.average(y[learn], weights=share[learn]) if len(learn) else 0.5, 1e-6, 1 - 1e-6)
    model.intercept = float(np.log(prior / (1 - prior)))
    trainer = _Trainer(model)
    for _ in range(EPOCHS):
        rng.shuffle(learn)
        for lo in range(0, len(learn), BATCH):
            part = learn[lo : lo + BATCH]
            trainer.step(ids, first[part], places[part], y[part], share[part])
    trainer.put(model)
    return model


def _laid_out(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``_words`` of texts: bucket pairs, places and first place of each row, and
    the row of each place."""
    raw, offsets = flat_utf8(pa.array(texts, pa.large_string()))
    made = [_words(raw, offsets[lo : hi + 1]) for lo, hi in pieces(offsets, 1 << 22)]
    ids, places = np.concatenate([m[0] for m in made], axis=1), np.concatenate([m[2] for m in made])
    first = np.cumsum(places + max(WIDTHS) - 1) - (places + max(WIDTHS) - 1)
    return ids, places, first, np.repeat(np.arange(len(places), dtype=np.int32), places + max(WIDTHS) - 1)


def _best_threshold(z: np.ndarray, y: np.ndarray, share: np.ndarray) -> float:
    """The logit with the fewest errors, each counted by its row's weight, in
    the middle of its gap; of equal ones the highest, which leaves more clean
    documents alone."""
    order = np.argsort(z, kind="stable")
    zs, ys, w = z[order], y[order], share[order]
    errors = np.concatenate(([0], np.cumsum(ys * w))) + np.concatenate((np.cumsum(((1 - ys) * w)[::-1])[::-1], [0]))
    errors = np.round(errors, 6)  # sums in another order are equal
    edges = np.concatenate(([zs[0] - 1], (zs[1:] + zs[:-1]) / 2, [zs[-1] + 1]))
    usable = np.concatenate(([True], zs[1:] > zs[:-1], [True]))
    return float(edges[np.flatnonzero(usable & (errors == errors[usable].min())).max()])


def _language_logs(counts: np.ndarray) -> np.ndarray:
    """Log shares of each language's words by bucket, of counts by bucket and language."""
    counts = counts.astype(float) + 0.1
    logs = np.log(counts / counts.sum(axis=0))
    logs[BUCKETS] = 0
    return logs.astype(np.float32)


def _thresholds(z: np.ndarray, y: np.ndarray, share: np.ndarray, guessed: np.ndarray, n_languages: int) -> np.ndarray:
    """By language, from rows that training did not see: ``share`` rows each."""
    out = np.zeros(n_languages)
    if len(np.unique(y)) < 2:
        return out
    common = _best_threshold(z, y, share)
    for i in range(n_languages):
        mine = guessed == i
        n = min((share * y)[mine].sum(), (share * (1 - y))[mine].sum())
        own = _best_threshold(z[mine], y[mine], share[mine]) if n else common
        out[i] = (n * own + SHRINK * common) / (n + SHRINK)
    return out


def _calibrate(model, texts, y, share, held, langs) -> None:
    """Language tables from the rows' languages; thresholds by the guessed
    language, from the documents that training did not see."""
    ids, _, _, row_of = _laid_out(texts)
    names = sorted({x for x in langs if x is not None}) or [""]
    index = {x: i for i, x in enumerate(names)}
    of = np.array([index.get(x, -1) for x in langs])
    keep = (of[row_of] >= 0) & (ids[0] < BUCKETS)
    cell = ids[0][keep].astype(np.int64) * len(names) + of[row_of[keep]]
    counts = np.bincount(cell, weights=share[row_of[keep]], minlength=(BUCKETS + 1) * len(names))
    model.language_logs = _language_logs(counts.reshape(-1, len(names)))
    seen = np.flatnonzero(held)
    z, guessed = _Scorer(model).unshifted(*flat_utf8(pa.array([texts[i] for i in seen], pa.large_string())))
    model.thresholds = _thresholds(z, y[seen], share[seen], guessed, len(names))


def _in_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Of batches of (text, ...): bucket pairs, first places, places, and the
    batch's rows that they are of, a bounded piece at a time."""
    for batch in batches:
        raw, offsets = flat_utf8(batch.column(0))
        for lo, hi in pieces(offsets, 1 << 22):
            yield *_words(raw, offsets[lo : hi + 1]), batch.slice(lo, hi - lo)


def _gathered(sums: DataFrame, columns: dict[str, str], pack: Callable[[pa.Table], object]) -> object:
    """``pack`` of a table whose size the model bounds, in one executor's task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([pa.field(c, pa.type_for_alias(kind)) for c, kind in columns.items()])
        found = pack(pa.Table.from_batches(list(batches), schema=schema))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], names=["model"])

    got = sums.select(*columns).repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(got[0][0]) if got else pack(pa.schema([(c, pa.type_for_alias(k)) for c, k in columns.items()]).empty_table())


def _counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Of all ``rows(_text, _y, _lang, _held)``: the evidence of both tables, from
    those that are not held, and the language tables."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for ids, _, places, own in _in_pieces(batches):
            row_of = np.repeat(np.arange(len(places), dtype=np.int32), places + max(WIDTHS) - 1)
            y, held = (own.column(k).to_numpy(zero_copy_only=False) for k in (1, 3))
            learn = ~held.astype(bool)
            found = [(t * 2 + label, None, c) for t in range(2) for label, c in enumerate(_documents_with(ids[t][learn[row_of]], row_of[learn[row_of]], y))]
            n = np.bincount(y[learn], minlength=2)
            langs = own.column(2).dictionary_encode()
            of = langs.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            for i, name in enumerate(langs.dictionary.to_pylist()):
                found.append((4, name, np.bincount(ids[0][of[row_of] == i], minlength=BUCKETS + 1)))
            for kind, name, c in [*found, (5, None, n)]:
                at = np.flatnonzero(c) if kind == 5 else np.flatnonzero(c[:BUCKETS])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(at), kind, np.int32)), pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at].astype(np.int64))],
                    names=["kind", "lang", "bucket", "n"],
                )

    def pack(found: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        kind, bucket, n = (found[c].to_numpy() for c in ("kind", "bucket", "n"))
        langs = found["lang"].combine_chunks().dictionary_encode()
        given = langs.dictionary.to_pylist()
        names = sorted(x for x in given if x is not None) or [""]
        place = np.array([names.index(x) if x is not None else -1 for x in given] + [-1])
        of = place[langs.indices.fill_null(-1).to_numpy(zero_copy_only=False)]
        held = np.zeros((6, BUCKETS + 1), np.int64)
        by_language = np.zeros((BUCKETS + 1, len(names)), np.int64)
        held[kind[kind != 4], bucket[kind != 4]] = n[kind != 4]
        by_language[bucket[kind == 4], of[kind == 4]] = n[kind == 4]
        evidence = np.stack([_evidence(held[2 * t : 2 * t + 2], held[5, :2]) for t in range(2)])
        return evidence.astype(np.float32), _language_logs(by_language)

    counted = rows.select("_text", "_y", "_lang", "_held").mapInArrow(count, "kind int, lang string, bucket int, n bigint")
    sums = counted.groupBy("kind", "lang", "bucket").agg(F.sum("n").alias("n"))
    return _gathered(sums, {"kind": "int32", "lang": "string", "bucket": "int32", "n": "int64"}, pack)


def _round(rows: DataFrame, model: ToxicityModel, seed: int) -> None:
    """One pass over all ``rows(_text, _y)``: each part trains from ``model``, which
    then gets the parts' mean change, by their documents. A word's embedding is
    averaged over the parts that changed it, so rare words learn as fast."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    change = [f"d{k}" for k in range(DIMS)]

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        rng = np.random.default_rng(seed)
        trainer, n = _Trainer(shared.value), 0
        before = trainer.rows()
        for ids, first, places, own in _in_pieces(batches):
            y = own.column(1).to_numpy(zero_copy_only=False)
            order = rng.permutation(len(y))
            for lo in range(0, len(y), BATCH):
                part = order[lo : lo + BATCH]
                trainer.step(ids, first[part], places[part], y[part], np.ones(len(part)))
            n += len(y)
        moved = trainer.rows() - before
        at = np.flatnonzero(moved.any(axis=1))
        parts = np.rint(moved[at] * (n * PARTS)).astype(np.int64)
        columns = [pa.array(at.astype(np.int32)), pa.array(np.full(len(at), n, np.int64)), *(pa.array(parts[:, k].copy()) for k in range(DIMS))]
        yield pa.RecordBatch.from_arrays(columns, names=["slot", "n", *change])

    def pack(found: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        moved = np.stack([found[c].to_numpy() for c in change], axis=1) / (found["n"].to_numpy()[:, None] * PARTS)
        return found["slot"].to_numpy(), moved.astype(np.float32)

    learned = rows.select("_text", "_y").mapInArrow(learn, "slot int, n bigint, " + ", ".join(f"{c} bigint" for c in change))
    sums = learned.groupBy("slot").agg(*[F.sum(c).alias(c) for c in ("n", *change)])
    slots, moved = _gathered(sums, {"slot": "int32", "n": "int64"} | dict.fromkeys(change, "int64"), pack)
    shared.destroy()
    trainer = _Trainer(model)
    now = trainer.rows()
    now[slots] += moved
    trainer.put(model, now)
    model.tables = model.tables.astype(np.float32)


def _calibrated(rows: DataFrame, model: ToxicityModel) -> np.ndarray:
    """Thresholds from all ``rows(_text, _y)``, their logits counted in bins."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        scorer = _Scorer(shared.value)
        for batch in batches:
            z, guessed = scorer.unshifted(*flat_utf8(batch.column(0)))
            bins = np.floor(np.clip(z, -50, 50) * BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(guessed.astype(np.int32)), pa.array(bins), batch.column(1)], names=["guessed", "bin", "y"])

    placed = rows.select("_text", F.col("_y").cast("int")).mapInArrow(place, "guessed int, bin int, y int")
    found = placed.groupBy("guessed", "bin", "y").count().collect()
    shared.destroy()
    guessed, bins, y, n = np.array(sorted(map(tuple, found)), dtype=np.int64).reshape(-1, 4).T
    return _thresholds((bins + 0.5) / BINS, y, n.astype(float), guessed, model.language_logs.shape[1])


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic"
) -> ToxicityModel:
    """Learn from all rows that ``labels`` (id, label 0 or 1) covers: the words'
    counts by label and language, ``ROUNDS`` rounds of training, and, on one row
    in five by the hash of its id, which training leaves out, the thresholds.

    Only the network's start comes from a sample: at most ``SAMPLE_DOCS``
    documents of each label, by the hash of their ids, and no further ones after
    ``SAMPLE_BYTES`` of whole texts; a sampled row counts for as many as its label
    has per sampled one. Rows with a null in id, label or text, and ids labelled
    both ways, are left out; of documents that share an id one is read. Without
    labelled rows every score is 0.01."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows = with_texts(one_label(labels, id_col, label_col), docs, id_col, text_col, lang_col).withColumnRenamed(f"_{lang_col}", "_lang")
    # by other digits of crc32 than callers that deal their folds by its remainder
    calibrates = F.floor(remainder(id_col, CALIBRATION**2) / CALIBRATION) == 0
    rows = scratch.cut(rows.withColumns({"_held": calibrates, "_y": F.col("_y").cast("int"), "_lang": F.col("_lang").cast("string")}), "rows")
    drawn = scratch.cut(hash_sample(rows.select(id_col, "_y"), id_col, "_y", SAMPLE_DOCS).drop("_y"), "sample")
    sample = rows.join(F.broadcast(drawn), id_col)

    most_bytes = SAMPLE_BYTES

    def keep(found: Iterator[tuple]) -> list[tuple]:
        spent, met, taken = Counter(), Counter(), []
        for r in found:
            met[r[2]] += 1
            if spent[r[2]] < most_bytes:
                spent[r[2]] += len(r[1].encode("utf-8", "replace"))
                taken.append(r)
        held = Counter(r[2] for r in taken)
        return [(*r[:4], r[4] * met[r[2]] / held[r[2]], *r[6:]) for r in taken]

    evidence, language_logs = _counts(rows)

    def learn(found: list[tuple]) -> ToxicityModel:
        y, share, held = (np.array([r[k] for r in found], dtype=kind) for k, kind in ((2, np.int64), (4, float), (5, bool)))
        model = _network([r[1] for r in found], y, share, held, evidence)
        model.tables = model.tables.astype(np.float32)
        return model

    model = fit_in_task(sample.select(id_col, "_text", "_y", "_lang", "_weight", "_place", "_held"), learn, keep)
    if model and model.weights.any():  # both labels are known
        for k in range(ROUNDS):
            _round(rows.where("not _held"), model, k)
        model.language_logs = language_logs
        model.thresholds = _calibrated(rows.where("_held"), model)
    scratch.drop()
    return model


def with_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with the score of every whole text added (0 to 1). Null and
    empty texts, and texts without words, are scored as no words. The model (a
    few MB, whatever the data) is broadcast; rows are not moved."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = float(np.abs(model.weights).sum() + model.intercept + model.tables[:, ::97].sum())

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        scorer = held(("toxicity", name), lambda: _Scorer(shared.value))
        return pa.array(scorer.scores(texts), pa.float64())

    return docs.withColumn(out_col, score.asNondeterministic()(F.col(text_col)))
