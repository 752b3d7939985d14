"""Language identification by segmentation-marginalised unigrams (operator 7).

A language is a distribution over the pieces of a fixed public vocabulary. A
word's probability is the sum, over all ways to cut it into pieces, of the
product of the pieces' probabilities; a forward pass over the word's bytes sums
them all, however long the word. Piece probabilities are fitted by expectation
maximisation with the same sums. All words of a batch run through the forward
pass together.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import Scratch
from .bytesops import BLANKS, flat_utf8, forget, pieces, row_slices, word_hashes, word_spans
from .sampling import fit_in_task, hash_sample, with_texts

UNDETERMINED = "und"
#: Bound of the training sample: documents of a language.
SAMPLE_DOCS = 300
EM_ROUNDS = 4
PRIOR = 0.05  # added to a piece's expected count
#: Bytes. Longer words (texts without blanks) are scored byte by byte with
#: rescaled masses; only fitting cuts them, between characters, into parts.
UNIT = 48
_RESCALE = 16  # places between rescalings of a long word's masses
_AT_ONCE = 4096  # words in one forward pass
_PIECE, _WORDS = 1 << 20, 1 << 18  # bytes of text, and words, handled at a time
_WORD_START = 0  # the byte put before a word, the vocabulary's mark of a word's start


def read_vocabulary(path: str) -> list[bytes]:
    """The pieces of a SentencePiece model, as bytes; all 256 single bytes are in."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out = {bytes([b]) for b in range(256)}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
            out.add(model.id_to_piece(i).replace("▁", chr(_WORD_START)).encode())
    return sorted(out)


class _Trie:
    """Pieces as a byte automaton: node 0 is dead, node 1 the root. A node's
    children lie at its base plus their byte, in slots that nodes share; a slot
    names the node it belongs to. The 100,000 slots of a vocabulary are smaller
    than a worker's other buffers, and are built once, with the model."""

    def __init__(self, vocabulary: list[bytes]):
        children: list[dict[int, int]] = [{}, {}]
        piece_at = [-1, -1]
        for i, piece in enumerate(vocabulary):
            node = 1
            for b in piece:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    piece_at.append(-1)
                node = children[node][b]
            piece_at[node] = i
        n_slots = 512 + 2 * len(children) + 256
        taken = np.zeros(n_slots, dtype=bool)
        self.base = np.zeros(len(children), dtype=np.int32)
        self.owner, self.child = np.zeros((2, n_slots), dtype=np.int32)
        start = 0  # every slot before is taken
        for node in sorted(range(len(children)), key=lambda k: -len(children[k])):
            if not children[node]:
                break
            codes = np.array(sorted(children[node]), dtype=np.int64)
            start += int(np.argmin(taken[start:]))
            at, window = start, 64
            while True:
                bases = at + np.flatnonzero(~taken[at : at + window]) - codes[0]
                bases = bases[(bases >= 0) & (bases + 256 <= n_slots)]
                free = ~taken[bases[:, None] + codes].any(axis=1)
                if free.any():
                    break
                at, window = at + window, window * 2
            base = int(bases[free.argmax()])
            self.base[node] = base
            taken[base + codes] = True
            self.owner[base + codes] = node
            self.child[base + codes] = [children[node][b] for b in codes.tolist()]
        self.piece = np.array(piece_at, dtype=np.int32)
        self.longest = max(map(len, vocabulary))

    def step(self, nodes: np.ndarray, found: np.ndarray) -> np.ndarray:
        """The nodes that follow on these bytes."""
        at = self.base[nodes] + found
        return np.where(self.owner[at] == nodes, self.child[at], 0)


@dataclass
class LanguageModel:
    languages: list[str]
    trie: _Trie | None
    probabilities: np.ndarray  # piece x language


def _units(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row, starts a word) of every unit to fit: words, long ones
    cut between characters."""
    starts, ends, rows = word_spans(raw, offsets, BLANKS)
    first = np.ones(len(starts), dtype=bool)
    parts = -(-(ends - starts) // UNIT)
    if len(parts) and parts.max() > 1:
        of = np.repeat(np.arange(len(starts)), parts)
        k = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        whole_end, cut = ends[of], starts[of] + (k + 1) * UNIT
        for _ in range(3):  # a character's further bytes go with its first
            cut += (cut < whole_end) & (raw[np.minimum(cut, len(raw) - 1)] & 0xC0 == 0x80)
        ends = np.minimum(cut, whole_end)
        starts = np.where(k == 0, starts[of], np.concatenate(([0], ends[:-1])))
        rows, first = rows[of], k == 0
        some = ends > starts
        starts, ends, rows, first = starts[some], ends[some], rows[some], first[some]
    return starts, ends, rows, first


def _matrix(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units as rows of bytes, with the mark before those that start a word."""
    sizes = ends - starts + first
    at = starts[:, None] - first[:, None] + np.arange(int(sizes.max()))
    data = raw[np.clip(at, 0, len(raw) - 1)]
    data[first, 0] = _WORD_START
    return data, sizes


def _edges(data: np.ndarray, sizes: np.ndarray, trie: _Trie) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(from, to, units, nodes): every piece at every place, in order of place."""
    for s in range(data.shape[1]):
        alive = np.flatnonzero(sizes > s)
        nodes = np.ones(len(alive), dtype=np.int32)
        for e in range(s + 1, min(s + trie.longest, data.shape[1]) + 1):
            inside = sizes[alive] >= e
            alive, nodes = alive[inside], nodes[inside]
            nodes = trie.step(nodes, data[alive, e - 1])
            live = nodes > 0
            alive, nodes = alive[live], nodes[live]
            if not len(alive):
                break
            hit = trie.piece[nodes] >= 0
            if hit.any():
                yield s, e, alive[hit], trie.piece[nodes[hit]]


def _forward(data: np.ndarray, sizes: np.ndarray, trie: _Trie, p: np.ndarray) -> np.ndarray:
    """Probability mass of each prefix: [place, unit, language]. A unit is some
    50 bytes at most, so doubles don't underflow."""
    mass = np.zeros((data.shape[1] + 1, len(data), p.shape[1]))
    mass[0] = 1.0
    for s, e, units, found in _edges(data, sizes, trie):
        mass[e, units] += mass[s, units] * p[found]
    return mass


def unit_scores(raw, starts, ends, first, trie: _Trie, p: np.ndarray) -> np.ndarray:
    """log P(unit | language), each different unit computed once."""
    keys = word_hashes(raw, starts, ends, lower=False) ^ first.astype(np.uint64)
    _, one, back = np.unique(keys, return_index=True, return_inverse=True)
    order = one[np.argsort(ends[one] - starts[one], kind="stable")]
    out = np.empty((len(starts), p.shape[1]))
    for lo in range(0, len(order), _AT_ONCE):
        part = order[lo : lo + _AT_ONCE]
        data, sizes = _matrix(raw, starts[part], ends[part], first[part])
        mass = _forward(data, sizes, trie, p)
        out[part] = np.log(mass[sizes, np.arange(len(part))])
    return out[one][back]


def _long_scores(raw, starts, ends, trie: _Trie, p: np.ndarray) -> np.ndarray:
    """log P(word | language) of words of any length, the mark before them. The
    words go byte by byte in step; what is held are the pieces begun and not yet
    ended, with the mass where they begin, rescaled every ``_RESCALE`` places."""
    out = np.empty((len(starts), p.shape[1]))
    order = np.argsort(starts - ends, kind="stable")  # the longest first
    for lo in range(0, len(order), _AT_ONCE):
        part = order[lo : lo + _AT_ONCE]
        before, sizes = starts[part] - 1, ends[part] - starts[part] + 1
        mass, scale = np.ones((2, len(part), p.shape[1]))
        scale[:] = 0
        who, nodes, begun = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros((0, p.shape[1]))
        for e in range(int(sizes[0])):
            n = int(np.searchsorted(-sizes, -e, side="left"))  # words with a byte here
            here = raw[before[:n] + e] if e else np.full(n, _WORD_START, np.uint8)
            going = who < n
            who = np.concatenate((who[going], np.arange(n)))
            nodes = np.concatenate((nodes[going], np.ones(n, np.int32)))
            begun = np.concatenate((begun[going], mass[:n]))
            nodes = trie.step(nodes, here[who])
            live = nodes > 0
            who, nodes, begun = who[live], nodes[live], begun[live]
            ended = trie.piece[nodes] >= 0
            mass[:n] = 0
            np.add.at(mass, who[ended], begun[ended] * p[trie.piece[nodes[ended]]])
            if e % _RESCALE == _RESCALE - 1:
                scale[:n] += np.log(mass[:n])
                begun /= mass[who]
                mass[:n] = 1
        out[part] = scale + np.log(mass)
    return out


def word_scores(raw, starts, ends, trie: _Trie, p: np.ndarray) -> np.ndarray:
    """log P(word | language), over all segmentations of the whole word."""
    out = np.empty((len(starts), p.shape[1]))
    long = ends - starts > UNIT
    short = ~long
    if short.any():
        out[short] = unit_scores(raw, starts[short], ends[short], np.ones(int(short.sum()), dtype=bool), trie, p)
    if long.any():
        keys = word_hashes(raw, starts[long], ends[long], lower=False)
        _, one, back = np.unique(keys, return_index=True, return_inverse=True)
        out[long] = _long_scores(raw, starts[long][one], ends[long][one], trie, p)[back]
    return out


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(language, unit, starts a word, times) of whole texts, per some MB of them.
    Blank texts are left out."""
    forget()
    for batch in batches:
        raw, offsets = flat_utf8(batch.column(0))
        filled = np.array([bool(t) and not t.isspace() for t in batch.column(0).to_pylist()])
        names, lang_of = np.unique(np.array(batch.column(1).to_pylist(), dtype=object), return_inverse=True)
        for lo, hi in pieces(offsets, _PIECE):
            starts, ends, rows, first = _units(raw, offsets[lo : hi + 1])
            rows = rows + lo
            starts, ends, rows, first = (a[filled[rows]] for a in (starts, ends, rows, first))
            keys = word_hashes(raw, starts, ends, lower=False) ^ first.astype(np.uint64)
            _, one, back = np.unique(keys, return_index=True, return_inverse=True)
            pair, times = np.unique(back * len(names) + lang_of[rows], return_counts=True)
            unit = one[pair // len(names)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([names[k] for k in pair % len(names)], batch.column(1).type),
                    pa.array([raw[a:b].tobytes() for a, b in zip(starts[unit], ends[unit], strict=True)], pa.binary()),
                    pa.array(first[unit], pa.bool_()),
                    pa.array(times, pa.int64()),
                ],
                names=["lang", "unit", "first", "times"],
            )


def fit(counts: list[tuple[str, bytes, bool, int]], vocabulary: list[bytes]) -> LanguageModel:
    """Piece probabilities of each language, by expectation maximisation, from
    (language, unit, starts a word, times)."""
    languages = sorted({c[0] for c in counts})
    trie = _Trie(vocabulary)
    units = sorted({(c[1], c[2]) for c in counts})
    index, column = {u: k for k, u in enumerate(units)}, {x: k for k, x in enumerate(languages)}
    raw = np.frombuffer(b"".join(u for u, _ in units), dtype=np.uint8)
    ends = np.cumsum([len(u) for u, _ in units])
    starts = ends - np.array([len(u) for u, _ in units])
    first = np.array([f for _, f in units])
    times = np.zeros((len(units), len(languages)))
    for lang, unit, begins, n in counts:
        times[index[unit, begins], column[lang]] += n
    one = np.arange(len(units))
    order = np.argsort(ends[one] - starts[one], kind="stable")
    # the start: a longer piece is rarer, whatever the language
    weight = np.array([256.0 ** -min(len(v), 4) for v in vocabulary])
    p = np.repeat((weight / weight.sum())[:, None], len(languages), axis=1)
    for _ in range(EM_ROUNDS):
        expected = np.full(p.shape, PRIOR)
        for lo in range(0, len(order), _AT_ONCE):
            part = order[lo : lo + _AT_ONCE]
            unit = one[part]
            data, sizes = _matrix(raw, starts[unit], ends[unit], first[unit])
            mass = _forward(data, sizes, trie, p)
            rest = np.zeros_like(mass)  # probability mass from each place to the end
            n = np.arange(len(part))
            rest[sizes, n] = times[part] / mass[sizes, n]
            for s, e, units, found in reversed(list(_edges(data, sizes, trie))):
                share = rest[e, units] * p[found]
                rest[s, units] += share
                np.add.at(expected, found, share * mass[s, units])
        p = expected / expected.sum(axis=0)
    return LanguageModel(languages, trie, p)


def predict(column: pa.Array, model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """(index of the likeliest language, its posterior under a flat prior) per row."""
    forget()
    raw, offsets = flat_utf8(column)
    best, score = np.zeros(len(column), dtype=np.int64), np.zeros(len(column))
    for lo, hi in pieces(offsets, _PIECE):
        total = np.zeros((hi - lo, len(model.languages)))
        starts, ends, rows = word_spans(raw, offsets[lo : hi + 1], BLANKS)
        for a in range(0, len(starts), _WORDS):
            b = a + _WORDS
            logs = word_scores(raw, starts[a:b], ends[a:b], model.trie, model.probabilities)
            own = row_slices(rows[a:b], hi - lo)
            some = np.flatnonzero(own[1:] > own[:-1])
            if len(some):
                total[some] += np.add.reduceat(logs, own[some], axis=0)
        best[lo:hi] = total.argmax(axis=1)
        score[lo:hi] = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
    return best, score


def train(docs: DataFrame, vocabulary: list[bytes], id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Fit on a sample of ``docs`` (rows with an id, a text and a language): at
    most ``SAMPLE_DOCS`` documents a language, by the hash of their ids. Whole
    texts are reduced to counts of their units where they lie; the fitting task
    receives the different ones. Of documents that share id and language one is
    read. Without such rows no language is learned."""
    scratch = Scratch(docs.sparkSession, "languages")
    drawn = scratch.cut(hash_sample(docs.select(id_col, lang_col), id_col, lang_col, SAMPLE_DOCS), "sample")
    texts = with_texts(drawn, docs.select(id_col, text_col), id_col, text_col).select("_text", lang_col)
    lang_type = docs.schema[lang_col].dataType.simpleString()
    counted = texts.mapInArrow(_counted, f"lang {lang_type}, unit binary, first boolean, times bigint")
    counted = counted.groupBy("lang", "unit", "first").agg(F.sum("times").alias("times"))

    def learn(counts: list[tuple]) -> LanguageModel:
        if not counts:
            return LanguageModel([], None, np.zeros((len(vocabulary), 0)))
        return fit(counts, vocabulary)

    model = fit_in_task(counted, learn)
    scratch.drop()
    return model


def with_language(
    docs: DataFrame, model: LanguageModel, text_col: str = "text", out_cols: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """``docs`` with the language predicted from the whole text, and its
    posterior, added as ``out_cols`` (which replace columns of these names).

    A null text, one without a letter, and any text where no language was
    learned get `und` and score 0. Ties go to the first language by name.
    Repeated rows are rows like others; an empty table gives an empty result. The
    model (vocabulary times languages) is broadcast; rows are not moved."""
    lang, posterior_ = out_cols
    has_letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    if not model.languages:
        return docs.withColumns({lang: F.lit(UNDETERMINED), posterior_: F.lit(0.0)})
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<best:int,score:double>")
    def score(texts: pa.Array) -> pa.Array:
        best, posterior = predict(texts, shared.value)
        return pa.StructArray.from_arrays([pa.array(best, pa.int32()), pa.array(posterior, pa.float64())], ["best", "score"])

    names = F.array(*[F.lit(x) for x in model.languages])
    found = docs.withColumn("_found", score.asNondeterministic()(F.col(text_col)))
    return found.withColumns(
        {
            lang: F.when(has_letter, F.get(names, F.col("_found.best"))).otherwise(UNDETERMINED),
            posterior_: F.when(has_letter, F.col("_found.score")).otherwise(0.0),
        }
    ).drop("_found")
