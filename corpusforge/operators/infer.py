"""Caller-supplied batch inference and segment scoring.

The model is never ours: the caller passes ``fn(list[str]) -> list[str]``
(or ``-> list[float]`` for scoring), or ``setup() -> fn``, which runs once in a
Python worker, before its first batch, and is the place to load a model. Spark
streams Arrow batches of the text columns to the workers; inside a batch rows
go to ``fn`` in chunks of ``batch_size`` in arrival order, and each result
stays with its row.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import py_round

#: What ``setup`` has given in this worker, by operator. Workers are used for
#: later tasks too, of a predictor and a scorer in turn: the last two are held.
_LOADED: dict[str, Callable] = {}
_MOST_LOADED = 2


def _loader(fn: Callable | None, setup: Callable[[], Callable] | None) -> Callable[[], Callable]:
    """How a task gets its function."""
    if (fn is None) == (setup is None):
        raise ValueError("either fn or setup is needed")
    if setup is None:
        return lambda: fn
    name = uuid.uuid4().hex

    def load() -> Callable:
        from corpusforge.operators.infer import _LOADED as loaded  # this worker's own, not a copy sent with the task

        model = loaded.pop(name, None) or setup()
        loaded[name] = model  # the last used comes last
        while len(loaded) > _MOST_LOADED:
            del loaded[next(iter(loaded))]
        return model

    return load


def _chunks(n: int, size: int):
    for i in range(0, n, size):
        yield i, min(i + size, n)


def batch_predict(
    df: DataFrame,
    fn: Callable[[list[str]], list[str]] | None = None,
    src_col: str = "src",
    out_col: str = "pred",
    batch_size: int = 4,
    setup: Callable[[], Callable[[list[str]], list[str]]] | None = None,
) -> DataFrame:
    """Add ``out_col`` = fn(source) with surrounding whitespace stripped."""
    size = max(int(batch_size), 1)
    load = _loader(fn, setup)

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for texts in batches:
            src = texts.tolist()
            out: list[str | None] = []
            for i, j in _chunks(len(src), size):
                got = list(model(src[i:j]))
                if len(got) != j - i:
                    raise RuntimeError(f"predictor returned {len(got)} outputs for {j - i} inputs")
                out.extend(None if p is None else str(p).strip() for p in got)
            yield pd.Series(out, dtype=object)

    # only the text goes to Python: other columns keep their values and types
    return df.withColumn(out_col, run.asNondeterministic()(F.col(src_col)))


def score_segments(
    df: DataFrame,
    fn: Callable[[list[dict]], list[float]] | None = None,
    cols: tuple[str, str, str] = ("src", "pred", "ref"),
    out_col: str = "segment_score",
    batch_size: int = 8,
    setup: Callable[[], Callable[[list[dict]], list[float]]] | None = None,
) -> DataFrame:
    """T4: rows {src, mt, ref} in chunks of ``batch_size`` -> segment score."""
    size = max(int(batch_size), 1)
    load = _loader(fn, setup)

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load()
        for src, mt, ref in batches:
            rows = [{"src": a, "mt": b, "ref": c} for a, b, c in zip(src, mt, ref, strict=True)]
            out: list[float] = []
            for i, j in _chunks(len(rows), size):
                got = [float(x) for x in model(rows[i:j])]
                if len(got) != j - i:
                    raise RuntimeError(f"scorer returned {len(got)} scores for {j - i} segments")
                out.extend(got)
            yield pd.Series(out, dtype=float)

    return df.withColumn(out_col, run.asNondeterministic()(*[F.col(c) for c in cols]))


def system_score(df: DataFrame, score_col: str = "segment_score", digits: int = 4) -> DataFrame:
    """A10: mean of segment scores, rounded as Python rounds."""
    return df.agg(py_round(F.avg(score_col), digits).alias("system_score"))


def timed(action: Callable[[], object]) -> tuple[object, float]:
    """Run an action, return (result, seconds rounded to 0.1)."""
    t0 = time.time()
    out = action()
    return out, round(time.time() - t0, 1)
