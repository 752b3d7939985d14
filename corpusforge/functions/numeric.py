"""Numeric helpers with Python's rounding semantics.

Python rounds the exact binary value of a double, ties to even
(``round(2.675, 2) == 2.67``, ``f"{0.125:.2f}" == "0.12"``). Spark's ``round``
rounds half-up on the shortest decimal form and gives 2.68 / 0.13.
``format_number`` with a pattern uses ``java.text.DecimalFormat``, which rounds
the exact binary value half-even, i.e. the same as Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pattern(digits: int) -> str:
    return "0." + "0" * digits if digits > 0 else "0"


def py_format(c: Column, digits: int) -> Column:
    """Python ``f"{x:.{digits}f}"`` (no grouping separators)."""
    return F.call_function("format_number", c, F.lit(_pattern(digits)))


def py_round(c: Column, digits: int) -> Column:
    """Python ``round(x, digits)`` for doubles."""
    return py_format(c, digits).cast("double")
