"""Scalar text functions on Spark columns.

All of these are built-in JVM expressions (whole-stage codegen) except
``nfc``, which Spark SQL lacks; it runs as an Arrow-batched UDF and is only
handed the rows that can change under NFC.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's behaviour).
#
# Python's str.isspace() set, 29 code points, which str.strip()/str.split()
# use: U+0009-U+000D, U+001C-U+001F, U+0020, U+0085, U+00A0, U+1680,
# U+2000-U+200A, U+2028, U+2029, U+202F, U+205F, U+3000.
WHITESPACE = (
    r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
# The same 29 characters as a plain string (for btrim, which strips any
# character of a set from both ends without scanning the middle).
WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Default source script: Hangul syllables U+AC00-U+D7A3.
HANGUL = r"[\x{ac00}-\x{d7a3}]"
# Default target script: ASCII Latin letters.
LATIN = r"[A-Za-z]"
# Line breaks of Python's str.splitlines(): \r\n, \n, \r, \v, \f, \x1c,
# \x1d, \x1e, \x85, U+2028, U+2029.
LINE_BREAK = r"\r\n|[\n\r\x{b}\x{c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]"
# ---------------------------------------------------------------------------

# Strings made only of these code points are already NFC: every one is a
# stable starter and none is the second half of a canonical composition.
_NFC_STABLE = r"^[\x{0}-\x{2ff}\x{ac00}-\x{d7a3}]*$"


def py_strip(c: Column) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends."""
    return F.btrim(c, F.lit(WHITESPACE_CHARS))


def py_split(c: Column) -> Column:
    """Python ``str.split()``: whitespace-separated tokens, no empty ones."""
    return F.filter(F.split(py_strip(c), f"{WHITESPACE}+"), lambda t: F.length(t) > 0)


def remove_whitespace(c: Column) -> Column:
    """``''.join(s.split())``."""
    return F.regexp_replace(c, f"{WHITESPACE}+", "")


def has_script(c: Column, pattern: str) -> Column:
    """True when some character of ``c`` matches ``pattern`` (regex search)."""
    return c.rlike(pattern)


def is_source_text(c: Column, src_pattern: str = HANGUL) -> Column:
    """Has a source-script character (Hangul syllable by default)."""
    return has_script(c, src_pattern)


def is_target_text(c: Column, tgt_pattern: str = LATIN, src_pattern: str = HANGUL) -> Column:
    """Has a target-script letter and no source-script letter."""
    return has_script(c, tgt_pattern) & ~has_script(c, src_pattern)


def null_safe(pred: Column, c: Column) -> Column:
    """Validator form of a script predicate: null or empty text is False."""
    return F.coalesce(F.when(F.length(c) > 0, pred), F.lit(False))


@F.arrow_udf(T.StringType())
def _nfc_arrow(a: pa.Array) -> pa.Array:
    # pyarrow's utf8_normalize is not available in every build; unicodedata
    # is. Nulls (rows that need no change) pass straight through.
    return pa.array(
        [None if x is None else unicodedata.normalize("NFC", x) for x in a.to_pylist()],
        type=pa.string(),
    )


def nfc(c: Column, only: Column | None = None) -> Column:
    """Unicode NFC. Python UDFs run on every row of their input, so rows that
    are already NFC (or not selected by ``only``) reach the UDF as a null,
    which costs a validity bit in Arrow; their value passes through."""
    needs = ~c.rlike(_NFC_STABLE)
    if only is not None:
        needs = only & needs
    return F.coalesce(_nfc_arrow(F.when(needs, c)), c)


def dedup_key(stripped: Column, only: Column | None = None) -> Column:
    """MD5 hex of NFC(lower(strip(text))); lower-casing comes before NFC.
    With ``only``, rows outside it get a null key and never reach Python."""
    key = F.md5(nfc(F.lower(py_strip(stripped)), only))
    return key if only is None else F.when(only, key)


def split_lines(c: Column) -> Column:
    """Python ``str.splitlines()``: split on its break set; a trailing break
    (or the empty string) yields no final empty element."""
    parts = F.split(c, LINE_BREAK, -1)
    return F.when(
        F.element_at(parts, -1) == F.lit(""), F.slice(parts, 1, F.size(parts) - 1)
    ).otherwise(parts)
