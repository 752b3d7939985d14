"""Plain configuration records: sources, validation candidates, filter thresholds."""

from __future__ import annotations

from dataclasses import dataclass

from ..functions.text import HANGUL, LATIN


@dataclass(frozen=True)
class SourceSpec:
    """One corpus. List position in a catalogue is its dedup priority.

    ``path`` is read with ``fmt`` (parquet, json, ...). ``ko_field`` /
    ``en_field`` / ``score_field`` are dotted paths into the row.
    ``ordinal`` names a column that gives arrival order; without one, order
    comes from file position (see ``corpus.with_file_ordinal``). ``schema``
    (DDL) gives a JSON source fixed types; without one, every value's type is
    that of its own row.
    """

    name: str
    path: str | None = None
    fmt: str = "parquet"
    ko_field: str = "ko"
    en_field: str = "en"
    score_field: str | None = None
    ordinal: str | None = None
    schema: str | None = None  # DDL
    license: str = "unknown"
    notes: str = ""


@dataclass(frozen=True)
class FilterCfg:
    """Waterfall thresholds and script patterns.

    Fixed default values: char_min 10, char_max_ko 800, char_max_en 1600,
    ratio_min 0.3, ratio_max 5.0; source script Hangul syllables, target
    script ASCII Latin.
    """

    char_min: int = 10
    char_max_ko: int = 800
    char_max_en: int = 1600
    ratio_min: float = 0.3
    ratio_max: float = 5.0
    src_pattern: str = HANGUL
    tgt_pattern: str = LATIN


@dataclass(frozen=True)
class TestsetBounds:
    """Curated test-set checks. Fixed default values: lengths 5..500 on each
    side, en/ko ratio 0.3..5.0."""

    len_min: int = 5
    len_max: int = 500
    ratio_min: float = 0.3
    ratio_max: float = 5.0


# Reason codes of the rejection waterfall, in test order (fixed values).
REASONS = ("schema", "empty", "not_ko", "not_en", "len_ko", "len_en", "ratio", "dup")
