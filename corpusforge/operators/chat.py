"""Direction projection and chat-format rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIRECTIONS = ("ko2en", "en2ko")

# Default system instructions (our own wording; pass your own per call).
DEFAULT_SYSTEM = {
    "ko2en": (
        "Translate the Korean text you are given into fluent English. Keep names, "
        "figures and dates unchanged and reply with the translation alone."
    ),
    "en2ko": (
        "주어진 영어 글을 자연스러운 한국어로 옮기세요. 이름, 수치, 날짜는 그대로 두고 "
        "번역문만 답하세요."
    ),
}


def _check(direction: str) -> None:
    if direction not in DIRECTIONS:
        raise ValueError(f"no such direction: {direction!r} (known: {DIRECTIONS})")


def direction_columns(direction: str, ko: str = "ko", en: str = "en") -> tuple[Column, Column]:
    """(source, target) columns for a direction."""
    _check(direction)
    return (F.col(ko), F.col(en)) if direction == "ko2en" else (F.col(en), F.col(ko))


def project_direction(df: DataFrame, direction: str, keep: list[str] = (), ko: str = "ko", en: str = "en") -> DataFrame:
    """(keep..., src, ref) for a direction."""
    src, ref = direction_columns(direction, ko, en)
    return df.select(*keep, src.alias("src"), ref.alias("ref"))


def _msg(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def prompt_messages(source: Column, direction: str, system: str | None = None) -> Column:
    """[system, user] messages for a translation request."""
    _check(direction)
    text = DEFAULT_SYSTEM[direction] if system is None else system
    return F.array(_msg("system", F.lit(text)), _msg("user", source))


def sft_messages(df: DataFrame, direction: str, ko: str = "ko", en: str = "en", system: str | None = None) -> DataFrame:
    """One ``messages`` column [system, user, assistant]; all other
    columns removed."""
    src, tgt = direction_columns(direction, ko, en)
    text = DEFAULT_SYSTEM[direction] if system is None else system
    return df.select(
        F.array(_msg("system", F.lit(text)), _msg("user", src), _msg("assistant", tgt)).alias("messages")
    )
