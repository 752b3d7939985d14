"""Fine-tuning data preparation: JSONL pairs
-> first-N caps -> chat-format rows -> JSONL. Training itself is out of scope."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.chat import sft_messages
from ..session import ship_package
from ..sources.jsonl import read_jsonl, write_jsonl


def formatted_split(spark: SparkSession, path: str, direction: str, limit: int | None = None,
                    system: str | None = None) -> DataFrame:
    """S5 -> W4 -> T2: ``messages`` rows for one split."""
    return sft_messages(read_jsonl(spark, path, limit=limit), direction, system=system)


def prepare_sft(spark: SparkSession, train: str, val: str, direction: str, out_dir: str,
                max_train: int | None = None, max_val: int | None = None) -> dict:
    ship_package(spark)
    counts = {}
    for name, path, cap in (("train", train, max_train), ("val", val, max_val)):
        df = formatted_split(spark, path, direction, cap)
        write_jsonl(df, f"{out_dir}/{name}_messages")
        counts[name] = spark.read.text(f"{out_dir}/{name}_messages").count()  # a row is a line
    return counts
