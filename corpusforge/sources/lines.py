"""Line-aligned parallel text (S7) and the evaluation dataset dispatch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .corpus import BROADCAST_SPLITS

# What str.splitlines() breaks at beside \n, \r and \r\n (fixed values).
EXTRA_BREAKS = "\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
_INNER_BREAK = r"[\r\x{b}\x{c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]"
_BOM = "\ufeff"

# FLORES-style layout: {root}/{split}/{code}.{split} (fixed values).
LANG_CODES = {"ko": "kor_Hang", "en": "eng_Latn"}
SPLITS = ("dev", "devtest")


def read_lines(spark: SparkSession, path: str, line_col: str = "line") -> DataFrame:
    """(line_no, line) with Python ``splitlines()`` numbering, file by file.

    Spark's reader splits at \\n alone; what lies between is split at the other
    breaks (an explode, narrow). So every piece is a line, with one exception:
    where a file ends in one of the extra breaks without a \\n, the piece after
    it is none. Whether a file ends in \\n is told by its size: its segments'
    bytes, one more for each, add up to it, or to one more where the last \\n
    is missing. (The reader takes a byte order mark away, three bytes less; it is
    put back; a file of nothing but the mark has no line.) The rows are written once with their split and task position, and
    no task holds a whole file. Compressed files, whose size says nothing, are
    taken to end in \\n."""
    file, value = F.col("_metadata.file_path").alias("_file"), F.col("value")
    segment = F.when(value.endswith("\r"), F.left(value, F.length(value) - 1)).otherwise(value)
    raw = spark.read.option("lineSep", "\n").text(path).select(
        file,
        F.col("_metadata.file_size").alias("_size"),
        F.col("_metadata.file_block_start").alias("_block"),
        (F.octet_length(value) + 1).cast("bigint").alias("_bytes"),
        F.right(value, F.lit(1)).isin(list(EXTRA_BREAKS)).alias("_open"),
        F.split(segment, _INNER_BREAK, -1).alias("_lines"),
    )
    rows = raw.select("_file", "_size", "_block", "_bytes", "_open", F.size("_lines").alias("_n"), F.posexplode("_lines").alias("_pos", line_col))
    rows = rows.select(
        "_file",
        "_size",
        "_block",
        F.when(F.col("_pos") == 0, F.col("_bytes")).otherwise(0).alias("_bytes"),
        (F.col("_open") & (F.col("_pos") == F.col("_n") - 1)).alias("_open"),
        F.monotonically_increasing_id().alias("_mid"),
        line_col,
    )
    rows = cut_lineage(rows, "lines")
    splits = rows.groupBy("_file", "_block").agg(
        F.min("_mid").alias("_first"),
        F.max("_mid").alias("_last"),
        F.count(F.lit(1)).alias("_rows"),
        F.sum("_bytes").alias("_held"),
        F.max("_size").alias("_size"),
        F.max(F.when(F.col("_open"), F.col("_mid"))).alias("_open_at"),
    )
    of_file = Window.partitionBy("_file")
    over = F.col("_size") - F.sum("_held").over(of_file)  # 0; -1 without the last \n; 3 more with a mark
    splits = splits.withColumns({"_over": over, "_last_block": F.max("_block").over(of_file), "_first_block": F.min("_block").over(of_file)})
    no_line = F.col("_over").isin(-1, 2) & (F.col("_block") == F.col("_last_block")) & (F.col("_open_at") == F.col("_last"))
    splits = splits.withColumn("_drop", F.coalesce(no_line, F.lit(False)))
    order = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.select(
        "_file",
        "_block",
        "_first",
        F.when(F.col("_drop"), F.col("_last")).alias("_none"),
        F.when(F.col("_over").isin(2, 3) & (F.col("_block") == F.col("_first_block")), F.col("_first")).alias("_marked"),
        F.coalesce(F.sum(F.col("_rows") - F.col("_drop").cast("int")).over(order), F.lit(0)).alias("_before"),
    )
    offsets = cut_lineage(offsets, "offsets")  # one row a split: counted, then broadcast below a bound
    side = F.broadcast(offsets) if offsets.count() <= BROADCAST_SPLITS else offsets
    kept = rows.drop("_size", "_bytes", "_open").join(side, ["_file", "_block"]).where("_none is null or _mid <> _none")
    line = F.when(F.col("_mid") == F.col("_marked"), F.concat(F.lit(_BOM), F.col(line_col))).otherwise(F.col(line_col))
    return kept.select((F.col("_before") + F.col("_mid") - F.col("_first")).alias("line_no"), line.alias(line_col))


def read_parallel_lines(spark: SparkSession, src_path: str, tgt_path: str, src: str = "ko", tgt: str = "en") -> DataFrame:
    """Pair line i of one file with line i of the other; unequal
    line counts raise. Returns (id, src, tgt) with id = line index as text."""
    a = read_lines(spark, src_path, src)
    b = read_lines(spark, tgt_path, tgt)
    na, nb = a.count(), b.count()  # of the numbered lines as written, not of a new scan
    if na != nb:
        raise RuntimeError(f"the files do not align: {na} {src} lines against {nb} {tgt} lines")
    return a.join(b, "line_no").select(F.col("line_no").cast("string").alias("id"), src, tgt, "line_no")


def flores_path(root: str, split: str, lang: str) -> str:
    return f"{root}/{split}/{LANG_CODES[lang]}.{split}"


def load_flores(spark: SparkSession, root: str, split: str = "devtest") -> DataFrame:
    if split not in SPLITS:
        raise ValueError(f"no such split: {split!r} (known: {SPLITS})")
    return read_parallel_lines(spark, flores_path(root, split, "ko"), flores_path(root, split, "en")).withColumnRenamed("line_no", "ord")


def load_eval_pairs(spark: SparkSession, name: str, root: str, split: str = "devtest") -> DataFrame:
    """(id, ko, en, ord) of a dataset by name; unknown names raise."""
    readers = {"flores": load_flores}
    if name not in readers:
        raise ValueError(f"no reader for dataset {name!r} (known: {sorted(readers)})")
    return readers[name](spark, root, split)
