"""Priority first-writer-wins deduplication.

Only rows that passed every earlier test claim a key; among the claimants of
a key the lowest (priority, ord) wins. The winner is found on narrow rows:
priority and ordinal are packed into one decimal, which Spark's hash aggregate
can update in place (a struct or a text would make it sort every task's rows),
and partial aggregation folds a key shared by a third of all rows to one row
per map task. Texts are never part of the aggregate.

* ``dedup_winners``: the claimants whose row id won (a semi join).
* ``annotate_duplicates``: every row keeps its outcome, losers get ``dup``.

Both join on the row id (priority, ord) with the key, so a common key can't
skew the join. (priority, ord) must be unique; a claimant without one raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import dedup_key
from ..session import cut_lineage

_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def with_dedup_key(df: DataFrame, text_col: str = "ko") -> DataFrame:
    """key = md5(NFC(lower(strip(text)))), only for rows still passing.
    The NFC UDF sees nothing from rejected rows (their key is null)."""
    return df.withColumn("dkey", dedup_key(F.col(text_col), only=F.col("reason").isNull()))


def _row_id(df: DataFrame) -> Column:
    """(priority, ord) as one ordered value: priority * 10^20 + ord + 2^63. An
    ordinal that is no whole number stays in a struct, aggregated by sorting."""
    if all(isinstance(df.schema[c].dataType, _WHOLE) for c in ("priority", "ord")):
        packed = "cast(priority as decimal(10,0)) * 100000000000000000000BD + (cast(ord as decimal(19,0)) + 9223372036854775808BD)"
        packed = F.expr(packed)
        complete = F.col("priority").isNotNull() & F.col("ord").isNotNull()
    else:
        packed = F.struct("priority", "ord")
        complete = F.lit(True)
    return F.when(complete, packed).otherwise(F.raise_error(F.lit("a row that claims a key has no priority or no ordinal")))


def _claims(keyed: DataFrame) -> DataFrame:
    """The rows that claim a key, with their row id."""
    return keyed.where(F.col("dkey").isNotNull()).withColumn("_cf_id", _row_id(keyed))


def winner_ids(keyed: DataFrame) -> DataFrame:
    """(dkey, row id) of the winning row of each key: its smallest row id."""
    return _claims(keyed).groupBy("dkey").agg(F.min("_cf_id").alias("_cf_id"))


def _keyed(checked: DataFrame, text_col: str, keyed: bool) -> DataFrame:
    """The frame is read twice (aggregate, join back), and a predicate on the
    key would be pushed below the text work: write it once, if it isn't yet."""
    return checked if keyed else cut_lineage(with_dedup_key(checked, text_col), "keyed")


def annotate_duplicates(checked: DataFrame, text_col: str = "ko", keyed: bool = False) -> DataFrame:
    """D2 annotating form: reason becomes 'dup' for claimants that lost.
    ``keyed=True`` when ``checked`` already has ``dkey`` and was materialised
    (``session.cut_lineage``), so that the text work and the UDF run once."""
    rows = _keyed(checked, text_col, keyed)
    wins = winner_ids(rows).withColumn("_cf_win", F.lit(True))
    claim = F.when(F.col("dkey").isNotNull(), _row_id(rows))
    joined = rows.withColumn("_cf_id", claim).join(wins, ["dkey", "_cf_id"], "left")
    lost = F.col("reason").isNull() & F.col("_cf_win").isNull()
    return joined.withColumn("reason", F.when(lost, F.lit("dup")).otherwise(F.col("reason"))).select(*rows.columns)


def dedup_winners(checked: DataFrame, payload: list[str], text_col: str = "ko", keyed: bool = False) -> DataFrame:
    """D2 filter form: (dkey, priority, ord, payload...) of the surviving rows."""
    rows = _keyed(checked, text_col, keyed)
    cols = ["priority", "ord"] + [c for c in payload if c not in ("priority", "ord")]
    won = _claims(rows).join(winner_ids(rows), ["dkey", "_cf_id"], "left_semi")
    return won.select("dkey", *cols)
