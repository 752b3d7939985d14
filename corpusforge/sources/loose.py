"""JSON whose values have no fixed types (P1, P4, P15 row by row).

A line is one VARIANT: the type of a value is known in its own row, so a
number or an object where text is expected is told apart from text, and a
missing key from a null. Nothing is inferred from other rows, and no scan
precedes the read.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The column that holds a line of a loose source.
LINE = "_json"


def json_path(path: str) -> str:
    """The variant path of a dotted path, every part a quoted key."""
    return "$" + "".join(f"['{part}']" for part in path.split("."))


def json_type(row: Column, path: str) -> Column:
    """The type of the value at a dotted path: STRING, BIGINT, DECIMAL(..),
    DOUBLE, BOOLEAN, VOID (a JSON null), OBJECT<..>, ARRAY<..>; null where
    there is none."""
    return F.schema_of_variant(F.try_variant_get(row, json_path(path), "variant"))


def json_text(row: Column, path: str) -> Column:
    """The value at a dotted path if it is text, else null."""
    return F.when(json_type(row, path) == "STRING", F.try_variant_get(row, json_path(path), "string"))


def json_number(row: Column, path: str) -> Column:
    """The value at a dotted path as a double if it is a number or a truth value, else null."""
    kind = json_type(row, path)
    number = F.try_variant_get(row, json_path(path), "double")
    truth = F.try_variant_get(row, json_path(path), "boolean").cast("double")
    return F.when(kind == "BOOLEAN", truth).when(kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), number)


def json_has(row: Column, path: str) -> Column:
    """Whether there is a value at a dotted path (a JSON null is one)."""
    return json_type(row, path).isNotNull()


def json_keys(row: Column) -> Column:
    """The keys of a line's object, sorted (a variant keeps no order); null for other values."""
    return F.map_keys(F.try_variant_get(row, "$", "map<string,variant>"))
