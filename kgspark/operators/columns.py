"""Column verbs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _require(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not in table: {missing}")


def select(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    _require(df, columns)
    return df.select(*columns)


def rename(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed(columns)


def drop(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    _require(df, columns)
    return df.drop(*columns)


def copy(df: DataFrame, to: str, column: str) -> DataFrame:
    return df.withColumn(to, F.col(column))


def fill(df: DataFrame, to: str, value) -> DataFrame:
    return df.withColumn(to, F.lit(value))


def fill_null(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    return df.na.fill(defaults)


def unroll(df: DataFrame, column: str) -> DataFrame:
    """One row per list item; a row with a null or empty list stays, with null."""
    return df.withColumn(column, F.explode_outer(column))


def zip_struct(df: DataFrame, to: str, columns: Sequence[str]) -> DataFrame:
    return df.withColumn(to, F.struct(*columns))


def zip_map(df: DataFrame, to: str, keys: str, values: str) -> DataFrame:
    """Map from a key list and a value list of equal length; the later key wins."""
    same = F.size(keys) == F.size(values)
    message = F.lit(f"{keys} and {values} differ in length")
    joined = F.map_from_entries(F.arrays_zip(F.col(keys).alias("k"), F.col(values).alias("v")))
    return df.withColumn(to, F.when(same, joined).otherwise(F.raise_error(message)))


def unzip(df: DataFrame, column: str, to: Sequence[str]) -> DataFrame:
    """Struct fields by position into the columns ``to``."""
    fields = df.schema[column].dataType.fieldNames()
    return df.withColumns({t: F.col(column)[f] for t, f in zip(to, fields, strict=True)})


def text_of(df: DataFrame, column: str) -> Column:
    """Text of a value: lower-case booleans, integral floats without fraction."""
    kind = df.schema[column].dataType
    c = F.col(column)
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(c == F.floor(c), c.cast("long").cast("string")).otherwise(c.cast("string"))
    return c.cast("string")


def merge(
    df: DataFrame,
    to: str,
    columns: Sequence[str],
    strategy: str = "first one wins",
    delimiter: str = "",
    preserve_source: bool = False,
    as_array: bool = False,
) -> DataFrame:
    """Merge several columns into one."""
    texts = [text_of(df, c) for c in columns]
    if strategy == "first one wins":
        merged = F.coalesce(*[F.col(c) for c in columns])
    elif strategy == "last one wins":
        merged = F.coalesce(*[F.col(c) for c in reversed(columns)])
    elif strategy == "concat":
        merged = F.concat_ws(delimiter, *texts)
    elif strategy == "array":
        merged = F.array_compact(F.array(*texts)) if as_array else F.concat_ws(",", *texts)
    else:
        raise ValueError(f"unknown merge strategy: {strategy}")
    out = df.withColumn(to, merged)
    return out if preserve_source else out.drop(*[c for c in columns if c != to])


def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def bool_combine(columns: Sequence[Column], operator: str) -> Column:
    """Combine boolean columns of a row; parity for xor / xnor."""
    if operator in ("or", "nor"):
        c = reduce(lambda a, b: a | b, columns)
    elif operator in ("and", "nand"):
        c = reduce(lambda a, b: a & b, columns)
    elif operator in ("xor", "xnor"):
        c = reduce(lambda a, b: a + b, [x.cast("int") for x in columns]) % 2 == 1
    else:
        raise ValueError(f"unknown operator: {operator}")
    return ~c if operator in ("nor", "nand", "xnor") else c


def node_details(df: DataFrame, to: str = "node_details") -> DataFrame:
    """One struct of the four node fields, missing descriptions named as such."""
    filled = df.na.fill({"description": "No Description"})
    return filled.withColumn(to, F.struct("human_readable_id", "title", "description", "degree"))


def edge_details(df: DataFrame, to: str = "edge_details") -> DataFrame:
    """One struct of the five edge fields."""
    filled = df.na.fill({"description": "No Description"})
    return filled.withColumn(to, F.struct("human_readable_id", "source", "target", "description", "rank"))
