"""Value conversion; a value that does not parse gives null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Digits allowed per radix, with the prefix Python's int() takes.
_INT_PATTERNS = {
    2: r"^\s*[+-]?(0[bB])?[01]+\s*$",
    8: r"^\s*[+-]?(0[oO])?[0-7]+\s*$",
    10: r"^\s*[+-]?[0-9]+\s*$",
    16: r"^\s*[+-]?(0[xX])?[0-9a-fA-F]+\s*$",
}


def to_boolean(c: Column) -> Column:
    return F.coalesce(F.lower(c.cast("string")) == "true", F.lit(False))


def to_int(c: Column, radix: int = 10) -> Column:
    if radix not in _INT_PATTERNS:
        raise ValueError(f"radix must be one of {sorted(_INT_PATTERNS)}")
    text = F.trim(c)
    valid = F.rlike(c, F.lit(_INT_PATTERNS[radix]))
    if radix == 10:
        return F.when(valid, text.try_cast("long"))
    negative = F.startswith(text, F.lit("-"))
    digits = F.regexp_replace(text, r"^[+-]?(0[xXoObB])?", "")
    number = F.conv(digits, radix, 10).try_cast("long")
    return F.when(valid, F.when(negative, -number).otherwise(number))


def auto_radix(df: DataFrame, column: str) -> int:
    """Radix from a look at the whole column: any 0x gives 16, any leading 0 gives 8, else 10."""
    c = F.lower(F.col(column))
    seen = df.agg(
        F.bool_or(F.startswith(c, F.lit("0x"))).alias("hex"), F.bool_or(F.startswith(c, F.lit("0"))).alias("oct")
    ).first()
    return 16 if seen["hex"] else 8 if seen["oct"] else 10


def to_float(c: Column) -> Column:
    return c.try_cast("double")


def to_string(df: DataFrame, column: str, pattern: str = "yyyy-MM-dd") -> Column:
    c, kind = F.col(column), df.schema[column].dataType
    if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, pattern)
    if isinstance(kind, T.BooleanType):
        c = F.lower(c.cast("string"))
    return F.coalesce(c.cast("string"), F.lit(""))


def to_date(df: DataFrame, column: str) -> Column:
    """Numbers are unix milliseconds, text is parsed."""
    c = F.col(column)
    if isinstance(df.schema[column].dataType, T.NumericType):
        return F.timestamp_millis(c.cast("long"))
    return F.try_to_timestamp(c)


def to_array(df: DataFrame, column: str, delimiter: str = ",") -> Column:
    c, kind = F.col(column), df.schema[column].dataType
    empty = F.array().cast(T.ArrayType(T.StringType()))
    if isinstance(kind, T.ArrayType):
        return F.coalesce(c, F.array().cast(kind))
    if isinstance(kind, T.StringType):
        return F.coalesce(F.split(c, quote(delimiter)), empty)
    return F.when(c.isNull(), F.array().cast(T.ArrayType(kind))).otherwise(F.array(c))


def quote(text: str) -> str:
    """A pattern that matches ``text`` literally."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def text_split(c: Column, separator: str = ",") -> Column:
    empty = F.array().cast(T.ArrayType(T.StringType()))
    return F.when(c == "", empty).otherwise(F.split(c, quote(separator)))


def convert(df: DataFrame, column: str, to: str, kind: str, radix: int | None = 10, pattern: str = "yyyy-MM-dd", delimiter: str = ",") -> DataFrame:
    """Convert one column; ``radix=None`` looks the radix up in the data."""
    if kind == "boolean":
        value = to_boolean(F.col(column))
    elif kind == "integer":
        value = to_int(F.col(column), radix if radix is not None else auto_radix(df, column))
    elif kind == "decimal":
        value = to_float(F.col(column))
    elif kind == "string":
        value = to_string(df, column, pattern)
    elif kind == "date":
        value = to_date(df, column)
    elif kind == "array":
        value = to_array(df, column, delimiter)
    else:
        raise ValueError(f"unknown type: {kind}")
    return df.withColumn(to, value)
