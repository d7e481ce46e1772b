"""CSV and JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = False
) -> DataFrame:
    """CSV with a header. Text columns without a schema.

    With ``multi_line`` quoted cells may hold line breaks; a file is then read by one task.
    """
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def read_csv_shards(
    spark: SparkSession, folder: str, name_pattern: str, schema: T.StructType | str | None = None, multi_line: bool = False
) -> DataFrame:
    """CSV files (or folders of parts) whose name fits a pattern with one number group, with that number as ``file_idx``."""
    everything = read_csv(spark, f"{folder.rstrip('/')}/*.csv", schema, multi_line)
    number = F.regexp_extract(F.col("_metadata.file_path"), name_pattern, 1)
    return everything.withColumn("file_idx", number.try_cast("int")).filter(F.col("file_idx").isNotNull())


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def read_nested_json(
    spark: SparkSession, path: str, array_field: str, schema: T.StructType | str | None = None, multi_line: bool = False
) -> DataFrame:
    """Rows of one array field of JSON documents, its struct fields as columns.

    A line is a document; with ``multi_line`` a file is, and one task reads it.
    """
    reader = spark.read.option("multiLine", multi_line)
    docs = (reader.schema(schema) if schema else reader).json(path)
    return docs.select(F.explode(array_field).alias("item")).select("item.*")
