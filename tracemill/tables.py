"""Tables of a data folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: White space at the ends of a spelling doesn't count.
WHITE = " \t\n\r\f\x0b"


def plain(column: Column) -> Column:
    """As spellings are looked up: trimmed, in lower case."""
    return F.lower(F.btrim(column, F.lit(WHITE)))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def meanings(spellings: DataFrame, field: str) -> DataFrame:
    """``written`` (trimmed, lower case) and ``means`` of one field, each spelling once."""
    return (
        spellings.where(F.col("field") == field)
        .groupBy(plain(F.col("written")).alias("written"))
        .agg(F.min("means").alias("means"))
    )


def spelled(df: DataFrame, column: str, spellings: DataFrame, field: str, into: str) -> DataFrame:
    """Add ``into``: what ``column`` means by the table of spellings; null if unlisted."""
    table = meanings(spellings, field).select(F.col("written").alias("__written"), F.col("means").alias(into))
    return df.join(table, plain(F.col(column)) == F.col("__written"), "left").drop("__written")
