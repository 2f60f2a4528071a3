"""Weighted bags as DataFrames: columns c0..cn and a weight ``w``; a change may have negative weights."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

W = "w"


def names(width: int) -> list[str]:
    return [f"c{i}" for i in range(width)]


def schema(width: int) -> T.StructType:
    return T.StructType([*(T.StructField(n, T.LongType()) for n in names(width)), T.StructField(W, T.LongType())])


def of_rows(spark: SparkSession, rows: Iterable[tuple], kind: T.StructType) -> DataFrame:
    """(row..., weight) tuples that the caller holds anyway."""
    return spark.createDataFrame(list(rows), kind)


def summed(df: DataFrame) -> DataFrame:
    """Equal rows together, weights added exactly; what cancels out goes."""
    keys = [c for c in df.columns if c != W]
    total = F.sum(F.col(W).cast(T.DecimalType(38, 0))).cast("long")
    return df.groupBy(*keys).agg(total.alias(W)).filter(F.col(W) != 0).select(*keys, W)


def added(*parts: DataFrame) -> DataFrame:
    """The sum of bags by position; not yet canonical."""
    return reduce(lambda a, b: a.union(b), parts)


def negated(df: DataFrame) -> DataFrame:
    return df.withColumn(W, -F.col(W))


def expanded(df: DataFrame) -> DataFrame:
    """Each row as often as it weighs, without the weight; a weight below 1 is an error."""
    times = F.when(F.col(W) >= 1, F.col(W)).otherwise(F.raise_error(F.lit("a row's weight fell below one")).cast("long"))
    return df.withColumn(W, F.explode(F.sequence(F.lit(1).cast("long"), times))).drop(W)
