"""Ordered inserts, updates and deletes by key, folded to one signed change."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyweir.operators.zset import W, summed


def folded(base: DataFrame, operations: DataFrame) -> DataFrame:
    """The change that ``operations`` make to ``base``.

    ``operations`` has ``at`` (the order), ``op`` ('insert', 'update' or 'delete')
    and the columns of the bag; a delete needs the key c0 only. Later operations of
    a key see the earlier ones: inserting a key that is there, or updating or
    deleting one that isn't, is an error. Only rows with a touched key are read.
    """
    keys = [c for c in base.columns if c != W]
    touched = base.join(operations.select(F.col("c0").alias("k")).distinct(), base["c0"] == F.col("k"), "left_semi")
    order = Window.partitionBy("c0").orderBy("at")
    there = touched.select(F.col("c0").alias("k")).withColumn("there", F.lit(True))
    ranked = operations.join(there, operations["c0"] == there["k"], "left").drop("k")
    before = F.coalesce(F.lag("op").over(order), F.when(F.coalesce("there", F.lit(False)), F.lit("insert")).otherwise(F.lit("delete")))
    present = before != "delete"
    wrong = F.when((F.col("op") == "insert") & present, F.concat(F.lit("the key exists: "), F.col("c0").cast("string"))).when((F.col("op") != "insert") & ~present, F.concat(F.lit("the key is missing: "), F.col("c0").cast("string")))
    checked = ranked.withColumn("wrong", wrong).withColumn("op", F.when(F.col("wrong").isNotNull(), F.raise_error(F.col("wrong")).cast("string")).otherwise(F.col("op")))
    last = checked.withColumn("rank", F.row_number().over(Window.partitionBy("c0").orderBy(F.col("at").desc())))
    one = F.lit(1).cast("long")
    come = last.filter("rank = 1 AND op <> 'delete'").select(*keys, one.alias(W))
    return summed(touched.select(*keys, (-one).alias(W)).union(come))
