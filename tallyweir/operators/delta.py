"""How a change of its inputs changes a node: the rules of incremental maintenance.

``old`` and ``new`` are the inputs' bags before and after, ``change`` their signed
differences, None for an input that doesn't change; ``own`` is the node's own bag
before. Each rule returns a signed, canonical difference. Joins, anti-joins and
groups meet the change by its keys, which Spark broadcasts if they are few; the bags
they meet are scanned, not sorted or summed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweir.functions.exact import checked
from tallyweir.operators.evaluate import filtered, joined, mapped, without
from tallyweir.operators.zset import W, negated, summed
from tallyweir.plans import ir


def _keys(*parts: tuple[DataFrame | None, int]) -> DataFrame:
    some = [df.select(F.col(f"c{key}").alias("k")) for df, key in parts if df is not None]
    out = some[0]
    for other in some[1:]:
        out = out.union(other)
    return out.distinct()


def _with_keys(df: DataFrame, key: int, keys: DataFrame) -> DataFrame:
    return df.join(keys, df[f"c{key}"] == keys["k"], "left_semi")


def join_change(node: ir.Join, old: list[DataFrame], new: list[DataFrame], change: list[DataFrame | None]) -> DataFrame:
    parts = []
    if change[0] is not None:
        parts.append(joined(change[0], old[1], node))
    if change[1] is not None:
        parts.append(joined(new[0], change[1], node))
    return summed(parts[0] if len(parts) == 1 else parts[0].union(parts[1]))


def anti_change(node: ir.Anti, new: list[DataFrame], change: list[DataFrame | None], own: DataFrame) -> DataFrame:
    keys = _keys((change[0], node.left_key), (change[1], node.right_key))
    gone = negated(_with_keys(own, node.left_key, keys))
    come = without(_with_keys(new[0], node.left_key, keys), new[1], node.left_key, node.right_key)
    return summed(gone.union(come))


def group_change(node: ir.Group, change: DataFrame, own: DataFrame) -> DataFrame:
    value = checked(node.value, lambda i: F.col(f"c{i}")).cast(T.DecimalType(19, 0))
    moved = change.select(F.col(f"c{node.key}").alias("k"), (value * F.col(W).cast(T.DecimalType(19, 0))).alias("s"), F.col(W).cast(T.DecimalType(38, 0)).alias("n")).groupBy("k").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    before = own.select("c0", "c1", "c2")
    both = moved.join(before, moved["k"] == before["c0"], "left")
    both = both.select("k", "c0", "c1", "c2", (F.coalesce(F.col("c1"), F.lit(0)).cast(T.DecimalType(38, 0)) + F.col("s")).cast("long").alias("s"), (F.coalesce(F.col("c2"), F.lit(0)).cast(T.DecimalType(38, 0)) + F.col("n")).cast("long").alias("n"))
    one = F.lit(1).cast("long")
    gone = both.filter("c0 IS NOT NULL").select("c0", "c1", "c2", (-one).alias(W))
    come = both.filter("n <> 0").select(F.col("k").alias("c0"), F.col("s").alias("c1"), F.when(F.col("n") < 0, F.raise_error(F.lit("a group's count fell below zero")).cast("long")).otherwise(F.col("n")).alias("c2"), one.alias(W))
    return summed(gone.union(come))


def changed(node: ir.Node, old: list[DataFrame], new: list[DataFrame], change: list[DataFrame | None], own: DataFrame) -> DataFrame:
    match node:
        case ir.Map():
            return summed(mapped(change[0], node.exprs))
        case ir.Filter():
            return filtered(change[0], node)
        case ir.Union():
            some = [c for c in change if c is not None]
            return summed(some[0] if len(some) == 1 else some[0].union(some[1]))
        case ir.Join():
            return join_change(node, old, new, change)
        case ir.Anti():
            return anti_change(node, new, change, own)
        case ir.Group():
            return group_change(node, change[0], own)
    raise TypeError(f"no rule for {node}")
