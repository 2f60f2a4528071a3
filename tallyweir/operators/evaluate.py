"""A graph node from its inputs' bags, from scratch; Catalyst chooses how."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweir.functions.exact import checked, wide_sum
from tallyweir.operators.zset import W, names, summed
from tallyweir.plans import ir

_WEIGHT = T.DecimalType(19, 0)


def compare(left: Column, cmp: str, right: Column) -> Column:
    return {"lt": left < right, "le": left <= right, "eq": left == right, "ne": left != right, "ge": left >= right, "gt": left > right}[cmp]


def mapped(df: DataFrame, exprs: tuple[ir.Expr, ...]) -> DataFrame:
    return df.select(*(checked(e, lambda i: F.col(f"c{i}")).alias(f"c{k}") for k, e in enumerate(exprs)), W)


def filtered(df: DataFrame, node: ir.Filter) -> DataFrame:
    right = F.col(f"c{node.right_column}") if node.right_column is not None else F.lit(node.value)
    return df.filter(compare(F.col(f"c{node.column}"), node.cmp, right))


def joined(left: DataFrame, right: DataFrame, node: ir.Join) -> DataFrame:
    """Rows side by side, weights multiplied; as weights may pass 64 bits on the way, they stay wide."""
    width = node.left.width
    other = right.select(*(F.col(f"c{i}").alias(f"c{width + i}") for i in range(node.right.width)), F.col(W).alias("v"))
    both = left.join(other, left[f"c{node.left_key}"] == other[f"c{width + node.right_key}"])
    return both.select(*names(node.width), (F.col(W).cast(_WEIGHT) * F.col("v").cast(_WEIGHT)).alias(W))


def without(left: DataFrame, right: DataFrame, left_key: int, right_key: int) -> DataFrame:
    """Rows whose key is not present on the right; weights there don't matter."""
    present = right.select(F.col(f"c{right_key}").alias("k"))
    return left.join(present, left[f"c{left_key}"] == present["k"], "left_anti")


def grouped(df: DataFrame, node: ir.Group) -> DataFrame:
    value = checked(node.value, lambda i: F.col(f"c{i}"))
    of = df.select(F.col(f"c{node.key}").alias("c0"), value.alias("x"), W)
    total = of.groupBy("c0").agg(wide_sum(F.col("x"), of.schema["x"].dataType, F.col(W)).alias("c1"), F.sum(F.col(W).cast(T.DecimalType(38, 0))).cast("long").alias("c2"))
    return total.withColumn(W, F.lit(1).cast("long"))


def evaluated(node: ir.Node, inputs: list[DataFrame]) -> DataFrame:
    """The canonical bag of a node whose inputs' bags are canonical; where keys survive, no rows can fall together."""
    match node:
        case ir.Map():
            out = mapped(inputs[0], node.exprs)
            return out if ir.keyed(node) else summed(out)
        case ir.Filter():
            return filtered(inputs[0], node)
        case ir.Join():
            out = joined(inputs[0], inputs[1], node)
            return out.withColumn(W, F.col(W).cast("long")) if ir.keyed(node) else summed(out)
        case ir.Anti():
            return without(inputs[0], inputs[1], node.left_key, node.right_key)
        case ir.Group():
            return grouped(inputs[0], node)
        case ir.Union():
            return summed(inputs[0].union(inputs[1]))
    raise TypeError(f"no rule for {node}")
