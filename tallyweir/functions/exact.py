"""Exact 64-bit integers: parameter checks, checked arithmetic and sums that overflow only in the result."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAST, MOST = -(1 << 63), (1 << 63) - 1
MAX_PARAMETERS = 8192
WIDE = T.DecimalType(38, 0)


def parameters(values: Sequence[int]) -> tuple[int, ...]:
    """Exactly int, within 64 bits; nothing is coerced."""
    if len(values) > MAX_PARAMETERS:
        raise ValueError("too many parameters")
    for value in values:
        if type(value) is not int:
            raise TypeError("parameters are integers")
        if not LEAST <= value <= MOST:
            raise OverflowError("a parameter exceeds 64 bits")
    return tuple(values)


def integral(kind: T.DataType) -> bool:
    return isinstance(kind, T.IntegralType)


def wide_sum(value: Column, kind: T.DataType, weight: Column | None = None) -> Column:
    """The sum of integers, weighted or not, checked for 64 bits only at its end; null over no rows.

    Without weights the thirds of each number (22, 21 and 21 bits) are summed as 64-bit
    integers, which costs little more than a plain sum and holds for a group of up to 2^41
    rows in all; with weights the products are summed as decimals.
    """
    if not integral(kind):
        return F.sum(value if weight is None else value * weight)
    if weight is None:
        long, mask = value.cast("long"), F.lit((1 << 21) - 1)
        high, middle, low = F.sum(F.shiftright(long, 42)), F.sum(F.shiftright(long, 21).bitwiseAND(mask)), F.sum(long.bitwiseAND(mask))
        return (high.cast(WIDE) * F.lit(1 << 42).cast(T.DecimalType(14, 0)) + middle.cast(WIDE) * F.lit(1 << 21).cast(T.DecimalType(14, 0)) + low.cast(WIDE)).cast("long")
    return F.sum(value.cast(T.DecimalType(19, 0)) * weight.cast(T.DecimalType(19, 0))).cast("long")


def checked(tokens: Sequence[str | int], column) -> Column:
    """A postfix expression over columns ``cN``, integers and ``+ - *``; every step is checked for 64 bits."""
    stack: list[Column] = []
    for token in tokens:
        if isinstance(token, int):
            stack.append(F.lit(token).cast("long"))
        elif token in ("+", "-", "*"):
            right, left = stack.pop(), stack.pop()
            # in ANSI mode these raise on overflow
            stack.append(left + right if token == "+" else left - right if token == "-" else left * right)
        else:
            stack.append(column(int(token[1:])))
    (out,) = stack
    return out
