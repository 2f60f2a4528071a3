"""Streams of signed changes into maintained relations: a micro-batch is a transaction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tallyweir.database import Database
from tallyweir.operators.zset import W, names


def applier(database: Database, table: str, stream: str | None = None) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``: rows of the table's columns, with a weight ``w`` or weighing 1 each.

    The number of the last batch of ``stream`` (by default, the table's name) is
    published in one with the batch, so a batch that comes again, after a restart
    as well if the database has a path, is told by its number and skipped.
    """
    name = stream or table

    def apply(batch: DataFrame, number: int) -> None:
        if number <= database.streams.get(name, -1):
            return
        width = len(database.catalog.tables[table])
        weighted = batch if W in batch.columns else batch.selectExpr("*", f"CAST(1 AS BIGINT) AS {W}")
        database.change({table: weighted.toDF(*names(width), W)}, stream=(name, number))

    return apply
