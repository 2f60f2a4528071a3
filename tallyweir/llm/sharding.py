"""Sharding by histogram sort: exact counts below candidate keys, refined until splitters fit, one exchange.

Rows are ordered by a 63-bit key: 27 bits of the text's hash, 24 of the id's hash
and 12 that tell repeated rows apart, so equal texts lie side by side and yet a
group of copies of any size can be cut. Each round counts the exact bytes and
rows in the sub-ranges of every range that still holds a wanted splitter; a
splitter is fixed once the bytes below a candidate are near enough: for a border of
shards within ``tolerance`` of a shard's share, for a border of fragments within a
quarter of a fragment's. A round brings at most ``MOST_BINS`` bins to the driver, or
two for each range. Shards are cut into fragments by more splitters, as many as it takes for
about ``FRAGMENT_ROWS`` rows each, and the counts fix where each fragment's slots
begin, so rows cross the network once, in as many tasks as there are fragments, and
no task holds a shard.

The keys are written once to the shared folder (no texts), so every round and the
exchange see the same keys whatever executor is lost.

Defined cases: a null text is the empty text; null ids are ids like any other;
repeated rows get slots of their own; an empty table gives no rows; other columns
are ignored unless named in ``carry``, and a carried column whose name is one of
the result's gets underscores.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallyweir.llm.common import free_name, in_arrow, stored

KEY_BITS, MOST_BINS, FRAGMENT_ROWS, MOST_FRAGMENTS = 63, 1 << 20, 500_000, 1 << 12
RESULT = ("doc_id", "size", "text_crc32", "shard", "slot")


def keyed(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, size, text_crc32 and key of each row, and the columns to carry."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    mask = lambda h, bits: F.shiftrightunsigned(h, 64 - bits)
    key = (
        F.shiftleft(mask(F.xxhash64(text), 27), 36)
        .bitwiseOR(F.shiftleft(mask(F.xxhash64(F.lit("id"), F.col("doc_id")), 24), 12))
        .bitwiseOR(mask(F.xxhash64(F.lit("row"), F.monotonically_increasing_id()), 12))
    )
    names, carried = list(RESULT), []
    for c in carry:
        names.append(free_name(names, c))
        carried.append(F.col(f"`{c}`").alias(names[-1]))
    held = [F.struct(*carried).alias("carried")] if carried else []
    return docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), key.alias("key"), *held)


def splitters(rows: DataFrame, shards: int, fragments: int | None = None, tolerance: float = 0.001) -> tuple[list[int], list[int]]:
    """The splitters between ``shards`` times some fragments, as the least keys of the ranges, and the rows in each range."""
    total = rows.agg(F.sum("size").alias("b"), F.count("*").alias("n")).first()
    if not total.n:
        return [], []
    if fragments is None:
        fragments = max(8, min(MOST_FRAGMENTS, -(-total.n // (shards * FRAGMENT_ROWS))))
    parts = shards * fragments
    wanted = {t: total.b * t / parts for t in range(1, parts)}  # bytes below each splitter
    slack = {t: tolerance * total.b / shards if t % fragments == 0 else 0.25 * total.b / parts for t in wanted}
    found: dict[int, tuple[int, int]] = {}  # splitter to (least key, rows below)
    # ranges of 2^wide keys that hold wanted splitters: least key to (bytes below, rows below, splitters)
    open_ranges: dict[int, tuple[int, int, list[int]]] = {0: (0, 0, list(wanted))}
    wide = KEY_BITS
    while open_ranges:
        digit = min(12, max(1, (MOST_BINS // len(open_ranges)).bit_length() - 1), wide)
        shift = wide - digit
        inside = rows if wide == KEY_BITS else rows.filter(_within(F.shiftright("key", wide), sorted(k >> wide for k in open_ranges)))
        counted: dict[int, list[tuple[int, int, int]]] = {}
        for r in inside.groupBy(F.shiftright("key", shift).alias("bin")).agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():  # MOST_BINS at most, or two a range
            counted.setdefault(r.bin << shift >> wide << wide, []).append((r.bin << shift, r.b, r.n))
        following: dict[int, tuple[int, int, list[int]]] = {}
        for least, (b, n, targets) in open_ranges.items():
            for start, in_bin, rows_in_bin in sorted(counted.get(least, [])):
                rest = []
                for t in targets:
                    if wanted[t] >= b + in_bin + slack[t] and wanted[t] < total.b:
                        rest.append(t)
                    elif abs(wanted[t] - b) <= slack[t] or (shift == 0 and wanted[t] - b <= in_bin / 2):
                        found[t] = (start, n)
                    elif abs(b + in_bin - wanted[t]) <= slack[t] or shift == 0:
                        found[t] = (start + (1 << shift), n + rows_in_bin)
                    else:
                        following.setdefault(start, (b, n, []))[2].append(t)
                targets, b, n = rest, b + in_bin, n + rows_in_bin
            for t in targets:
                found[t] = (least + (1 << wide), n)
        open_ranges, wide = following, shift
    below, cut, last = [0], [], 0
    for t in range(1, parts):
        least, n = found[t]
        if least < last:
            least, n = last, below[-1]
        cut.append(least)
        below.append(n)
        last = least
    below.append(total.n)
    return [min(c, (1 << KEY_BITS) - 1) for c in cut], [b - a for a, b in zip(below, below[1:], strict=False)]


def _within(value: Column, sorted_values: Sequence[int]) -> Column:
    """Whether a value is one of some sorted ones; many are tested by the runs of neighbours that they form."""
    runs: list[list[int]] = []
    for v in sorted_values:
        if runs and v == runs[-1][1] + 1:
            runs[-1][1] = v
        else:
            runs.append([v, v])
    if len(runs) > 64:
        return value.isin(list(sorted_values))
    out = F.lit(False)
    for a, b in runs:
        out = out | value.between(a, b)
    return out


def sharded(docs: DataFrame, shards: int = 16, fragments: int | None = None, tolerance: float = 0.001, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row, and the carried columns."""
    rows = stored(keyed(docs, carry), "shard-keys")
    cut, counts = splitters(rows, shards, fragments, tolerance)
    fragments = max(1, len(counts) // shards)
    begins = np.zeros(max(len(counts), 1), np.int64)
    if counts:
        begins = (np.cumsum(counts) - counts).astype(np.int64)
        begins -= np.repeat(begins[::fragments], fragments)
    sent = docs.sparkSession.sparkContext.broadcast((np.array(cut, np.int64), begins))  # 16 bytes a fragment
    at = rows.columns.index("key")

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        borders, first = sent.value
        for batch in batches:
            fragment = np.searchsorted(borders, batch.column(at).to_numpy(), "right")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fragment, pa.int32()), pa.array(first[fragment])], names=[*batch.schema.names, "fragment", "first"])

    dealt = in_arrow(rows, placed, T.StructType([*rows.schema.fields, T.StructField("fragment", T.IntegerType()), T.StructField("first", T.LongType())]))
    order = Window.partitionBy("fragment").orderBy("key", "doc_id", "text_crc32")
    result = dealt.withColumn("place", F.row_number().over(order) - 1)
    shown = ["carried.*"] if carry else []
    return result.select("doc_id", "size", "text_crc32", F.floor(F.col("fragment") / fragments).cast("int").alias("shard"), (F.col("first") + F.col("place")).cast("long").alias("slot"), *shown)
