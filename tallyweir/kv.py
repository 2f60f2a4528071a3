"""The key/value surface: rows of (key, value, text of at most 31 bytes), staged and flushed in batches."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweir.functions.exact import LEAST, MOST
from tallyweir.operators.zset import W, of_rows, summed
from tallyweir.sources.store import Store, tail

TEXT_BYTES = 31
MOST_FRAGMENTS = 8
SCHEMA = T.StructType([T.StructField("key", T.LongType()), T.StructField("value", T.LongType()), T.StructField("text", T.StringType()), T.StructField(W, T.LongType())])


@dataclass(frozen=True)
class Row:
    key: int
    value: int
    text: str = ""

    def __post_init__(self) -> None:
        for v in (self.key, self.value):
            if type(v) is not int:
                raise TypeError("keys and values are integers")
            if not LEAST <= v <= MOST:
                raise OverflowError("an integer exceeds 64 bits")
        if not isinstance(self.text, str):
            raise TypeError("a text is a string")
        if len(self.text.encode()) > TEXT_BYTES:
            raise ValueError("a text has at most 31 bytes")


class KeyValue:
    """Point reads see staged rows first; a commit writes the net change as one fragment, and nothing if there is none."""

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.store = spark, Store(spark, path)
        found = self.store.recover()
        self._fragments: tuple[str, ...] = tuple(found["bags"]["kv"]) if found else ()
        self._rows: tuple[int, ...] = tuple(found["rows"]["kv"]) if found else ()
        self._staged: dict[int, Row | None] = {}
        self._held: dict[int, Row | None] = {}  # what the touched keys are in the committed state
        self._open = False

    def frame(self) -> DataFrame:
        """Committed rows, distributed."""
        if not self._fragments:
            return of_rows(self.spark, [], SCHEMA)
        return summed(self.store.read(self._fragments, SCHEMA))

    def _committed(self, key: int) -> Row | None:
        if key not in self._held:
            if not self._fragments:
                return None
            # the filter reaches the scan of every fragment
            parts = summed(self.store.read(self._fragments, SCHEMA).filter(F.col("key") == key)).collect()
            self._held[key] = Row(parts[0]["key"], parts[0]["value"], parts[0]["text"]) if parts else None
        return self._held[key]

    def _now(self, key: int) -> Row | None:
        return self._staged[key] if key in self._staged else self._committed(key)

    def insert(self, key: int, value: int, text: str = "") -> None:
        row = Row(key, value, text)
        if self._now(key) is not None:
            raise ValueError(f"key {key} exists")
        self._stage(key, row)

    def get(self, key: int) -> Row:
        row = self._now(key)
        if row is None:
            raise KeyError(key)
        return row

    def update(self, key: int, value: int | None = None, text: str | None = None) -> None:
        row = self.get(key)
        self._stage(key, Row(key, row.value if value is None else value, row.text if text is None else text))

    def delete(self, key: int) -> None:
        self.get(key)
        self._stage(key, None)

    def insert_frame(self, rows: DataFrame) -> None:
        """A batch of any size at once; keys that exist, or twice, and texts that are too long are errors."""
        if self._open or self._staged:
            raise RuntimeError("a frame is inserted outside transactions")
        long = rows.select(F.col("key").cast("long"), F.col("value").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
        if long.filter(F.col("key").isNull() | F.col("value").isNull() | (F.octet_length("text") > TEXT_BYTES)).limit(1).count():
            raise ValueError("rows need keys, values and texts of at most 31 bytes")
        everything = long.select("key").union(self.frame().select("key"))
        if everything.groupBy("key").count().filter("count > 1").limit(1).count():
            raise ValueError("a key exists")
        self._write(long.withColumn(W, F.lit(1).cast("long")))

    def __len__(self) -> int:
        change = sum((row is not None) - (self._committed(key) is not None) for key, row in self._staged.items())
        return self.frame().count() + change

    def _stage(self, key: int, row: Row | None) -> None:
        self._committed(key)
        self._staged[key] = row
        if not self._open:
            self._commit()

    def _commit(self) -> None:
        change = []
        for key, row in self._staged.items():
            before = self._committed(key)
            if before != row:
                change += [(r.key, r.value, r.text, w) for r, w in ((before, -1), (row, 1)) if r is not None]
        self._staged = {}
        if change:
            self._write(of_rows(self.spark, change, SCHEMA).coalesce(1))

    def _write(self, change: DataFrame) -> None:
        path, n = self.store.write_counted(change)
        fragments, rows = (*self._fragments, path), (*self._rows, n)
        if len(fragments) > MOST_FRAGMENTS:  # the newest changes are merged with each other, the base only by a checkpoint
            at = tail(rows, 1)
            path, n = self.store.write_counted(summed(self.store.read(fragments[at:], SCHEMA)))
            fragments, rows = (*fragments[:at], path), (*rows[:at], n)
        self._publish(fragments, rows)

    def _publish(self, fragments: tuple[str, ...], rows: tuple[int, ...]) -> None:
        self.store.publish({"bags": {"kv": list(fragments)}, "rows": {"kv": list(rows)}})
        self._fragments, self._rows, self._held = fragments, rows, {}

    @contextmanager
    def transaction(self) -> Iterator[KeyValue]:
        """All or nothing; a caught validation error does not undo it."""
        if self._open:
            raise RuntimeError("a transaction is open")
        self._open = True
        try:
            yield self
            self._commit()
        finally:
            self._staged, self._open = {}, False

    def checkpoint(self) -> None:
        if self._open:
            raise RuntimeError("no checkpoint in a transaction")
        if len(self._fragments) > 1:
            path, n = self.store.write_counted(self.frame())
            self._publish((path,), (n,))
            self.store.sweep({path})

    def close(self) -> None:
        self.store.close()
