"""Helpers the operators share: shared scratch tables, column hygiene, folds of documents."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only on a local master without such a setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = getattr(spark, "_tallyweir_shared_dir", None)
    if own is None:
        own = "file://" + tempfile.mkdtemp(prefix="tallyweir-")
        spark._tallyweir_shared_dir = own
    return own


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back.

    This cuts lineage, fixes values that a second evaluation might not repeat
    (row numbers, block numbers), and survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that ``stored`` wrote, as soon as nothing reads it any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def shipped(spark: SparkSession) -> None:
    """Sends this package to the executors once a context, so that they need no path of the driver's."""
    context = spark.sparkContext
    if not getattr(context, "_tallyweir_shipped", False):
        package = Path(__file__).resolve().parent.parent
        if package.is_dir():
            folder = tempfile.mkdtemp(prefix="tallyweir-code-")
            context.addPyFile(shutil.make_archive(f"{folder}/{package.name}", "zip", package.parent, package.name))
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
        context._tallyweir_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    shipped(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def in_arrow(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: Any, keeps: str | None = None) -> DataFrame:
    """``mapInArrow`` in batches of bounded bytes; the worker first forgets what other operators left, ``keeps`` aside."""
    bounded_batches(df.sparkSession)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget(keeps)
        yield from rows(batches)
        give_back()

    return df.mapInArrow(tidy, schema)


def forget(keeps: str | None = None) -> None:
    """Drops what ``worker_memory`` holds, one name aside; workers outlive tasks and serve every operator in turn."""
    others = [name for name in _MEMORY if name != keeps]
    for name in others:
        del _MEMORY[name]
    if others:
        give_back()


def give_back() -> None:
    """Returns free memory of this worker to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def bounded_batches(spark: SparkSession) -> None:
    """Batches between JVM and Python of ``BATCH_BYTES``, unless the session says otherwise; rows alone don't bound them."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if name not in spark.conf.getAll:
        spark.conf.set(name, str(BATCH_BYTES))


def slices(batch: pa.RecordBatch, at: int, most: int, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``most`` bytes of the string or binary column ``at``, one row at least."""
    raw = batch.column(at).cast(pa.large_binary())
    size = np.diff(np.frombuffer(raw.buffers()[1], np.int64, len(raw) + 1, raw.offset * 8)) if len(raw) else np.zeros(0, np.int64)
    cut = np.flatnonzero(np.diff(np.cumsum(size + most // rows) // most, prepend=0)).tolist()
    for a, b in zip([0, *cut], [*cut, len(raw)], strict=True):
        if a < b:
            yield batch.slice(a, b - a)


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def free_name(taken: Iterable[str], wanted: str) -> str:
    """``wanted``, or that with underscores, so that it clashes with no column (case aside)."""
    lowered = {name.lower() for name in taken}
    while wanted.lower() in lowered:
        wanted += "_"
    return wanted


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, max_chars: int) -> DataFrame:
    """At most ``rows`` labelled training rows as (doc_id, text, y, n_chars), chosen by a hash of the id.

    Only ids outside the held-out fold (crc32 mod 5 = 0) are eligible, and only
    texts of up to ``max_chars`` characters, so that what a fit holds is bounded.
    Null ids, null labels and unlabelled rows are left out; of several labels of
    one id the largest counts; of several rows of one id one is taken.
    """
    chosen = (
        labels.select(F.col("doc_id").alias("id"), F.col(label).cast("int").alias("y"))
        .filter(F.col("id").isNotNull() & F.col("y").isin(0, 1) & (fold(F.col("id"), 5) != 0))
        .groupBy("id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(rows)
    )
    n_chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")
    texts = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), n_chars.alias("n_chars"))
    # the sample is bounded by ``rows``: 12 bytes a row to broadcast
    return texts.filter(F.length("text") <= max_chars).join(F.broadcast(chosen), "id").groupBy("id").agg(F.min(F.struct("text", "y", "n_chars")).alias("r")).select(F.col("id").alias("doc_id"), "r.text", "r.y", "r.n_chars")


class Remembered(dict):
    """Values by key, worked out when first asked for; old ones are forgotten so that about ``2 * most`` bytes stay.

    When ``most`` bytes are held they become the older generation, from which a
    key that is asked for again returns to the younger. Long keys are not kept.
    """

    def __init__(self, work: Callable[[Any], Any], most: int, longest: int = 256):
        super().__init__()
        self._work, self._most, self._longest, self._held, self._older = work, most, longest, 0, {}

    def __missing__(self, key: Any) -> Any:
        if len(key) > self._longest:
            return self._work(key)
        value = self._older.get(key)
        if value is None:
            value = self._work(key)
        if self._held > self._most:
            self._older, self._held = self.copy(), 0
            self.clear()
        self[key] = value
        # an object of Python's takes about 50 bytes beside its content, an entry of a dict about 100
        self._held += 200 + len(key) + (len(value) if isinstance(value, (bytes, str)) else 0)
        return value


_MEMORY: dict[str, Any] = {}


def worker_memory(name: str, make: Callable[[], Any]) -> Any:
    """What a worker keeps between tasks under a name; only the latest name's is kept."""
    if name not in _MEMORY:
        forget()
        _MEMORY[name] = make()
    return _MEMORY[name]


def read_text(path: str) -> str:
    """A small file that the driver reads."""
    return Path(path).read_text(encoding="utf-8")
