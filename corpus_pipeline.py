"""The corpus pipeline: stages over ``documents``, each written and read again by its caller.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweir.llm import bpe, decontamination, near_dedup, pii, toxicity
from tallyweir.llm.common import free_name, stored, table
from tallyweir.llm.queries import tokenizer_path


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity machine rejects go; all others stay as they are."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs.columns, "score")
    return toxicity.score(docs, model, score).filter(F.col(score) < 0.5).drop(score)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, a similarity of 0.8 or more."""
    kept = stored(near_dedup.chosen(docs, threshold=0.8, n=5).withColumnsRenamed({"doc_id": "kept_id", "digest": "kept_digest"}), "kept")

    def same(of: DataFrame, how: str) -> DataFrame:
        return marked.join(of.select("kept_id", "kept_digest"), F.col("doc_id").eqNullSafe(F.col("kept_id")) & (F.col(digest) == F.col("kept_digest")), how)

    digest = free_name([*docs.columns, "kept_digest"], "digest")
    marked = docs.withColumn(digest, near_dedup.text_digest(F.col("text")))
    marked = out = same(kept, "left_semi")
    # rows that repeat an id and a text are rare: only they are moved to keep one of each
    repeated = kept.filter("copies > 1")
    if repeated.limit(1).count():
        once = same(repeated, "left_semi").dropDuplicates(["doc_id", digest])
        out = same(repeated, "left_anti").unionByName(once)
    return out.drop(digest)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    return decontamination.cleaned(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data becomes its kind in brackets."""
    return pii.redacted(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids and the text that they decode to."""
    return bpe.round_trip(docs.select("doc_id", "text"), tokenizer_path()).select("doc_id", "ids", "decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxic_out),
    ("near-duplicates", one_of_each),
    ("decontamination", without_benchmark),
    ("personal data", without_personal_data),
    ("bpe", encoded),
]

#: Models, sketches and token ids are beyond SQL; tests hold the run against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, "stage")
    return docs
