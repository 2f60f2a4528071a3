"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Words and pairs of neighbouring words are hashed into ``BUCKETS``. One pass over
all documents counts the raw corpus bucket by bucket, one over all trusted
documents in it (labelled of good quality) counts those; both become smoothed
multinomials. A document's score is the mean over its n-grams of
log(target / raw): its log-likelihood ratio, length-normalised. A second pass
scores every whole text and keeps those at or above a threshold that the trusted
documents' own scores fix, so equal texts get equal verdicts.

All of it is built-in functions: counts are combined before the shuffle, which
carries at most a row for each bucket and task; texts' buckets meet the trusted ids
by a shuffle, less most of those that a bitmap of fixed size rules out, and those of
the trusted ones are written once; the ratios are an array literal of
fixed size; scoring shuffles nothing.

Base figures of a text, with words as runs of other than ASCII white space:
n_words; word_chars, code points in words; n_symbols; n_dup_lines, lines with a
word that equal an earlier line; n_repeat_words, words in three-word windows
that stand twice or more in the text; base_failed, fewer than ``min_words``
words or more than half of them repeated.

Defined cases: null and empty texts have no words, fail the base rules and have a
score of 0; without trusted documents all ratios are 0 and the base rules alone
decide; repeated rows count and are judged each; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweir.llm.common import fold, stored

BUCKETS = 1 << 14
WORDS = 1 << 18
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def word_hashes(tokens: Column) -> Column:
    return F.transform(tokens, lambda w: F.xxhash64(w))


def ngram_buckets(hashes: Column) -> Column:
    """A bucket for each word and for each word with its right neighbour (at the end, none)."""
    single = F.transform(hashes, lambda h: F.shiftrightunsigned(h, 50).cast("int"))
    pairs = F.transform(hashes, lambda h, i: F.shiftrightunsigned(F.xxhash64(h, F.get(hashes, i + 1)), 50).cast("int"))
    return F.concat(single, pairs)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """All ids of good quality outside the held-out fold."""
    good = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), 5) != 0))
    return good.select(F.col("doc_id").alias("trusted_id")).distinct()


def trusted_buckets(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The n-gram buckets of each row of ``docs`` whose id is trusted, written once."""
    kind = docs.schema["doc_id"].dataType
    ids = trusted_ids(labels).select(F.col("trusted_id").try_cast(kind).alias("trusted_id"))
    # WORDS longs at most, however many ids: it only spares texts the shuffle, the join decides
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(64 * WORDS))
    bits = ids.select(place("trusted_id").alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(p & 63))")).alias("bits"))
    near = docs.select("doc_id", "text", place("doc_id").alias("p")).withColumn("word", F.shiftright("p", 6)).join(F.broadcast(bits), "word").filter(F.expr("shiftrightunsigned(bits, int(p & 63)) & 1 = 1"))
    # the hashes are a column of their own, as a lambda would evaluate them anew for every word; and they are made
    # where the texts are read, not in the few tasks that the join leaves
    hashed = near.select("doc_id", word_hashes(words(F.col("text"))).alias("h"))
    met = hashed.select("doc_id", ngram_buckets(F.col("h")).alias("buckets")).join(ids.hint("merge"), F.col("doc_id") == F.col("trusted_id"), "left_semi")
    return stored(met.select("buckets"), "trusted")


def _counted(buckets: DataFrame) -> list[int]:
    """How often each bucket stands in the rows."""
    out = [0] * BUCKETS
    # of the inner form Spark would infer a filter that hashes anew for every word
    for r in buckets.select(F.explode_outer("buckets").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")).collect():  # BUCKETS rows at most, and one for texts without words
        if r.bucket is not None:
            out[r.bucket] = r.n
    return out


def log_ratios(docs: DataFrame, labels: DataFrame, smoothing: float = 1.0, trusted: DataFrame | None = None) -> list[float]:
    """log(target / raw) of each bucket, from all documents; ``trusted`` are the trusted_buckets, if at hand."""
    target = _counted(trusted_buckets(docs, labels) if trusted is None else trusted)
    if not sum(target):
        return [0.0] * BUCKETS
    raw = _counted(docs.select(word_hashes(words(F.col("text"))).alias("h")).select(ngram_buckets(F.col("h")).alias("buckets")))
    of_raw, of_target = sum(raw) + smoothing * BUCKETS, sum(target) + smoothing * BUCKETS
    return [math.log((t + smoothing) / of_target) - math.log((r + smoothing) / of_raw) for t, r in zip(target, raw, strict=True)]


def with_repeats(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words, from the word hashes h: words covered by three-word windows that stand twice or more.

    Each step is a column of its own, as a lambda would evaluate an inlined step anew for every element.
    """
    steps = df.withColumn("windows", F.transform(F.slice("h", F.lit(1), F.greatest(F.size("h") - 2, F.lit(0))), lambda h, i: F.xxhash64(h, F.get("h", i + 1), F.get("h", i + 2))))
    steps = steps.withColumn("ordered", F.sort_array("windows"))
    steps = steps.withColumn("twice", F.array_distinct(F.filter("ordered", lambda h, i: (i > 0) & (h == F.get("ordered", i - 1)))))
    some = F.size("twice") > 0
    # with many different repeats, sorting places beside hashes keeps the work near linear
    many = F.size("twice") > 32
    steps = steps.withColumn("beside", F.when(many, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    found = F.when(many, F.sort_array(F.transform(F.filter("beside", lambda s, k: (s["h"] == F.get("beside", k - 1)["h"]) | (s["h"] == F.get("beside", k + 1)["h"])), lambda s: s["i"])))
    found = found.when(some, F.filter(F.transform("windows", lambda h, i: F.when(F.array_contains("twice", h), i)), lambda i: i.isNotNull()))
    steps = steps.withColumn("places", found)
    start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
    covered = F.aggregate("places", start, lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).alias("n"), p.alias("last")), lambda a: a["n"])
    return steps.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("windows", "ordered", "twice", "beside", "places")


def _score(buckets: str, n_words: Column, ratios: list[float]) -> Column:
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")  # folded to one literal
    total = F.aggregate(buckets, F.lit(0.0), lambda a, b: a + F.get(table, b))
    return F.when(n_words > 0, total / (2 * n_words)).otherwise(0.0)


def threshold(docs: DataFrame, labels: DataFrame, ratios: list[float], spread: float = 5.0, min_words: int = 50, trusted: DataFrame | None = None) -> float:
    """The mean score of the trusted documents that are long enough, less ``spread`` standard deviations."""
    read = trusted_buckets(docs, labels) if trusted is None else trusted
    n_words = (F.size("buckets") / 2).cast("int")  # a bucket for each word, and one for its pair
    r = read.filter(n_words >= min_words).select(_score("buckets", n_words, ratios).alias("s")).agg(F.avg("s").alias("m"), F.stddev_pop("s").alias("d")).first()
    return -math.inf if r.m is None else r.m - spread * r.d


def judged(docs: DataFrame, ratios: list[float], least: float, min_words: int = 50) -> DataFrame:
    """doc_id, the base figures, base_failed, kept and score of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select("doc_id", text.alias("text"), words(F.col("text")).alias("w")).withColumn("h", word_hashes(F.col("w")))
    read = with_repeats(read).withColumn("buckets", ngram_buckets(F.col("h"))).withColumn("lines", F.when(F.contains("text", F.lit("\n")), F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))))
    figures = read.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.coalesce(F.size("lines") - F.size(F.array_distinct("lines")), F.lit(0)).cast("long").alias("n_dup_lines"),
        "n_repeat_words",
        _score("buckets", F.size("w"), ratios).alias("score"),
    )
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return figures.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= F.lit(least))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
