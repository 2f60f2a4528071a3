"""Benchmark decontamination: size-partitioned MinHash containment search.

A test item is contained in a document if at least ``containment`` of the item's
distinct shingles (five words, case-folded, punctuation aside) stand in it. Items
are partitioned by the size of their shingle sets, by powers of two; in each
partition an item is sketched by its k least shingles, in the order of how many
items hold a shingle and then of its hash, where k is one more than the shingles that
a contained item of that partition's largest size may lack. At least one sketched
shingle, or as many as the item's own size implies, must then stand in every
document that contains the item, however long the document is, and a document can't
contain an item of a partition that is too large for it: the search has no false
negatives. Candidates are verified by the exact containment of the item's shingles
as words. A shingle that many items share, as of a template, is in their sketches
only if they have no rarer ones; equal items are searched for once.

A benchmark of up to ``BLOCK_SHINGLES`` shingles in all is broadcast, and one pass
over the documents finds and verifies, without a shuffle. A larger one stays
distributed: one pass looks up the documents' shingles in a bitmap of the sketches,
of a fixed size, and those that are there meet the sketches, and candidates their
texts, by joins between stored tables, which adaptive execution can split. Both ways
give the same rows.

Defined cases: an item of fewer than five words has its whole sequence as its one
shingle; null, empty and wordless items and texts match nothing; repeated items
and repeated documents each give their own rows; ids may have any type; other
columns are ignored, and ``cleaned`` passes them through.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweir.llm.common import bounded_batches, dropped, free_name, in_arrow, shipped, stored
from tallyweir.llm.shingles import WordHashes, runs

N_WORDS, BLOCK_SHINGLES = 5, 500_000
SCREEN_BITS = 26  # of the bitmap that screens documents' shingles against a distributed benchmark
_WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _hashes(tokens: list[str], known: WordHashes) -> np.ndarray:
    return known.of([t.encode("utf-8", "replace") for t in tokens])


def _runs_of_words(tokens: list[str], n: int) -> frozenset[tuple[str, ...]]:
    return frozenset(zip(*(tokens[k:] for k in range(n)), strict=False))


@dataclass
class Item:
    places: list[int]  # of the equal items that it stands for
    length: int  # words in a shingle
    shingles: frozenset[tuple[str, ...]]
    hashed: np.ndarray
    sketch: np.ndarray
    least_hits: int


def sketch_size(size: int, containment: float) -> int:
    """Sketch size of the partition of items with 2^c to 2^(c+1)-1 shingles."""
    largest = (1 << size.bit_length()) - 1
    return min(size, floor((1 - containment) * largest + 1e-9) + 1)


def hits_needed(size: int, containment: float) -> int:
    """How many of an item's sketched shingles every document that contains it has."""
    return max(1, sketch_size(size, containment) - floor((1 - containment) * size + 1e-9))


class Index:
    """The sketches of items, each with its place."""

    def __init__(self, texts: Iterable[str | None], containment: float):
        self.containment, known = containment, WordHashes()
        by_words: dict[tuple[str, ...], Item] = {}
        for place, text in enumerate(texts):
            tokens = words(text)
            if not tokens:
                continue
            same = by_words.get(tuple(tokens))
            if same:
                same.places.append(place)
                continue
            n = min(N_WORDS, len(tokens))
            by_words[tuple(tokens)] = Item([place], n, _runs_of_words(tokens, n), np.unique(runs(_hashes(tokens, known), n)), np.empty(0, np.uint64), 1)
        self.items = list(by_words.values())
        holders = Counter(h for i in self.items for h in i.hashed.tolist())
        self.holders: dict[int, list[int]] = {}
        for at, i in enumerate(self.items):
            size = len(i.shingles)
            i.least_hits = hits_needed(size, containment)
            i.sketch = np.array(sorted(i.hashed.tolist(), key=lambda h: (holders[h], h))[: sketch_size(size, containment)], np.uint64)
            for h in i.sketch.tolist():
                self.holders.setdefault(h, []).append(at)
        self.lengths = sorted({i.length for i in self.items})
        self.keys = np.array(sorted(self.holders), np.uint64)
        self.screen = np.zeros(1 << 20, bool)
        self.screen[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def matches(self, text: str | None, known: WordHashes) -> list[tuple[int, int, int]]:
        """(place, shared, size) of each item that the text contains."""
        tokens = words(text)
        if not tokens:
            return []
        hashes, hits = _hashes(tokens, known), Counter()
        for n in self.lengths:
            found = runs(hashes, n)
            found = found[self.screen[(found >> np.uint64(44)).astype(np.int64)]]
            if len(found):
                for h in np.intersect1d(found, self.keys).tolist():
                    hits.update(self.holders[h])
        out, own = [], {}
        for at in sorted(hits):
            item = self.items[at]
            if hits[at] < item.least_hits or self.containment * len(item.shingles) - 1e-9 > len(tokens):
                continue
            if item.length not in own:
                own[item.length] = _runs_of_words(tokens, item.length)
            shared = len(item.shingles & own[item.length])
            if shared >= self.containment * len(item.shingles) - 1e-9:
                out += [(place, shared, len(item.shingles)) for place in item.places]
        return out


def contained(docs: DataFrame, benchmark: DataFrame, containment: float = 0.8, broadcast_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """doc_id, item_id, n_shared, n_item_shingles and containment of each contained item."""
    found = _broadcast(benchmark, containment, broadcast_shingles)
    if found is not None:
        kinds = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item_id", benchmark.schema["item_id"].dataType), T.StructField("n_shared", T.LongType()), T.StructField("n_item_shingles", T.LongType())])
        pairs = in_arrow(docs.select("doc_id", "text"), _search(*found), kinds)
    else:
        hit, items = _distributed(docs, benchmark, containment)
        texts = docs.select("doc_id", _digest(F.col("text")).alias("digest"))
        pairs = texts.join(hit, "digest").join(items, "node").select("doc_id", "item_id", "n_shared", "n_item_shingles")
    return pairs.withColumn("containment", F.col("n_shared") / F.col("n_item_shingles"))


def cleaned(docs: DataFrame, benchmark: DataFrame, containment: float = 0.8, broadcast_shingles: int = BLOCK_SHINGLES) -> DataFrame:
    """The rows of ``docs`` that contain no item, with their columns; of a broadcast benchmark only texts go to Python."""
    found = _broadcast(benchmark, containment, broadcast_shingles)
    if found is None:
        hit, _ = _distributed(docs, benchmark, containment)
        name = free_name([*docs.columns, *hit.columns], "text_digest")
        bad = hit.select(F.col("digest").alias(name)).distinct()
        return docs.withColumn(name, _digest(F.col("text"))).join(bad, name, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
    index, _ = found
    bounded_batches(docs.sparkSession)

    @F.arrow_udf(T.BooleanType())
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = WordHashes()
        for texts in batches:
            yield pa.array([not index.value.matches(t.as_py(), known) for t in texts], pa.bool_())

    return docs.filter(clean(F.col("text")))


def _broadcast(benchmark: DataFrame, containment: float, most: int):
    """The index of a benchmark that is small enough, and its ids; None of a larger one."""
    shipped(benchmark.sparkSession)
    # an item has as many shingles as words at most
    size = benchmark.select(F.sum(F.regexp_count("text", F.lit(r"\w+"))).alias("n"), F.count("*").alias("rows")).first()
    if (size.n or 0) > most or size.rows > most:
        return None
    rows = benchmark.select("item_id", "text").toArrow()
    context = benchmark.sparkSession.sparkContext
    return context.broadcast(Index(rows.column("text").to_pylist(), containment)), context.broadcast(rows.column("item_id").combine_chunks())


def _search(index, ids) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            found = [(row, *m) for row, text in enumerate(batch.column(1)) for m in index.value.matches(text.as_py(), known)]
            if found:
                at, places, shared, sizes = (list(c) for c in zip(*found, strict=True))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), ids.value.take(pa.array(places)), pa.array(shared, pa.int64()), pa.array(sizes, pa.int64())], names=["doc_id", "item_id", "n_shared", "n_item_shingles"])

    return rows


# --- a benchmark that is too large to broadcast ------------------------------------------------


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def _distributed(docs: DataFrame, benchmark: DataFrame, containment: float) -> tuple[DataFrame, DataFrame]:
    """(digest of a text, node, n_shared, n_item_shingles) of contained items, and the ids (node, item_id) of the nodes."""

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                tokens = words(text)
                n = min(N_WORDS, len(tokens))
                hashed = np.unique(runs(_hashes(tokens, known), n)).view(np.int64).tolist() if tokens else None
                size = len(_runs_of_words(tokens, n)) if tokens else 0
                node = hashlib.sha256("\n".join(tokens).encode("utf-8", "replace")).digest() if tokens else None
                out.append((node, n, size, sketch_size(size, containment) if size else 0, hits_needed(size, containment) if size else 0, hashed))
            columns = list(zip(*out, strict=True))
            kinds = [pa.binary(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["item_id", "text", "node", "n", "size", "k", "least", "hashed"])

    given = benchmark.select("item_id", "text")
    kinds = T.StructType([*given.schema.fields, *T.StructType.fromDDL("node binary, n int, size long, k int, least int, hashed array<bigint>").fields])
    rows = stored(in_arrow(given, described, kinds).filter("node IS NOT NULL"), "items")
    nodes = stored(rows.groupBy("node").agg(*(F.first(c).alias(c) for c in ("text", "n", "size", "k", "least", "hashed"))), "nodes")
    each = nodes.select("node", "k", "least", "size", F.explode("hashed").alias("h"))
    held = stored(each.groupBy("h").agg(F.count("*").alias("holders")), "holders")
    least = F.slice(F.array_sort(F.collect_list(F.struct("holders", F.expr("h ^ (-9223372036854775807 - 1)").alias("unsigned"), "h"))), 1, F.first("k"))
    ranked = each.join(held, "h").groupBy("node").agg(least.alias("sketch"), F.first("least").alias("least"), F.first("size").alias("size"))
    sketches = stored(ranked.select("node", "least", "size", F.explode("sketch.h").alias("h")), "sketches")
    place = F.shiftrightunsigned("h", 64 - SCREEN_BITS)
    bits = sketches.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(p & 63))")).alias("bits"))
    screen = np.zeros(1 << (SCREEN_BITS - 6), np.int64)  # of a fixed size, whatever the benchmark
    for part in bits.toArrow().to_batches():
        screen[part.column("word").to_numpy()] = part.column("bits").to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(screen.view(np.uint64))
    lengths = sorted(r.n for r in nodes.select("n").distinct().collect())  # N_WORDS at most

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = WordHashes(), sent.value
        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                tokens = words(text)
                hashes = _hashes(tokens, known)
                some = np.unique(np.concatenate([np.empty(0, np.uint64), *(runs(hashes, n) for n in lengths)]))
                p = some >> np.uint64(64 - SCREEN_BITS)
                some = some[(table[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63))) & np.uint64(1) == 1]
                if len(some):
                    out.append((hashlib.sha256((text or "").encode()).digest(), len(tokens), some.view(np.int64).tolist()))
            if out:
                digests, sizes, hits = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), pa.array(hits, pa.list_(pa.int64()))], names=["digest", "words", "hits"])

    # copies of a text are looked up once
    near = stored(in_arrow(docs.select("text"), found, "digest binary, words long, hits array<bigint>").dropDuplicates(["digest"]), "near")
    met = near.select("digest", "words", F.explode("hits").alias("h")).join(sketches, "h").filter(F.col("size") * containment - 1e-9 <= F.col("words"))
    candidates = stored(met.groupBy("digest", "node").agg(F.count("*").alias("n"), F.first("least").alias("least")).filter("n >= least").select("digest", "node"), "candidates")
    wanted = stored(candidates.select("digest").distinct(), "wanted")
    texts = stored(docs.select(_digest(F.col("text")).alias("digest"), F.col("text").alias("doc")).join(wanted, "digest", "left_semi").dropDuplicates(["digest"]), "texts")

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared, sizes = [], []
            for item, n, doc in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                own = _runs_of_words(words(item), n)
                shared.append(len(own & _runs_of_words(words(doc), n)))
                sizes.append(len(own))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(shared, pa.int64()), pa.array(sizes, pa.int64())], names=["digest", "node", "n_shared", "n_item_shingles"])

    both = candidates.join(texts, "digest").join(nodes.select("node", F.col("text").alias("item"), "n"), "node").select("digest", "node", "item", "n", "doc")
    hit = stored(in_arrow(both, verified, "digest binary, node binary, n_shared long, n_item_shingles long").filter(F.col("n_shared") >= containment * F.col("n_item_shingles") - 1e-9), "contained")
    for done in (nodes, held, sketches, near, candidates, wanted, texts):
        dropped(done)
    return hit, rows.select("node", "item_id")
