"""LM scoring by deleted interpolation of bigram, unigram and uniform estimates.

    P(w | v) = l2(b) c(v w) / c(v) + l1(b) c(w) / N + l0(b) / (V + 1)

where b is the bucket of the context's frequency c(v). The weights of each bucket
are learned by expectation-maximisation on held-out counts: every training token
is taken out of all its counts in turn (c - 1) and the mixture is fitted to what
the remaining counts say of it, in cells of tokens with equal or (from 16 on) near
counts, which stand for the means of their tokens.

Counts are of the whole training corpus and may be as large as the corpus, so they
are neither broadcast nor gathered. The texts are read once into blocks of about
``BLOCK_TOKENS`` tokens. Each block asks, bucket of n-gram hashes by bucket, for
the totals of its distinct n-grams and sends along its own counts: one compressed
row for a block and bucket, so a word that a third of all tokens are costs a block
one key. Each bucket adds up and answers; the answers join their block again.
A bucket holds a slice of the hash range, so no frequent word, document or source
can fill one. What the driver sees is a table of quantised held-out counts with a
fixed number of cells.

Blocks and answers are stored in the shared folder, so a lost executor costs its
own tasks only; words are compared as 64-bit hashes, pairs by 56 bits.

Defined cases: a null or empty text is one end token; without training documents
every token has the probability 1 / (V + 1) with V = 0; repeated rows count and
are scored each; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweir.llm.common import bounded_batches, dropped, fold, forget, in_arrow, stored
from tallyweir.llm.shingles import WordHashes, mixed

BLOCK_TOKENS, BUCKET_TOKENS = 2_000_000, 2_000_000
END, START = np.uint64(0x5BD1E9955BD1E995), np.uint64(0xC6A4A7935BD1E995)
PAIR_BITS = ~np.uint64(0xFF)  # the 56 bits by which pairs are told apart; single words keep all 64
LEVELS = 48  # buckets of context frequency: powers of two


def _pack(values: np.ndarray) -> bytes:
    """Integers by bytes of equal weight, compressed."""
    values = np.ascontiguousarray(values)
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes())


def _unpack(raw: bytes, kind: type) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(flat.reshape(size, -1).T).view(kind).ravel()


def _pack_keys(keys: np.ndarray) -> bytes:
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(_unpack(raw, np.uint64), dtype=np.uint64)


def blocks(docs: DataFrame, held_out_of: int = 10) -> DataFrame:
    """One row a block: its documents, vocabulary hashes and tokens."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        ids, held, lengths, parts, size = [], [], [], [], 0

        def block() -> pa.RecordBatch:
            tokens = np.concatenate(parts)
            vocabulary, seq, counts = np.unique(tokens, return_inverse=True, return_counts=True)
            # frequent words get small numbers, which compress better
            order = np.argsort(-counts, kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            vocabulary, seq = vocabulary[order], place[seq]
            training = int(sum(n for n, h in zip(lengths, held, strict=True) if not h))
            values = [uuid.uuid4().hex, pa.concat_arrays(ids), held, lengths, vocabulary.tobytes(), _pack(seq.astype(np.int32)), training]
            kinds = [pa.string(), None, pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64()]
            columns = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) if k is None else pa.array([v], k) for v, k in zip(values, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(columns, names=["block", "ids", "held", "lengths", "vocabulary", "seq", "training"])

        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            for i in range(batch.num_rows):
                words = (texts[i].as_py() or b"").lower().split()
                parts.append(np.append(known.of(words), END))
                ids.append(batch.column(0).slice(i, 1))
                held.append(bool(batch.column(2)[i].as_py()))
                lengths.append(len(words) + 1)
                size += len(words) + 1
                if size >= BLOCK_TOKENS:
                    yield block()
                    ids, held, lengths, parts, size = [], [], [], [], 0
        if ids:
            yield block()

    flagged = docs.select("doc_id", "text", (fold(F.col("doc_id"), held_out_of) == 0).alias("held"))
    return in_arrow(flagged, rows, f"block string, ids array<{kind}>, held array<boolean>, lengths array<bigint>, vocabulary binary, seq binary, training bigint")


class Ngrams:
    """The distinct n-grams of a block, in one order wherever they are made."""

    def __init__(self, vocabulary: bytes, seq: bytes, held: list[bool], lengths: list[int]):
        self.words = np.frombuffer(vocabulary, np.uint64)
        self.seq = _unpack(seq, np.int32)
        lengths = np.array(lengths, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        self.train = np.repeat(~np.array(held, bool), lengths)
        hashes = self.words[self.seq]
        before = np.concatenate([[START], hashes[:-1]])
        before[self.starts] = START
        self.pairs, self.pair_of = np.unique(mixed(before * np.uint64(0x9E3779B97F4A7C15) + hashes) & PAIR_BITS, return_inverse=True)
        # the start of a document is a context too: its count is that of training documents
        singles = mixed(np.append(self.words, START) ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        self.order = np.argsort(singles)
        self.singles = singles[self.order]
        self.documents = int((~np.array(held, bool)).sum())

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """This block's training counts of its singles and pairs."""
        ones = np.bincount(self.seq[self.train], minlength=len(self.words))
        return np.append(ones, self.documents)[self.order].astype(np.uint32), np.bincount(self.pair_of[self.train], minlength=len(self.pairs)).astype(np.uint32)


def _cuts(keys: np.ndarray, bits: int) -> np.ndarray:
    edges = np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    return np.concatenate([[0], np.searchsorted(keys, edges), [len(keys)]])


def asked(stored_blocks: DataFrame, bits: int) -> DataFrame:
    """What each block asks of each bucket of hashes, with its own counts."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                grams = Ngrams(r["vocabulary"], r["seq"], r["held"], r["lengths"])
                n1, n2 = grams.counts()
                cut1, cut2 = _cuts(grams.singles, bits), _cuts(grams.pairs, bits)
                out: list[list] = [[], [], [], [], []]
                for k in range(1 << bits):
                    a, b, c, d = cut1[k], cut1[k + 1], cut2[k], cut2[k + 1]
                    if a == b and c == d:
                        continue
                    for column, value in zip(out, (k, _pack_keys(grams.singles[a:b]), _pack(n1[a:b]), _pack_keys(grams.pairs[c:d]), _pack(n2[c:d])), strict=True):
                        column.append(value)
                kinds = [pa.int32(), *[pa.binary()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array([r["block"]] * len(out[0]), pa.string()), *(pa.array(v, k) for v, k in zip(out, kinds, strict=True))], names=["block", "bucket", "singles", "n1", "pairs", "n2"])

    return in_arrow(stored_blocks.select("block", "held", "lengths", "vocabulary", "seq"), rows, "block string, bucket int, singles binary, n1 binary, pairs binary, n2 binary")


def answered(questions: DataFrame) -> DataFrame:
    """Totals for each block's n-grams; a row without a block tells how many singles a bucket has seen in training."""

    def total(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(place, weights=np.concatenate(counts).astype(np.float64), minlength=len(distinct)).astype(np.uint64)
        ends = np.cumsum([0, *map(len, keys)])
        return [_pack(sums[place[a:b]]) for a, b in zip(ends, ends[1:], strict=False)], distinct, sums

    def group(table: pa.Table) -> pa.Table:
        forget()
        rows = table.to_pylist()
        one, words, sums = total([_unpack_keys(r["singles"]) for r in rows], [_unpack(r["n1"], np.uint32) for r in rows])
        two, _, _ = total([_unpack_keys(r["pairs"]) for r in rows], [_unpack(r["n2"], np.uint32) for r in rows])
        start = mixed(np.array([START ^ np.uint64(0xA5A5A5A5A5A5A5A5)], np.uint64))[0]
        seen = int(((sums > 0) & (words != start)).sum())
        return pa.table(
            {
                "block": pa.array([r["block"] for r in rows] + [None], pa.string()),
                "bucket": pa.array([r["bucket"] for r in rows] + [rows[0]["bucket"]], pa.int32()),
                "one": pa.array([*one, None], pa.binary()),
                "two": pa.array([*two, None], pa.binary()),
                "seen": pa.array([None] * len(rows) + [seen], pa.int64()),
            }
        )

    bounded_batches(questions.sparkSession)
    return questions.groupBy("bucket").applyInArrow(group, "block string, bucket int, one binary, two binary, seen bigint")


def _octaves(x: np.ndarray) -> np.ndarray:
    """Counts below 16 as they are, then four bins an octave."""
    return np.where(x < 16, x, 16 + np.floor(4 * np.log2(np.maximum(x, 16) / 16) + 1e-9)).astype(np.int64)


def cell_of(context: np.ndarray, pair: np.ndarray, single: np.ndarray) -> np.ndarray:
    """The cell of three held-out counts."""
    return (_octaves(context) * 256 + _octaves(pair)) * 256 + _octaves(single)


def _low(level: np.ndarray) -> np.ndarray:
    """The least count of a bin."""
    return np.where(level < 16, level, np.ceil(16 * 2 ** ((level - 16) / 4) - 1e-6))


CELLS = pa.list_(pa.struct([(name, pa.int64()) for name in ("cell", "n", "v", "two", "one")]))


def told_cells(context: np.ndarray, pair: np.ndarray, single: np.ndarray) -> list[dict]:
    """Of each cell its tokens, and by how much in all their counts pass the least of the cell."""
    values = [x.astype(np.int64) for x in (context, pair, single)]
    cells, place, n = np.unique(cell_of(*values), return_inverse=True, return_counts=True)
    over = []
    for x, digit in zip(values, (65536, 256, 1), strict=True):
        sums = np.zeros(len(cells), np.int64)
        np.add.at(sums, place, x - _low(cells // digit % 256).astype(np.int64)[place])
        over.append(sums)
    return [dict(zip(("cell", "n", "v", "two", "one"), row, strict=True)) for row in zip(cells.tolist(), n.tolist(), *(o.tolist() for o in over), strict=True)]


def means(cells: np.ndarray, counts: np.ndarray, over: list[np.ndarray]) -> list[np.ndarray]:
    """The mean held-out counts of each cell."""
    return [_low(cells // digit % 256) + o / counts for o, digit in zip(over, (65536, 256, 1), strict=True)]


def resolved(stored_blocks: DataFrame, answers: DataFrame) -> DataFrame:
    """Each block with its tokens' totals and its cells of held-out counts."""
    kind = stored_blocks.schema["ids"].dataType.simpleString()

    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        forget()
        if not left.num_rows:  # answers without a block carry the size of the vocabulary
            seen = [v for v in right.column("seen").to_pylist() if v is not None]
            return pa.table({"ids": pa.array([None], left.schema.field("ids").type), "held": pa.array([None], pa.list_(pa.bool_())), "lengths": pa.array([None], pa.list_(pa.int64())), "c1": pa.array([None], pa.binary()), "cv": pa.array([None], pa.binary()), "c2": pa.array([None], pa.binary()), "cells": pa.array([[]], CELLS), "seen": pa.array([sum(seen)], pa.int64())})
        r = left.to_pylist()[0]
        grams = Ngrams(r["vocabulary"], r["seq"], r["held"], r["lengths"])
        parts = sorted(right.select(["bucket", "one", "two"]).to_pylist(), key=lambda x: x["bucket"])
        of_single = np.empty(len(grams.singles), np.uint64)
        of_single[grams.order] = np.concatenate([_unpack(p["one"], np.uint64) for p in parts])
        c2 = np.concatenate([_unpack(p["two"], np.uint64) for p in parts])[grams.pair_of]
        c1 = of_single[grams.seq]
        cv = np.concatenate([of_single[-1:], c1[:-1]])
        cv[grams.starts] = of_single[-1]
        t = grams.train  # their own counts hold them
        cells = told_cells(cv[t] - 1, c2[t] - 1, c1[t] - 1)
        return pa.table({"ids": left.column("ids"), "held": left.column("held"), "lengths": left.column("lengths"), "c1": pa.array([_pack(c1)], pa.binary()), "cv": pa.array([of_single[-1:].tobytes()], pa.binary()), "c2": pa.array([_pack(c2)], pa.binary()), "cells": pa.array([cells], CELLS), "seen": pa.array([None], pa.int64())})

    return stored_blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(group, f"ids {kind}, held array<boolean>, lengths array<bigint>, c1 binary, cv binary, c2 binary, cells array<struct<cell:bigint,n:bigint,v:bigint,two:bigint,one:bigint>>, seen bigint")


def weights(context: np.ndarray, pair: np.ndarray, single: np.ndarray, counts: np.ndarray, tokens: int, vocabulary: int, rounds: int = 80) -> np.ndarray:
    """LEVELS by (bigram, unigram, uniform), by expectation-maximisation on held-out counts, each standing ``counts`` times."""
    out = np.tile([0.4, 0.5, 0.1], (LEVELS, 1))
    out[0] = [0.0, 0.9, 0.1]  # an unseen context has no bigram estimate
    if not len(context):
        return out
    level = level_of(context)
    p = np.stack([np.where(context > 0, np.minimum(pair / np.maximum(context, 1), 1), 0), single / max(tokens - 1, 1), np.full(len(context), 1 / (vocabulary + 1))], 1)
    for _ in range(rounds):
        part = out[level] * p
        part *= (counts / np.maximum(part.sum(1), 1e-300))[:, None]
        sums = np.zeros((LEVELS, 3))
        np.add.at(sums, level, part)
        sums += [0.01, 0.01, 0.01]
        sums[0, 0] = 0
        out = sums / sums.sum(1, keepdims=True)
    return out


def level_of(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.where(context > 0, 1 + np.floor(np.log2(np.maximum(context, 1)) + 1e-9), 0), LEVELS - 1).astype(np.int64)


def probabilities(c2: np.ndarray, cv: np.ndarray, c1: np.ndarray, mixture: np.ndarray, tokens: int, vocabulary: int) -> np.ndarray:
    w = mixture[level_of(cv)]
    if not tokens:
        return np.full(len(c1), 1 / (vocabulary + 1))
    return w[:, 0] * np.where(cv > 0, c2 / np.maximum(cv, 1), 0) + w[:, 1] * c1 / tokens + w[:, 2] / (vocabulary + 1)


def scores(docs: DataFrame, held_out_of: int = 10) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    kept = stored(blocks(docs, held_out_of), "lm-blocks")
    size = kept.select(F.sum("training").alias("n"), F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("all")).first()
    tokens = size.n or 0
    bits = max(3, min(20, math.ceil(math.log2(max((size["all"] or 0) / BUCKET_TOKENS, 1)))))
    known = stored(resolved(kept, answered(asked(kept, bits))), "lm-known")
    dropped(kept)
    vocabulary = known.agg(F.sum("seen").alias("v")).first().v or 0
    # cells are of binned counts, so their number is bounded whatever the corpus; each gives the exact means of its tokens
    totals = [F.sum(F.col(f"c.{name}").cast("decimal(38,0)")).cast("double").alias(name) for name in ("n", "v", "two", "one")]
    cells = known.select(F.explode("cells").alias("c")).groupBy("c.cell").agg(*totals).orderBy("cell").toArrow()
    number, counts, *over = (cells.column(name).to_numpy() for name in ("cell", "n", "v", "two", "one"))
    mixture = weights(*means(number, counts, over), counts, tokens, vocabulary)
    kind = docs.schema["doc_id"].dataType

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).select(["held", "lengths", "c1", "cv", "c2"]).to_pylist()[0]
                lengths = np.array(r["lengths"], np.int64)
                starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                c1, c2 = _unpack(r["c1"], np.uint64).astype(np.float64), _unpack(r["c2"], np.uint64).astype(np.float64)
                cv = np.concatenate([[0.0], c1[:-1]])
                cv[starts] = float(np.frombuffer(r["cv"], np.uint64)[0])
                model = np.log10(probabilities(c2, cv, c1, mixture, tokens, vocabulary))
                base = np.log10((c1 + 0.1) / (tokens + 0.1 * (vocabulary + 1)))
                add = lambda x, starts=starts: np.add.reduceat(x, starts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i].values, pa.array(r["held"], pa.bool_()), pa.array(lengths), pa.array(add((c1 > 0).astype(np.int64))), pa.array(np.full(len(lengths), tokens, np.int64)), pa.array(add(base)), pa.array(add(model))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return in_arrow(known.filter("ids IS NOT NULL").select("ids", "held", "lengths", "c1", "cv", "c2"), rows, f"doc_id {kind.simpleString()}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
