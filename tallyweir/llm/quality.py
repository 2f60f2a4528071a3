"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

    score(x) = sigmoid(w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2))

The last term is every pairwise interaction through ``RANK`` factors, in time
linear in the features that are not zero. Features of a text: its words (ASCII
case folded), hashed into ``BUCKETS`` and weighted by 1 + log count, scaled to
length 1; structure statistics of the whole text, standardised, and an
indicator of the bin that each falls into; the declared length ``n_chars`` as
metadata, relative to the true length.

The fit sees at most ``sample_rows`` labelled rows of at most
``sample_chars`` characters (see ``common.labelled_sample``); scoring is one
pass over all rows and whole texts without a shuffle. The model is a few
megabytes whatever the data.

Defined cases: null and empty texts are scored alike, by the features of an
empty text; a null or missing ``n_chars`` counts as the true length; with no
labelled rows of both classes every text gets the share of ones among them, or
0.5 without any; repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweir.llm.common import fold, in_arrow, labelled_sample, slices

BUCKETS, RANK, BINS = 1 << 16, 8, 6
_UPPER, _LOWER, _DIGIT = bytes(range(65, 91)), bytes(range(97, 123)), bytes(range(48, 58))
_SYMBOL, _STOP, _HIGH = b"#*$%&|<>", b".,;:!?", bytes(range(128, 256))
N_STATS = 14


def _share(raw: bytes, kind: bytes) -> float:
    return (len(raw) - len(raw.translate(None, kind))) / max(len(raw), 1)


def statistics(raw: bytes, words: list[bytes], counts: Counter, n_chars: int | None) -> list[float]:
    n = max(len(words), 1)
    lines = raw.split(b"\n")
    kept = [x for x in lines if x.strip()]
    triples = list(zip(words, words[1:], words[2:], strict=False))
    true_chars = len(raw.decode("utf-8", "replace"))
    return [
        math.log1p(len(raw)), math.log1p(len(words)), len(raw) / n, _share(raw, _SYMBOL), _share(raw, _UPPER), _share(raw, _DIGIT), _share(raw, _STOP), raw.count(b"!") / n,
        1 - len(counts) / n, (len(kept) - len(set(kept))) / max(len(kept), 1), (len(triples) - len(set(triples))) / max(len(triples), 1), len(lines) / n,
        _share(raw, _LOWER + _HIGH), math.log1p(true_chars if n_chars is None else max(n_chars, 0)) - math.log1p(true_chars),
    ]


def features(raw: bytes, n_chars: int | None, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Buckets and weights of the words, and the raw statistics."""
    words = raw.lower().split()
    counts = Counter(words)
    at = np.empty(len(counts), np.int32)
    for i, word in enumerate(counts):
        bucket = known.get(word)
        if bucket is None:
            if len(known) > 200_000:
                known.clear()
            bucket = known[word] = zlib.crc32(word) & (BUCKETS - 1)
        at[i] = bucket
    weight = 1 + np.log(np.fromiter(counts.values(), np.float32, len(counts)))
    if len(weight):
        weight /= math.sqrt(float(weight @ weight))
    return at, weight, statistics(raw, words, counts, n_chars)


@dataclass
class Machine:
    bias: float
    linear: np.ndarray  # BUCKETS words, N_STATS statistics, N_STATS * BINS indicators
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    edges: np.ndarray  # (N_STATS, BINS - 1)

    def vector(self, at: np.ndarray, weight: np.ndarray, stats: list[float]) -> tuple[np.ndarray, np.ndarray]:
        raw = np.array(stats)
        z = np.clip((raw - self.mean) / self.scale, -3, 3) / 3
        bins = (raw[:, None] > self.edges).sum(1)
        where = np.concatenate([at, BUCKETS + np.arange(N_STATS), BUCKETS + N_STATS + BINS * np.arange(N_STATS) + bins])
        return where, np.concatenate([weight, z, np.full(N_STATS, 0.5)]).astype(np.float32)

    def margin(self, where: np.ndarray, x: np.ndarray) -> float:
        v = self.factors[where] * x[:, None]
        total = v.sum(0)
        return self.bias + float(self.linear[where] @ x) + 0.5 * float(total @ total - (v * v).sum())

    def score(self, at: np.ndarray, weight: np.ndarray, stats: list[float]) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.margin(*self.vector(at, weight, stats))))))


def fit(rows: list[tuple[bytes, int | None, int]], epochs: int = 12, rate: float = 0.08, decay: float = 2e-4) -> Machine:
    """AdaGrad on the logistic loss, rows in a fixed order."""
    size = BUCKETS + N_STATS * (1 + BINS)
    rng = np.random.default_rng(7)
    known: dict[bytes, int] = {}
    seen = [(*features(raw, n_chars, known), y) for raw, n_chars, y in rows]
    stats = np.array([s for _, _, s, _ in seen]).reshape(len(seen), N_STATS)
    ones = sum(y for *_, y in seen)
    share = min(max(ones / len(seen), 1e-6), 1 - 1e-6) if seen else 0.5
    edges = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T if seen else np.zeros((N_STATS, BINS - 1))
    machine = Machine(math.log(share / (1 - share)), np.zeros(size, np.float32), np.zeros((size, RANK), np.float32), stats.mean(0) if seen else np.zeros(N_STATS), np.maximum(stats.std(0), 1e-9) if seen else np.ones(N_STATS), edges)
    if not 0 < ones < len(seen):
        return machine
    machine.factors = rng.normal(0, 0.02, (size, RANK)).astype(np.float32)
    data = [(*machine.vector(at, weight, s), y) for at, weight, s, y in seen]
    grad_w, grad_v, grad_0 = np.full(size, 1e-3, np.float32), np.full((size, RANK), 1e-3, np.float32), 1e-3
    for _ in range(epochs):
        for k in rng.permutation(len(data)):
            where, x, y = data[k]
            own = machine.factors[where]
            total = (own * x[:, None]).sum(0)
            error = 1 / (1 + math.exp(-max(-30.0, min(30.0, machine.margin(where, x))))) - y
            g = error * x + decay * machine.linear[where]
            grad_w[where] += g * g
            machine.linear[where] -= rate * g / np.sqrt(grad_w[where])
            g = error * (x[:, None] * total - own * (x * x)[:, None]) + decay * own
            grad_v[where] += g * g
            machine.factors[where] = own - rate * g / np.sqrt(grad_v[where])
            grad_0 += error * error
            machine.bias -= rate * error / math.sqrt(grad_0)
    return machine


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000, sample_chars: int = 20_000) -> Machine:
    rows = labelled_sample(docs, labels, "quality", sample_rows, sample_chars).orderBy("doc_id").collect()
    return fit([(r.text.encode("utf-8", "replace"), r.n_chars, r.y) for r in rows])


def score(docs: DataFrame, machine: Machine, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    n_chars = F.col("n_chars").cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        model = shared.value
        for batch in batches:
            for part in slices(batch, 1, 4 << 20):
                texts = part.column(1).cast(pa.large_binary()).to_pylist()
                scores = [model.score(*features(t or b"", c, known)) for t, c in zip(texts, part.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(3), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "score"])

    given = docs.select("doc_id", "text", n_chars.alias("n"), (fold(F.col("doc_id"), 5) == 0).alias("held_out"))
    scored = in_arrow(given, rows, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
