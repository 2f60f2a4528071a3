"""MinHash near-duplicate detection with odd sketches.

Documents are linked if their sets of three-word shingles (ASCII case folded)
have a Jaccard similarity of at least ``threshold``; a document's component is
what can be reached over links.

1. One pass over the texts gives each document the digest of its whole set, the
   keys of ``bands(threshold)`` bands of ``ROWS`` MinHash values each, and an odd sketch:
   every (place, value) of the MinHash sample flips one bit of a parity bitmap.
   Equal sets, whatever the number of copies, become one node at once.
2. Nodes that share a band key are candidates. In every bucket each node is held
   against the bucket's smallest node only, so a bucket of any size gives as many
   pairs as it has nodes. The bits in which two sketches differ estimate how many
   sample values do; pairs far below the threshold are dropped unverified.
3. Candidate pairs are verified on the full shingle sets, which are taken from
   the texts again for the nodes in question alone. Verified pairs are links.
4. Buckets whose nodes still lie in several components are then searched in full:
   in blocks of bounded rows and bytes, block against block, likely pairs of
   different components are verified on the spot, and a pair that joins two
   components leaves as a link. Pairs that share an earlier band, or that a link
   found before has put together, are skipped, so a block gives fewer links than
   it has nodes however many pairs it holds.

No join sends a hot key to one task: rows without a set never enter one, and the
sides of every other join are stored tables or exchanges of them, so that adaptive
execution can split a heavy key (a bucket, a star's centre, the copies of one text,
a large component) between tasks.

At the threshold a pair shares no band with a probability below 1e-6 (24 bands for
0.85, 35 for 0.8) and fails the sketch test with one of the same order. Every table between steps is
written to the shared folder and deleted when nothing reads it any more; components are found by joins, never on the driver.

Defined cases: a text of fewer than three words has its whole sequence as its one
shingle; null, empty and wordless texts have an empty set and link with nothing,
each its own component; rows with a null id can be linked, and a component of
null ids only has a null component_id; repeated rows are equal sets.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweir.llm.common import bounded_batches, dropped, forget, in_arrow, slices, stored
from tallyweir.llm.shingles import WordHashes, mixed, shingle_set

ROWS, BITS = 5, 512
SLICE_BYTES = 1 << 20  # of text or sets at a time
BLOCK_NODES, BLOCK_BYTES = 1000, 4 << 20


def bands(threshold: float) -> int:
    """So many that a pair at the threshold shares none with a probability below one in a million."""
    return math.ceil(math.log(1e-6) / math.log1p(-min(threshold**ROWS, 1 - 1e-12)))


def shingles(text: bytes | None, n: int, known: WordHashes) -> np.ndarray:
    """The sorted distinct shingle hashes of a whole text."""
    return shingle_set(known.of((text or b"").lower().split()), n)


def sampled(sets: list[np.ndarray], threshold: float = 0.85) -> np.ndarray:
    """MinHash values, sets by sample places; sets must not be empty."""
    size = ROWS * bands(threshold)
    seeds = mixed(np.arange(1, size + 1, dtype=np.uint64))
    multipliers = mixed(np.arange(1001, size + 1001, dtype=np.uint64)) | np.uint64(1)
    whole = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    # 32-bit values halve the work; they only nominate candidates
    low = (whole >> np.uint64(32)).astype(np.uint32) ^ whole.astype(np.uint32)
    out = np.empty((len(sets), size), np.uint32)
    for k in range(size):
        h = (low ^ np.uint32(seeds[k] & np.uint64(0xFFFFFFFF))) * np.uint32(multipliers[k] & np.uint64(0xFFFFFFFF))
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        h ^= h >> np.uint32(13)
        out[:, k] = np.minimum.reduceat(h, starts)
    return out


def band_keys(sample: np.ndarray) -> np.ndarray:
    keys = np.zeros((len(sample), sample.shape[1] // ROWS), np.uint64)
    for r in range(ROWS):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + sample[:, r::ROWS].astype(np.uint64) + np.uint64(1))
    return mixed(keys + np.arange(keys.shape[1], dtype=np.uint64)).view(np.int64)


def odd_sketches(sample: np.ndarray) -> np.ndarray:
    """Parity bitmaps, sets by BITS / 64 words."""
    bit = (mixed(sample.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.arange(1, sample.shape[1] + 1, dtype=np.uint64)) % np.uint64(BITS)).astype(np.int64)
    parity = np.zeros((len(sample), BITS), np.uint8)
    np.add.at(parity, (np.repeat(np.arange(len(sample)), sample.shape[1]), bit.ravel()), 1)
    return np.packbits(parity & 1, axis=1).view(np.uint64)


def most_different_bits(threshold: float) -> int:
    """The most bits in which the sketches of a pair at the threshold differ, but for one in a million."""
    size = ROWS * bands(threshold)
    differing = size * (1 - threshold) + 4.9 * np.sqrt(size * threshold * (1 - threshold)) + 1
    flips = 2 * differing
    expected = BITS / 2 * (1 - np.exp(-2 * flips / BITS))
    return int(expected + 2 * np.sqrt(expected * max(1 - 2 * expected / BITS, 0.1)) + 2)


def described(docs: DataFrame, n: int = 3, threshold: float = 0.85) -> DataFrame:
    """doc_id, n_shingles, node, keys, sketch and the text's digest of each row; node, keys and sketch are null for empty sets."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for part in slices(batch, 1, SLICE_BYTES):
                texts = part.column(1).cast(pa.large_binary()).to_pylist()
                sets = [shingles(t, n, known) for t in texts]
                full = [s for s in sets if len(s)]
                keys, sketch = (None, None)
                if full:
                    sample = sampled(full, threshold)
                    keys, sketch = iter(band_keys(sample).tolist()), iter(odd_sketches(sample).view(np.int64).tolist())
                columns = [(node_of(s), next(keys), next(sketch)) if len(s) else (None, None, None) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([c[0] for c in columns], pa.binary()), pa.array([c[1] for c in columns], pa.list_(pa.int64())), pa.array([c[2] for c in columns], pa.list_(pa.int64())), pa.array([hashlib.sha256(t or b"").digest() for t in texts], pa.binary())],
                    names=["doc_id", "n_shingles", "node", "keys", "sketch", "digest"],
                )

    return in_arrow(docs.select("doc_id", "text"), rows, f"doc_id {kind}, n_shingles long, node binary, keys array<bigint>, sketch array<bigint>, digest binary")


def node_of(full: np.ndarray) -> bytes:
    """The digest that stands for a whole set."""
    return hashlib.blake2b(full.tobytes(), digest_size=16).digest()


def sets_of(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, n: int) -> DataFrame:
    """node and set (its shingle hashes as bytes) of the wanted nodes, from their texts alone."""
    # the documents of the nodes in question only; a null id joins as a value of its own
    ids = stored(wanted.join(nodes.select("node", "doc_id"), "node").select(F.col("doc_id").alias("id")).distinct(), "ids")
    texts = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("id")), "left_semi")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for part in slices(batch, 0, SLICE_BYTES):
                sets = [s for t in part.column(0).cast(pa.large_binary()).to_pylist() if len(s := shingles(t, n, known))]
                yield pa.RecordBatch.from_arrays([pa.array(map(node_of, sets), pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "set"])

    found = stored(in_arrow(texts.select("text"), rows, "node binary, set binary").dropDuplicates(["node"]), "sets")
    dropped(ids)
    return found


def verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, threshold: float, n: int = 3) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough; ``nodes`` has node and doc_id of one document each."""
    per_mille = round(threshold * 1000)
    wanted = stored(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b"))).distinct(), "wanted")
    sets = sets_of(wanted, nodes, docs, n)
    left, right = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a")), sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "set_a", "set_b")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, SLICE_BYTES):
                keep = []
                for x, y in zip(part.column(2), part.column(3), strict=True):
                    s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    at = np.minimum(np.searchsorted(s, t), len(s) - 1)
                    shared = int((s[at] == t).sum())
                    keep.append(1000 * shared >= per_mille * (len(s) + len(t) - shared))
                kept = part.filter(pa.array(keep, pa.bool_()))
                yield pa.RecordBatch.from_arrays(kept.columns[:2], names=["a", "b"])

    links = stored(in_arrow(both, alike, "a binary, b binary"), "links")
    dropped(sets)
    dropped(wanted)
    return links


def components(links: DataFrame) -> DataFrame:
    """node and root, the smallest node of its component, of every linked node.

    Each round points every node to the smallest root among its neighbours and
    then follows pointers once, so chains shrink by halves.
    """
    edges = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "edges")
    state = stored(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "roots")
    while True:
        near = edges.join(state, edges.b == state.node).groupBy("a").agg(F.min("root").alias("m"))
        joined = stored(state.join(near, state.node == near.a).select("node", F.col("root").alias("old"), F.least("root", "m").alias("now")), "joined")
        # the root of a node may itself have learnt of a smaller one
        hooks = stored(joined.filter(F.col("now") < F.col("old")).groupBy("old").agg(F.min("now").alias("better")), "hooks")
        if not hooks.limit(1).count():
            for done in (edges, joined, hooks):
                dropped(done)
            return state
        moved = stored(joined.join(hooks, "old", "left").select("node", F.coalesce(F.least("now", "better"), F.col("now")).alias("mid")), "moved")
        roots = moved.select(F.col("node").alias("mid"), F.col("mid").alias("far"))
        following = stored(moved.join(roots, "mid", "left").select("node", F.coalesce(F.least("mid", "far"), F.col("mid")).alias("root")), "roots")
        for done in (state, joined, hooks, moved):
            dropped(done)
        state = following


def _different(a: Column, b: Column) -> Column:
    """In how many bits two sketches differ."""
    return reduce(lambda x, y: x + y, (F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(BITS // 64)))


def text_digest(text: Column) -> Column:
    """The digest that ``placed`` gives a text; a null text counts as empty."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def placed(docs: DataFrame, threshold: float = 0.85, n: int = 3) -> DataFrame:
    """doc_id, n_shingles, digest of the text, root (null for empty sets) and component_id of each row."""
    told = stored(described(docs, n, threshold), "described")
    full = told.filter("node IS NOT NULL")
    nodes = stored(full.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")), "nodes")
    whole = nodes.select("node", F.explode("keys").alias("key"))
    shared = stored(whole.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("centre")).filter("n > 1").drop("n"), "shared")
    buckets = stored(whole.join(shared, "key").select("key", "centre", "node"), "buckets")
    dropped(shared)
    most = most_different_bits(threshold)
    sketches = nodes.select("node", "sketch")

    def likely(pairs: DataFrame) -> DataFrame:
        a, b = sketches.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), sketches.select(F.col("node").alias("b"), F.col("sketch").alias("sb"))
        return pairs.join(b, "b").join(a, "a").filter(_different(F.col("sa"), F.col("sb")) <= most).select("a", "b")

    stars = stored(likely(buckets.filter("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()), "stars")
    links = verified(stars, nodes, docs, threshold, n)
    dropped(stars)
    roots = components(links)
    rooted = stored(buckets.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "rooted")
    dropped(buckets)
    open_keys = stored(rooted.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("key"), "open")
    rest = stored(rooted.join(open_keys, "key"), "rest")
    for done in (rooted, open_keys):
        dropped(done)
    if rest.limit(1).count():
        wanted = stored(rest.select("node").distinct(), "wanted")
        sets = sets_of(wanted, nodes, docs, n)
        more = stored(_between(rest, nodes, sets, threshold, most), "more")
        if more.limit(1).count():
            dropped(roots)
            roots = components(links.unionByName(more))
        for done in (wanted, sets, more):
            dropped(done)
    dropped(links)
    dropped(rest)
    # of the linked nodes, the least id of the component; all others are components of their own
    least = stored(roots.join(nodes.select("node", "doc_id"), "node").groupBy("root").agg(F.min("doc_id").alias("least")), "least")
    linked = roots.join(least, "root").select("node", "root", "least")
    told_of = stored(nodes.select("node", "doc_id").join(linked, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id")), "members")
    for done in (roots, least, nodes):
        dropped(done)
    columns = ["doc_id", "n_shingles", "digest", "root", "component_id"]
    empty = told.filter("node IS NULL").select("doc_id", "n_shingles", "digest", F.col("node").alias("root"), F.col("doc_id").alias("component_id"))
    return full.select("doc_id", "n_shingles", "digest", "node").join(told_of, "node").select(columns).unionByName(empty)


def near_duplicates(docs: DataFrame, threshold: float = 0.85, n: int = 3) -> DataFrame:
    """doc_id, n_shingles and component_id of each row."""
    return placed(docs, threshold, n).select("doc_id", "n_shingles", "component_id")


def chosen(docs: DataFrame, threshold: float = 0.85, n: int = 3) -> DataFrame:
    """doc_id, digest and copies of the one row of each component that stays, by smallest id; of empty sets every row stays and copies is 0.

    Rows with the same id and text are the same row here: ``copies`` of them match, of which one stays.
    """
    found = stored(placed(docs, threshold, n), "placed")
    rows = found.filter("n_shingles > 0").groupBy("root", "doc_id", "digest").agg(F.count("*").alias("copies"))
    # a null id comes last, as in component_id
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest", "copies")).alias("r")).select("r.doc_id", "r.digest", "r.copies")
    return first.unionByName(found.filter("n_shingles = 0").select("doc_id", "digest", F.lit(0).cast("long").alias("copies")).distinct())


def _between(rest: DataFrame, nodes: DataFrame, sets: DataFrame, threshold: float, most: int) -> DataFrame:
    """Links between components within the open buckets (key, node, root), searched block against block."""
    per_mille = round(threshold * 1000)
    told = nodes.select("node", "keys", "sketch").join(sets, "node")
    sizes = stored(rest.join(told.select("node", F.octet_length("set").alias("bytes")), "node").groupBy("key").agg(F.ceil(F.greatest(F.count("*") / BLOCK_NODES, F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("blocks")), "sizes")
    own = rest.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).join(told, "node")
    # a row of block i goes to every pair (i, j), so a bucket of k blocks is searched in k (k + 1) / 2 groups
    dealt = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "root", "keys", "sketch", "set")

    def search(table: pa.Table) -> pa.Table:
        forget()
        node, own = table.column("node").to_pylist(), np.array(table.column("own"))
        bits = np.array(table.column("sketch").to_pylist(), np.int64).view(np.uint64)
        keys = np.array(table.column("keys").to_pylist(), np.int64)
        full = [np.frombuffer(s.as_buffer(), np.uint64) for s in table.column("set")]
        size = np.array([len(s) for s in full])
        places = {r: k for k, r in enumerate(dict.fromkeys(table.column("root").to_pylist()))}
        group = np.array([places[r] for r in table.column("root").to_pylist()])
        band = int((keys[0] == table.column("key")[0].as_py()).argmax())
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        right, found = np.flatnonzero(own == j), []
        for x in np.flatnonzero(own == i):
            others = right[(group[right] != group[x]) & ((right > x) if i == j else True)]
            others = others[~(keys[others, :band] == keys[x, :band]).any(1)]
            apart = np.bitwise_count(bits[others] ^ bits[x]).sum(1)
            # nearest first, as a link makes the rest of its component needless
            waiting = others[np.argsort(apart, kind="stable")][: int((apart <= most).sum())]
            while len(waiting):
                now, waiting = waiting[:32], waiting[32:]
                flat = np.concatenate([full[y] for y in now])
                at = np.minimum(np.searchsorted(full[x], flat), size[x] - 1)
                shared = np.add.reduceat((full[x][at] == flat).astype(np.int64), np.concatenate([[0], np.cumsum(size[now])[:-1]]))
                for y in now[1000 * shared >= per_mille * (size[now] + size[x] - shared)]:
                    if group[y] != group[x]:
                        found.append((node[x], node[y]))
                        group[group == group[y]] = group[x]
                waiting = waiting[group[waiting] != group[x]]
        return pa.table({"a": pa.array([a for a, _ in found], pa.binary()), "b": pa.array([b for _, b in found], pa.binary())})

    bounded_batches(rest.sparkSession)
    return dealt.groupBy("key", "i", "j").applyInArrow(search, "a binary, b binary")


def judged(docs: DataFrame, threshold: float = 0.85, n: int = 3) -> DataFrame:
    """The components and whether a row is its component's first."""
    found = near_duplicates(docs, threshold, n)
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
