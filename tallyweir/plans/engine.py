"""The maintained graph: stored bags of nodes, candidates of transactions, incremental propagation."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweir.operators import delta, evaluate, zset
from tallyweir.operators.zset import W
from tallyweir.plans import ir
from tallyweir.sources.store import Store, tail

MOST_FRAGMENTS = 8  # in overlay mode, beyond that the newest changes are merged with each other


def key_of(node: ir.Node) -> str:
    return hashlib.sha256(json.dumps(ir.to_json(node), sort_keys=True).encode()).hexdigest()[:32]


@dataclass
class Bag:
    """Fragments whose sum is the bag: a base, unless that is ``outside``, then changes; and how many rows each has."""

    fragments: tuple[str, ...]
    schema: T.StructType
    outside: DataFrame | None = None  # a registered source, read where it lies
    rows: tuple[int, ...] = ()

    @property
    def first(self) -> int:
        """The first fragment that is a change."""
        return 0 if self.outside is not None else 1


@dataclass
class State:
    """What is visible at one moment: a bag for each node."""

    bags: dict[ir.Node, Bag] = field(default_factory=dict)


@dataclass
class Written:
    """A change that lies in the store already."""

    path: str
    rows: int


class Engine:
    """Bags by node over a store. ``overlay`` merges fragments on read, ``modular`` rewrites a changed bag.

    In a keyed bag (see ``ir.keyed``) a change takes out rows by key and puts
    others in: reading one is an anti-join of the base with the changes' keys,
    which Spark broadcasts if they are few, and no sum over the base. The base of
    a bag is only rewritten by ``compact``; changes are merged with each other by size.
    """

    def __init__(self, store: Store, mode: str = "overlay"):
        if mode not in ("overlay", "modular"):
            raise ValueError("mode is overlay or modular")
        self.store, self.mode = store, mode
        self.evaluations = self.propagations = self.pruned = self.merges = self.changed_rows = 0

    def bag(self, state: State, node: ir.Node) -> DataFrame:
        """The canonical bag of a node."""
        held = state.bags[node]
        if not held.fragments:
            return held.outside if held.outside is not None else zset.of_rows(self.store.spark, [], held.schema)
        if len(held.fragments) == held.first:
            return self.store.read(held.fragments, held.schema)
        base = held.outside if held.outside is not None else self.store.read(held.fragments[:1], held.schema)
        if not ir.keyed(node):
            return zset.summed(base.union(self.store.read(held.fragments[held.first :], held.schema)))
        change = self.changes(held)
        gone = change.filter(F.col(W) < 0).select(F.col("c0").alias("k"))
        return base.join(gone, F.col("c0").eqNullSafe(F.col("k")), "left_anti").union(change.filter(F.col(W) > 0))

    def changes(self, held: Bag) -> DataFrame:
        """The sum of a bag's changes."""
        read = self.store.read(held.fragments[held.first :], held.schema)
        return read if len(held.fragments) == held.first + 1 else zset.summed(read)

    def put(self, df: DataFrame) -> Bag:
        path, rows = self.store.write_counted(df)
        return Bag((path,), _loose(df.schema), rows=(rows,))

    def build(self, state: State, roots: list[ir.Node]) -> None:
        """Computes the nodes below the roots that have no bag yet; all others are reused."""
        for node in ir.in_order(*roots):
            if node not in state.bags:
                self.evaluations += 1
                state.bags[node] = self.put(evaluate.evaluated(node, [self.bag(state, i) for i in node.inputs]))

    def checked(self, state: State, source: ir.Source, change: DataFrame) -> Written:
        """A table's change, canonical and written, if each touched key then has one row at most and none twice or less than once."""
        kind = state.bags[source].schema
        if change.columns != kind.names:
            raise ValueError(f"a change has the columns {', '.join(kind.names)}")
        path, rows = self.store.write_counted(zset.summed(change.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in kind))))
        stored = self.store.read((path,), kind)
        keys = stored.select(F.col("c0").alias("k")).distinct()
        touched = self.bag(state, source).join(keys, F.col("c0").eqNullSafe(F.col("k")), "left_semi")
        after = zset.summed(touched.union(stored)).groupBy("c0").agg(F.count("*").alias("n"), F.min(W).alias("least"), F.max(W).alias("most"))
        wrong = after.filter("c0 IS NULL OR n > 1 OR least < 1 OR most > 1").limit(1).collect()
        if wrong:
            r = wrong[0]
            raise ValueError("a row has no key" if r.c0 is None else f"the key {r.c0} would lack a row that the change takes out" if r.least < 1 else f"the key {r.c0} would stand twice")
        return Written(path, rows)

    def apply(self, state: State, changes: Mapping[ir.Node, DataFrame | Written], roots: list[ir.Node]) -> State:
        """The state after the sources' changes, each node changed once, in order; ``state`` stays as it is."""
        after = State(dict(state.bags))
        written: dict[ir.Node, DataFrame] = {}
        for node in ir.in_order(*roots, *changes):
            if node in changes:
                change = changes[node]
            else:
                given = [written.get(i) for i in node.inputs]
                if all(c is None for c in given):
                    self.pruned += 1
                    continue
                old, new = [self.bag(state, i) for i in node.inputs], [self.bag(after, i) for i in node.inputs]
                change = delta.changed(node, old, new, given, self.bag(state, node))
                self.propagations += 1
            path, rows = (change.path, change.rows) if isinstance(change, Written) else self.store.write_counted(change)
            held = state.bags[node]
            if not rows:
                continue  # what lies downstream sees no change
            self.changed_rows += rows
            written[node] = self.store.read((path,), held.schema)
            after.bags[node] = self._tidied(node, Bag((*held.fragments, path), held.schema, held.outside, (*held.rows, rows)))
        return after

    def _tidied(self, node: ir.Node, bag: Bag) -> Bag:
        if self.mode == "modular" and len(bag.fragments) > bag.first:
            self.merges += 1
            path, rows = self.store.write_counted(self.bag(State({node: bag}), node))
            return Bag((path,), bag.schema, rows=(rows,))
        if len(bag.fragments) - bag.first <= MOST_FRAGMENTS:
            return bag
        self.merges += 1
        at = tail(bag.rows, bag.first)
        path, rows = self.store.write_counted(zset.summed(self.store.read(bag.fragments[at:], bag.schema)))
        return Bag((*bag.fragments[:at], path), bag.schema, bag.outside, (*bag.rows[:at], rows))

    def empty(self, state: State, node: ir.Node) -> bool:
        return self.bag(state, node).limit(1).count() == 0

    def compact(self, state: State) -> None:
        for node, held in list(state.bags.items()):
            if len(held.fragments) > 1:
                self.merges += 1
                path, rows = self.store.write_counted(self.bag(state, node))
                state.bags[node] = Bag((path,), held.schema, rows=(rows,))


def _loose(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])
