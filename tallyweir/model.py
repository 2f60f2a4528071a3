"""The declarative surface: a sealed graph of relations, changed by atomic batches."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweir.functions.exact import LEAST, MOST
from tallyweir.operators import zset
from tallyweir.operators.mutations import folded
from tallyweir.operators.zset import W
from tallyweir.plans import ir
from tallyweir.plans.engine import Bag, Engine, State
from tallyweir.sources.store import Store

_NAME = re.compile(r"[a-z][a-z0-9_]*\Z")


class ModelError(ValueError):
    pass


def declared(spec: Mapping) -> tuple[dict[str, ir.Node], list[str]]:
    """The nodes of a declaration, by name, and the relations that must stay empty."""
    nodes: dict[str, ir.Node] = {}

    def of(name: str) -> ir.Node:
        if name not in nodes:
            raise ModelError(f"unknown relation {name}")
        return nodes[name]

    def column(node: ir.Node, place: int) -> int:
        if type(place) is not int or not 0 <= place < node.width:
            raise ModelError("a column is out of range")
        return place

    for raw in spec["nodes"]:
        name, op = raw["name"], raw["op"]
        if not _NAME.match(name) or name in nodes:
            raise ModelError(f"bad or repeated name {name}")
        if op == "source":
            if type(raw["width"]) is not int or raw["width"] < 1:
                raise ModelError("a source has columns")
            node: ir.Node = ir.Source(name, raw["width"])
        elif op == "map":
            inner = of(raw["input"])
            exprs = tuple(tuple(e) for e in raw["exprs"])
            for e in exprs:
                ir.validate_expr(e, inner.width)
            node = ir.Map(inner, exprs)
        elif op == "filter":
            inner = of(raw["input"])
            if raw["cmp"] not in ir.CMP or not LEAST <= raw["value"] <= MOST:
                raise ModelError("bad comparison")
            node = ir.Filter(inner, column(inner, raw["column"]), raw["cmp"], raw["value"])
        elif op in ("join", "anti"):
            left, right = of(raw["left"]), of(raw["right"])
            kind = ir.Join if op == "join" else ir.Anti
            node = kind(left, right, column(left, raw["left_key"]), column(right, raw["right_key"]))
        elif op == "group":
            inner = of(raw["input"])
            node = ir.Group(inner, column(inner, raw["key"]), (f"c{column(inner, raw['value'])}",))
        elif op == "union":
            left, right = of(raw["left"]), of(raw["right"])
            if left.width != right.width:
                raise ModelError("a union needs equal widths")
            node = ir.Union(left, right)
        else:
            raise ModelError(f"unknown operator {op}")
        nodes[name] = ir.simplified(node)
    empty = list(spec.get("required_empty", ()))
    if len(set(empty)) != len(empty):
        raise ModelError("a relation is required to be empty twice")
    for name in empty:
        of(name)
    return nodes, empty


class Candidate:
    """A prepared batch: to be inspected, then published or dropped."""

    def __init__(self, model: Model, state: State, epoch: int):
        self._model, self._state, self._epoch = model, state, epoch

    def preview(self) -> dict[str, DataFrame]:
        return self._model._bags(self._state)

    def violations(self) -> list[str]:
        m = self._model
        return [n for n in m.required_empty if not m.engine.empty(self._state, m.nodes[n])]

    def publish(self) -> int:
        m = self._model
        if self._state is None or m.epoch != self._epoch:
            raise ModelError("the candidate is no longer current")
        if broken := self.violations():
            raise ModelError(f"must be empty: {', '.join(broken)}")
        m.state, self._state = self._state, None
        m.epoch += 1
        return m.epoch

    def abort(self) -> None:
        self._state = None


class Model:
    """An immutable graph whose bags are kept up to date by batches, all or nothing."""

    def __init__(self, spark: SparkSession, spec: Mapping, mode: str = "overlay"):
        self.spark = spark
        self.nodes, self.required_empty = declared(spec)
        self.engine = Engine(Store(spark, None), mode)
        self.epoch = 0
        self.state = State({n: Bag((), zset.schema(n.width)) for n in ir.in_order(*self.nodes.values())})

    def _bags(self, state: State) -> dict[str, DataFrame]:
        return {name: self.engine.bag(state, node) for name, node in self.nodes.items()}

    def snapshot(self) -> dict[str, DataFrame]:
        return self._bags(self.state)

    def prepare(self, operations: Sequence[Mapping]) -> Candidate:
        """Operations {"op": insert | update, "table", "row"} or {"op": "delete", "table", "key"}, in order."""
        rows: dict[str, list[tuple]] = {}
        for at, raw in enumerate(operations):
            node = self.nodes.get(raw.get("table"))
            if not isinstance(node, ir.Source) or raw.get("op") not in ("insert", "update", "delete"):
                raise ModelError("an operation names a source and is insert, update or delete")
            row = tuple(raw["row"]) if raw["op"] != "delete" else (raw["key"], *[None] * (node.width - 1))
            if len(row) != node.width:
                raise ModelError("a row has a value for each column")
            for v in row if raw["op"] != "delete" else row[:1]:
                if type(v) is not int:
                    raise TypeError("values are integers")
                if not LEAST <= v <= MOST:
                    raise OverflowError("a value exceeds 64 bits")
            rows.setdefault(raw["table"], []).append((at, raw["op"], *row))
        frames = {}
        for table, listed in rows.items():
            width = self.nodes[table].width
            frames[table] = self.spark.createDataFrame(listed, "at int, op string, " + ", ".join(f"{c} long" for c in zset.names(width)))
        return self.prepare_frames(frames)

    def prepare_frames(self, operations: Mapping[str, DataFrame]) -> Candidate:
        """The same for operations that are tables of their own, of any size."""
        changes = {self.nodes[name]: folded(self.engine.bag(self.state, self.nodes[name]), frame) for name, frame in operations.items()}
        return Candidate(self, self.engine.apply(self.state, changes, list(self.nodes.values())), self.epoch)

    def load(self, sources: Mapping[str, DataFrame]) -> int:
        """A first or further load: rows of c0..cn to be inserted, without an order among them."""
        frames = {name: df.toDF(*zset.names(self.nodes[name].width)).withColumn("at", F.lit(0)).withColumn("op", F.lit("insert")) for name, df in sources.items()}
        return self.prepare_frames(frames).publish()

    def apply(self, operations: Sequence[Mapping]) -> int:
        return self.prepare(operations).publish()


__all__ = ["W", "Candidate", "Model", "ModelError", "declared"]
