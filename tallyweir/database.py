"""The SQL surface: tables, exact queries, transactions, maintained views and deferred assertions."""

from __future__ import annotations

import os
import threading
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweir.agent import AgentConfig, AgentError, Clarification, ClarificationRequired, Decline, Generation, GenerationRequest, QueryDeclined, RelationContext
from tallyweir.functions.exact import parameters as checked_parameters
from tallyweir.functions.exact import wide_sum
from tallyweir.operators import zset
from tallyweir.operators.evaluate import compare
from tallyweir.operators.zset import W
from tallyweir.plans import binder, ir
from tallyweir.plans.engine import Bag, Engine, State, Written, key_of
from tallyweir.plans.parser import MAX_TEXT, Predicate, SQLError, Statement, parse
from tallyweir.sources.store import Store, StoreError

_WEIGHT = T.DecimalType(19, 0)


@dataclass(frozen=True)
class Result:
    columns: tuple[str, ...]
    frame: DataFrame | None
    affected: int
    plan: str
    physical: str = ""  # of an explained SELECT, what Spark would run

    @cached_property
    def rows(self) -> list[tuple]:
        """All rows on the driver; ``frame`` keeps them distributed."""
        return [tuple(r) for r in self.frame.collect()] if self.frame is not None else []


@dataclass
class Catalog:
    tables: dict[str, tuple[str, ...]]
    views: dict[str, tuple[tuple[str, ...], ir.Node, binder.Bound]]
    assertions: dict[str, str]
    sources: dict[str, ir.Source]

    def columns(self) -> dict[str, tuple[str, ...]]:
        return self.tables | {name: v[0] for name, v in self.views.items()}

    def copy(self) -> Catalog:
        return Catalog(dict(self.tables), dict(self.views), dict(self.assertions), dict(self.sources))

    def nodes(self) -> dict[str, ir.Node]:
        """Every relation's node; a cycle of views is an error."""
        done: dict[str, ir.Node] = dict(self.sources)
        open_names: list[str] = []

        def visit(name: str) -> None:
            if name in done:
                return
            if name in open_names:
                raise SQLError("views would depend on each other in a cycle")
            open_names.append(name)
            definition = self.views[name][1]
            for other in ir.references(definition):
                visit(other)
            open_names.pop()
            done[name] = ir.resolved(definition, done)

        for name in self.views:
            visit(name)
        return done


@dataclass
class Transaction:
    state: State
    streams: dict[str, int]
    doomed: bool = False


class Database:
    """One catalog of exact tables, maintained views and assertions; in memory of the session, or at ``path``."""

    def __init__(self, spark: SparkSession, path: str | None = None, mode: str = "overlay", agent: AgentConfig | None = None):
        self.spark = spark
        self.agent = agent
        self._owner = (os.getpid(), threading.get_ident())
        self._busy = self._closed = False
        self._tx: Transaction | None = None
        self._scoped = False
        self.store = Store(spark, path)
        self.engine = Engine(self.store, mode)
        self.catalog = Catalog({}, {}, {}, {})
        self.state = State()
        self.streams: dict[str, int] = {}  # the last batch of each stream
        self.epoch = self.revision = 0
        self._counts = {"statements": 0, "commits": 0, "rollbacks": 0, "reuses": 0}
        try:
            self._recover()
        except BaseException:
            self.store.close()
            raise

    # --- life cycle -------------------------------------------------------------------------

    def close(self) -> None:
        if not self._closed:
            self._tx = None
            self._closed = True
            self.store.close()

    def __enter__(self) -> Database:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def _enter(self) -> None:
        if self._closed or self.store.poisoned:
            raise RuntimeError("the database is closed" if self._closed else "the database must be reopened")
        if self._owner != (os.getpid(), threading.get_ident()):
            raise RuntimeError("the database belongs to another thread or process")
        if self._busy:
            raise RuntimeError("the database is busy")

    def stats(self) -> dict[str, int]:
        e = self.engine
        return self._counts | {"epoch": self.epoch, "revision": self.revision, "relations": len(self.catalog.columns()), "nodes": len(self.state.bags), "evaluations": e.evaluations, "propagations": e.propagations, "pruned": e.pruned, "merges": e.merges, "changed_rows": e.changed_rows, "fragments": sum(len(b.fragments) for b in self.state.bags.values())}

    def checkpoint(self) -> None:
        """Merges every bag's fragments and removes what is no longer named."""
        self._enter()
        if self._tx:
            raise RuntimeError("no checkpoint in a transaction")
        self.engine.compact(self.state)
        self._publish(self.catalog, self.state, self.streams)
        self.store.sweep({p for b in self.state.bags.values() for p in b.fragments})

    # --- persistence ------------------------------------------------------------------------

    def _publish(self, catalog: Catalog, state: State, streams: dict[str, int]) -> None:
        if not self.store.durable:
            return
        self.store.publish(
            {
                "epoch": self.epoch,
                "revision": self.revision,
                "tables": {k: list(v) for k, v in catalog.tables.items()},
                "views": {k: {"columns": list(v[0]), "graph": ir.to_json(v[1]), "text": _bound_json(v[2])} for k, v in catalog.views.items()},
                "assertions": catalog.assertions,
                "streams": streams,
                "rows": {key_of(n): list(b.rows) for n, b in state.bags.items()},
                "bags": {key_of(n): list(b.fragments) for n, b in state.bags.items()},
                "schemas": {key_of(n): b.schema.json() for n, b in state.bags.items()},
            }
        )

    def _recover(self) -> None:
        import json

        found = self.store.recover()
        if found is None:
            return
        try:
            tables = {k: tuple(v) for k, v in found["tables"].items()}
            sources = {k: ir.Source(k, len(v)) for k, v in tables.items()}
            views = {k: (tuple(v["columns"]), ir.from_json(v["graph"]), _bound_of(v["text"])) for k, v in found["views"].items()}
            catalog = Catalog(tables, views, dict(found["assertions"]), sources)
            nodes = catalog.nodes()
            state = State()
            for node in ir.in_order(*nodes.values()):
                key = key_of(node)
                state.bags[node] = Bag(tuple(found["bags"][key]), T.StructType.fromJson(json.loads(found["schemas"][key])), rows=tuple(found["rows"][key]))
            streams = {str(k): int(v) for k, v in found["streams"].items()}
        except (KeyError, TypeError, ValueError, SQLError) as error:
            raise StoreError("the catalog is damaged") from error
        for source in sources.values():
            bag = self.engine.bag(state, source)
            if bag.groupBy("c0").agg(F.count("*").alias("n"), F.max(W).alias("m"), F.min(W).alias("l")).filter("n <> 1 OR m <> 1 OR l <> 1").limit(1).count():
                raise StoreError("a table's keys are not unique")
        for target in catalog.assertions.values():
            if not self.engine.empty(state, nodes[target]):
                raise StoreError("an assertion does not hold")
        self._verify(nodes, state)
        self.catalog, self.state, self.streams = catalog, state, streams
        self.epoch, self.revision = found["epoch"], found["revision"]
        self.store.sweep({p for b in state.bags.values() for p in b.fragments})

    def _verify(self, nodes: dict[str, ir.Node], state: State) -> None:
        """Each maintained bag must have the checksum and rows of its definition over the recovered tables."""
        fresh = State({n: b for n, b in state.bags.items() if isinstance(n, ir.Source)})
        evaluations = self.engine.evaluations
        for node in ir.in_order(*nodes.values()):
            if node in fresh.bags:
                continue
            self.engine.build(fresh, [node])
            columns = [*zset.names(node.width), W]
            kept, again = (df.select(F.count("*").alias("n"), F.sum(F.xxhash64(*columns).cast(T.DecimalType(38, 0))).alias("s")).first() for df in (self.engine.bag(state, node), self.engine.bag(fresh, node)))
            if kept != again:
                raise StoreError("a maintained relation does not follow from its definition")
        self.engine.evaluations = evaluations

    # --- sources ----------------------------------------------------------------------------

    def register(self, name: str, frame: DataFrame) -> None:
        """A table over any DataFrame, read where it lies; its first column is the key that DML goes by.

        Columns may have any type; exactness rules hold for the integral ones. The
        key's uniqueness is the caller's promise. Such tables live as long as this handle.
        """
        self._enter()
        if self._tx or self.store.durable:
            raise SQLError("tables are registered outside transactions, in databases without a path")
        binder.check_name(name, self.catalog.columns())
        width = len(frame.columns)
        source = ir.Source(name, width)
        bag = frame.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(frame.columns)), F.lit(1).cast("long").alias(W))
        self.catalog.tables[name] = tuple(c.lower() for c in frame.columns)
        self.catalog.sources[name] = source
        self.state.bags[source] = Bag((), bag.schema, bag)
        self.revision += 1

    def register_parquet(self, name: str, path: str) -> None:
        self.register(name, self.spark.read.parquet(path))

    def relation(self, name: str) -> DataFrame:
        """The visible rows of a relation, distributed."""
        columns = binder.columns_of(name, self.catalog.columns())
        bag = self.engine.bag(self._visible(), self.catalog.nodes()[name])
        return zset.expanded(bag).toDF(*columns)

    def snapshot(self) -> dict[str, DataFrame]:
        """Every relation as a weighted bag, at one moment."""
        state, nodes = self._visible(), self.catalog.nodes()
        return {name: self.engine.bag(state, node) for name, node in nodes.items()}

    def _visible(self) -> State:
        return self._tx.state if self._tx else self.state

    # --- statements -------------------------------------------------------------------------

    def execute(self, sql: str, parameters: Sequence[int] = (), *, explain: bool = False, agent: bool = False) -> Result:
        self._enter()
        if not isinstance(sql, str) or not sql.strip() or "\0" in sql or len(sql.encode("utf-8", "replace")) > MAX_TEXT:
            raise ValueError("a statement is 1 to 65536 bytes of text without NUL")
        if agent:
            return self._ask(sql, parameters)
        values = checked_parameters(parameters)
        try:
            statement = parse(sql, values)
            if self._scoped and statement.kind in ("begin", "commit", "rollback"):
                raise SQLError("a scoped transaction ends with its scope")
            out = self._run(statement, explain)
            self._counts["statements"] += not explain
            return out
        except Exception as error:
            if self._tx and not explain:
                if self._scoped:
                    self._tx.doomed = True
                else:
                    self._rollback()
            if isinstance(error, (SQLError, StoreError)):
                raise
            raise SQLError(str(error).splitlines()[0] if str(error) else type(error).__name__) from error

    def _run(self, s: Statement, explain: bool) -> Result:
        done = Result((), None, 0, s.kind.upper())
        if self._tx and self._tx.doomed:
            raise SQLError("the transaction has failed")
        if s.kind == "select":
            return self._select(binder.bind(s.select, self.catalog.columns()), explain)
        if s.kind in ("insert", "update", "delete"):
            return self._dml(s, explain)
        if s.kind in ("begin", "commit", "rollback"):
            if s.kind == "begin" and self._tx:
                raise SQLError("a transaction is open")
            if s.kind == "commit" and not self._tx:
                raise SQLError("no transaction is open")
            if not explain:
                {"begin": self._begin, "commit": self._commit, "rollback": self._rollback}[s.kind]()
            return done
        if self._tx:
            raise SQLError("definitions stand outside transactions")
        catalog, state = self.catalog.copy(), State(dict(self.state.bags))
        names = catalog.columns()
        if s.kind == "table":
            binder.check_name(s.name, names)
            if len(set(s.columns)) != len(s.columns):
                raise SQLError("a table's columns need different names")
            source = ir.Source(s.name, len(s.columns))
            catalog.tables[s.name], catalog.sources[s.name] = s.columns, source
            state.bags[source] = Bag((), zset.schema(len(s.columns)))
        elif s.kind == "assertion":
            binder.check_name(s.name, catalog.assertions)
            binder.columns_of(s.target, names)
            catalog.assertions[s.name] = s.target
        else:
            if s.kind == "create view":
                binder.check_name(s.name, names)
            elif s.name not in catalog.views:
                raise SQLError(f"unknown view {s.name}")
            bound = binder.bind(s.select, names)
            node = binder.lowered(bound, {k: len(v) for k, v in names.items()})
            labels = tuple(o.label for o in bound.outputs)
            if s.kind == "alter view" and labels != catalog.views[s.name][0]:
                raise SQLError("a view keeps its columns")
            catalog.views[s.name] = (labels, node, bound)
            catalog.nodes()  # finds cycles
            done = replace(done, plan=f"{s.kind.upper()} {bound.plan()}")
        if explain:
            return done
        nodes = catalog.nodes()
        self.engine.build(state, list(nodes.values()))
        used = set(ir.in_order(*nodes.values()))
        state = State({n: b for n, b in state.bags.items() if n in used})
        self._check(catalog, state)
        self._swap(catalog, state, revision=True)
        return done

    def _swap(self, catalog: Catalog, state: State, revision: bool = False, streams: dict[str, int] | None = None) -> None:
        epoch, before = self.epoch, self.revision
        self.epoch, self.revision = epoch + 1, before + revision
        streams = self.streams if streams is None else streams
        try:
            self._publish(catalog, state, streams)
        except BaseException:
            self.epoch, self.revision = epoch, before
            raise
        self.catalog, self.state, self.streams = catalog, state, streams

    def _check(self, catalog: Catalog, state: State, changed: set[ir.Node] | None = None) -> None:
        nodes = catalog.nodes()
        for name, target in catalog.assertions.items():
            if (changed is None or nodes[target] in changed) and not self.engine.empty(state, nodes[target]):
                raise SQLError(f"assertion {name} is violated")

    # --- transactions -----------------------------------------------------------------------

    def _begin(self) -> None:
        self._tx = Transaction(State(dict(self.state.bags)), dict(self.streams))

    def _commit(self) -> None:
        tx = self._tx
        try:
            self._check(self.catalog, tx.state, {n for n, b in tx.state.bags.items() if b is not self.state.bags.get(n)})
            self._swap(self.catalog, tx.state, streams=tx.streams)
            self._counts["commits"] += 1
        finally:
            self._tx = None

    def _rollback(self) -> None:
        self._counts["rollbacks"] += self._tx is not None
        self._tx = None

    @contextmanager
    def transaction(self) -> Iterator[Database]:
        """Commits on exit; an error inside, caught or not, undoes all of it."""
        self._enter()
        if self._tx:
            raise SQLError("a transaction is open")
        self._begin()
        self._scoped = True
        try:
            yield self
            if self._tx.doomed:
                raise SQLError("the transaction has failed")
            self._commit()
        except BaseException:
            if self._tx:
                self._rollback()
            raise
        finally:
            self._scoped = False

    # --- changes ----------------------------------------------------------------------------

    def _dml(self, s: Statement, explain: bool) -> Result:
        if s.name not in self.catalog.tables:
            raise SQLError(f"unknown table {s.name}")
        columns, source = self.catalog.tables[s.name], self.catalog.sources[s.name]
        now = self._visible()
        bag = self.engine.bag(now, source)
        one = F.lit(1).cast("long")
        if s.kind == "insert":
            if len(s.values) != len(columns):
                raise SQLError("a row has a value for each column")
            if explain:
                return Result((), None, 0, f"INSERT {s.name}")
            if bag.filter(F.col("c0") == F.lit(s.values[0])).limit(1).count():
                raise SQLError("the key exists")
            row = self.spark.range(1).select(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(s.values, bag.schema.fields, strict=False)), one.alias(W))
            self._apply({source: row})
            return Result((), None, 1, f"INSERT {s.name}")
        tests = binder.tests_of(s.where, binder.Scope([(s.name, columns)]))
        sets = {}
        for column, value in s.sets:
            place = binder.Scope([(s.name, columns)]).place(binder.Column(None, column))
            if place == 0:
                raise SQLError("a key can't be updated")
            if place in sets:
                raise SQLError("a column is set twice")
            sets[place] = value
        if explain:
            return Result((), None, 0, f"{s.kind.upper()} {s.name}")
        hit = bag
        for t in tests:
            hit = hit.filter(_test(t))
        # one scan: each row that is hit is counted and gives its own removal and what takes its place
        seen = Observation()
        hit = hit.observe(seen, F.count(F.lit(1)).alias("n"))
        old = F.struct(*zset.names(len(columns)), F.lit(-1).cast("long").alias(W))
        parts = [old]
        if s.kind == "update":
            now_values = [F.lit(sets[i]).cast(bag.schema[f"c{i}"].dataType).alias(f"c{i}") if i in sets else F.col(f"c{i}") for i in range(len(columns))]
            parts.append(F.struct(*now_values, one.alias(W)))
            same = F.struct(*now_values) == F.struct(*zset.names(len(columns)))
            hit = hit.filter(~same)
        self._apply({source: hit.select(F.inline(F.array(*parts)))})
        return Result((), None, seen.get["n"], f"{s.kind.upper()} {s.name}")

    def change(self, changes: dict[str, DataFrame], *, stream: tuple[str, int] | None = None) -> None:
        """Applies signed changes of tables and all that follows from them; commits at once outside a transaction.

        A frame has the columns c0.. of its table and a weight ``w``. Nothing is
        applied if a key would stand twice, a row to be taken out is not there, or a
        row has no key. ``stream`` names the stream's batch that this is.
        """
        self._enter()
        now = self._visible()
        try:
            for name in changes:
                if name not in self.catalog.sources:
                    raise SQLError(f"unknown table {name}")
            written = {self.catalog.sources[name]: self.engine.checked(now, self.catalog.sources[name], df) for name, df in changes.items()}
            self._apply(written, stream)
        except Exception as error:
            if self._tx:
                if self._scoped:
                    self._tx.doomed = True
                else:
                    self._rollback()
            if isinstance(error, (SQLError, StoreError)):
                raise
            raise SQLError(str(error).splitlines()[0] if str(error) else type(error).__name__) from error

    def _apply(self, changes: dict[ir.Node, DataFrame | Written], stream: tuple[str, int] | None = None) -> None:
        now = self._visible()
        after = self.engine.apply(now, changes, list(self.catalog.nodes().values()))
        streams = (self._tx.streams if self._tx else self.streams) | ({stream[0]: stream[1]} if stream else {})
        if self._tx:
            self._tx.state, self._tx.streams = after, streams
            return
        self._check(self.catalog, after, {n for n, b in after.bags.items() if b is not now.bags.get(n)})
        self._swap(self.catalog, after, streams=streams)
        self._counts["commits"] += 1

    # --- queries ----------------------------------------------------------------------------

    def _reuse(self, b: binder.Bound) -> str | None:
        """A view with the same source, projection and predicates, in their order."""
        if self._tx or b.join or b.absent or b.aggregates:
            return None
        for name, (_, _, v) in self.catalog.views.items():
            if v.source == b.source and not (v.join or v.absent or v.aggregates) and [o.place for o in v.outputs] == [o.place for o in b.outputs] and v.tests == b.tests:
                return name
        return None

    def _select(self, b: binder.Bound, explain: bool, reuse: bool = True) -> Result:
        labels, plan = tuple(o.label for o in b.outputs), b.plan()
        if reuse and (view := self._reuse(b)):
            b = replace(b, source=view, tests=(), outputs=tuple(replace(o, place=i) for i, o in enumerate(b.outputs)))
            plan = " ".join([f"FROM_VIEW {view}", *(["SORT"] if b.order else []), *(["LIMIT"] if b.limit is not None else [])])
            self._counts["reuses"] += not explain
        frame = self._frame(b)
        if explain:
            jvm = self.spark.sparkContext._jvm
            mode = jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
            return Result(labels, None, 0, plan, frame._jdf.queryExecution().explainString(mode))
        return Result(labels, frame.toDF(*labels), 0, plan)

    def _frame(self, b: binder.Bound) -> DataFrame:
        state, nodes = self._visible(), self.catalog.nodes()
        unit = all(isinstance(nodes[name], ir.Source) for name in b.relations)
        df = self.engine.bag(state, nodes[b.source])
        if b.join:
            name, left, right = b.join
            width = len(df.columns) - 1
            other = self.engine.bag(state, nodes[name])
            other = other.select(*(F.col(c).alias(f"c{width + i}") for i, c in enumerate(other.columns[:-1])), F.col(W).alias("v"))
            df = df.join(other, df[f"c{left}"] == other[f"c{width + right}"])
            weight = F.lit(1).cast("long") if unit else F.col(W) * F.col("v")  # each product is checked
            df = df.select(*(c for c in df.columns if c not in (W, "v")), weight.alias(W))
        if b.absent:
            name, outer, inner = b.absent
            present = self.engine.bag(state, nodes[name]).select(F.col(f"c{inner}").alias("k"))
            df = df.join(present, df[f"c{outer}"] == present["k"], "left_anti")
        for t in b.tests:
            df = df.filter(_test(t))
        if b.aggregates:
            out = [self._aggregate(df, o, unit).alias(f"o{i}") for i, o in enumerate(b.outputs) if o.kind != "column"]
            if b.group is None:
                df = df.agg(*out)
            else:
                key = F.col(f"c{b.group}")
                df = (df.groupBy(key.alias("k")).agg(*out) if out else df.select(key.alias("k")).distinct()).select(*(F.col("k").alias(f"o{i}") if o.kind == "column" else F.col(f"o{i}") for i, o in enumerate(b.outputs)))
        else:
            df = df.select(*(F.col(f"c{o.place}").alias(f"o{i}") for i, o in enumerate(b.outputs)), *([] if unit else [W]))
            df = df if unit else zset.expanded(df)
        if b.order:
            df = df.orderBy(*(F.col(f"o{i}").desc() if descending else F.col(f"o{i}").asc() for i, descending in b.order))
        return df if b.limit is None else df.limit(b.limit)

    @staticmethod
    def _aggregate(df: DataFrame, o: binder.Output, unit: bool) -> Column:
        if o.kind == "count":
            return F.count("*") if unit else F.coalesce(F.sum(F.col(W).cast(T.DecimalType(38, 0))), F.lit(0)).cast("long")
        value = F.col(f"c{o.place}")
        return wide_sum(value, df.schema[f"c{o.place}"].dataType, None if unit else F.col(W))

    # --- generated queries ------------------------------------------------------------------

    def _ask(self, text: str, parameters: Sequence[int]) -> Result:
        config = self.agent
        if config is None:
            raise AgentError("no agent is configured")
        if self._tx or parameters:
            raise AgentError("generated queries stand outside transactions and have no parameters")
        if not config.disclose_schema:
            raise AgentError("disclosing the schema needs consent")
        names = self.catalog.columns()
        for name in config.relations:
            if name not in names:
                raise AgentError("an allowed relation does not exist")
        context = tuple(RelationContext(n, tuple(names[n]), n in self.catalog.views) for n in config.relations)
        revision = self.revision
        self._busy = True
        try:
            answer = config.generator(GenerationRequest(text, context, revision))
        except Exception:
            raise AgentError("the generator failed") from None
        finally:
            self._busy = False
        if not isinstance(answer, Generation):
            raise AgentError("the generator's answer has the wrong type")
        if isinstance(answer.outcome, Clarification):
            raise ClarificationRequired(answer.outcome.question)
        if isinstance(answer.outcome, Decline):
            raise QueryDeclined(answer.outcome.reason)
        return self.read_only(answer.outcome.sql, config.relations, revision)

    def read_only(self, sql: str, relations: Sequence[str], revision: int) -> Result:
        """A SELECT over allowed relations of the catalog as it was when the query was made."""
        if revision != self.revision:
            raise SQLError("the catalog has changed")
        statement = parse(sql)
        if statement.kind != "select":
            raise SQLError("only SELECT is allowed")
        bound = binder.bind(statement.select, {n: c for n, c in self.catalog.columns().items() if n in relations})
        return self._select(bound, explain=False, reuse=False)


def _test(t: binder.Test) -> Column:
    right = F.col(f"c{t.right}") if t.right is not None else F.lit(t.value)
    return compare(F.col(f"c{t.left}"), t.cmp, right)


def _bound_json(b: binder.Bound) -> dict:
    return {"source": b.source, "outputs": [[o.kind, o.place, o.label, o.qualifier] for o in b.outputs], "join": b.join, "absent": b.absent, "tests": [[t.left, t.cmp, t.value, t.right] for t in b.tests], "group": b.group}


def _bound_of(raw: dict) -> binder.Bound:
    pair = lambda p: tuple(p) if p else None
    return binder.Bound(raw["source"], tuple(binder.Output(*o) for o in raw["outputs"]), pair(raw["join"]), pair(raw["absent"]), tuple(binder.Test(*t) for t in raw["tests"]), raw["group"], (), None)


__all__ = ["Database", "Predicate", "Result", "SQLError", "StoreError"]
