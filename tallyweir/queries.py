"""A query for each operator of the engine over the synthetic tables, with SQL for the same rows.

Maintained operators prove themselves: they reach their result by changes, the SQL
computes it from scratch. Their tables start with ids whose last digit is below 7;
then the rest comes and ids that end in 0 go, so ids that don't end in 0 remain.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweir.agent import AgentConfig, Generation, QueryProposal
from tallyweir.database import Database, SQLError, StoreError
from tallyweir.kv import KeyValue
from tallyweir.model import Model
from tallyweir.operators import zset
from tallyweir.operators.mutations import folded
from tallyweir.sources.store import scratch
from tallyweir.streaming.batches import applier

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

CENTS = "CAST(round({} * 100) AS BIGINT)"
TABLES = {
    "orders": ["o_orderkey AS id", "o_custkey AS customer", CENTS.format("o_totalprice") + " AS cents"],
    "customer": ["c_custkey AS id", "CAST(c_nationkey AS BIGINT) AS nation", CENTS.format("c_acctbal") + " AS cents"],
    "lineitem": ["l_orderkey AS order_id", "l_partkey AS part", "l_suppkey AS supplier", "CAST(l_linenumber AS BIGINT) AS line", "CAST(l_quantity AS BIGINT) AS quantity"],
    "events": ["event_id AS id", "user_id AS customer", CENTS.format("value") + " AS cents"],
    "part": ["p_partkey AS id", CENTS.format("p_retailprice") + " AS price", "CAST(p_size AS BIGINT) AS size"],
    "labels": ["doc_id AS id", "CAST(quality AS BIGINT) AS quality", "CAST(toxic AS BIGINT) AS toxic"],
    "documents": ["doc_id AS id", "n_chars AS size"],
}
#: The same projections for the oracles, as common table expressions.
WITH = "WITH " + ", ".join(f"{name}_t AS (SELECT {', '.join(columns)} FROM {name})" for name, columns in TABLES.items())


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").selectExpr(*TABLES[name])


def database(spark: SparkSession, sf_dir: str, *names: str, mode: str = "overlay") -> Database:
    out = Database(spark, mode=mode)
    for name in names:
        out.register(name, frame(spark, sf_dir, name))
    return out


def add(name: str, oracle: str) -> Callable[[Query], Query]:
    def keep(query: Query) -> Query:
        QUERIES[name] = query
        ORACLES[name] = f"{WITH} {oracle}"
        return query

    return keep


def sql(name: str, text: str, oracle: str, *tables: str, parameters: tuple[int, ...] = ()) -> None:
    @add(name, oracle)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return database(spark, sf_dir, *tables).execute(text, parameters).frame


# --- ad-hoc SELECT ---------------------------------------------------------------------------

sql("scan_projection", "SELECT customer, cents FROM events", "SELECT customer, cents FROM events_t", "events")
sql("projection_alias", "SELECT e.customer AS who, e.cents AS amount FROM events AS e", "SELECT customer AS who, cents AS amount FROM events_t", "events")
for _name, _op in (("eq", "="), ("ne", "<>"), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")):
    sql(f"filter_{_name}", f"SELECT order_id, line FROM lineitem WHERE line {_op} ?", f"SELECT order_id, line FROM lineitem_t WHERE line {_op} 3", "lineitem", parameters=(3,))
sql("filter_and", "SELECT order_id, part FROM lineitem WHERE line = 2 AND quantity > 20 AND part <> 7", "SELECT order_id, part FROM lineitem_t WHERE line = 2 AND quantity > 20 AND part <> 7", "lineitem")
sql("filter_col_col", "SELECT order_id, supplier, part FROM lineitem WHERE supplier < part", "SELECT order_id, supplier, part FROM lineitem_t WHERE supplier < part", "lineitem")
sql("pk_lookup", "SELECT * FROM orders WHERE id = 77", "SELECT id, customer, cents FROM orders_t WHERE id = 77", "orders")
sql("join_inner", "SELECT o.id AS order_id, c.nation AS nation, o.cents AS cents FROM orders AS o JOIN customer AS c ON o.customer = c.id", "SELECT o.id AS order_id, c.nation, o.cents FROM orders_t o JOIN customer_t c ON o.customer = c.id", "orders", "customer")
# whole tables, on a key of some ten orders each
sql("join_self", "SELECT a.id AS a, b.id AS b FROM orders AS a INNER JOIN orders AS b ON a.customer = b.customer", "SELECT a.id AS a, b.id AS b FROM orders_t a JOIN orders_t b ON a.customer = b.customer", "orders")
sql("anti_join", "SELECT o.id, o.cents FROM orders AS o WHERE NOT EXISTS (SELECT 1 FROM lineitem AS l WHERE l.order_id = o.id)", "SELECT id, cents FROM orders_t o WHERE NOT EXISTS (SELECT 1 FROM lineitem_t l WHERE l.order_id = o.id)", "orders", "lineitem")
sql("agg_count_global", "SELECT COUNT(*) AS n FROM lineitem WHERE quantity > 10", "SELECT count(*) AS n FROM lineitem_t WHERE quantity > 10", "lineitem")
sql("agg_sum_global", "SELECT SUM(cents) AS total FROM orders", "SELECT CAST(sum(cents) AS BIGINT) AS total FROM orders_t", "orders")
sql("agg_group_sum_count", "SELECT customer, SUM(cents) AS total, COUNT(*) AS n FROM orders GROUP BY customer", "SELECT customer, CAST(sum(cents) AS BIGINT) AS total, count(*) AS n FROM orders_t GROUP BY customer", "orders")
sql("agg_group_distinct", "SELECT nation FROM customer GROUP BY nation", "SELECT DISTINCT nation FROM customer_t", "customer")
FLAGSHIP = "SELECT c.nation AS nation, SUM(o.cents) AS total, COUNT(*) AS n FROM orders AS o JOIN customer AS c ON o.customer = c.id WHERE o.cents > 100000 GROUP BY c.nation ORDER BY total DESC, nation LIMIT 10"
sql("agg_over_join", FLAGSHIP, "SELECT c.nation, CAST(sum(o.cents) AS BIGINT) AS total, count(*) AS n FROM orders_t o JOIN customer_t c ON o.customer = c.id WHERE o.cents > 100000 GROUP BY c.nation ORDER BY total DESC, nation LIMIT 10", "orders", "customer")
sql("sort_multi", "SELECT nation, cents, id FROM customer ORDER BY nation DESC, cents, id", "SELECT nation, cents, id FROM customer_t", "customer")
sql("limit_n", "SELECT id, cents FROM orders ORDER BY id LIMIT ?", "SELECT id, cents FROM orders_t ORDER BY id LIMIT 25", "orders", parameters=(25,))
sql("topk", "SELECT id, cents FROM orders ORDER BY cents DESC, id LIMIT 20", "SELECT id, cents FROM orders_t ORDER BY cents DESC, id LIMIT 20", "orders")


@add("agg_sum_cancel", "SELECT 9223372036854775807 AS total, CAST(3 AS BIGINT) AS n")
def agg_sum_cancel(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark)
    db.execute("CREATE TABLE numbers (id INTEGER PRIMARY KEY, value INTEGER NOT NULL)")
    for key, value in enumerate((9223372036854775807, 1, -1)):
        db.execute("INSERT INTO numbers VALUES (?, ?)", (key, value))
    return db.execute("SELECT SUM(value) AS total, COUNT(*) AS n FROM numbers").frame


# --- maintained graphs -----------------------------------------------------------------------


def maintained(spark: SparkSession, nodes: list[dict], sources: Mapping[str, DataFrame], out: str, statements: int = 1, mode: str = "overlay", empty: tuple[str, ...] = ()) -> DataFrame:
    """The bag of ``out`` after a load and the changes described above, in one batch or two."""
    model = Model(spark, {"nodes": nodes, "required_empty": list(empty)}, mode)
    flat = {name: df.toDF(*zset.names(len(df.columns))) for name, df in sources.items()}
    model.load({name: df.filter(F.col("c0") % 10 < 7) for name, df in flat.items()})
    more = {name: df.filter(F.col("c0") % 10 >= 7).withColumn("op", F.lit("insert")) for name, df in flat.items()}
    less = {name: df.filter(F.col("c0") % 10 == 0).withColumn("op", F.lit("delete")) for name, df in flat.items()}
    if statements == 1:
        model.prepare_frames({n: more[n].union(less[n]).withColumn("at", F.lit(0)) for n in flat}).publish()
    else:
        for part in (more, less):
            model.prepare_frames({n: part[n].withColumn("at", F.lit(0)) for n in flat}).publish()
    return zset.expanded(model.snapshot()[out])


def source(name: str, width: int) -> dict:
    return {"op": "source", "name": name, "width": width}


def ivm(name: str, tables: list[str], nodes: list[dict], columns: list[str], oracle: str, statements: int = 1) -> None:
    @add(name, oracle)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        frames = {t: frame(spark, sf_dir, t) for t in tables}
        declared = [*(source(t, len(TABLES[t])) for t in tables), *nodes]
        return maintained(spark, declared, frames, nodes[-1]["name"], statements).toDF(*columns)


_E = "(SELECT * FROM events_t WHERE id % 10 <> 0)"
_O = "(SELECT * FROM orders_t WHERE id % 10 <> 0)"
_C = "(SELECT * FROM customer_t WHERE id % 10 <> 0)"
ivm("ivm_map", ["events"], [{"op": "map", "name": "out", "input": "events", "exprs": [["c1"], ["c2", 3, "*", "c0", "-"]]}], ["customer", "x"], f"SELECT customer, cents * 3 - id AS x FROM {_E}")
ivm("ivm_filter", ["events"], [{"op": "filter", "name": "out", "input": "events", "column": 2, "cmp": "gt", "value": 5000}], ["id", "customer", "cents"], f"SELECT id, customer, cents FROM {_E} WHERE cents > 5000")
ivm("ivm_union", ["events"], [{"op": "filter", "name": "low", "input": "events", "column": 2, "cmp": "lt", "value": 4000}, {"op": "filter", "name": "some", "input": "events", "column": 1, "cmp": "lt", "value": 500}, {"op": "union", "name": "out", "left": "low", "right": "some"}], ["id", "customer", "cents"], f"SELECT id, customer, cents FROM {_E} WHERE cents < 4000 UNION ALL SELECT id, customer, cents FROM {_E} WHERE customer < 500")
ivm("ivm_join_delta", ["orders", "customer"], [{"op": "join", "name": "both", "left": "orders", "right": "customer", "left_key": 1, "right_key": 0}, {"op": "map", "name": "out", "input": "both", "exprs": [["c0"], ["c4"], ["c2"]]}], ["id", "nation", "cents"], f"SELECT o.id, c.nation, o.cents FROM {_O} o JOIN {_C} c ON o.customer = c.id")
ivm("ivm_self_join_delta", ["orders"], [{"op": "join", "name": "both", "left": "orders", "right": "orders", "left_key": 1, "right_key": 1}, {"op": "map", "name": "out", "input": "both", "exprs": [["c0"], ["c3"]]}], ["a", "b"], f"SELECT a.id AS a, b.id AS b FROM {_O} a JOIN {_O} b ON a.customer = b.customer")
ivm("ivm_anti_delta", ["documents", "labels"], [{"op": "anti", "name": "out", "left": "documents", "right": "labels", "left_key": 0, "right_key": 0}], ["id", "size"], "SELECT id, size FROM documents_t d WHERE id % 10 <> 0 AND NOT EXISTS (SELECT 1 FROM labels_t l WHERE l.id = d.id AND l.id % 10 <> 0)")
ivm("ivm_group_delta", ["events"], [{"op": "group", "name": "out", "input": "events", "key": 1, "value": 2}], ["customer", "total", "n"], f"SELECT customer, CAST(sum(cents) AS BIGINT) AS total, count(*) AS n FROM {_E} GROUP BY customer")
ivm("ivm_two_batches", ["orders"], [{"op": "group", "name": "sums", "input": "orders", "key": 1, "value": 2}, {"op": "filter", "name": "out", "input": "sums", "column": 2, "cmp": "gt", "value": 5}], ["customer", "total", "n"], f"SELECT customer, CAST(sum(cents) AS BIGINT) AS total, count(*) AS n FROM {_O} GROUP BY customer HAVING count(*) > 5", statements=2)
ivm("map_identity", ["events"], [{"op": "map", "name": "same", "input": "events", "exprs": [["c0"], ["c1"], ["c2"]]}, {"op": "filter", "name": "out", "input": "same", "column": 2, "cmp": "le", "value": 900}], ["id", "customer", "cents"], f"SELECT id, customer, cents FROM {_E} WHERE cents <= 900")


@add("ivm_two_statement_tx", "SELECT customer, CAST(sum(cents) AS BIGINT) AS total, count(*) AS n FROM (SELECT customer, CASE WHEN customer % 2 = 0 THEN cents + 0 ELSE 7 END AS cents FROM orders_t WHERE cents >= 100000) GROUP BY customer")
def ivm_two_statement_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view after two statements of one transaction, of which the second sees what the first did."""
    db = database(spark, sf_dir, "orders")
    db.execute("CREATE MATERIALIZED VIEW v AS SELECT customer, SUM(cents) AS total, COUNT(*) AS n FROM orders GROUP BY customer")
    odd = frame(spark, sf_dir, "orders").filter("customer % 2 = 1 AND cents >= 100000")
    with db.transaction():
        db.execute("DELETE FROM orders WHERE cents < 100000")
        old = odd.select(F.col("id").alias("c0"), F.col("customer").alias("c1"), F.col("cents").alias("c2"))
        db.change({"orders": old.withColumn("w", F.lit(-1).cast("long")).union(old.withColumn("c2", F.lit(7).cast("long")).withColumn("w", F.lit(1).cast("long")))})
    return db.execute("SELECT customer, total, n FROM v").frame


@add("map_arithmetic", "SELECT order_id * 10 + line - supplier AS x FROM lineitem_t")
def map_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyweir.functions.exact import checked

    lines = frame(spark, sf_dir, "lineitem").toDF(*zset.names(5))
    return lines.select(checked(("c0", 10, "*", "c3", "+", "c2", "-"), lambda i: F.col(f"c{i}")).alias("x"))


@add("union_all", "SELECT id, cents FROM events_t WHERE cents < 3000 UNION ALL SELECT id, cents FROM events_t WHERE cents < 6000")
def union_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = frame(spark, sf_dir, "events").select("id", "cents")
    low, mid = (events.filter(F.col("cents") < most).toDF("c0", "c1").withColumn("w", F.lit(1).cast("long")) for most in (3000, 6000))
    return zset.expanded(zset.summed(zset.added(low, mid))).toDF("id", "cents")


@add("delta_canonicalize", "SELECT customer, CAST(count(*) FILTER (WHERE cents >= 5000) - count(*) FILTER (WHERE cents < 5000) AS BIGINT) AS weight FROM events_t GROUP BY customer HAVING count(*) FILTER (WHERE cents >= 5000) <> count(*) FILTER (WHERE cents < 5000)")
def delta_canonicalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    signed = frame(spark, sf_dir, "events").select(F.col("customer").alias("c0"), F.when(F.col("cents") < 5000, -1).otherwise(1).cast("long").alias("w"))
    return zset.summed(signed).toDF("customer", "weight")


@add("mutation_fold", "SELECT id, CASE WHEN id % 5 = 1 THEN cents + 1 ELSE cents END AS cents FROM orders_t WHERE id % 5 <> 0 AND id % 10 <> 7 UNION ALL SELECT -id AS id, cents FROM orders_t WHERE id % 5 = 0")
def mutation_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates, deletes, inserts, and an update that a later delete undoes, as one change."""
    base = frame(spark, sf_dir, "orders").select(F.col("id").alias("c0"), F.col("cents").alias("c1"), F.lit(1).cast("long").alias("w"))

    def some(at: int, op: str, when: str, key: str = "c0", value: str = "c1") -> DataFrame:
        return base.filter(when).selectExpr(f"{at} AS at", f"'{op}' AS op", f"{key} AS c0", f"{value} AS c1")

    steps = [some(0, "update", "c0 % 5 = 1", value="c1 + 1"), some(1, "delete", "c0 % 5 = 0"), some(2, "insert", "c0 % 5 = 0", key="-c0"), some(3, "update", "c0 % 10 = 7", value="0"), some(4, "delete", "c0 % 10 = 7")]
    operations = steps[0]
    for s in steps[1:]:
        operations = operations.union(s)
    return zset.expanded(zset.summed(base.union(folded(base, operations)))).toDF("id", "cents")


@add("model_nations", f"SELECT c.nation, CAST(sum(e.cents) AS BIGINT) AS total, count(*) AS n FROM {_E} e JOIN {_C} c ON e.customer = c.id WHERE e.cents > 5000 GROUP BY c.nation HAVING count(*) > 3")
def model_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model with a relation that must stay empty."""
    nodes = [
        source("events", 3),
        source("customer", 3),
        {"op": "filter", "name": "large", "input": "events", "column": 2, "cmp": "gt", "value": 5000},
        {"op": "join", "name": "placed", "left": "large", "right": "customer", "left_key": 1, "right_key": 0},
        {"op": "map", "name": "by_nation", "input": "placed", "exprs": [["c4"], ["c2"]]},
        {"op": "group", "name": "totals", "input": "by_nation", "key": 0, "value": 1},
        {"op": "filter", "name": "out", "input": "totals", "column": 2, "cmp": "gt", "value": 3},
        {"op": "filter", "name": "nowhere", "input": "customer", "column": 1, "cmp": "lt", "value": 0},
    ]
    return maintained(spark, nodes, {t: frame(spark, sf_dir, t) for t in ("events", "customer")}, "out", empty=("nowhere",)).toDF("nation", "total", "n")


@add("model_pricing", f"SELECT o.customer, CAST(sum(p.price * (o.cents % 7 + 1)) AS BIGINT) AS total, count(*) AS n FROM {_O} o JOIN (SELECT * FROM part_t WHERE id % 10 <> 0) p ON o.id % 200 + 1 = p.id GROUP BY o.customer")
def model_pricing(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = [
        source("part", 3),
        source("orders", 4),
        {"op": "join", "name": "priced", "left": "orders", "right": "part", "left_key": 2, "right_key": 0},
        {"op": "map", "name": "totals", "input": "priced", "exprs": [["c1"], ["c5", "c3", "*"]]},
        {"op": "group", "name": "out", "input": "totals", "key": 0, "value": 1},
    ]
    orders = frame(spark, sf_dir, "orders").selectExpr("id", "customer", "id % 200 + 1 AS product", "cents % 7 + 1 AS quantity")
    return maintained(spark, nodes, {"part": frame(spark, sf_dir, "part"), "orders": orders}, "out").toDF("customer", "total", "n")


# --- views, transactions, assertions through SQL ----------------------------------------------


def changed(db: Database, table: str, frame_: DataFrame) -> None:
    """Rows of ``table`` whose key ends in 0 go, by SQL-level change."""
    gone = frame_.filter(F.col(frame_.columns[0]) % 10 == 0)
    db.change({table: gone.toDF(*zset.names(len(gone.columns))).withColumn("w", F.lit(-1).cast("long"))})


def refused(action: Callable[[], object], word: str) -> None:
    """The action must fail with an error that says why."""
    try:
        action()
    except (SQLError, StoreError) as error:
        if word not in str(error):
            raise
        return
    raise AssertionError(f"expected an error about {word}")


def view(name: str, tables: list[str], views: list[str], query_text: str, oracle: str, after: list[str] | None = None) -> None:
    @add(name, oracle)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = database(spark, sf_dir, *tables)
        for text in views:
            db.execute(text)
        changed(db, tables[0], frame(spark, sf_dir, tables[0]))
        for text in after or []:
            db.execute(text)
        return db.execute(query_text).frame


view("mv_project", ["events"], ["CREATE MATERIALIZED VIEW v AS SELECT customer, cents FROM events"], "SELECT * FROM v", f"SELECT customer, cents FROM {_E}")
view("mv_filter", ["events"], ["CREATE MATERIALIZED VIEW v AS SELECT id, cents FROM events WHERE cents > 2000 AND customer < 900"], "SELECT id, cents FROM v", f"SELECT id, cents FROM {_E} WHERE cents > 2000 AND customer < 900")
view("mv_join", ["orders", "customer"], ["CREATE MATERIALIZED VIEW v AS SELECT o.id AS id, c.nation AS nation FROM orders AS o JOIN customer AS c ON o.customer = c.id"], "SELECT * FROM v", f"SELECT o.id, c.nation FROM {_O} o JOIN customer_t c ON o.customer = c.id")
view("mv_group", ["orders"], ["CREATE MATERIALIZED VIEW v AS SELECT customer, SUM(cents) AS total, COUNT(*) AS n FROM orders GROUP BY customer"], "SELECT customer, total, n FROM v WHERE n > 2", f"SELECT customer, CAST(sum(cents) AS BIGINT) AS total, count(*) AS n FROM {_O} GROUP BY customer HAVING count(*) > 2")
view("mv_anti", ["documents", "labels"], ["CREATE MATERIALIZED VIEW v AS SELECT d.id AS id FROM documents AS d WHERE NOT EXISTS (SELECT * FROM labels AS l WHERE l.id = d.id)"], "SELECT id FROM v", "SELECT id FROM documents_t d WHERE id % 10 <> 0 AND NOT EXISTS (SELECT 1 FROM labels_t l WHERE l.id = d.id)")
view("mv_on_mv", ["orders"], ["CREATE MATERIALIZED VIEW big AS SELECT customer, cents FROM orders WHERE cents > 200000", "CREATE MATERIALIZED VIEW v AS SELECT customer, COUNT(*) AS n FROM big GROUP BY customer"], "SELECT customer, n FROM v", f"SELECT customer, count(*) AS n FROM {_O} WHERE cents > 200000 GROUP BY customer")
view("mv_alter_recompute", ["orders"], ["CREATE MATERIALIZED VIEW big AS SELECT customer, cents FROM orders WHERE cents > 200000", "CREATE MATERIALIZED VIEW v AS SELECT customer, SUM(cents) AS total FROM big GROUP BY customer"], "SELECT customer, total FROM v", f"SELECT customer, CAST(sum(cents) AS BIGINT) AS total FROM {_O} WHERE cents <= 9000000 GROUP BY customer", ["ALTER MATERIALIZED VIEW big AS SELECT customer, cents FROM orders WHERE cents <= 9000000"])
view("agg_over_view", ["events"], ["CREATE MATERIALIZED VIEW v AS SELECT customer, cents FROM events WHERE cents < 8000"], "SELECT customer, COUNT(*) AS n, SUM(cents) AS total FROM v GROUP BY customer", f"SELECT customer, count(*) AS n, CAST(sum(cents) AS BIGINT) AS total FROM {_E} WHERE cents < 8000 GROUP BY customer")
view("shared_views", ["events"], ["CREATE MATERIALIZED VIEW a AS SELECT customer, SUM(cents) AS x FROM events GROUP BY customer", "CREATE MATERIALIZED VIEW b AS SELECT customer, SUM(cents) AS y FROM events GROUP BY customer"], "SELECT a.customer AS customer, a.x AS x, b.y AS y FROM a JOIN b ON a.customer = b.customer", f"SELECT customer, CAST(sum(cents) AS BIGINT) AS x, CAST(sum(cents) AS BIGINT) AS y FROM {_E} GROUP BY customer")
view("view_reuse", ["events"], ["CREATE MATERIALIZED VIEW v AS SELECT id, cents AS amount FROM events WHERE cents > 7000"], "SELECT id, cents FROM events WHERE cents > 7000", f"SELECT id, cents FROM {_E} WHERE cents > 7000")
@add("assertion_violations", "SELECT id, customer FROM orders_t WHERE customer < 100")
def assertion_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an assertion's relation holds inside a transaction that therefore can't commit."""
    db = database(spark, sf_dir, "orders")
    db.execute("CREATE MATERIALIZED VIEW negative AS SELECT id, customer FROM orders WHERE cents < 0")
    db.execute("CREATE ASSERTION none_negative CHECK (NOT EXISTS (SELECT * FROM negative))")
    db.execute("BEGIN")
    db.execute("UPDATE orders SET cents = -1 WHERE customer < 100")
    found = db.execute("SELECT * FROM negative").frame
    refused(lambda: db.execute("COMMIT"), "none_negative")
    return found


@add("assertion_repair", "SELECT id, customer, CASE WHEN id = 3 THEN 7 ELSE cents END AS cents FROM orders_t")
def assertion_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A violation within a transaction that a later statement repairs."""
    db = database(spark, sf_dir, "orders")
    db.execute("CREATE MATERIALIZED VIEW negative AS SELECT id FROM orders WHERE cents < 0")
    db.execute("CREATE ASSERTION none_negative CHECK (NOT EXISTS (SELECT * FROM negative))")
    with db.transaction():
        db.execute("UPDATE orders SET cents = -1 WHERE id = 3")
        db.execute("UPDATE orders SET cents = 7 WHERE id = 3")
    return db.execute("SELECT * FROM orders").frame


@add("tx_rollback", "SELECT customer, count(*) AS n FROM orders_t GROUP BY customer")
def tx_rollback(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = database(spark, sf_dir, "orders")
    db.execute("CREATE MATERIALIZED VIEW v AS SELECT customer, COUNT(*) AS n FROM orders GROUP BY customer")
    db.execute("BEGIN")
    db.execute("DELETE FROM orders WHERE customer < 500")
    db.execute("ROLLBACK")
    return db.execute("SELECT * FROM v").frame


def dml(name: str, text: str, oracle: str) -> None:
    @add(name, oracle)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = database(spark, sf_dir, "orders")
        db.execute(text)
        return db.execute("SELECT * FROM orders").frame


dml("dml_insert", "INSERT INTO orders VALUES (-5, 1, 99)", "SELECT id, customer, cents FROM orders_t UNION ALL SELECT -5, 1, 99")
dml("dml_update", "UPDATE orders SET cents = 5, customer = 1 WHERE customer < 100 AND cents > 1000", "SELECT id, CASE WHEN customer < 100 AND cents > 1000 THEN 1 ELSE customer END AS customer, CASE WHEN customer < 100 AND cents > 1000 THEN 5 ELSE cents END AS cents FROM orders_t")
dml("dml_delete", "DELETE FROM orders WHERE cents < 10000000", "SELECT id, customer, cents FROM orders_t WHERE cents >= 10000000")


def reading(name: str, mode: str) -> None:
    @add(name, "SELECT id, customer, CASE WHEN customer = 7 THEN 1 ELSE cents END AS cents FROM orders_t WHERE id % 10 <> 0")
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = database(spark, sf_dir, "orders", mode=mode)
        changed(db, "orders", frame(spark, sf_dir, "orders"))
        db.execute("BEGIN")
        db.execute("UPDATE orders SET cents = 1 WHERE customer = 7")
        return db.execute("SELECT * FROM orders").frame  # read within the transaction


reading("overlay_read", "overlay")
reading("modular_read", "modular")


# --- snapshots, previews, recovery, streams, generated queries ---------------------------------


@add("snapshot_then_change", "SELECT id, customer, cents FROM orders_t")
def snapshot_then_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot stays as it was, whatever is changed after it."""
    db = database(spark, sf_dir, "orders")
    before = db.snapshot()["orders"]
    db.execute("DELETE FROM orders WHERE customer < 700")
    return zset.expanded(before).toDF("id", "customer", "cents")


def _half_model(spark: SparkSession, sf_dir: str) -> tuple[Model, DataFrame]:
    model = Model(spark, {"nodes": [source("orders", 3), {"op": "group", "name": "sums", "input": "orders", "key": 1, "value": 2}]})
    rows = frame(spark, sf_dir, "orders").toDF(*zset.names(3))
    model.load({"orders": rows.filter("c0 % 2 = 0")})
    return model, rows.filter("c0 % 2 = 1").withColumn("op", F.lit("insert")).withColumn("at", F.lit(0))


@add("preview_read", "SELECT customer, CAST(sum(cents) AS BIGINT) AS total, count(*) AS n FROM orders_t GROUP BY customer")
def preview_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a prepared batch would make visible."""
    model, rest = _half_model(spark, sf_dir)
    return zset.expanded(model.prepare_frames({"orders": rest}).preview()["sums"]).toDF("customer", "total", "n")


@add("prepare_abort", "SELECT customer, CAST(sum(cents) AS BIGINT) AS total, count(*) AS n FROM orders_t WHERE id % 2 = 0 GROUP BY customer")
def prepare_abort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prepared batch that is dropped leaves no trace."""
    model, rest = _half_model(spark, sf_dir)
    model.prepare_frames({"orders": rest}).abort()
    return zset.expanded(model.snapshot()["sums"]).toDF("customer", "total", "n")


def _durable(spark: SparkSession) -> str:
    return f"{scratch(spark)}/db"


def _filled(spark: SparkSession, sf_dir: str, path: str) -> Database:
    db = Database(spark, path)
    db.execute("CREATE TABLE orders (id INTEGER PRIMARY KEY, customer INTEGER NOT NULL, cents INTEGER NOT NULL)")
    db.execute("CREATE MATERIALIZED VIEW v AS SELECT customer, SUM(cents) AS total FROM orders GROUP BY customer")
    db.change({"orders": frame(spark, sf_dir, "orders").toDF(*zset.names(3)).withColumn("w", F.lit(1).cast("long"))})
    db.execute("DELETE FROM orders WHERE cents < 100000")
    return db


_BIG = "SELECT customer, CAST(sum(cents) AS BIGINT) AS total FROM orders_t WHERE cents >= 100000 GROUP BY customer"


@add("recover_read", _BIG)
def recover_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view of a store that was closed and opened again, which checks it against its definition."""
    path = _durable(spark)
    _filled(spark, sf_dir, path).close()
    return Database(spark, path).execute("SELECT * FROM v").frame


@add("checkpoint_read", _BIG)
def checkpoint_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after its fragments were merged."""
    path = _durable(spark)
    with _filled(spark, sf_dir, path) as db:
        db.checkpoint()
    return Database(spark, path).execute("SELECT * FROM v").frame


@add("stream_replay", "SELECT customer, count(*) AS n FROM orders_t WHERE id % 4 <> 3 GROUP BY customer")
def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of a stream that come again, before and after a restart, count once."""
    path, rows = _durable(spark), frame(spark, sf_dir, "orders")
    with Database(spark, path) as db:
        db.execute("CREATE TABLE orders (id INTEGER PRIMARY KEY, customer INTEGER NOT NULL, cents INTEGER NOT NULL)")
        db.execute("CREATE MATERIALIZED VIEW v AS SELECT customer, COUNT(*) AS n FROM orders GROUP BY customer")
        for number in (0, 1, 1, 0):
            applier(db, "orders")(rows.filter(F.col("id") % 4 == number), number)
    db = Database(spark, path)
    for number in (1, 2):
        applier(db, "orders")(rows.filter(F.col("id") % 4 == number), number)
    return db.execute("SELECT * FROM v").frame


@add("change_rejects", "SELECT id, customer, cents FROM orders_t")
def change_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes that repeat a key, take out what isn't there or change nothing real leave a table as it was."""
    db, rows = database(spark, sf_dir, "orders"), frame(spark, sf_dir, "orders").toDF(*zset.names(3))
    weighing = lambda df, w: df.withColumn("w", F.lit(w).cast("long"))
    refused(lambda: db.change({"orders": weighing(rows.withColumn("c2", F.col("c2") + 1), 1)}), "twice")
    refused(lambda: db.change({"orders": weighing(rows.withColumn("c0", -F.col("c0")), -1)}), "lack")
    refused(lambda: db.change({"orders": weighing(rows.withColumn("c0", F.lit(None).cast("long")), 1)}), "no key")
    db.change({"orders": weighing(rows, 1).union(weighing(rows, -1))})
    return db.execute("SELECT * FROM orders").frame


@add("change_batch", "SELECT id, customer, CASE WHEN id % 3 = 0 THEN 1 ELSE cents END AS cents FROM orders_t WHERE id % 3 <> 1")
def change_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of updates and deletes as one frame."""
    db, rows = database(spark, sf_dir, "orders"), frame(spark, sf_dir, "orders").toDF(*zset.names(3))
    old = rows.filter("c0 % 3 < 2").withColumn("w", F.lit(-1).cast("long"))
    db.change({"orders": old.union(rows.filter("c0 % 3 = 0").withColumn("c2", F.lit(1).cast("long")).withColumn("w", F.lit(1).cast("long")))})
    return db.execute("SELECT * FROM orders").frame


@add("prune_untouched", "SELECT true AS pruned, CAST(0 AS BIGINT) AS propagations")
def prune_untouched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change of one table reaches no view of another: counted by the engine's own figures."""
    db = database(spark, sf_dir, "orders", "customer")
    db.execute("CREATE MATERIALIZED VIEW v AS SELECT nation, COUNT(*) AS n FROM customer GROUP BY nation")
    before = db.stats()
    db.execute("DELETE FROM orders WHERE id = 1")
    after = db.stats()
    return spark.createDataFrame([(after["pruned"] > before["pruned"], after["propagations"] - before["propagations"])], "pruned boolean, propagations long")


@add("explain_select", "SELECT true AS joins, true AS pushes, true AS names_view")
def explain_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What explaining tells: Spark's plan of a join, a filter that reaches the scan, a view that is used instead."""
    db = database(spark, sf_dir, "orders", "customer", "lineitem")
    join = db.execute("SELECT o.id FROM orders AS o JOIN customer AS c ON o.customer = c.id", explain=True).physical
    scan = db.execute("SELECT part FROM lineitem WHERE supplier = 3", explain=True).physical
    db.execute("CREATE MATERIALIZED VIEW v AS SELECT id FROM orders WHERE customer = 5")
    plan = db.execute("SELECT id FROM orders WHERE customer = 5", explain=True).plan
    return spark.createDataFrame([("Join" in join, "PushedFilters: [IsNotNull(l_suppkey), EqualTo(l_suppkey,3)]" in scan, plan == "FROM_VIEW v")], "joins boolean, pushes boolean, names_view boolean")


@add("agent_query", "SELECT id, cents FROM orders_t WHERE cents > 20000000")
def agent_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generated query over an allowed relation; one over another is refused."""
    answers = iter(["SELECT id FROM customer", "SELECT id, cents FROM orders WHERE cents > 20000000"])
    db = Database(spark, agent=AgentConfig(lambda request: Generation(QueryProposal(next(answers))), ("orders",), True))
    for name in ("orders", "customer"):
        db.register(name, frame(spark, sf_dir, name))
    refused(lambda: db.execute("who are our customers?", agent=True), "customer")
    return db.execute("which orders are large?", agent=True).frame


# --- key/value -------------------------------------------------------------------------------


def _kv_filled(store: KeyValue, sf_dir: str) -> KeyValue:
    store.insert_frame(store.spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey AS key", "CAST(p_size AS BIGINT) AS value", "substr(p_name, 1, 31) AS text"))
    return store


def kv(name: str, change: Callable[[KeyValue], object], oracle: str) -> None:
    @add(name, oracle)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        store = _kv_filled(KeyValue(spark), sf_dir)
        out = change(store)
        return out if isinstance(out, DataFrame) else store.frame().select("key", "value", "text")


_KV = "SELECT p_partkey AS key, CAST(p_size AS BIGINT) AS value, substr(p_name, 1, 31) AS text FROM part"
kv("kv_insert", lambda s: s.insert(-1, 5, "new"), f"{_KV} UNION ALL SELECT -1, 5, 'new'")
kv("kv_get", lambda s: s.spark.createDataFrame([(r.key, r.value, r.text) for r in [s.get(42)]], "key long, value long, text string"), f"SELECT * FROM ({_KV}) WHERE key = 42")
kv("kv_update", lambda s: s.update(42, value=-7), f"SELECT key, CASE WHEN key = 42 THEN -7 ELSE value END AS value, text FROM ({_KV})")
kv("kv_delete", lambda s: s.delete(42), f"SELECT * FROM ({_KV}) WHERE key <> 42")
kv("kv_count", lambda s: s.spark.range(1).select(F.lit(len(s)).cast("long").alias("n")), "SELECT count(*) AS n FROM part")


@add("kv_transaction", f"SELECT key, CASE WHEN key IN (50, 100) THEN 0 ELSE value END AS value, text FROM ({_KV}) WHERE key <> 7")
def kv_transaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A transaction that commits, and one that an error undoes."""
    store = _kv_filled(KeyValue(spark), sf_dir)
    with store.transaction():
        for key in (50, 100):
            store.update(key, value=0)
        store.delete(7)
    try:
        with store.transaction():
            store.delete(8)
            store.insert(9, 1)
    except ValueError:
        pass
    return store.frame().select("key", "value", "text")


@add("kv_recover", f"SELECT key, CASE WHEN key = 3 THEN 1 ELSE value END AS value, text FROM ({_KV})")
def kv_recover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store on disk, closed and opened again."""
    path = _durable(spark)
    store = _kv_filled(KeyValue(spark, path), sf_dir)
    store.update(3, value=1)
    store.close()
    return KeyValue(spark, path).frame().select("key", "value", "text")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["agg_over_join"](spark, sf_dir)
