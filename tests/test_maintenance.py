"""Maintained relations: seeded changes against recomputation, views, assertions, sharing and recovery."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyweir import AgentConfig, Database, KeyValue, Model, SQLError
from tallyweir.agent import AgentError, Clarification, ClarificationRequired, Generation, QueryProposal
from tallyweir.model import ModelError
from tallyweir.sources.store import StoreError

NODES = [
    {"op": "source", "name": "lhs", "width": 3},
    {"op": "source", "name": "rhs", "width": 3},
    {"op": "map", "name": "bag", "input": "lhs", "exprs": [["c1"], ["c2", 2, "*", 1, "+"]]},
    {"op": "map", "name": "keys", "input": "rhs", "exprs": [["c1"]]},
    {"op": "join", "name": "both", "left": "bag", "right": "keys", "left_key": 0, "right_key": 0},
    {"op": "join", "name": "self", "left": "keys", "right": "keys", "left_key": 0, "right_key": 0},
    {"op": "anti", "name": "missing", "left": "bag", "right": "keys", "left_key": 0, "right_key": 0},
    {"op": "group", "name": "totals", "input": "both", "key": 0, "value": 1},
    {"op": "filter", "name": "some", "input": "totals", "column": 1, "cmp": "gt", "value": 0},
    {"op": "union", "name": "all", "left": "bag", "right": "bag"},
]


def recomputed(lhs, rhs):
    """The same graph in plain Python."""
    bag = Counter()
    for _, k, v in lhs.values():
        bag[k, v * 2 + 1] += 1
    keys = Counter((k,) for _, k, _ in rhs.values())
    both = Counter({(*a, *b): n * m for a, n in bag.items() for b, m in keys.items() if a[0] == b[0]})
    totals = Counter()
    for k in {a[0] for a in both}:
        totals[k, sum(a[1] * n for a, n in both.items() if a[0] == k), sum(n for a, n in both.items() if a[0] == k)] = 1
    return {
        "bag": bag,
        "both": both,
        "self": Counter({(*a, *a): n * n for a, n in keys.items()}),
        "missing": Counter({a: n for a, n in bag.items() if (a[0],) not in keys}),
        "totals": totals,
        "some": Counter({t: 1 for t in totals if t[1] > 0}),
        "all": Counter({a: 2 * n for a, n in bag.items()}),
    }


@pytest.mark.parametrize("mode", ["overlay", "modular"])
def test_seeded_batches(spark, mode):
    rng = random.Random(4)
    model, state = Model(spark, {"nodes": NODES}, mode), {"lhs": {}, "rhs": {}}
    for step in range(2):
        operations = []
        for _ in range(12):
            table = rng.choice(("lhs", "rhs"))
            key, row = rng.randrange(10), [0, rng.randrange(4), rng.randrange(-2, 3)]
            row[0] = key
            if key not in state[table]:
                operations.append({"op": "insert", "table": table, "row": row})
                state[table][key] = row
            elif rng.random() < 0.5:
                operations.append({"op": "update", "table": table, "row": row})
                state[table][key] = row
            else:
                operations.append({"op": "delete", "table": table, "key": key})
                del state[table][key]
        assert model.apply(operations) == step + 1
        bags = model.snapshot()
        for name, expected in recomputed(state["lhs"], state["rhs"]).items():
            assert Counter({tuple(r)[:-1]: r["w"] for r in bags[name].collect()}) == expected, name


def test_model_rejects_and_prepares(spark):
    spec = {"nodes": [{"op": "source", "name": "s", "width": 2}, {"op": "filter", "name": "bad", "input": "s", "column": 1, "cmp": "lt", "value": 0}], "required_empty": ["bad"]}
    model = Model(spark, spec)
    with pytest.raises(ModelError):
        model.apply([{"op": "insert", "table": "s", "row": [1, -1]}])
    with pytest.raises(Exception, match="missing"):
        model.apply([{"op": "delete", "table": "s", "key": 5}])
    with pytest.raises(TypeError):
        model.prepare([{"op": "insert", "table": "s", "row": [1, True]}])
    candidate = model.prepare([{"op": "insert", "table": "s", "row": [1, 4]}])
    assert candidate.preview()["s"].count() == 1 and model.snapshot()["s"].count() == 0
    assert candidate.publish() == 1
    assert model.snapshot()["s"].count() == 1
    for nodes in ([{"op": "union", "name": "u", "left": "a", "right": "b"}], [{"op": "source", "name": "Bad", "width": 1}]):
        with pytest.raises(ModelError):
            Model(spark, {"nodes": nodes})


def timetable(db):
    """Lessons need a teacher who exists, and a slot holds one lesson."""
    db.execute("CREATE TABLE teachers (id INTEGER PRIMARY KEY, hired INTEGER NOT NULL)")
    db.execute("CREATE TABLE lessons (id INTEGER PRIMARY KEY, slot INTEGER NOT NULL, teacher INTEGER NOT NULL)")
    for key, hired in ((70, 1999), (71, 2010)):
        db.execute("INSERT INTO teachers VALUES (?, ?)", (key, hired))
    db.execute("CREATE MATERIALIZED VIEW slots AS SELECT slot, COUNT(*) AS lessons FROM lessons GROUP BY slot")
    db.execute("CREATE MATERIALIZED VIEW clashes AS SELECT slot FROM slots WHERE lessons > 1")
    db.execute("CREATE MATERIALIZED VIEW orphans AS SELECT l.id AS id FROM lessons AS l WHERE NOT EXISTS (SELECT 1 FROM teachers AS t WHERE t.id = l.teacher)")
    db.execute("CREATE ASSERTION one_a_slot CHECK (NOT EXISTS (SELECT * FROM clashes))")
    db.execute("CREATE ASSERTION taught CHECK (NOT EXISTS (SELECT * FROM orphans))")
    for row in ((1, 900, 70), (2, 1000, 71), (3, 1100, 70)):
        db.execute("INSERT INTO lessons VALUES (?, ?, ?)", row)


def test_assertions_are_deferred(spark):
    with Database(spark) as db:
        timetable(db)
        with pytest.raises(SQLError, match="one_a_slot"):
            db.execute("UPDATE lessons SET slot = 1000 WHERE id = 3")
        with db.transaction():  # two lessons change places, with a clash on the way
            db.execute("UPDATE lessons SET slot = 1000 WHERE id = 1")
            assert db.execute("SELECT * FROM clashes").rows == [(1000,)]
            db.execute("UPDATE lessons SET slot = 900 WHERE id = 2")
        assert sorted(db.execute("SELECT id, slot FROM lessons").rows) == [(1, 1000), (2, 900), (3, 1100)]
        with pytest.raises(SQLError, match="taught"):
            db.execute("DELETE FROM teachers WHERE id = 71")
        with db.transaction():
            db.execute("DELETE FROM teachers WHERE id = 71")
            db.execute("UPDATE lessons SET teacher = 70 WHERE teacher = 71")
        assert db.execute("SELECT COUNT(*) FROM orphans").rows == [(0,)]


def test_alter_recomputes_and_rejects(spark):
    with Database(spark) as db:
        timetable(db)
        db.execute("CREATE MATERIALIZED VIEW early AS SELECT slot, COUNT(*) AS lessons FROM lessons GROUP BY slot")
        before = db.stats()["nodes"]
        db.execute("CREATE MATERIALIZED VIEW again AS SELECT slot, COUNT(*) AS many FROM lessons GROUP BY slot")
        assert db.stats()["nodes"] == before  # equal definitions share one state
        db.execute("ALTER MATERIALIZED VIEW early AS SELECT slot, COUNT(*) AS lessons FROM lessons WHERE slot < 1050 GROUP BY slot")
        assert sorted(db.execute("SELECT slot FROM early").rows) == [(900,), (1000,)] and len(db.execute("SELECT * FROM again").rows) == 3
        for text in ("ALTER MATERIALIZED VIEW early AS SELECT slot FROM lessons", "ALTER MATERIALIZED VIEW slots AS SELECT slot, slot AS lessons FROM clashes"):
            with pytest.raises(SQLError):
                db.execute(text)


def manifests(folder):
    newest = max(p.name.split("-")[1] for p in folder.glob("manifest-*"))
    return [folder / f"manifest-{newest}-{copy}" for copy in (1, 2)]


def spoil(path, text):
    path.write_text(text)
    (path.parent / f".{path.name}.crc").unlink(missing_ok=True)


def test_recovery_checkpoint_and_damage(spark, tmp_path):
    path = str(tmp_path / "db")
    with Database(spark, path) as db:
        timetable(db)
        with pytest.raises(StoreError):
            Database(spark, path)
    with Database(spark, path) as db:
        assert len(db.execute("SELECT slot FROM slots").rows) == 3
        db.execute("DELETE FROM lessons WHERE id = 2")
        db.checkpoint()
        assert db.stats()["fragments"] <= db.stats()["nodes"]
    with Database(spark, path) as db:
        assert sorted(db.execute("SELECT slot, lessons FROM slots").rows) == [(900, 1), (1100, 1)]
        with pytest.raises(SQLError):
            db.execute("INSERT INTO lessons VALUES (4, 900, 70)")
    first, second = manifests(tmp_path / "db")
    good = first.read_text()
    spoil(first, good[:-20])
    with Database(spark, path) as db:  # the second copy is sound
        assert len(db.execute("SELECT * FROM slots").rows) == 2
    outer = json.loads(good)
    spoil(second, json.dumps(outer | {"body": outer["body"].replace("slots", "slotz")}))
    with pytest.raises(StoreError):
        Database(spark, path)


def test_recovery_checks_maintained_relations(spark, tmp_path):
    path = str(tmp_path / "db")
    with Database(spark, path) as db:
        timetable(db)
        wrong = db.catalog.nodes()["slots"]
        bag = db.engine.put(db.engine.bag(db.state, wrong).withColumn("c1", F.col("c1") + 1))
        db.state.bags[wrong] = bag
        db.execute("INSERT INTO teachers VALUES (72, 2020)")
    with pytest.raises(StoreError, match="definition"):
        Database(spark, path)


def test_store_on_a_path_that_only_spark_opens(spark, tmp_path):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.shelf.link./at", f"file://{tmp_path}")
    with Database(spark, "viewfs://shelf/at/db") as db:
        timetable(db)
        with pytest.raises(StoreError):
            Database(spark, "viewfs://shelf/at/db")
    with Database(spark, "viewfs://shelf/at/db") as db:
        assert len(db.execute("SELECT * FROM slots").rows) == 3
    kv = KeyValue(spark, "viewfs://shelf/at/kv")
    kv.insert(5, 6)
    kv.close()
    again = KeyValue(spark, "viewfs://shelf/at/kv")
    assert again.get(5).value == 6
    again.close()


def test_changes_are_checked(spark):
    with Database(spark) as db:
        timetable(db)
        change = lambda *rows: spark.createDataFrame(list(rows), "c0 long, c1 long, w long")
        for rows, word in ((((72, 2000, -1),), "lack"), (((70, 2000, 1),), "twice"), (((80, 1, 1), (80, 2, 1)), "twice"), (((80, 1, 2),), "twice"), (((70, 1998, -1),), "lack"), (((None, 1, 1),), "key")):
            with pytest.raises(SQLError, match=word):
                db.change({"teachers": change(*rows)})
        with pytest.raises(SQLError, match="columns"):
            db.change({"teachers": spark.range(3)})
        db.change({"teachers": change((70, 1999, -1), (70, 2001, 1), (90, 5, 1), (90, 5, -1))})
        assert sorted(db.execute("SELECT * FROM teachers").rows) == [(70, 2001), (71, 2010)]
        with pytest.raises(Exception, match="below one"):
            from tallyweir.operators import zset

            zset.expanded(change((1, 1, -1))).collect()


def test_key_value(spark, tmp_path):
    kv = KeyValue(spark, str(tmp_path / "kv"))
    kv.insert(1, 10, "é")
    with pytest.raises(ValueError):
        kv.insert(1, 1)
    with pytest.raises(ValueError):
        kv.insert(2, 1, "x" * 32)
    with pytest.raises(KeyError):
        kv.get(2)
    with kv.transaction():
        kv.update(1, value=11)
        kv.insert(2, 5)
        assert len(kv) == 2 and kv.get(1).value == 11
        with pytest.raises(KeyError):
            kv.delete(9)
    with pytest.raises(RuntimeError), kv.transaction():
        kv.delete(1)
        raise RuntimeError
    kv.checkpoint()
    kv.close()
    again = KeyValue(spark, str(tmp_path / "kv"))
    assert again.get(1).value == 11 and again.get(1).text == "é" and len(again) == 2
    again.close()


def test_agent(spark):
    answers = iter([Generation(QueryProposal("SELECT id FROM items")), Generation(QueryProposal("SELECT id FROM hidden")), Generation(Clarification("which?"))])
    with Database(spark, agent=AgentConfig(lambda request: next(answers), ("items",), True)) as db:
        db.execute("CREATE TABLE items (id INTEGER PRIMARY KEY)")
        db.execute("CREATE TABLE hidden (id INTEGER PRIMARY KEY)")
        db.execute("INSERT INTO items VALUES (4)")
        assert db.execute("what is there?", agent=True).rows == [(4,)]
        with pytest.raises(SQLError):
            db.execute("and hidden?", agent=True)
        with pytest.raises(ClarificationRequired):
            db.execute("hm?", agent=True)
        with pytest.raises(AgentError):
            db.execute("more", agent=True)
        with pytest.raises(SQLError):
            db.read_only("SELECT id FROM items", ("items",), db.revision - 1)


def test_stream_of_changes(spark, tmp_path):
    from tallyweir.streaming.batches import applier

    source, path = str(tmp_path / "in"), str(tmp_path / "db")
    spark.range(20).select(F.col("id"), (F.col("id") % 3).alias("k")).write.parquet(source)
    with Database(spark, path) as db:
        db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, k INTEGER NOT NULL)")
        db.execute("CREATE MATERIALIZED VIEW v AS SELECT k, COUNT(*) AS n FROM t GROUP BY k")
        apply = applier(db, "t")
        apply(spark.read.parquet(source), 0)
        apply(spark.read.parquet(source), 0)
    with Database(spark, path) as db:  # after a restart the batch comes again
        applier(db, "t")(spark.read.parquet(source), 0)
        applier(db, "t")(spark.createDataFrame([(0, 0, -1), (30, 1, 1)], "id long, k long, w long"), 1)
        assert sorted(db.execute("SELECT * FROM v").rows) == [(0, 6), (1, 8), (2, 6)]
    with Database(spark, path) as db:
        assert db.streams == {"t": 1} and db.execute("SELECT COUNT(*) FROM t").rows == [(20,)]
