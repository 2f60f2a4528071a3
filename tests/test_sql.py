"""Ad-hoc SQL: results, rejections, parameters, exact sums, reuse and explanations."""

import pytest
from pyspark.sql import functions as F

from tallyweir import Database, SQLError
from tallyweir.functions.exact import wide_sum

RIVERS = {1: (2100, 5), 2: (340, 5), 3: (990, 6), 4: (12, 9)}
GAUGES = {10: (1, 40, -3), 11: (1, 25, 8), 12: (3, 60, 0), 13: (2, 25, 1), 14: (3, 5, 77)}


def filled(d):
    with d:
        d.execute("CREATE TABLE rivers (id INTEGER PRIMARY KEY, length INTEGER NOT NULL, basin INTEGER NOT NULL)")
        d.execute("CREATE TABLE gauges (id INTEGER PRIMARY KEY, river INTEGER NOT NULL, depth INTEGER NOT NULL, drift INTEGER NOT NULL)")
        with d.transaction():
            for key, row in RIVERS.items():
                d.execute("INSERT INTO rivers VALUES (?, ?, ?)", (key, *row))
            for key, row in GAUGES.items():
                d.execute("INSERT INTO gauges VALUES (?, ?, ?, ?)", (key, *row))
        yield d


@pytest.fixture(scope="module")
def db(spark):
    """For tests that leave it as it is."""
    yield from filled(Database(spark))


@pytest.fixture
def fresh(spark):
    yield from filled(Database(spark))


def rows(db, text, parameters=()):
    return sorted(db.execute(text, parameters).rows)


def test_groups_over_a_join(db):
    expected = {}
    for river, depth, drift in GAUGES.values():
        if drift >= 0:
            n, total = expected.get(RIVERS[river][1], (0, 0))
            expected[RIVERS[river][1]] = n + 1, total + depth
    r = db.execute("SELECT r.basin, SUM(g.depth) AS depths, COUNT(*) AS gauges FROM gauges AS g JOIN rivers AS r ON g.river = r.id WHERE g.drift >= ? GROUP BY r.basin ORDER BY depths DESC", (0,))
    assert r.columns == ("basin", "depths", "gauges")
    assert r.rows == sorted(((b, t, n) for b, (n, t) in expected.items()), key=lambda x: -x[1])
    first = db.execute("SELECT r.basin, SUM(g.depth) AS depths FROM gauges AS g JOIN rivers AS r ON g.river = r.id GROUP BY r.basin ORDER BY depths LIMIT 1")
    assert first.rows == [(6, 65)]


def test_absence_and_empty_aggregates(db):
    assert rows(db, "SELECT r.id, r.length FROM rivers AS r WHERE NOT EXISTS (SELECT 1 FROM gauges AS g WHERE g.river = r.id)") == [(4, 12)]
    assert rows(db, "SELECT COUNT(*), SUM(drift) FROM gauges WHERE depth > 1000") == [(0, None)]
    assert db.execute("SELECT SUM(drift), COUNT(*) FROM gauges").columns == ("sum(drift)", "count(*)")
    assert rows(db, "SELECT depth FROM gauges GROUP BY depth") == [(5,), (25,), (40,), (60,)]


@pytest.mark.parametrize(
    "text",
    [
        "SELECT colour FROM rivers",
        "SELECT id FROM lakes",
        "SELECT id FROM gauges JOIN rivers ON gauges.river = rivers.id",
        "SELECT basin, SUM(length) FROM rivers",
        "SELECT * FROM rivers WHERE length > 'long'",
        "SELECT id FROM rivers LIMIT 100001",
        "SELECT id FROM rivers WHERE length < 5 OR basin = 9",
        "SELECT id FROM rivers; DELETE FROM rivers",
        "SELECT id FROM rivers ORDER BY length",
        "INSERT INTO rivers VALUES (4, 1, 1)",
        "INSERT INTO rivers VALUES (5, 1)",
        "UPDATE rivers SET id = 7 WHERE id = 1",
        "CREATE TABLE gauges (id INTEGER PRIMARY KEY)",
        "CREATE TABLE __ivm_r (id INTEGER PRIMARY KEY)",
        "COMMIT",
        "TRUNCATE rivers",
    ],
)
def test_rejections(db, text):
    with pytest.raises(SQLError):
        db.execute(text)
    assert rows(db, "SELECT COUNT(*) FROM rivers") == [(4,)]


def test_parameters(db):
    for bad, error in ((False, TypeError), (2.5, TypeError), ("2", TypeError), (-(1 << 63) - 1, OverflowError)):
        with pytest.raises(error):
            db.execute("SELECT id FROM rivers WHERE basin = ?", (bad,))
    with pytest.raises(SQLError):
        db.execute("SELECT id FROM rivers WHERE basin = ? AND id = ?", (5,))
    with pytest.raises(ValueError):
        db.execute(" \n")


def test_sums_are_checked_at_the_end_only(spark):
    with Database(spark) as d:
        d.execute("CREATE TABLE n (id INTEGER PRIMARY KEY, v INTEGER NOT NULL)")
        least = -(1 << 63)
        d.execute("INSERT INTO n VALUES (?, ?)", (1, least))
        d.execute("INSERT INTO n VALUES (2, -4)")
        with pytest.raises(Exception):
            d.execute("SELECT SUM(v) FROM n").rows
        d.execute("INSERT INTO n VALUES (3, 9)")
        assert d.execute("SELECT SUM(v) FROM n").rows == [(least + 5,)]


def test_sums_of_more_rows_than_32_bits_count(spark):
    n = (1 << 31) + 3
    of = spark.range(n).select(F.when(F.col("id") % 2 == 0, F.lit((1 << 32) - 1)).otherwise(F.lit(-(1 << 32))).alias("x"))
    assert of.agg(wide_sum(F.col("x"), of.schema["x"].dataType).alias("s")).first().s == ((n + 1) // 2) * ((1 << 32) - 1) - (n // 2) * (1 << 32)


def test_transaction_reads_its_writes_and_rolls_back(db):
    db.execute("BEGIN")
    assert db.execute("UPDATE gauges SET depth = 1 WHERE river = 3").affected == 2
    assert db.execute("UPDATE gauges SET depth = 1 WHERE river = 3").affected == 2  # hit, if not changed
    assert rows(db, "SELECT id FROM gauges WHERE depth = 1") == [(12,), (14,)]
    assert db.execute("DELETE FROM gauges WHERE depth = 1").affected == 2
    db.execute("ROLLBACK")
    assert rows(db, "SELECT id FROM gauges WHERE depth < 10") == [(14,)]
    assert db.execute("DELETE FROM gauges WHERE river = 99").affected == 0
    with pytest.raises(SQLError), db.transaction():
        db.execute("DELETE FROM rivers WHERE id = 2")
        with pytest.raises(SQLError):
            db.execute("SELECT colour FROM rivers")
    assert rows(db, "SELECT COUNT(*) FROM rivers") == [(4,)]


def test_reuse_and_explain(fresh):
    db = fresh
    db.execute("CREATE MATERIALIZED VIEW deep AS SELECT id, depth AS metres FROM gauges WHERE depth > 20")
    plan = db.execute("SELECT id, depth FROM gauges WHERE depth > 20 ORDER BY id", explain=True)
    assert plan.plan == "FROM_VIEW deep SORT" and "Sort" in plan.physical
    assert rows(db, "SELECT id, depth FROM gauges WHERE depth > 20") == [(10, 40), (11, 25), (12, 60), (13, 25)]
    for other in ("SELECT depth, id FROM gauges WHERE depth > 20", "SELECT id, depth FROM gauges WHERE depth > 21", "SELECT id, depth FROM gauges"):
        assert "FROM_VIEW" not in db.execute(other, explain=True).plan
    db.execute("BEGIN")
    assert "FROM_VIEW" not in db.execute("SELECT id, depth FROM gauges WHERE depth > 20", explain=True).plan
    db.execute("ROLLBACK")


def test_changed_tables_are_not_summed_on_reading(spark):
    with Database(spark) as db:
        db.register("big", spark.range(1000).select("id", (F.col("id") % 7).alias("k")))
        db.execute("UPDATE big SET k = 9 WHERE id = 4")
        db.execute("DELETE FROM big WHERE id = 5")
        plan = db.execute("SELECT * FROM big", explain=True).physical
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        found = dict(db.execute("SELECT * FROM big").rows)
        assert found == {i: 9 if i == 4 else i % 7 for i in range(1000) if i != 5}


def test_many_small_changes_merge_with_each_other_only(spark):
    with Database(spark) as db:
        db.register("big", spark.range(100).select("id", F.lit(0).cast("long").alias("k")))
        for i in range(12):
            db.execute("UPDATE big SET k = ? WHERE id = ?", (i, i % 5))
        (bag,) = db.state.bags.values()
        assert bag.outside is not None and len(bag.fragments) <= 8 and sum(bag.rows) < 30 and db.stats()["merges"] > 0
        assert dict(db.execute("SELECT * FROM big").rows) == {i: {0: 10, 1: 11, 2: 7, 3: 8, 4: 9}.get(i, 0) for i in range(100)}
