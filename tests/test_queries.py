"""The registered queries against DuckDB over the smallest tables, and what the package imports."""

import os
import subprocess
import sys

import duckdb
import pytest

from tallyweir import queries

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")
SOME = ["scan_projection", "filter_col_col", "anti_join", "agg_over_join", "agg_sum_cancel", "topk", "ivm_join_delta", "ivm_group_delta", "mutation_fold", "model_pricing", "mv_on_mv", "mv_alter_recompute", "shared_views", "assertion_repair", "dml_update", "modular_read", "kv_update", "change_rejects", "stream_replay", "recover_read", "preview_read", "explain_select", "prune_untouched", "kv_transaction", "assertion_violations", "ivm_two_statement_tx"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_matches_duckdb(spark, duck, name):
    found = queries.queries()[name](spark, SF)
    expected = duck.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in expected.description]
    assert sorted(columns) == sorted(found.columns)
    assert sorted(map(tuple, found.select(*columns).collect())) == sorted(expected.fetchall())


def test_every_query_has_sql():
    assert set(queries.queries()) == set(queries.oracle_sql())


def test_the_rest_stands_without_the_training_data_operators():
    code = "import sys; sys.modules['tallyweir.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert 'pk_lookup' in e.queries() and not any(n.startswith('op') for n in e.queries()) and e.oracle_sql()"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_a_copy_without_those_folders_stands(tmp_path):
    import shutil

    root, copy = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), str(tmp_path / "copy")
    shutil.copytree(root, copy, ignore=lambda folder, names: [n for n in names if n in (".git", "__pycache__", "llm", "corpus_pipeline.py")])
    assert not os.path.exists(f"{copy}/tallyweir/llm") and not os.path.exists(f"{copy}/tests/llm")
    code = "import __spark_entry__ as e; assert set(e.queries()) == set(e.oracle_sql()) and 'pk_lookup' in e.queries() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True)
    subprocess.run([sys.executable, "-m", "pytest", "tests/", "-q", "-k", "parameters or rejections"], cwd=copy, check=True, timeout=300)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["join_self", "ivm_self_join_delta"])
def test_self_joins_of_whole_tables(spark, duck, name):
    """Every order meets every order of its customer, whatever its id."""
    kept = "true" if name == "join_self" else "o_orderkey % 10 <> 0"
    of = {}
    for order, customer in duck.execute(f"SELECT o_orderkey, o_custkey FROM orders WHERE {kept}").fetchall():
        of.setdefault(customer, []).append(order)
    expected = sorted((a, b) for group in of.values() for a in group for b in group)
    assert sorted(map(tuple, queries.queries()[name](spark, SF).select("a", "b").collect())) == expected
    assert sorted(duck.execute(queries.oracle_sql()[name]).fetchall()) == expected
