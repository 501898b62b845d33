"""Every library query against its SQL, and what the entry points promise."""

from __future__ import annotations

import duckdb
import pytest
from conftest import MIDDLE, SMALL
from harness import TABLES, compare, oracle
from lumenlake.plans import registry as catalogue

import __spark_entry__ as entry_points


@pytest.fixture(scope="module")
def small():
    return oracle(SMALL)


@pytest.fixture(scope="module")
def middle():
    return oracle(MIDDLE)


@pytest.fixture(scope="module")
def empty_dir(tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for t in TABLES:
        duckdb.sql(f"COPY (SELECT * FROM '{SMALL}/{t}.parquet' LIMIT 0) TO '{folder}/{t}.parquet' (FORMAT parquet)")
    return str(folder)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql_on_small_tables(spark, small, name):
    assert compare(spark, small, catalogue.QUERIES[name], catalogue.SQL[name], SMALL) is None


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql_on_larger_tables(spark, middle, name):
    assert compare(spark, middle, catalogue.QUERIES[name], catalogue.SQL[name], MIDDLE) is None


def test_queries_run_on_empty_tables(spark, empty_dir):
    con = oracle(empty_dir)
    found = {n: compare(spark, con, catalogue.QUERIES[n], catalogue.SQL[n], empty_dir) for n in sorted(catalogue.SQL)}
    assert {k: v for k, v in found.items() if v} == {}


def test_entry_has_a_stable_schema(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["kind", "confidence", "group_key", "n", "wasted", "members"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())
    assert set(catalogue.SQL) == set(catalogue.QUERIES)


@pytest.mark.parametrize("name", ["lib_totals", "type_breakdown"])
def test_shares_and_counts_are_sane(spark, name):
    row = catalogue.QUERIES[name](spark, SMALL).first().asDict()
    assert all(v is None or isinstance(v, str) or v >= 0 for v in row.values())
    assert row.get("percentage", 0) <= 100


def test_reconciled_rows_add_up(spark):
    """Paths after a scan are those before, less the deleted, plus the new."""
    from lumenlake.sources.adapters import listed, stored

    actions = {r["action"]: r["count"] for r in catalogue.QUERIES["reconcile_actions"](spark, SMALL).groupBy("action").count().collect()}
    before, after = stored(spark, SMALL).count(), listed(spark, SMALL).count()
    assert after == before - actions.get("DELETED", 0) + actions.get("NEW", 0)
    assert after == sum(n for a, n in actions.items() if a != "DELETED")
