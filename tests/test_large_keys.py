"""Queries over items with numbers of seven digits, as tables of 1 GB have."""

import duckdb
import pytest
from test_queries import rows

from shelfspark import catalog

SF = "/root/testdata/sf0.001"
TABLES = "customer supplier part orders lineitem".split()


@pytest.fixture(scope="module")
def grown(tmp_path_factory):
    """The smallest tables and copies of them whose part numbers, cut at six digits, are those of other parts of the copies."""
    path, c = str(tmp_path_factory.mktemp("grown")), duckdb.connect()
    n = c.sql(f"SELECT max(p_partkey) + 1 FROM '{SF}/part.parquet'").fetchall()[0][0]
    copies = f"(VALUES (0), (100000), (1000000), (1000000 + {n // 50 * 50 + 50})) r(i)"
    for t, keys in (("part", ["p_partkey"]), ("lineitem", ["l_partkey"])):
        changed = ", ".join(f"{k} + i AS {k}" for k in keys) + (", CASE WHEN i = 100000 THEN 'Brand#1' ELSE 'Brand#11' END AS p_brand, 'blue gizmo' AS p_name" if t == "part" else ", l_orderkey + i AS l_orderkey")
        c.sql(f"COPY (SELECT * REPLACE ({changed}) FROM '{SF}/{t}.parquet', {copies}) TO '{path}/{t}.parquet' (FORMAT parquet)")
    for t in ("supplier", "customer", "orders"):
        c.sql(f"COPY (SELECT * FROM '{SF}/{t}.parquet') TO '{path}/{t}.parquet' (FORMAT parquet)")
    for t in TABLES:
        c.sql(f"CREATE TABLE {t} AS SELECT * FROM '{path}/{t}.parquet'")
    return path, c


@pytest.mark.parametrize("name", ["canonical_names", "coverage_intersect", "pattern_lookup", "sales_bridge", "sales_name_match", "sales_velocity", "sheet_supplier", "supplier_type_join", "item_uom", "latest_po_supplier", "run_metrics", "avg_monthly", "notes", "item_name_universe", "scope_top_n", "scope_filter"])
def test_same_as_sql_with_long_numbers(spark, grown, name):
    path, con = grown
    got, want = catalog.QUERIES[name](spark, path), con.sql(catalog.ORACLES[name])
    assert rows(got.columns, map(tuple, got.collect())) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", ["drift_lookup", "role_override"])
def test_tables_that_grow_are_not_broadcast(spark, name):
    assert "BroadcastExchange" not in catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
