"""Registered queries against their SQL on the smallest test tables. bench and the driver run all of them."""

import os

import duckdb
import pytest

from batchwright.queries import graphs, rows

SF = "/root/testdata/sf0.001"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "conversations")
SOME = ("delete_rows", "match_ambiguous_keys", "update_missing_conflict", "graph_hierarchy_edges", "m2m_link_diff", "m2m_stats", "graph_shared_child", "update_duplicate_unique", "delete_null_token", "graph_delete_repeats", "graph_upsert_retry", "graph_insert_generated_ids", "writer_commits", "guards_of_graphs")
ALL = {**rows.QUERIES, **graphs.QUERIES}
SQL = {**rows.SQL, **graphs.SQL}


def test_every_query_but_the_fixpoint_has_sql():
    assert set(ALL) - set(SQL) == {"unique_multi_fixpoint"}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    expected = db.execute(SQL[name])
    columns = sorted(c[0] for c in expected.description)
    order = [[c[0] for c in expected.description].index(c) for c in columns]
    found = ALL[name](spark, SF)
    assert sorted(found.columns) == columns
    assert sorted((tuple(r) for r in found.select(*columns).collect()), key=str) == sorted((tuple(r[i] for i in order) for r in expected.fetchall()), key=str)
