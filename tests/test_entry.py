import os

import duckdb
import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
SQL = sorted(k for k in entry_module.oracle_sql() if k in __import__("textrine.queries").queries.QUERIES)


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_names():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


@pytest.mark.parametrize("name", [n for n in SQL if n in ("text_stats", "suffix_array", "edges_detailed", "suffix_links", "window_stats", "window_edges", "traversal_log_simple", "prefix_partitions_p2", "hash_cuckoo", "window_spec_resolve")])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    df = entry_module.queries()[name](spark, SF)
    want = con.sql(entry_module.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    columns = sorted(df.columns)
    key = lambda row: tuple(map(repr, row))
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key)
    assert got == sorted((tuple(r) for r in want.project(", ".join(f'"{c}"' for c in columns)).fetchall()), key=key)
