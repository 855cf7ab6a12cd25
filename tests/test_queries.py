"""Every query with SQL gives the rows of its SQL on the smallest tables."""

import os

import pytest

from motifloom import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    got = queries.QUERIES[name](spark, DATA)
    rows = got.collect()
    if name not in queries.ORACLES:
        assert rows
        return
    run = duck.execute(queries.ORACLES[name])
    columns = [c[0] for c in run.description]
    assert sorted(columns) == sorted(got.columns)
    order = [columns.index(c) for c in got.columns]
    expected = sorted(tuple(r[i] for i in order) for r in run.fetchall())
    assert sorted(map(tuple, rows)) == expected


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_graph_files_are_mined_to_the_end(spark):
    """All patterns of graph_patterns_3edge, at its threshold, and all larger ones."""
    found = sorted(map(tuple, queries.QUERIES["graph_file_patterns"](spark, DATA).collect()))
    assert [r for r in found if r[1] <= 3] == sorted(map(tuple, queries.QUERIES["graph_patterns_3edge"](spark, DATA).collect()))
    assert max(r[1] for r in found) == 8


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 124
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
