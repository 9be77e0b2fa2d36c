import duckdb
import pytest

import __spark_entry__ as entry

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
SOME = ["mention_edges", "communities", "project_users", "tokenize", "topic_cosine", "windowed_topk"]


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 67


def test_flagship(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["com_id", "nbv", "n_edges"] and rows.count() > 0


@pytest.mark.parametrize("name", SOME)
def test_query_equals_its_sql(spark, sf, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
    expected = db.sql(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, sf)
    assert sorted(got.columns) == sorted(expected.columns)
    got = got.select(*expected.columns)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected.fetchall()))
