"""Every registered query of the library proper against its SQL twin, and the rest for rows and determinism."""

import duckdb
import pytest

from evalmill.plans import all_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(all_queries.oracle_sql()))
def test_against_sql(spark, con, sf_dir, name):
    got = all_queries.queries()[name](spark, sf_dir)
    found = con.execute(all_queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(got.columns)
    left = sorted(str([plain(r[n]) for n in names]) for r in got.collect())
    assert left == sorted(str([plain(x) for x in r]) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(set(all_queries.queries()) - set(all_queries.oracle_sql())))
def test_same_rows_for_any_partitions(spark, sf_dir, name):
    query = all_queries.queries()[name]
    first = sorted(map(str, query(spark, sf_dir).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert first and first == sorted(map(str, query(spark, sf_dir).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
