"""Values that round to zero keep their sign, as in the SQL twins."""

import duckdb
import pytest

from evalmill.plans import all_queries

TINY = [-1e-8, 1e-8, -0.0, 0.0, -0.4, 0.7] + [-2e-8] * 58


@pytest.mark.parametrize("name", ["krn06_colours", "krn06_contrast", "udf01_transform_callable", "krn08_down_up_whole", "krn10_blur", "ml05_batch_scoring", "ml07_paired_scoring"])
def test_sign_of_zero(spark, tmp_path, name):
    table = spark.createDataFrame([(1, 0, TINY), (2, 5, [-x for x in TINY])], "vec_id long, label int, embedding array<float>")
    table.coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    found = con.execute(all_queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(repr(r[n]) for r in all_queries.queries()[name](spark, str(tmp_path)).collect() for n in names) == sorted(repr(x) for r in found.fetchall() for x in r)
