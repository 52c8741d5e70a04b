"""The registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from hyperloom.plans import queries as engine

DATA = "/root/testdata/sf0.001"
QUICK = "pairwise_distance knn_topk propagation_matrix spgemm spmm dense_at_mult feature_colnorm coo_dedupe_max macro_f1 weight_gradient lr_step_schedule".split()


def test_contract():
    found, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(found) and set(engine.queries()) <= set(found)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    got = engine.queries()[name](spark, DATA)
    want = db.sql(engine.oracle_sql()[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    assert sorted(tuple(r[c] for c in order) for r in got.collect()) == sorted(want.select(*order).fetchall())


def test_entry(spark):
    if os.path.isdir(DATA):
        df = __spark_entry__.entry(spark)
        assert df.columns == ["row", "col", "val"] and df.count() > 0
