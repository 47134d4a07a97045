"""Registered queries against their SQL on the smallest tables, where those are present."""

import math
import os

import pytest

from tidespan.plans.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings labels conversations".split()


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equal(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    r = con.execute(ORACLE_SQL[name])
    cols = [c[0] for c in r.description]
    assert sorted(cols) == sorted(df.columns)
    at = [cols.index(c) for c in df.columns]
    assert sorted((tuple(map(plain, x)) for x in df.collect()), key=repr) == sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=repr)


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_label_join_has_no_most(spark, tmp_path):
    spark.range(10_050).selectExpr("id as event_id", "'t' || id as event_type").write.parquet(f"{tmp_path}/events.parquet")
    assert QUERIES["label_join"](spark, str(tmp_path)).agg({"label_index": "max", "event_id": "count"}).first().asDict() == {"max(label_index)": 10_049, "count(event_id)": 10_050}
