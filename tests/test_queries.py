"""Every query against its SQL on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb

    db = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        db.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return db


def normal(frame, columns):
    rows = frame[columns].astype(object).values.tolist()
    return sorted(repr([None if v is None or v != v else int(v) if isinstance(v, float) and v == int(v) else v for v in r]) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(__spark_entry__.oracle_sql()))
def test_against_sql(spark, duck, name):
    got, want = __spark_entry__.queries()[name](spark, SF).toPandas(), duck.execute(__spark_entry__.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got, sorted(got.columns)) == normal(want, sorted(got.columns))


def test_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_comparison_of_benchmarks():
    import bench

    found = bench.compare({"a": 10.0, "b": 1.0, "c": 2.0, "gone": 1.0}, {"a": 5.0, "b": 1.04, "c": 4.0, "new": 1.0})
    assert found == {"change_percent": {"a": 100.0, "b": -3.8, "c": -50.0}, "improved": 1, "regressed": 1, "unchanged": 1}
    assert bench.compare({}, {"a": 1.0})["improved"] == 0
