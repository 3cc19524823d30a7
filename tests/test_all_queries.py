"""Every registered query on tables that are empty, and on tables with null rows, repeated rows and columns of clashing names."""

import glob
import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
CLASHING = "key block slot t value text_ ids label n rank class side day words source cell id_ instant epoch_ns place own chunk origin kind row_id pos"

pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the test tables")


def tables():
    return [os.path.basename(p)[:-8] for p in glob.glob(f"{SMALL}/*.parquet")]


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("empty")
    for t in tables():
        spark.read.parquet(f"{SMALL}/{t}.parquet").where("false").write.parquet(f"{at}/{t}.parquet")
    return str(at)


@pytest.fixture(scope="module")
def dirty(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("dirty")
    for t in tables():
        df = spark.read.parquet(f"{SMALL}/{t}.parquet")
        nothing = spark.createDataFrame([tuple(None for _ in df.columns)], df.schema if False else ", ".join(f"`{c}` {k}" for c, k in df.dtypes))
        whole = df.unionByName(nothing).unionByName(nothing).unionByName(df.limit(20))
        for c in CLASHING.split():
            if c not in whole.columns:
                whole = whole.selectExpr("*", f"'x' as `{c}`")
        whole.write.parquet(f"{at}/{t}.parquet")
    return str(at)


NAMES = list(entry.queries())
ALWAYS = {"r_s24_load", "r_a1_a5_report", "r_a3_reliability", "r_a7_latency", "r_a13_counts", "r_d13_a6_totals", "r_o8_featured",
          "r_s19_constraints", "r_s23_q7_reports", "r_a6_edges", "r_a9_total", "r_o12_pager"}


@pytest.mark.parametrize("name", NAMES)
def test_empty(spark, empty, name):
    df = entry.queries()[name](spark, empty)
    assert (df.count() == 0) or name in ALWAYS


@pytest.mark.parametrize("name", NAMES)
def test_dirty(spark, dirty, name):
    entry.queries()[name](spark, dirty).write.format("noop").mode("overwrite").save()
