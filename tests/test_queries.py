import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from slabscan.plans.queries import CATALOG

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_same_as_sql(spark, name):
    run, sql = CATALOG[name]
    df = run(spark, SF)
    if sql is None:
        assert df.count() > 0
    else:
        assert_same(df, sql, SF)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 152


def test_timestamps_of_large_keys(spark, tmp_path):
    """Years beyond 9999, and seconds beyond twelve digits, as tables of many orders have them."""
    run, sql = CATALOG["f_timestamp"]
    keys = F.array(*(F.lit(k).cast("bigint") for k in (0, 2_932_890, 2_932_896, 8_999_999, 11_574_058, 36_000_000, 106_000_000)))
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").limit(50)
    rows.withColumn("l_orderkey", F.explode(keys)).coalesce(1).write.parquet(str(tmp_path / "t"))
    next((tmp_path / "t").glob("*.parquet")).rename(tmp_path / "lineitem.parquet")
    assert_same(run(spark, str(tmp_path)), sql, tmp_path)
