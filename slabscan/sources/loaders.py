"""Loaders for the workload tables, for delimited files and for the flight layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slabscan.functions import scalars
from slabscan.sources.blocks import BlockStore, store_once
from slabscan.types import BLOCK_CAPACITY, scaled, sentinel

#: A total order of lineitem at every scale of the test data.
LINEITEM_ORDER = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")

LINEITEM_INTS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "quantity", "price_cents", "discount_pct", "tax_pct")
LINEITEM_VALUES = (*LINEITEM_INTS, "ship_d")
LINEITEM_STRINGS = ("l_returnflag", "l_linestatus")

#: Pipe-delimited lineitem text, in its public column order.
LINEITEM_TEXT = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in (
            ("l_orderkey", T.LongType()),
            ("l_partkey", T.LongType()),
            ("l_suppkey", T.LongType()),
            ("l_linenumber", T.IntegerType()),
            ("l_quantity", T.DecimalType(12, 2)),
            ("l_extendedprice", T.DecimalType(12, 2)),
            ("l_discount", T.DecimalType(12, 2)),
            ("l_tax", T.DecimalType(12, 2)),
            ("l_returnflag", T.StringType()),
            ("l_linestatus", T.StringType()),
            ("l_shipdate", T.DateType()),
            ("l_commitdate", T.DateType()),
            ("l_receiptdate", T.DateType()),
            ("l_shipinstruct", T.StringType()),
            ("l_shipmode", T.StringType()),
            ("l_comment", T.StringType()),
        )
    ]
)
NATION_TEXT = T.StructType(
    [
        T.StructField("n_nationkey", T.LongType()),
        T.StructField("n_name", T.StringType()),
        T.StructField("n_regionkey", T.LongType()),
        T.StructField("n_comment", T.StringType()),
    ]
)
FLIGHT_COLUMNS = 29
FLIGHT_MISSING = 255


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem in the integer domain of its blocks, beside the plain columns."""
    return table(spark, sf_dir, "lineitem").select(
        "*",
        scaled(F.col("l_quantity"), 0).alias("quantity"),
        scaled(F.col("l_extendedprice")).alias("price_cents"),
        scaled(F.col("l_discount")).alias("discount_pct"),
        scaled(F.col("l_tax")).alias("tax_pct"),
        F.to_date("l_shipdate").alias("ship_d"),
    )


def lineitem_store(spark: SparkSession, sf_dir: str, capacity: int = BLOCK_CAPACITY) -> BlockStore:
    """lineitem as a block table, clustered by ship date; written when the session first asks for it.

    Its files hold the integer domain and the DATE, so predicates on them reach the scan.
    """
    rows = lineitem(spark, sf_dir)
    return store_once(spark, "lineitem", rows.inputFiles(), capacity, lambda path: BlockStore.create(rows, path, LINEITEM_ORDER, LINEITEM_VALUES, LINEITEM_STRINGS, capacity))


def read_lineitem_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="|", schema=LINEITEM_TEXT)


def read_nation_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="|", schema=NATION_TEXT)


def read_flight_text(spark: SparkSession, path: str, missing: int | None = FLIGHT_MISSING, texts: tuple[int, ...] = (10, 17)) -> DataFrame:
    """A headerless comma file of 29 columns; NA is NULL, or ``missing`` when that is given.

    The columns in ``texts`` hold short codes, packed to integers.
    """
    schema = T.StructType([T.StructField(f"c{i}", T.StringType() if i in texts else T.LongType()) for i in range(FLIGHT_COLUMNS)])
    raw = spark.read.csv(path, sep=",", schema=schema, nullValue="NA")
    cols = []
    for i in range(FLIGHT_COLUMNS):
        value = scalars.pack_chars(F.col(f"c{i}")) if i in texts else F.col(f"c{i}")
        cols.append((value if missing is None else sentinel(value, missing)).alias(f"c{i}"))
    return raw.select(*cols)


def write_result_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)
