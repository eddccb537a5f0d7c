"""Scan-and-materialise legs of the decision-support queries, and labelled extensions."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slabscan.predicate import Between, Eq, Lt, conjunction
from slabscan.sources.loaders import lineitem_store, table
from slabscan.types import BLOCK_CAPACITY

KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def _shipped(first: str, last: str) -> Between:
    """Ship dates from first to last, on the DATE that the block files hold."""
    return Between("ship_d", datetime.date.fromisoformat(first), datetime.date.fromisoformat(last))


def _rows(spark: SparkSession, sf_dir: str, capacity: int) -> DataFrame:
    return lineitem_store(spark, sf_dir, capacity).blocks


def q1_leg(spark: SparkSession, sf_dir: str, cutoff: str = "1998-09-02", capacity: int = BLOCK_CAPACITY) -> DataFrame:
    rows = _rows(spark, sf_dir, capacity).where(Lt("ship_d", datetime.date.fromisoformat(cutoff)).column())
    return rows.select(*KEYS, "discount_pct", "price_cents", "l_returnflag", "l_linestatus", "quantity")


def q6_leg(spark: SparkSession, sf_dir: str, first: str = "1996-01-01", last: str = "1996-12-31", discount: tuple[int, int] = (5, 7), quantity: int = 24, capacity: int = BLOCK_CAPACITY) -> DataFrame:
    wanted = conjunction([_shipped(first, last), Between("discount_pct", *discount), Lt("quantity", quantity)])
    return _rows(spark, sf_dir, capacity).where(wanted).select(*KEYS, "discount_pct", "price_cents")


def q6_sweep(spark: SparkSession, sf_dir: str, capacity: int = BLOCK_CAPACITY) -> DataFrame:
    """The number of matches as each predicate narrows, all from one scan."""
    rows = _rows(spark, sf_dir, capacity)
    steps = [(f"shipdate>={m:02d}", _shipped(f"1996-{m:02d}-01", "1996-12-31")) for m in range(1, 13)]
    steps += [("discount 5..7", Between("discount_pct", 5, 7)), ("discount 6..7", Between("discount_pct", 6, 7)), ("discount 5..6", Between("discount_pct", 5, 6))]
    steps += [(f"quantity<{n}", Lt("quantity", n)) for n in (24, 5, 2)]
    counts = rows.agg(*(F.count(F.when(p.column(), 1)).alias(f"n{i}") for i, (_, p) in enumerate(steps)))
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("step"), F.col(f"n{i}").alias("matches")) for i, (name, _) in enumerate(steps))))
    return counts.select(each.alias("s")).select("s.step", "s.matches")


def q7_leg(spark: SparkSession, sf_dir: str, capacity: int = BLOCK_CAPACITY) -> DataFrame:
    rows = _rows(spark, sf_dir, capacity).where(_shipped("1995-01-01", "1996-12-31").column())
    return rows.select(*KEYS, "discount_pct", "price_cents")


def q12_leg(spark: SparkSession, sf_dir: str, capacity: int = BLOCK_CAPACITY) -> DataFrame:
    """The data has no receipt date and ship mode; ship date and return flag stand for them."""
    wanted = conjunction([_shipped("1996-01-01", "1996-12-31"), Eq("l_returnflag", "R")])
    return _rows(spark, sf_dir, capacity).where(wanted).select(*KEYS, "ship_d")


def nation_lookup(spark: SparkSession, sf_dir: str, name: str = "NATION_7") -> DataFrame:
    return table(spark, sf_dir, "nation").where(Eq("n_name", name).column()).select("n_nationkey", "n_name")


def q1_full(spark: SparkSession, sf_dir: str, capacity: int = BLOCK_CAPACITY) -> DataFrame:
    """Extension: the aggregation on top of the leg."""
    return (
        q1_leg(spark, sf_dir, capacity=capacity)
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.sum("quantity").alias("sum_qty"),
            F.sum("price_cents").alias("sum_base_cents"),
            F.sum(F.col("price_cents") * (100 - F.col("discount_pct"))).alias("sum_disc_units"),
            F.count(F.lit(1)).alias("count_order"),
        )
    )


def q6_full(spark: SparkSession, sf_dir: str, capacity: int = BLOCK_CAPACITY) -> DataFrame:
    """Extension: revenue in units of 1/10000."""
    return q6_leg(spark, sf_dir, capacity=capacity).agg(F.coalesce(F.sum(F.col("price_cents") * F.col("discount_pct")), F.lit(0)).alias("revenue_units"))
