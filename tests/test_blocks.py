"""Plans of the block table: what reaches the scan, and how many rows it reads."""

import datetime

import pyarrow.dataset as ds
import pytest

from slabscan.operators import stats
from slabscan.operators.scan import BlockTable
from slabscan.plans import formats
from slabscan.plans.queries import CAPACITY, CATALOG, SCAN
from slabscan.predicate import Between, Eq, Lt, conjunction
from slabscan.sources.loaders import lineitem_store

SF = "/root/testdata/sf0.01"


def plan_of(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", 4000)
    return df._jdf.queryExecution().executedPlan().toString()


def rows_scanned(df):
    """Rows that the file scans of the plan gave, after it ran."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            walk(node.executedPlan())
        elif hasattr(node, "plan") and "QueryStage" in node.nodeName():
            walk(node.plan())
        if node.nodeName().startswith("Scan parquet"):
            found.append(node.metrics().apply("numOutputRows").value())
        for i in range(node.children().size()):
            walk(node.children().apply(i))

    walk(plan)
    return sum(found)


@pytest.fixture(scope="module")
def store(spark):
    return lineitem_store(spark, SF, CAPACITY)


def year():
    return Between("ship_d", datetime.date(1996, 1, 1), datetime.date(1996, 12, 31))


def test_a_row_group_for_each_block(store):
    sizes = [g.num_rows for f in ds.dataset(store.path.removeprefix("file:") + "/blocks").get_fragments() for g in f.row_groups]
    assert sorted(sizes) == sorted([CAPACITY] * (60_000 // CAPACITY) + [60_000 % CAPACITY])


def test_predicates_reach_the_scan(spark, store):
    plan = plan_of(store.blocks.where(conjunction(SCAN)).select("price_cents"))
    for name in ("discount_pct", "quantity", "l_suppkey"):
        assert f"GreaterThan({name}" in plan or f"GreaterThanOrEqual({name}" in plan or f"LessThan({name}" in plan
    assert "PushedFilters: []" not in plan_of(CATALOG["p_lt_int"][0](spark, SF))
    schema = next(line for line in plan.split("\n") if "FileScan" in line).split("ReadSchema: ")[1]
    assert "l_returnflag" not in schema


def test_blocks_are_skipped(store):
    year_rows = store.blocks.where(year().column()).select("pos")
    assert rows_scanned(year_rows) < 20_000
    assert rows_scanned(BlockTable(store.blocks).scan_block(3, [Eq("l_suppkey", 42)])) == CAPACITY


def test_pruned_count_reads_only_partial_blocks(store):
    report = stats.prune_report(store.meta, [year()])
    partial = sum(r.tuple_count for r in report.where("verdict = 'PARTIAL'").collect())
    counts = {stats.pruned_count(store.blocks, report, [year()], named_blocks=n).first().matches for n in (0, 1000)}
    assert counts == {store.blocks.where(year().column()).count()}
    counted = stats.pruned_count(store.blocks, report, [year()])
    # The count also reads the rows of the metadata.
    assert rows_scanned(counted) <= partial + store.meta.count() < 15_000


def test_append_checks_columns(store):
    t = BlockTable(store.blocks.select("block_id", "pos", "quantity"))
    assert t.append(t).count([Lt("quantity", 0)]).first().matches == 0
    with pytest.raises(ValueError):
        t.append(BlockTable(store.blocks))


def test_flight_without_sentinel(spark):
    """Without a sentinel, NA is NULL."""
    rows = formats.flight_rows(spark, "/root/testdata/sf0.001", missing=None)
    assert len(rows.columns) == 29
    assert rows.where("c4 is null").count() == rows.where("c1 = 3").count() > 0
