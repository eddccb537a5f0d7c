"""Block assignment, and block tables on disk with the metadata of their blocks."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slabscan.operators.stats import block_meta
from slabscan.types import BLOCK_CAPACITY


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors share: in spark.checkpoint.dir, or else the warehouse."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{top.rstrip('/')}/slabscan/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def delete_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def assign_blocks(df: DataFrame, order_by: Sequence[str], staging: str, capacity: int = BLOCK_CAPACITY) -> DataFrame:
    """Add ``block_id`` and ``pos``: the row's rank in a total order, cut every ``capacity`` rows.

    The rows are dealt by ranges of the order, sorted, and written to
    ``staging`` with their range and their place in it, so that ranks don't
    change when a task runs again.  The ranges' sizes, one row for each, tell
    where each begins.  No key gathers its rows in a task: a day that holds a
    third of the table is split like any other part of the order.
    """
    keys = [F.col(c) for c in order_by]
    part = F.spark_partition_id()
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = dealt.withColumns({"_part": part, "_place": F.monotonically_increasing_id() - F.shiftleft(part.cast("bigint"), 33)})
    placed.write.parquet(staging)
    rows = df.sparkSession.read.schema(placed.schema).parquet(staging)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    # One row for each range, so at most as many as there were partitions.
    ranked = rows.join(F.broadcast(before), "_part").withColumn("_rank", F.col("_before") + F.col("_place"))
    return ranked.withColumns({"block_id": F.expr(f"_rank div {capacity}"), "pos": (F.col("_rank") % capacity).cast("int")}).drop("_part", "_place", "_before", "_rank")


def write_blocks(blocks: DataFrame, path: str, capacity: int = BLOCK_CAPACITY) -> None:
    """Write a block table with a row group for each block, in the order of blocks.

    A filter then skips blocks by the row groups' statistics.  Row groups are
    not skipped for TIMESTAMP_NTZ, so loaders add a DATE beside such a column.
    """
    ordered = blocks.repartitionByRange("block_id").sortWithinPartitions("block_id", "pos")
    ordered.write.option("parquet.block.row.count.limit", capacity).parquet(path)


def append_blocks(df: DataFrame, path: str, capacity: int = BLOCK_CAPACITY, mode: str = "append") -> None:
    """Add rows as further blocks; blocks that exist stay as they are."""
    df.write.mode(mode).option("maxRecordsPerFile", capacity).parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The rows with the file that holds their block and their place in it."""
    return spark.read.parquet(path).select("*", F.col("_metadata.file_name").alias("block_file"), F.col("_metadata.row_index").alias("row_index"))


@dataclass(frozen=True)
class BlockStore:
    """A block table on disk (``blocks``), written once, and a row for each block (``meta``, see ``block_meta``)."""

    blocks: DataFrame
    meta: DataFrame
    path: str
    capacity: int

    @staticmethod
    def create(df: DataFrame, path: str, order_by: Sequence[str], values: Sequence[str], strings: Sequence[str] = (), capacity: int = BLOCK_CAPACITY) -> BlockStore:
        """Cluster ``df`` by ``order_by`` and write it with its metadata; ``values`` and ``strings`` get minima and maxima, strings their dictionaries' sizes too."""
        spark = df.sparkSession
        write_blocks(assign_blocks(df, order_by, f"{path}/staging", capacity), f"{path}/blocks", capacity)
        delete_path(spark, f"{path}/staging")
        block_meta(spark.read.parquet(f"{path}/blocks"), values, strings).write.parquet(f"{path}/meta")
        return BlockStore.open(spark, path, capacity)

    @staticmethod
    def open(spark: SparkSession, path: str, capacity: int = BLOCK_CAPACITY) -> BlockStore:
        return BlockStore(spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/meta"), path, capacity)

    def drop(self) -> None:
        delete_path(self.blocks.sparkSession, self.path)


_MADE: dict[tuple, BlockStore] = {}
_LOCK = threading.Lock()


def store_once(spark: SparkSession, name: str, files: Sequence[str], capacity: int, make) -> BlockStore:
    """The store of the source files ``files``, which ``make(path)`` writes when the session first asks for it."""
    key = (spark.sparkContext.applicationId, name, tuple(sorted(files)), capacity)
    with _LOCK:
        if key not in _MADE:
            _MADE[key] = make(scratch_path(spark, name))
        return _MADE[key]
