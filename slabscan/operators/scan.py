"""Scans of a block table: counts, per-block counts, positions, materialisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slabscan.predicate import Predicate, conjunction


class BlockTable:
    """A DataFrame with ``block_id`` and ``pos`` as an append-only table of blocks."""

    def __init__(self, df: DataFrame):
        missing = {"block_id", "pos"} - set(df.columns)
        if missing:
            raise ValueError(f"a block table needs the columns {sorted(missing)}")
        self.df = df

    def append(self, other: BlockTable) -> BlockTable:
        """The other table's blocks after this table's; schemas must agree."""
        if set(self.df.columns) != set(other.df.columns):
            raise ValueError("the tables have different columns")
        after = self.df.agg(F.coalesce(F.max("block_id") + 1, F.lit(0)).alias("_after"))
        moved = other.df.crossJoin(F.broadcast(after)).withColumn("block_id", F.col("block_id") + F.col("_after")).drop("_after")
        return BlockTable(self.df.unionByName(moved))

    def scan(self, predicates: Sequence[Predicate] = ()) -> DataFrame:
        """All columns of the matching rows."""
        return self.df.where(conjunction(predicates))

    def scan_block(self, block_id: int, predicates: Sequence[Predicate] = ()) -> DataFrame:
        return self.df.where(F.col("block_id") == block_id).where(conjunction(predicates))

    def count(self, predicates: Sequence[Predicate] = ()) -> DataFrame:
        return self.scan(predicates).agg(F.count(F.lit(1)).alias("matches"))

    def block_counts(self, predicates: Sequence[Predicate] = ()) -> DataFrame:
        """A row for each block, also for those without a match; one pass over the table."""
        return self.df.groupBy("block_id").agg(F.count(F.when(conjunction(predicates), 1)).alias("matches"))

    def positions(self, predicates: Sequence[Predicate] = ()) -> DataFrame:
        return self.scan(predicates).select("block_id", "pos")

    def selection_vectors(self, predicates: Sequence[Predicate] = ()) -> DataFrame:
        """The ascending positions of each block with a match; at most a block's capacity in an array."""
        return self.positions(predicates).groupBy("block_id").agg(F.sort_array(F.collect_list("pos")).alias("positions"))

    def materialize(self, predicates: Sequence[Predicate], *columns: str) -> DataFrame:
        return self.scan(predicates).select("block_id", "pos", *columns)

    def fetch(self, positions: DataFrame, *columns: str) -> DataFrame:
        """Columns at positions that an earlier scan found."""
        return self.df.join(positions.select("block_id", "pos"), ["block_id", "pos"], "left_semi").select("block_id", "pos", *columns)
