"""A small index from the leading byte of a value's delta to a range of positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slabscan.operators.stats import with_reference
from slabscan.types import signed_bits


def slot(delta: Column) -> Column:
    """The top non-zero byte of a delta, plus 256 times that byte's place; the delta's 64 bits are unsigned."""
    byte = F.when(delta == 0, 0).otherwise(F.floor((F.length(F.hex(delta)) - 1) / 2)).cast("int")
    top = F.call_function("shiftrightunsigned", delta, byte * 8)
    return top + 256 * byte


def _bits(delta: Column, kind: T.DataType) -> Column:
    return signed_bits(delta) if isinstance(kind, T.DecimalType) else delta.cast("bigint")


def with_slot(blocks: DataFrame, meta: DataFrame, column: str) -> DataFrame:
    known = with_reference(blocks, meta, column)
    return known.withColumn("slot", slot(_bits(F.col("delta"), known.schema["delta"].dataType)))


def build(blocks: DataFrame, meta: DataFrame, column: str) -> DataFrame:
    """The first position of each slot of a block, and the position after its last."""
    return with_slot(blocks, meta, column).groupBy("block_id", "slot").agg(F.min("reference").alias("reference"), F.min("pos").alias("start"), (F.max("pos") + 1).alias("end"))


def lookup(index: DataFrame, value: int) -> DataFrame:
    """The range of each block in which the value can be; blocks without its slot have no row."""
    kind = index.schema["reference"].dataType
    literal = F.lit(str(int(value))).cast(kind)
    low = index.where(F.col("reference") <= literal)
    return low.where(F.col("slot") == slot(_bits(literal - F.col("reference"), kind))).select("block_id", "start", "end")


def search(blocks: DataFrame, index: DataFrame, column: str, value: int) -> DataFrame:
    """Positions of the rows equal to the value, looked for inside the ranges only."""
    near = lookup(index, value)
    inside = (F.col("pos") >= F.col("start")) & (F.col("pos") < F.col("end"))
    literal = F.lit(str(int(value))).cast(blocks.schema[column].dataType)
    return blocks.where(F.col(column) == literal).join(near, "block_id").where(inside).select("block_id", "pos")
