"""Block metadata: minima and maxima, widths, frame of reference, dictionaries, sizes, pruning.

``block_meta`` makes a row for each block in one pass; the other functions read
that row instead of the block.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slabscan.predicate import Predicate, conjunction
from slabscan.types import BLOCK_CAPACITY, U64

#: The widths in bytes of the encodings, and the sizes of the parts of a block.
WIDTHS = (("Singlevalue", 0), ("Byte1", 1), ("Byte2", 2), ("Byte4", 4), ("Byte8", 8))
HEADER_BYTES = 12
HEADER_COLUMN_BYTES = 20
SMA_BYTES = 32
ALIGNMENT = 32

#: Blocks that a count still has to read are named in the filter up to this number, and joined beyond it.
NAMED_BLOCKS = 1000


def block_meta(blocks: DataFrame, values: Sequence[str], strings: Sequence[str] = ()) -> DataFrame:
    """block_id, tuple_count, min_ and max_ of all columns, and of each string column nd_ (its distinct values) and bytes_ (theirs)."""
    aggs = [f(c).alias(f"{p}_{c}") for c in (*values, *strings) for p, f in (("min", F.min), ("max", F.max))]
    sets = [F.collect_set(c).alias(f"set_{c}") for c in strings]
    wide = blocks.groupBy("block_id").agg(F.count(F.lit(1)).alias("tuple_count"), *aggs, *sets)
    words = [e for c in strings for e in (F.size(f"set_{c}").alias(f"nd_{c}"), F.aggregate(f"set_{c}", F.lit(0), lambda n, s: n + F.octet_length(s)).alias(f"bytes_{c}"))]
    return wide.select(*(c for c in wide.columns if not c.startswith("set_")), *words)


def _number_type(meta: DataFrame, columns: Sequence[str]) -> T.DataType:
    """BIGINT, or the unsigned 64-bit type if any of the columns has it."""
    return U64 if any(isinstance(meta.schema[f"min_{c}"].dataType, T.DecimalType) for c in columns) else T.LongType()


def sma(meta: DataFrame, columns: Sequence[str]) -> DataFrame:
    """A row for each block and column with its smallest and largest value, in long form."""
    kind = _number_type(meta, columns)
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"min_{c}").cast(kind).alias("min"), F.col(f"max_{c}").cast(kind).alias("max")) for c in columns)))
    return meta.select("block_id", "tuple_count", each.alias("s")).select("block_id", "tuple_count", "s.column", "s.min", "s.max")


def encoding_of(low: Column, high: Column) -> Column:
    """The narrowest encoding that holds high - low."""
    diff = high - low
    return F.when(diff == 0, "Singlevalue").when(diff < 1 << 8, "Byte1").when(diff < 1 << 16, "Byte2").when(diff < 1 << 32, "Byte4").otherwise("Byte8")


def width_of(encoding: Column) -> Column:
    name, width = WIDTHS[0]
    out = F.when(encoding == name, width)
    for name, width in WIDTHS[1:]:
        out = out.when(encoding == name, width)
    return out


def encodings(meta: DataFrame, columns: Sequence[str]) -> DataFrame:
    stats = sma(meta, columns)
    return stats.withColumn("encoding", encoding_of(F.col("min"), F.col("max"))).withColumn("width", width_of(F.col("encoding")))


def with_reference(blocks: DataFrame, meta: DataFrame, column: str) -> DataFrame:
    """Add ``reference``, the block's minimum, and ``delta``, the value's distance from it; both of the column's type."""
    kind = blocks.schema[column].dataType
    known = blocks.join(meta.select("block_id", F.col(f"min_{column}").alias("reference")), "block_id")
    return known.withColumn("delta", (F.col(column) - F.col("reference")).cast(kind))


def frame_of_reference(blocks: DataFrame, meta: DataFrame, column: str) -> DataFrame:
    return with_reference(blocks, meta, column)


def from_reference(encoded: DataFrame) -> DataFrame:
    kind = encoded.schema["delta"].dataType
    return encoded.withColumn("value", (F.col("reference") + F.col("delta")).cast(kind))


def dictionary(blocks: DataFrame, column: str) -> DataFrame:
    """The distinct strings of each block in byte order, with codes from 0."""
    distinct = blocks.select("block_id", F.col(column).alias("value")).distinct()
    return distinct.withColumn("code", F.dense_rank().over(Window.partitionBy("block_id").orderBy("value")) - 1)


def dictionary_encode(blocks: DataFrame, column: str) -> DataFrame:
    """Add ``code``; only the dictionaries are sorted."""
    entries = dictionary(blocks, column).withColumnRenamed("value", "_value")
    return blocks.join(entries, (blocks["block_id"] == entries["block_id"]) & (blocks[column] == F.col("_value"))).drop(entries["block_id"], F.col("_value"))


def dictionary_decode(encoded: DataFrame, entries: DataFrame) -> DataFrame:
    return encoded.join(entries, ["block_id", "code"])


def dictionary_lists(blocks: DataFrame, column: str) -> DataFrame:
    return blocks.groupBy("block_id").agg(F.array_sort(F.collect_set(column)).alias("entries"))


def lookup(entries: DataFrame, literal: str) -> DataFrame:
    """The code of a literal in each block that has it; an absent literal has no row."""
    return entries.where(F.col("value") == literal).select("block_id", "code")


def _aligned(n: Column) -> Column:
    return F.ceil(n / ALIGNMENT) * ALIGNMENT


def _widths(meta: DataFrame, ints: Sequence[str], strings: Sequence[str]) -> list[Column]:
    spans = [(F.col(f"min_{c}"), F.col(f"max_{c}")) for c in ints] + [(F.lit(0), F.col(f"nd_{c}") - 1) for c in strings]
    return [width_of(encoding_of(*s)).cast("bigint") for s in spans]


def _header(columns: int) -> int:
    return -(-(HEADER_BYTES + HEADER_COLUMN_BYTES * columns) // ALIGNMENT) * ALIGNMENT


def column_offsets(meta: DataFrame, ints: Sequence[str], strings: Sequence[str]) -> DataFrame:
    """block_id, column, sma_offset, data_offset, data_bytes of each column in the packed layout, integer columns first."""
    widths = _widths(meta, ints, strings)
    start = F.array(F.lit(_header(len(widths))).cast("bigint"))
    # Each step appends where the column's data begins and where they end.
    ends = F.aggregate(
        F.array(*widths),
        start,
        lambda at, w: F.concat(at, F.array(_aligned(F.element_at(at, -1) + SMA_BYTES).cast("bigint"), (_aligned(F.element_at(at, -1) + SMA_BYTES) + F.col("tuple_count") * w).cast("bigint"))),
    )
    at = meta.select("block_id", ends.alias("_at"))
    each = F.array(*(F.struct(F.lit(c).alias("column"), F.get("_at", F.lit(2 * i)).alias("sma_offset"), F.get("_at", F.lit(2 * i + 1)).alias("data_offset"), (F.get("_at", F.lit(2 * i + 2)) - F.get("_at", F.lit(2 * i + 1))).alias("data_bytes")) for i, c in enumerate((*ints, *strings))))
    return at.select("block_id", F.explode(each).alias("c")).select("block_id", "c.*")


def size_report(meta: DataFrame, ints: Sequence[str], strings: Sequence[str] = ()) -> DataFrame:
    """Header, data and dictionary bytes of each block in the packed layout, integer columns first.

    A string column is stored as the codes of its dictionary; the dictionaries
    follow all data, each with two counters, an end offset for each entry and
    the entries' bytes.
    """
    widths = _widths(meta, ints, strings)
    header = _header(len(widths))
    data = F.aggregate(F.array(*widths), F.lit(header).cast("bigint"), lambda at, w: (_aligned(at + SMA_BYTES) + F.col("tuple_count") * w).cast("bigint"))
    words = F.lit(0).cast("bigint")
    for c in strings:
        words = words + 8 + 4 * F.col(f"nd_{c}") + F.col(f"bytes_{c}")
    return meta.select("block_id", "tuple_count", F.lit(header).cast("bigint").alias("header_bytes"), (data - header).alias("data_bytes"), words.cast("bigint").alias("dictionary_bytes"), (data + words).cast("bigint").alias("block_bytes"))


def accessors(blocks: DataFrame, meta: DataFrame, capacity: int = BLOCK_CAPACITY) -> DataFrame:
    n = len([c for c in blocks.columns if c not in ("block_id", "pos")])
    return meta.select("block_id", "tuple_count", (F.col("tuple_count") == 0).alias("is_empty"), (F.col("tuple_count") == capacity).alias("is_full"), F.lit(n).alias("column_count"))


def prune_report(meta: DataFrame, predicates: Sequence[Predicate]) -> DataFrame:
    """NONE, ALL or PARTIAL for each block under the conjunction, from its minima and maxima."""
    verdicts = [p.verdict(F.col(f"min_{p.name}"), F.col(f"max_{p.name}")) for p in predicates]
    none = functools.reduce(operator.or_, (v == "NONE" for v in verdicts), F.lit(False))
    every = functools.reduce(operator.and_, (v == "ALL" for v in verdicts), F.lit(True))
    return meta.select("block_id", "tuple_count", F.when(none, "NONE").when(every, "ALL").otherwise("PARTIAL").alias("verdict"))


def pruned_count(blocks: DataFrame, report: DataFrame, predicates: Sequence[Predicate], named_blocks: int = NAMED_BLOCKS) -> DataFrame:
    """The count of matches that reads only the blocks whose verdict is PARTIAL.

    Few such blocks are named in the filter, by which the scan skips the row
    groups of all others; more are joined, and the predicates alone skip.
    """
    partial = report.where("verdict = 'PARTIAL'").select("block_id")
    some = [r.block_id for r in partial.limit(named_blocks + 1).collect()]
    if len(some) <= named_blocks:
        rows = blocks.where(F.col("block_id").isin(some)) if some else blocks.where(F.lit(False))
    else:
        rows = blocks.join(partial, "block_id", "left_semi")
    scanned = rows.where(conjunction(predicates)).agg(F.count(F.lit(1)).alias("n"))
    known = report.where("verdict = 'ALL'").agg(F.coalesce(F.sum("tuple_count"), F.lit(0)).alias("n"))
    return scanned.unionByName(known).agg(F.sum("n").alias("matches"))
