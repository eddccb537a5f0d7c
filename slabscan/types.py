"""Logical types and the policy for unsigned 64-bit values.

Spark has no unsigned integers.  Values below 2**63 are BIGINT; a column that
may use the whole unsigned range is DECIMAL(20,0), whose predicates still
reach the Parquet reader.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows in a full block.
BLOCK_CAPACITY = 1 << 16
U64 = T.DecimalType(20, 0)
U64_MAX = (1 << 64) - 1


class Unsigned(int):
    """An integer that a predicate compares in the unsigned domain."""


def literal(value) -> Column:
    """A literal of a predicate."""
    return u64(value) if isinstance(value, Unsigned) else F.lit(value)


def u64(value: int) -> Column:
    """A literal of the unsigned domain."""
    if not 0 <= value <= U64_MAX:
        raise ValueError(f"{value} is outside the unsigned 64-bit range")
    return F.lit(str(int(value))).cast(U64)


def unsigned(bits: Column) -> Column:
    """The 64 bits of a BIGINT as an unsigned number."""
    return F.when(bits < 0, bits.cast(U64) + u64(1 << 63) + u64(1 << 63)).otherwise(bits).cast(U64)


def signed_bits(value: Column) -> Column:
    """The BIGINT with the 64 bits of an unsigned number; the inverse of ``unsigned``."""
    half = F.lit(str(1 << 63)).cast("decimal(20,0)")
    return F.when(value >= half, value - half - half).otherwise(value).cast("bigint")


def scaled(col: Column, digits: int = 2) -> Column:
    """A decimal or double as an integer of 10**-digits units, rounded half up."""
    return F.round(col * F.lit(10**digits)).cast("bigint")


def sentinel(col: Column, value: int) -> Column:
    """NULL replaced by a sentinel value, for loaders that need one."""
    return F.coalesce(col, F.lit(value).cast("bigint"))
