"""Scalar functions of the fixed-width SQL types, as Column expressions.

ANSI mode makes overflow an error in Spark; where wrap-around is the meaning,
the expressions below compute in a wider type and mask.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the seed of the xorshift generator and of the numeric hash.
XORSHIFT_SEED = 88172645463325252
_MASK = (1 << 64) - 1


def wrap_int32(value: Column) -> Column:
    """A BIGINT as the 32-bit integer of its low bits."""
    low = value.bitwiseAND(F.lit((1 << 32) - 1))
    return F.when(low >= 1 << 31, low - (1 << 32)).otherwise(low).cast("int")


def int_add(a: Column, b: Column) -> Column:
    return wrap_int32(a.cast("bigint") + b.cast("bigint"))


def int_sub(a: Column, b: Column) -> Column:
    return wrap_int32(a.cast("bigint") - b.cast("bigint"))


def int_mul(a: Column, b: Column) -> Column:
    return wrap_int32(a.cast("bigint") * b.cast("bigint"))


def modulo(a: Column, n: int) -> Column:
    """The remainder with the sign of the dividend."""
    return a % F.lit(n)


def parse_int(text: Column) -> Column:
    """Digits before a point, with blanks around and a sign allowed; NULL for anything else or over ten digits."""
    digits = F.regexp_extract(F.trim(text), r"^([+-]?[0-9]{1,10})(?:\..*)?$", 1)
    return F.when(digits != "", digits).try_cast("int")


def parse_numeric(text: Column, length: int, precision: int) -> Column:
    """An exact decimal; NULL unless it fits once zeros at its end are dropped."""
    whole = f"[0-9]{{1,{length - precision}}}"
    shape = rf"^[+-]?{whole}(?:\.[0-9]{{0,{precision}}}0*)?$"
    return F.when(F.trim(text).rlike(shape), F.trim(text)).try_cast(f"decimal({length},{precision})")


def char_value(text: Column) -> Column:
    """Leading blanks go, trailing ones stay."""
    return F.ltrim(text)


def char1(text: Column) -> Column:
    return F.when(F.substring(text, 1, 1) == " ", "").otherwise(F.substring(text, 1, 1))


def prefix_equal(value: Column, text: Column) -> Column:
    return F.startswith(text, value)


def numeric_add(a: Column, b: Column, length: int, precision: int) -> Column:
    return (a + b).cast(f"decimal({length},{precision})")


def numeric_mul(a: Column, b: Column) -> Column:
    """The scales add up."""
    return a * b


def unscaled(value: Column, precision: int) -> Column:
    return (value * F.lit(10**precision)).cast("bigint")


def truncating_div(a: str, b: str) -> Column:
    """Integer division of two BIGINT expressions, towards zero."""
    return F.expr(f"cast({a} as bigint) div cast({b} as bigint)")


def scale_up(unscaled_value: Column, digits: int) -> Column:
    return unscaled_value * F.lit(10**digits)


def scale_down(unscaled_value: str, digits: int) -> Column:
    return truncating_div(unscaled_value, str(10**digits))


def extract_year(date: Column) -> Column:
    return F.year(date)


def julian_day(date: Column) -> Column:
    return F.unix_date(date) + 2440588


def ship_day(date: Column) -> Column:
    """Days from the end of 1991, so 1 January 1992 is 1."""
    return F.datediff(date, F.lit("1991-12-31").cast("date"))


def flight_day(date: Column) -> Column:
    """A sortable code of year, month and day."""
    return 404 * F.year(date) + 32 * F.month(date) + F.dayofmonth(date)


def timestamp_of(millis: Column) -> Column:
    """Milliseconds from 1970 as a TIMESTAMP_NTZ, whatever the session's zone; exact for all that the type holds."""
    rest = F.pmod(millis, F.lit(86_400_000))
    days = ((millis - rest) / F.lit(86_400_000)).cast("int")
    seconds = (rest.cast("decimal(18,6)") / F.lit(1000)).cast("decimal(18,6)")
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(days=days, secs=seconds)


def print_timestamp(at: Column) -> Column:
    """A TIMESTAMP_NTZ with milliseconds; a year beyond 9999 has no sign."""
    whole = F.substring_index(F.ltrim(at.cast("string"), F.lit("+")), ".", 1)
    return F.concat(whole, F.date_format(at, ".SSS"))


def parse_date(text: Column) -> Column:
    """yyyy-mm-dd as a DATE; NULL for a day that isn't in the calendar."""
    return text.try_cast("date")


def print_date(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM-dd")


def pack_chars(text: Column) -> Column:
    """Up to seven bytes as a big-endian integer."""
    return F.conv(F.hex(F.encode(text, "UTF-8")), 16, 10).cast("bigint")


def tid_pack(page: Column, slot: Column) -> Column:
    return F.shiftleft(page, 16).bitwiseXOR(slot.bitwiseAND(F.lit(0xFFFF)))


def tid_page(tid: Column) -> Column:
    return F.shiftrightunsigned(tid, 16)


def tid_page_id(tid: Column, segment: Column) -> Column:
    """The page with the segment in the 16 bits above it."""
    return tid_page(tid).bitwiseXOR(F.shiftleft(segment.cast("bigint"), 48))


def tid_slot(tid: Column) -> Column:
    return tid.bitwiseAND(F.lit(0xFFFF))


def pid_pack(segment: Column, page: Column) -> Column:
    return F.shiftleft(segment.cast("bigint"), 48).bitwiseOR(page.bitwiseAND(F.lit((1 << 48) - 1)))


def pid_segment(pid: Column) -> Column:
    return F.shiftrightunsigned(pid, 48)


def pid_page(pid: Column) -> Column:
    return pid.bitwiseAND(F.lit((1 << 48) - 1))


def hash_number(value: Column) -> Column:
    """The xorshift step of the seed xor the value, as a signed 64-bit number."""
    x = value.cast("bigint").bitwiseXOR(F.lit(XORSHIFT_SEED))
    x = x.bitwiseXOR(F.shiftleft(x, 13))
    x = x.bitwiseXOR(F.shiftrightunsigned(x, 7))
    return x.bitwiseXOR(F.shiftleft(x, 17))


def hash_text(text: Column) -> Column:
    """Bytes folded into 32 bits: rotated left by five, then xor the byte."""
    raw = F.encode(text, "UTF-8")
    places = F.when(F.length(raw) > 0, F.sequence(F.lit(1), F.length(raw))).otherwise(F.array().cast("array<int>"))
    byte = lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("bigint")
    turned = lambda h: F.shiftleft(h, 5).bitwiseAND(F.lit((1 << 32) - 1)).bitwiseOR(F.shiftrightunsigned(h, 27))
    return F.aggregate(places, F.lit(0).cast("bigint"), lambda h, i: turned(h).bitwiseXOR(byte(i)))


def hash_key(*hashes: Column) -> Column:
    out = hashes[0]
    for h in hashes[1:]:
        out = out.bitwiseXOR(h)
    return out


def split_fields(text: Column, delimiter: str) -> Column:
    """Fields of a line; an empty one at the end is dropped."""
    import re

    parts = F.split(text, re.escape(delimiter), -1)
    last_empty = F.element_at(parts, -1) == ""
    return F.when(last_empty, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


class XorShift64:
    """The fixture generator; its recurrence is sequential, so it runs on the driver."""

    def __init__(self, seed: int = XORSHIFT_SEED):
        self.state = seed

    def next(self) -> int:
        x = self.state
        for left, n in ((True, 13), (False, 7), (True, 17)):
            x ^= (x << n) & _MASK if left else x >> n
        self.state = x
        return x
