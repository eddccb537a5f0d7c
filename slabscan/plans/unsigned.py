"""Queries over the whole unsigned 64-bit domain: hashes of order keys as a block table of DECIMAL(20,0)."""

from __future__ import annotations

from pyspark.sql import functions as F

from slabscan.functions import scalars as S
from slabscan.operators import psma, stats
from slabscan.operators.scan import BlockTable
from slabscan.predicate import Between, Eq, Gt, Lt
from slabscan.sources.blocks import BlockStore, store_once
from slabscan.sources.loaders import lineitem
from slabscan.types import U64_MAX, Unsigned, unsigned

CAPACITY = 4096
KEYS = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
ORDER = ("u", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price_cents")
#: Literals of the queries; the first is the hash of order key 42.
VALUE = Unsigned(S.XorShift64(S.XORSHIFT_SEED ^ 42).next())
LOW, HIGH = Unsigned(1 << 63), Unsigned((1 << 63) + (1 << 62))


def hash_sql(value: str) -> str:
    """The xorshift step in HUGEINT arithmetic, from 0 to 2**64 - 1."""
    x = f"xor(CAST({value} AS HUGEINT), {S.XORSHIFT_SEED}::HUGEINT)"
    x = f"xor({x}, ({x} * 8192::HUGEINT) & {U64_MAX}::HUGEINT)"
    x = f"xor({x}, {x} // 128::HUGEINT)"
    return f"xor({x}, ({x} * 131072::HUGEINT) & {U64_MAX}::HUGEINT)"


def signed_sql(bits: str) -> str:
    return f"CAST(CASE WHEN {bits} > {U64_MAX >> 1}::HUGEINT THEN {bits} - 18446744073709551616::HUGEINT ELSE {bits} END AS BIGINT)"


def store(spark, sf_dir) -> BlockStore:
    rows = lineitem(spark, sf_dir)
    hashed = rows.select(*KEYS, "price_cents", unsigned(S.hash_number(F.col("l_orderkey"))).alias("u"))
    return store_once(spark, "unsigned", rows.inputFiles(), CAPACITY, lambda path: BlockStore.create(hashed, path, ORDER, ("u",), capacity=CAPACITY))


_U = f"""u AS (SELECT {', '.join(KEYS)}, CAST(round(l_extendedprice * 100) AS BIGINT) AS price_cents, CAST({hash_sql('l_orderkey')} AS HUGEINT) AS v FROM lineitem),
 b AS (SELECT *, CAST(v AS DECIMAL(20,0)) AS u, CAST((row_number() OVER (ORDER BY v, {', '.join(ORDER[1:])}) - 1) // {CAPACITY} AS BIGINT) AS block_id, CAST((row_number() OVER (ORDER BY v, {', '.join(ORDER[1:])}) - 1) % {CAPACITY} AS INT) AS pos FROM u)"""
_SPAN = "max(v) - min(v)"
_ENCODING = f"CASE WHEN {_SPAN} = 0 THEN 'Singlevalue' WHEN {_SPAN} < 256 THEN 'Byte1' WHEN {_SPAN} < 65536 THEN 'Byte2' WHEN {_SPAN} < 4294967296 THEN 'Byte4' ELSE 'Byte8' END"
_WIDTH = f"CASE WHEN {_SPAN} = 0 THEN 0 WHEN {_SPAN} < 256 THEN 1 WHEN {_SPAN} < 65536 THEN 2 WHEN {_SPAN} < 4294967296 THEN 4 ELSE 8 END"
_BYTE = "(CASE WHEN d = 0 THEN 0 ELSE (length(hex(d)) - 1) // 2 END)"
_INDEX = f"""{_U}, e AS (SELECT block_id, pos, v - min(v) OVER (PARTITION BY block_id) AS delta, min(v) OVER (PARTITION BY block_id) AS low FROM b),
 d AS (SELECT *, CAST(delta AS UBIGINT) AS d FROM e), sl AS (SELECT *, CAST((d >> CAST(8 * {_BYTE} AS UBIGINT)) + CAST(256 * {_BYTE} AS UBIGINT) AS BIGINT) AS slot FROM d)"""


def _scan(predicate, where):
    return (lambda spark, sf_dir: BlockTable(store(spark, sf_dir).blocks).materialize([predicate], *KEYS, "u"), f"WITH {_U} SELECT block_id, pos, {', '.join(KEYS)}, u FROM b WHERE {where}")


def _on_store(run):
    return lambda spark, sf_dir: run(store(spark, sf_dir))


CATALOG: dict[str, tuple] = {
    "u64_eq": _scan(Eq("u", VALUE), f"v = {VALUE}::HUGEINT"),
    "u64_gt": _scan(Gt("u", HIGH), f"v > {HIGH}::HUGEINT"),
    "u64_lt": _scan(Lt("u", LOW), f"v < {LOW}::HUGEINT"),
    "u64_between": _scan(Between("u", LOW, HIGH), f"v BETWEEN {LOW}::HUGEINT AND {HIGH}::HUGEINT"),
    "u64_encoding": (
        _on_store(lambda s: stats.encodings(s.meta, ("u",))),
        f"WITH {_U} SELECT block_id, count(*) AS tuple_count, 'u' AS \"column\", min(u) AS \"min\", max(u) AS \"max\", {_ENCODING} AS encoding, {_WIDTH} AS width FROM b GROUP BY block_id",
    ),
    "u64_for": (
        _on_store(lambda s: stats.from_reference(stats.frame_of_reference(s.blocks, s.meta, "u")).select("block_id", "pos", "reference", "delta", "value")),
        f"WITH {_U} SELECT block_id, pos, min(u) OVER w AS reference, CAST(v - min(v) OVER w AS DECIMAL(20,0)) AS delta, u AS value FROM b WINDOW w AS (PARTITION BY block_id)",
    ),
    "u64_size": (
        _on_store(lambda s: stats.size_report(s.meta, ("u",)).select("block_id", "block_bytes")),
        f"WITH {_U}, w AS (SELECT block_id, count(*) AS n, {_WIDTH} AS w FROM b GROUP BY block_id) SELECT block_id, CAST(64 + n * w AS BIGINT) AS block_bytes FROM w",
    ),
    "u64_prune": (
        _on_store(lambda s: stats.prune_report(s.meta, [Between("u", LOW, HIGH)])),
        f"WITH {_U} SELECT block_id, count(*) AS tuple_count, CASE WHEN max(v) < {LOW}::HUGEINT OR min(v) > {HIGH}::HUGEINT THEN 'NONE' WHEN min(v) >= {LOW}::HUGEINT AND max(v) <= {HIGH}::HUGEINT THEN 'ALL' ELSE 'PARTIAL' END AS verdict FROM b GROUP BY block_id",
    ),
    "u64_psma_build": (
        _on_store(lambda s: psma.build(s.blocks, s.meta, "u")),
        f'WITH {_INDEX} SELECT block_id, slot, CAST(min(low) AS DECIMAL(20,0)) AS reference, min(pos) AS "start", max(pos) + 1 AS "end" FROM sl GROUP BY block_id, slot',
    ),
    "u64_psma_search": (
        _on_store(lambda s: psma.search(s.blocks, psma.build(s.blocks, s.meta, "u"), "u", VALUE)),
        f"WITH {_U} SELECT block_id, pos FROM b WHERE v = {VALUE}::HUGEINT",
    ),
}
