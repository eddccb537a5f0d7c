"""Queries of the loaders and sinks: delimited text, flight layout, CSV results, appended streams, generated fixtures."""

from __future__ import annotations

from pyspark.sql import functions as F

from slabscan.functions import scalars as S
from slabscan.operators import stats
from slabscan.sources.blocks import BlockStore, scratch_path, store_once
from slabscan.sources.loaders import FLIGHT_COLUMNS, FLIGHT_MISSING, lineitem, read_flight_text, read_lineitem_text, read_nation_text, table, write_result_csv
from slabscan.streaming import append_stream

GENERATED = 1000
_TEXT = {10: "l_returnflag || l_linestatus", 17: "'SFO'"}
_LEADING = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", None, "price_cents")
#: Columns that hold NA in some rows.
_GAPS = (4, 6)
_ORDER = ("c0", "c1", "c2", "c3", "c5")
FLIGHT = [f"c{i}" for i in range(FLIGHT_COLUMNS)]


def _flight_cell(i: int) -> str:
    """The column's value in SQL that both engines read."""
    plain = _TEXT.get(i) or (_LEADING[i] if i < len(_LEADING) and _LEADING[i] else f"(l_orderkey * {i + 1} + l_linenumber) % 1000")
    return f"CASE WHEN l_linenumber = 3 THEN NULL ELSE {plain} END" if i in _GAPS else plain


def _lines(rows, cells, separator):
    """One text column; null cells are NA."""
    return rows.select(F.concat_ws(separator, *(F.coalesce(F.expr(c).cast("string"), F.lit("NA")) for c in cells)).alias("value"))


def lineitem_text(spark, sf_dir):
    """Write lineitem as pipe-delimited text with a delimiter at each line's end, and read it."""
    cells = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "cast(quantity as decimal(12,2))", "cast(price_cents / 100 as decimal(12,2))", "cast(discount_pct / 100 as decimal(12,2))", "cast(tax_pct / 100 as decimal(12,2))"]
    cells += ["l_returnflag", "l_linestatus", "ship_d", "date_add(ship_d, 10)", "date_add(ship_d, 20)", "'NONE'", "'MAIL'", "'some words'", "''"]
    path = scratch_path(spark, "lineitem_text")
    _lines(lineitem(spark, sf_dir), cells, "|").write.text(path)
    return read_lineitem_text(spark, path)


def nation_text(spark, sf_dir):
    path = scratch_path(spark, "nation_text")
    _lines(table(spark, sf_dir, "nation"), ["n_nationkey", "n_name", "n_regionkey", "concat('about ', n_name)"], "|").write.text(path)
    return read_nation_text(spark, path)


def flight_rows(spark, sf_dir, missing=FLIGHT_MISSING):
    path = scratch_path(spark, "flight_text")
    _lines(lineitem(spark, sf_dir), [_flight_cell(i) for i in range(FLIGHT_COLUMNS)], ",").write.text(path)
    return read_flight_text(spark, path, missing)


def flight_size(spark, sf_dir):
    files = lineitem(spark, sf_dir).inputFiles()
    store = store_once(spark, "flight", files, 65536, lambda path: BlockStore.create(flight_rows(spark, sf_dir), path, _ORDER, FLIGHT))
    return stats.size_report(store.meta, FLIGHT)


def csv_sink(spark, sf_dir):
    path = scratch_path(spark, "result_csv")
    write_result_csv(table(spark, sf_dir, "nation"), path)
    return spark.read.csv(path, header=True, schema="n_nationkey int, n_name string, n_regionkey int")


def stream_append(spark, sf_dir):
    """Stream two files of nations to a block table, which is then read as a batch."""
    source, target = scratch_path(spark, "stream"), scratch_path(spark, "streamed")
    nations = table(spark, sf_dir, "nation")
    nations.repartition(2, "n_nationkey").write.parquet(source)
    append_stream(spark.readStream.schema(nations.schema).option("maxFilesPerTrigger", 1).parquet(source), f"{target}/rows", f"{target}/checkpoint", capacity=8).awaitTermination()
    return spark.read.parquet(f"{target}/rows").drop("epoch")


def generated(spark, sf_dir):
    """The first numbers of the fixture generator, which is sequential."""
    g = S.XorShift64()
    return spark.createDataFrame([(i, str(g.next())) for i in range(GENERATED)], "step int, value string")


def _packed(text: str) -> str:
    return f"list_reduce(list_prepend(0::BIGINT, list_transform(range(1, length({text}) + 1), lambda i: CAST(ord(({text})[i]) AS BIGINT))), lambda h, b: h * 256 + b)"


def _flight_sql_cell(i: int) -> str:
    cell = _packed(_TEXT[i]) if i in _TEXT else f"CAST({_flight_cell(i)} AS BIGINT)"
    return f"coalesce({cell}, {FLIGHT_MISSING}) AS c{i}"


_FLIGHT = f"""li AS (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS price_cents FROM lineitem), f AS (SELECT {', '.join(_flight_sql_cell(i) for i in range(FLIGHT_COLUMNS))} FROM li)"""


def _flight_size_sql() -> str:
    header = -(-(12 + 20 * FLIGHT_COLUMNS) // 32) * 32
    width = lambda d: f"(CASE WHEN {d} = 0 THEN 0 WHEN {d} < 256 THEN 1 WHEN {d} < 65536 THEN 2 WHEN {d} < 4294967296 THEN 4 ELSE 8 END)"
    spans = ", ".join(f"max({c}) - min({c}) AS d_{c}" for c in FLIGHT)
    at, prev, steps = str(header), "g", []
    for c in FLIGHT:
        steps.append(f"s_{c} AS (SELECT *, CAST((({at} + 63) // 32) * 32 + n * {width(f'd_{c}')} AS BIGINT) AS o_{c} FROM {prev})")
        at, prev = f"o_{c}", f"s_{c}"
    return f"""WITH {_FLIGHT}, b AS (SELECT *, CAST((row_number() OVER (ORDER BY {', '.join(_ORDER)}) - 1) // 65536 AS BIGINT) AS block_id FROM f), g AS (SELECT block_id, count(*) AS n, {spans} FROM b GROUP BY block_id), {', '.join(steps)}
SELECT block_id, n AS tuple_count, CAST({header} AS BIGINT) AS header_bytes, CAST({at} - {header} AS BIGINT) AS data_bytes, 0::BIGINT AS dictionary_bytes, {at} AS block_bytes FROM {prev}"""


CATALOG: dict[str, tuple] = {
    "s_lineitem_text": (
        lineitem_text,
        """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round(l_quantity) AS DECIMAL(12,2)) AS l_quantity, CAST(round(l_extendedprice * 100) / 100 AS DECIMAL(12,2)) AS l_extendedprice,
 CAST(round(l_discount * 100) / 100 AS DECIMAL(12,2)) AS l_discount, CAST(round(l_tax * 100) / 100 AS DECIMAL(12,2)) AS l_tax, l_returnflag, l_linestatus, CAST(l_shipdate AS DATE) AS l_shipdate,
 CAST(l_shipdate AS DATE) + 10 AS l_commitdate, CAST(l_shipdate AS DATE) + 20 AS l_receiptdate, 'NONE' AS l_shipinstruct, 'MAIL' AS l_shipmode, 'some words' AS l_comment FROM lineitem""",
    ),
    "s_nation_text": (nation_text, "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey, 'about ' || n_name AS n_comment FROM nation"),
    "s_flight_text": (flight_rows, f"WITH {_FLIGHT} SELECT * FROM f"),
    "m_flight_size": (flight_size, _flight_size_sql()),
    "s_csv_sink": (csv_sink, "SELECT n_nationkey, n_name, n_regionkey FROM nation"),
    "s_stream_append": (stream_append, "SELECT n_nationkey, n_name, n_regionkey FROM nation"),
    "g_xorshift": (
        generated,
        f"""WITH RECURSIVE r(step, x) AS (SELECT -1, {S.XORSHIFT_SEED}::HUGEINT UNION ALL
 SELECT step + 1, xor(c, (c * 131072::HUGEINT) & 18446744073709551615::HUGEINT) FROM (SELECT step, xor(a, a // 128::HUGEINT) AS c FROM (SELECT step, xor(x, (x * 8192::HUGEINT) & 18446744073709551615::HUGEINT) AS a FROM r WHERE step < {GENERATED - 1})))
SELECT CAST(step AS INT) AS step, CAST(x AS VARCHAR) AS value FROM r WHERE step >= 0""",
    ),
}
