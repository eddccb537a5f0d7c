"""Every operator as a named query on the test tables, with the same result in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from slabscan.functions import scalars as S
from slabscan.operators import psma, stats
from slabscan.operators.scan import BlockTable
from slabscan.plans import workloads as W
from slabscan.predicate import Between, Eq, Gt, Lt, conjunction
from slabscan.plans import formats, unsigned
from slabscan.sources.blocks import BlockStore, read_blocks, scratch_path
from slabscan.sources.loaders import LINEITEM_INTS as INTS
from slabscan.sources.loaders import LINEITEM_STRINGS as STRINGS
from slabscan.sources.loaders import lineitem, lineitem_store, table

#: Small enough for several blocks at the smallest scales.
CAPACITY = 4096
SCAN = (Between("discount_pct", 5, 7), Lt("quantity", 24), Gt("l_suppkey", 10))

_KEYS = ", ".join(W.KEYS)
_DOMAIN = """li AS (SELECT *, CAST(round(l_quantity) AS BIGINT) AS quantity, CAST(round(l_extendedprice * 100) AS BIGINT) AS price_cents,
 CAST(round(l_discount * 100) AS BIGINT) AS discount_pct, CAST(round(l_tax * 100) AS BIGINT) AS tax_pct, CAST(l_shipdate AS DATE) AS ship_d FROM lineitem)"""
_BLOCKS = f"""{_DOMAIN}, ranked AS (SELECT *, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS rn FROM li),
 b AS (SELECT *, CAST(rn // {CAPACITY} AS BIGINT) AS block_id, CAST(rn % {CAPACITY} AS INT) AS pos FROM ranked)"""
_SCAN = "discount_pct BETWEEN 5 AND 7 AND quantity < 24 AND l_suppkey > 10"
_DIFFS = ", ".join(f"CAST(max({c}) - min({c}) AS BIGINT) AS d_{c}" for c in INTS)


def _store(spark, sf_dir):
    return lineitem_store(spark, sf_dir, CAPACITY)


def _blocks(spark, sf_dir):
    return _store(spark, sf_dir).blocks


def _meta(spark, sf_dir):
    return _store(spark, sf_dir).meta


def _block_table(spark, sf_dir):
    return BlockTable(_blocks(spark, sf_dir))


def _leg(run):
    return lambda spark, sf_dir: run(spark, sf_dir, capacity=CAPACITY)


def _width_sql(diff: str) -> str:
    return f"(CASE WHEN {diff} = 0 THEN 0 WHEN {diff} < 256 THEN 1 WHEN {diff} < 65536 THEN 2 WHEN {diff} < 4294967296 THEN 4 ELSE 8 END)"


def _encoding_sql(diff: str) -> str:
    return f"(CASE WHEN {diff} = 0 THEN 'Singlevalue' WHEN {diff} < 256 THEN 'Byte1' WHEN {diff} < 65536 THEN 'Byte2' WHEN {diff} < 4294967296 THEN 'Byte4' ELSE 'Byte8' END)"


def _on(name, source, predicates, columns, sql_where):
    def run(spark, sf_dir):
        df = _blocks(spark, sf_dir) if source == "lineitem" else table(spark, sf_dir, source)
        return df.where(conjunction(predicates)).select(*columns)

    origin = f"WITH {_DOMAIN} SELECT {', '.join(columns)} FROM li" if source == "lineitem" else f"SELECT {', '.join(columns)} FROM {source}"
    return {name: (run, f"{origin} WHERE {sql_where}")}


def _offsets_sql() -> str:
    widths = [_width_sql(f"d_{c}") for c in INTS] + [_width_sql(f"(nd_{c} - 1)") for c in STRINGS]
    at, prev, steps, parts = str(-(-(12 + 20 * len(widths)) // 32) * 32), "g", [], []
    for i, (c, w) in enumerate(zip((*INTS, *STRINGS), widths, strict=True)):
        steps.append(f"s{i} AS (SELECT *, CAST({at} AS BIGINT) AS sma{i}, CAST((({at} + 63) // 32) * 32 AS BIGINT) AS data{i}, CAST((({at} + 63) // 32) * 32 + n * {w} AS BIGINT) AS o{i} FROM {prev})")
        parts.append((c, i))
        at, prev = f"o{i}", f"s{i}"
    nds = ", ".join(f"count(DISTINCT {c}) AS nd_{c}" for c in STRINGS)
    each = " UNION ALL ".join(f"SELECT block_id, '{c}' AS \"column\", sma{i} AS sma_offset, data{i} AS data_offset, o{i} - data{i} AS data_bytes FROM {prev}" for c, i in parts)
    return f"WITH {_BLOCKS}, g AS (SELECT block_id, count(*) AS n, {_DIFFS}, {nds} FROM b GROUP BY block_id), {', '.join(steps)} {each}"


def _size_sql() -> str:
    widths = [_width_sql(f"d_{c}") for c in INTS] + [_width_sql(f"(nd_{c} - 1)") for c in STRINGS]
    header = -(-(12 + 20 * len(widths)) // 32) * 32
    at = str(header)
    ctes, prev = [], "g"
    for i, w in enumerate(widths):
        ctes.append(f"s{i} AS (SELECT *, CAST((({at} + 32 + 31) // 32) * 32 + n * {w} AS BIGINT) AS o{i} FROM {prev})")
        at, prev = f"o{i}", f"s{i}"
    words = " + ".join(f"8 + 4 * nd_{c} + len_{c}" for c in STRINGS)
    nds = ", ".join(f"count(DISTINCT {c}) AS nd_{c}" for c in STRINGS)
    lens = " ".join(f"JOIN (SELECT block_id, sum(strlen(v)) AS len_{c} FROM (SELECT DISTINCT block_id, {c} AS v FROM b) GROUP BY block_id) x_{c} USING (block_id)" for c in STRINGS)
    return f"""WITH {_BLOCKS}, g0 AS (SELECT block_id, count(*) AS n, {_DIFFS}, {nds} FROM b GROUP BY block_id), g AS (SELECT * FROM g0 {lens}), {', '.join(ctes)}
SELECT block_id, n AS tuple_count, CAST({header} AS BIGINT) AS header_bytes, CAST({at} - {header} AS BIGINT) AS data_bytes, CAST({words} AS BIGINT) AS dictionary_bytes, CAST({at} + {words} AS BIGINT) AS block_bytes FROM {prev}"""


def _sma_sql(extra: str = "") -> str:
    parts = " UNION ALL ".join(f"SELECT block_id, count(*) AS tuple_count, '{c}' AS \"column\", CAST(min({c}) AS BIGINT) AS \"min\", CAST(max({c}) AS BIGINT) AS \"max\" FROM b GROUP BY block_id" for c in INTS)
    return f'WITH {_BLOCKS}, s AS ({parts}) SELECT * {extra} FROM s'


def _prune_sql() -> str:
    return f"""WITH {_BLOCKS}, g AS (SELECT block_id, count(*) AS tuple_count, min(ship_d) AS lo, max(ship_d) AS hi FROM b GROUP BY block_id)
SELECT block_id, tuple_count, CASE WHEN hi < DATE '1996-01-01' OR lo > DATE '1996-12-31' THEN 'NONE' WHEN lo >= DATE '1996-01-01' AND hi <= DATE '1996-12-31' THEN 'ALL' ELSE 'PARTIAL' END AS verdict FROM g"""


def _ship_year():
    import datetime

    return Between("ship_d", datetime.date(1996, 1, 1), datetime.date(1996, 12, 31))


def _append(spark, sf_dir):
    t = _block_table(spark, sf_dir)
    return t.append(t).df.groupBy("block_id").agg(F.count(F.lit(1)).alias("tuple_count"), F.max("pos").alias("last_pos"))


def _pruned(spark, sf_dir):
    s = _store(spark, sf_dir)
    return stats.pruned_count(s.blocks, stats.prune_report(s.meta, [_ship_year()]), [_ship_year()])


def _late(spark, sf_dir):
    t = _block_table(spark, sf_dir)
    return t.fetch(t.positions(SCAN), "price_cents", "l_returnflag")


def _dict_decode(spark, sf_dir):
    b = _blocks(spark, sf_dir)
    codes = stats.dictionary_encode(b, "l_returnflag").select("block_id", "pos", "code")
    return stats.dictionary_decode(codes, stats.dictionary(b, "l_returnflag")).select("block_id", "pos", "value")


def _dict_lists(spark, sf_dir):
    return stats.dictionary_lists(_blocks(spark, sf_dir), "l_returnflag").select("block_id", F.array_join("entries", "|").alias("entries"))


def _psma_lookup(spark, sf_dir):
    return psma.lookup(psma.build(_blocks(spark, sf_dir), _meta(spark, sf_dir), "l_suppkey"), 42)


def _psma_search(spark, sf_dir):
    s = _store(spark, sf_dir)
    return psma.search(s.blocks, psma.build(s.blocks, s.meta, "l_suppkey"), "l_suppkey", 42)


_SLOT = "(CASE WHEN d = 0 THEN 0 ELSE (length(hex(d)) - 1) // 2 END)"
_PSMA = f"""{_BLOCKS}, e AS (SELECT block_id, pos, l_suppkey, min(l_suppkey) OVER (PARTITION BY block_id) AS reference FROM b), d AS (SELECT *, l_suppkey - reference AS d FROM e),
 sl AS (SELECT *, CAST((d >> CAST(8 * {_SLOT} AS BIGINT)) + 256 * {_SLOT} AS BIGINT) AS slot FROM d),
 ix AS (SELECT block_id, slot, min(reference) AS reference, min(pos) AS "start", max(pos) + 1 AS "end" FROM sl GROUP BY block_id, slot)"""
_LOOKUP = f"""{_PSMA}, q AS (SELECT block_id, slot, "start", "end", 42 - reference AS d FROM ix WHERE reference <= 42), near AS (SELECT block_id, "start", "end" FROM q WHERE slot = (d >> CAST(8 * {_SLOT} AS BIGINT)) + 256 * {_SLOT})"""


def _li(fn):
    return lambda spark, sf_dir: fn(_blocks(spark, sf_dir))


def _scalar(name, columns, sql):
    """A query of scalar functions: the key columns and (alias, Column) pairs against their SQL."""
    return {name: (_li(lambda df: df.select(*W.KEYS, *(c.alias(a) for a, c in columns().items()))), f"WITH {_DOMAIN} SELECT {_KEYS}, {sql} FROM li")}


def _segment_io(spark, sf_dir):
    """Write block files in a folder of this run and read them again."""
    rows = lineitem(spark, sf_dir).select(*W.KEYS, "ship_d", "price_cents")
    store = BlockStore.create(rows, scratch_path(spark, "segments"), ("ship_d", *W.KEYS), ("ship_d", "price_cents"), capacity=CAPACITY)
    return read_blocks(spark, f"{store.path}/blocks").where(_ship_year().column()).select(*W.KEYS, "ship_d", "price_cents")


CATALOG: dict[str, tuple] = {
    **_on("p_eq_int", "lineitem", [Eq("l_suppkey", 42)], W.KEYS, "l_suppkey = 42"),
    **_on("p_gt_int", "lineitem", [Gt("l_suppkey", 90)], W.KEYS, "l_suppkey > 90"),
    **_on("p_lt_int", "lineitem", [Lt("quantity", 3)], W.KEYS, "quantity < 3"),
    **_on("p_between_int", "lineitem", [Between("discount_pct", 5, 7)], W.KEYS, "discount_pct BETWEEN 5 AND 7"),
    **_on("p_eq_str", "orders", [Eq("o_orderpriority", "1-URGENT")], ("o_orderkey",), "o_orderpriority = '1-URGENT'"),
    **_on("p_gt_str", "customer", [Gt("c_mktsegment", "FURNITURE")], ("c_custkey", "c_mktsegment"), "c_mktsegment > 'FURNITURE'"),
    **_on("p_lt_str", "customer", [Lt("c_mktsegment", "BUILDING0")], ("c_custkey", "c_mktsegment"), "c_mktsegment < 'BUILDING0'"),
    **_on("p_between_str", "part", [Between("p_type", "E", "PROMO")], ("p_partkey", "p_type"), "p_type BETWEEN 'E' AND 'PROMO'"),
    **_on("p_eq_str_absent", "customer", [Eq("c_mktsegment", "BUILDIN")], ("c_custkey",), "c_mktsegment = 'BUILDIN'"),
    **_on("p_empty_str", "customer", [Gt("c_mktsegment", "")], ("c_custkey",), "c_mktsegment > ''"),
    **_on("p_between_bounds", "lineitem", [Between("quantity", 7, 7)], W.KEYS, "quantity BETWEEN 7 AND 7"),
    **_on("p_between_reversed", "lineitem", [Between("quantity", 9, 7)], W.KEYS, "quantity BETWEEN 9 AND 7"),
    **_on("p_and_multi", "lineitem", SCAN, W.KEYS, _SCAN),
    **_on("p_and_same_col", "lineitem", [Gt("quantity", 5), Lt("quantity", 40), Between("quantity", 10, 20)], W.KEYS, "quantity > 5 AND quantity < 40 AND quantity BETWEEN 10 AND 20"),
    **_on("p_and_all_match", "lineitem", [Gt("quantity", 0), Lt("quantity", 1000)], W.KEYS, "quantity > 0 AND quantity < 1000"),
    **_on("p_none", "nation", [], ("n_nationkey", "n_name"), "true"),
    "p_single_value": (
        lambda spark, sf_dir: _blocks(spark, sf_dir).withColumn("one", F.lit(7)).where(conjunction([Between("one", 7, 9)])).select(*W.KEYS, "one"),
        f"SELECT {_KEYS}, 7 AS one FROM lineitem",
    ),
    "c_total": (lambda spark, sf_dir: _block_table(spark, sf_dir).count(SCAN), f"WITH {_DOMAIN} SELECT count(*) AS matches FROM li WHERE {_SCAN}"),
    "c_per_block": (lambda spark, sf_dir: _block_table(spark, sf_dir).block_counts(SCAN), f"WITH {_BLOCKS} SELECT block_id, count(CASE WHEN {_SCAN} THEN 1 END) AS matches FROM b GROUP BY block_id"),
    "c_positions": (lambda spark, sf_dir: _block_table(spark, sf_dir).positions(SCAN), f"WITH {_BLOCKS} SELECT block_id, pos FROM b WHERE {_SCAN}"),
    "c_block_scan": (lambda spark, sf_dir: _block_table(spark, sf_dir).scan_block(1, SCAN).select("block_id", "pos"), f"WITH {_BLOCKS} SELECT block_id, pos FROM b WHERE block_id = 1 AND {_SCAN}"),
    "c_selection_vector": (
        lambda spark, sf_dir: _block_table(spark, sf_dir).selection_vectors(SCAN).select("block_id", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions")),
        f"WITH {_BLOCKS} SELECT block_id, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM b WHERE {_SCAN} GROUP BY block_id",
    ),
    "j_single": (lambda spark, sf_dir: _block_table(spark, sf_dir).materialize(SCAN, "price_cents"), f"WITH {_BLOCKS} SELECT block_id, pos, price_cents FROM b WHERE {_SCAN}"),
    "j_multi": (lambda spark, sf_dir: _block_table(spark, sf_dir).materialize(SCAN, "price_cents", "quantity", "l_returnflag"), f"WITH {_BLOCKS} SELECT block_id, pos, price_cents, quantity, l_returnflag FROM b WHERE {_SCAN}"),
    "j_late": (_late, f"WITH {_BLOCKS} SELECT block_id, pos, price_cents, l_returnflag FROM b WHERE {_SCAN}"),
    "s_append": (_append, f"WITH {_BLOCKS}, n AS (SELECT max(block_id) + 1 AS k FROM b), two AS (SELECT block_id, pos FROM b UNION ALL SELECT block_id + k, pos FROM b, n) SELECT block_id, count(*) AS tuple_count, max(pos) AS last_pos FROM two GROUP BY block_id"),
    "s_segment_io": (_segment_io, f"WITH {_DOMAIN} SELECT {_KEYS}, ship_d, price_cents FROM li WHERE ship_d BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'"),
    "s_cluster": (lambda spark, sf_dir: _meta(spark, sf_dir).select("block_id", F.col("min_ship_d").alias("first_d"), F.col("max_ship_d").alias("last_d")), f"WITH {_BLOCKS} SELECT block_id, min(ship_d) AS first_d, max(ship_d) AS last_d FROM b GROUP BY block_id"),
    "s_split": (
        lambda spark, sf_dir: table(spark, sf_dir, "customer").select("c_custkey", F.array_join(S.split_fields(F.concat_ws("|", "c_name", "c_mktsegment", F.lit("")), "|"), ";").alias("fields")),
        "SELECT c_custkey, c_name || ';' || c_mktsegment AS fields FROM customer",
    ),
    "m_sma": (lambda spark, sf_dir: stats.sma(_meta(spark, sf_dir), INTS), _sma_sql()),
    "m_encoding": (lambda spark, sf_dir: stats.encodings(_meta(spark, sf_dir), INTS), _sma_sql(f', {_encoding_sql("(max - min)")} AS encoding, {_width_sql("(max - min)")} AS width')),
    "m_for_encode": (lambda spark, sf_dir: stats.frame_of_reference(_blocks(spark, sf_dir), _meta(spark, sf_dir), "price_cents").select("block_id", "pos", "reference", "delta"), f"WITH {_BLOCKS} SELECT block_id, pos, min(price_cents) OVER (PARTITION BY block_id) AS reference, price_cents - min(price_cents) OVER (PARTITION BY block_id) AS delta FROM b"),
    "m_for_decode": (lambda spark, sf_dir: stats.from_reference(stats.frame_of_reference(_blocks(spark, sf_dir), _meta(spark, sf_dir), "price_cents")).select("block_id", "pos", "value"), f"WITH {_BLOCKS} SELECT block_id, pos, price_cents AS value FROM b"),
    "m_dict": (lambda spark, sf_dir: stats.dictionary(_blocks(spark, sf_dir), "l_returnflag"), f"WITH {_BLOCKS}, d AS (SELECT DISTINCT block_id, l_returnflag AS value FROM b) SELECT block_id, value, CAST(row_number() OVER (PARTITION BY block_id ORDER BY value) - 1 AS INT) AS code FROM d"),
    "m_dict_encode": (lambda spark, sf_dir: stats.dictionary_encode(_blocks(spark, sf_dir), "l_returnflag").select("block_id", "pos", "code"), f"WITH {_BLOCKS} SELECT block_id, pos, CAST(dense_rank() OVER (PARTITION BY block_id ORDER BY l_returnflag) - 1 AS INT) AS code FROM b"),
    "m_dict_decode": (_dict_decode, f"WITH {_BLOCKS} SELECT block_id, pos, l_returnflag AS value FROM b"),
    "m_dict_lists": (_dict_lists, f"WITH {_BLOCKS}, d AS (SELECT DISTINCT block_id, l_returnflag AS v FROM b) SELECT block_id, string_agg(v, '|' ORDER BY v) AS entries FROM d GROUP BY block_id"),
    "m_dict_lookup": (lambda spark, sf_dir: stats.lookup(stats.dictionary(_blocks(spark, sf_dir), "l_returnflag"), "R"), f"WITH {_BLOCKS}, d AS (SELECT DISTINCT block_id, l_returnflag AS value FROM b), c AS (SELECT block_id, value, CAST(row_number() OVER (PARTITION BY block_id ORDER BY value) - 1 AS INT) AS code FROM d) SELECT block_id, code FROM c WHERE value = 'R'"),
    "m_size": (lambda spark, sf_dir: stats.size_report(_meta(spark, sf_dir), INTS, STRINGS), _size_sql()),
    "m_accessors": (
        lambda spark, sf_dir: stats.accessors(_blocks(spark, sf_dir).select("block_id", "pos", *INTS), _meta(spark, sf_dir), CAPACITY),
        f"WITH {_BLOCKS} SELECT block_id, count(*) AS tuple_count, count(*) = 0 AS is_empty, count(*) = {CAPACITY} AS is_full, {len(INTS)} AS column_count FROM b GROUP BY block_id",
    ),
    "m_prune": (lambda spark, sf_dir: stats.prune_report(_meta(spark, sf_dir), [_ship_year()]), _prune_sql()),
    "m_pruned_count": (_pruned, f"WITH {_DOMAIN} SELECT count(*) AS matches FROM li WHERE ship_d BETWEEN DATE '1996-01-01' AND DATE '1996-12-31'"),
    "psma_slot": (
        lambda spark, sf_dir: psma.with_slot(_blocks(spark, sf_dir), _meta(spark, sf_dir), "l_suppkey").select("block_id", "pos", "slot"),
        f"WITH {_PSMA} SELECT block_id, pos, slot FROM sl",
    ),
    "psma_build": (lambda spark, sf_dir: psma.build(_blocks(spark, sf_dir), _meta(spark, sf_dir), "l_suppkey"), f"WITH {_PSMA} SELECT * FROM ix"),
    "psma_lookup": (_psma_lookup, f"WITH {_LOOKUP} SELECT * FROM near"),
    "psma_search": (_psma_search, f"WITH {_BLOCKS} SELECT block_id, pos FROM b WHERE l_suppkey = 42"),
    "q1_leg": (_leg(W.q1_leg), f"WITH {_DOMAIN} SELECT {_KEYS}, discount_pct, price_cents, l_returnflag, l_linestatus, quantity FROM li WHERE ship_d < DATE '1998-09-02'"),
    "q6_leg": (_leg(W.q6_leg), f"WITH {_DOMAIN} SELECT {_KEYS}, discount_pct, price_cents FROM li WHERE ship_d BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AND discount_pct BETWEEN 5 AND 7 AND quantity < 24"),
    "q6_sweep": (
        _leg(W.q6_sweep),
        f"WITH {_DOMAIN} "
        + " UNION ALL ".join(
            [f"SELECT 'shipdate>={m:02d}' AS step, count(*) AS matches FROM li WHERE ship_d BETWEEN DATE '1996-{m:02d}-01' AND DATE '1996-12-31'" for m in range(1, 13)]
            + [f"SELECT 'discount {a}..{b}' AS step, count(*) AS matches FROM li WHERE discount_pct BETWEEN {a} AND {b}" for a, b in ((5, 7), (6, 7), (5, 6))]
            + [f"SELECT 'quantity<{n}' AS step, count(*) AS matches FROM li WHERE quantity < {n}" for n in (24, 5, 2)]
        ),
    ),
    "q7_leg": (_leg(W.q7_leg), f"WITH {_DOMAIN} SELECT {_KEYS}, discount_pct, price_cents FROM li WHERE ship_d BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'"),
    "q12_leg_subst": (_leg(W.q12_leg), f"WITH {_DOMAIN} SELECT {_KEYS}, ship_d FROM li WHERE ship_d BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AND l_returnflag = 'R'"),
    "nation_lookup": (W.nation_lookup, "SELECT n_nationkey, n_name FROM nation WHERE n_name = 'NATION_7'"),
    "x_q1_full": (_leg(W.q1_full), f"WITH {_DOMAIN} SELECT l_returnflag, l_linestatus, CAST(sum(quantity) AS BIGINT) AS sum_qty, CAST(sum(price_cents) AS BIGINT) AS sum_base_cents, CAST(sum(price_cents * (100 - discount_pct)) AS BIGINT) AS sum_disc_units, count(*) AS count_order FROM li WHERE ship_d < DATE '1998-09-02' GROUP BY ALL"),
    "x_q6_full": (_leg(W.q6_full), f"WITH {_DOMAIN} SELECT CAST(coalesce(sum(price_cents * discount_pct), 0) AS BIGINT) AS revenue_units FROM li WHERE ship_d BETWEEN DATE '1996-01-01' AND DATE '1996-12-31' AND discount_pct BETWEEN 5 AND 7 AND quantity < 24"),
    **_scalar(
        "f_int",
        lambda: {"added": S.int_add(F.col("l_orderkey"), F.lit(2147483647)), "less": S.int_sub(F.col("l_partkey"), F.col("l_suppkey")), "product": S.int_mul(F.col("l_orderkey"), F.lit(65536 * 17)), "remainder": S.modulo(-F.col("l_partkey"), 7)},
        "CAST(((l_orderkey + 2147483647 + 2147483648) & 4294967295) - 2147483648 AS INT) AS added, CAST(l_partkey - l_suppkey AS INT) AS less, CAST(((l_orderkey * 1114112 + 2147483648) & 4294967295) - 2147483648 AS INT) AS product, (-l_partkey) % 7 AS remainder",
    ),
    **_scalar(
        "f_parse",
        lambda: {"whole": S.parse_int(F.concat(F.lit("  -"), F.col("quantity").cast("string"), F.lit(".75 "))), "bad": S.parse_int(F.col("l_returnflag")), "num": S.parse_numeric(F.concat(F.col("quantity").cast("string"), F.lit(".2500")), 12, 2)},
        "CAST(-quantity AS INT) AS whole, CAST(NULL AS INT) AS bad, CAST(quantity + 0.25 AS DECIMAL(12,2)) AS num",
    ),
    **_scalar(
        "f_text",
        lambda: {"trimmed": S.char_value(F.concat(F.lit("  "), "l_returnflag", F.lit(" "))), "first": S.char1(F.col("l_linestatus")), "prefix": S.prefix_equal(F.col("l_returnflag"), F.lit("RAIL")), "n": F.length("l_returnflag")},
        "l_returnflag || ' ' AS trimmed, l_linestatus[1:1] AS first, starts_with('RAIL', l_returnflag) AS prefix, CAST(length(l_returnflag) AS INT) AS n",
    ),
    **_scalar(
        "f_decimal_mul",
        lambda: {"product": S.numeric_mul(F.col("l_extendedprice").cast("decimal(9,2)"), F.col("l_discount").cast("decimal(9,2)")).cast("decimal(18,4)"), "total": S.numeric_add(F.col("l_discount").cast("decimal(12,2)"), F.col("l_tax").cast("decimal(12,2)"), 12, 2)},
        "CAST(CAST(l_extendedprice AS DECIMAL(9,2)) * CAST(l_discount AS DECIMAL(9,2)) AS DECIMAL(18,4)) AS product, CAST(CAST(l_discount AS DECIMAL(12,2)) + CAST(l_tax AS DECIMAL(12,2)) AS DECIMAL(12,2)) AS total",
    ),
    **_scalar("f_decimal_div_trunc", lambda: {"third": S.truncating_div("-price_cents", "3"), "ratio": S.truncating_div("price_cents * 100", "quantity * 100")}, "-(price_cents // 3) AS third, (price_cents * 100) // (quantity * 100) AS ratio"),
    **_scalar("f_scale_cast", lambda: {"up": S.scale_up(F.col("price_cents"), 2), "down": S.scale_down("price_cents", 1), "down2": S.scale_down("price_cents", 2)}, "price_cents * 100 AS up, price_cents // 10 AS down, price_cents // 100 AS down2"),
    **_scalar("f_year", lambda: {"y": S.extract_year(F.col("ship_d")), "jd": S.julian_day(F.col("ship_d"))}, "CAST(year(ship_d) AS INT) AS y, CAST(date_diff('day', DATE '1970-01-01', ship_d) + 2440588 AS INT) AS jd"),
    **_scalar("f_date_code", lambda: {"day_no": S.ship_day(F.col("ship_d")), "flight": S.flight_day(F.col("ship_d"))}, "CAST(date_diff('day', DATE '1991-12-31', ship_d) AS INT) AS day_no, CAST(404 * year(ship_d) + 32 * month(ship_d) + day(ship_d) AS INT) AS flight"),
    **_scalar("f_pack", lambda: {"packed": S.pack_chars(F.concat("l_returnflag", "l_linestatus"))}, "CAST(ord(l_returnflag) * 256 + ord(l_linestatus) AS BIGINT) AS packed"),
    **_scalar(
        "f_tid",
        lambda: {"tid": S.tid_pack(F.col("l_orderkey"), F.col("l_suppkey")), "page": S.tid_page(S.tid_pack(F.col("l_orderkey"), F.col("l_suppkey"))), "slot": S.tid_slot(S.tid_pack(F.col("l_orderkey"), F.col("l_suppkey"))), "pid": S.pid_pack(F.col("l_linenumber"), F.col("l_orderkey")), "segment": S.pid_segment(S.pid_pack(F.col("l_linenumber"), F.col("l_orderkey")))},
        "l_orderkey * 65536 + l_suppkey AS tid, l_orderkey AS page, l_suppkey AS slot, CAST(l_linenumber AS BIGINT) * 281474976710656 + l_orderkey AS pid, CAST(l_linenumber AS BIGINT) AS segment",
    ),
    "f_hash": (
        _li(lambda df: df.select(*W.KEYS, S.hash_number(F.col("l_orderkey")).alias("h"), S.hash_key(S.hash_number(F.col("l_orderkey")), S.hash_number(F.col("l_linenumber"))).alias("hk"))),
        f"SELECT {_KEYS}, {unsigned.signed_sql(unsigned.hash_sql('l_orderkey'))} AS h, xor({unsigned.signed_sql(unsigned.hash_sql('l_orderkey'))}, {unsigned.signed_sql(unsigned.hash_sql('l_linenumber'))}) AS hk FROM lineitem",
    ),
    "f_hash_text": (
        _li(lambda df: df.select(*W.KEYS, S.hash_text(F.concat_ws("-", "l_returnflag", "l_partkey", "l_linestatus")).alias("h"), S.hash_text(F.lit("")).alias("none"))),
        f"""WITH s AS (SELECT {_KEYS}, concat_ws('-', l_returnflag, l_partkey, l_linestatus) AS t FROM lineitem)
SELECT {_KEYS}, list_reduce(list_prepend(0::BIGINT, list_transform(range(1, length(t) + 1), lambda i: CAST(ord(t[i]) AS BIGINT))), lambda h, b: xor(((h * 32) & 4294967295) | (h >> 27), b)) AS h, 0::BIGINT AS none FROM s""",
    ),
    **_scalar(
        "f_timestamp",
        lambda: {"at": S.print_timestamp(S.timestamp_of(F.col("l_orderkey") * 86_400_123)), "later": S.timestamp_of(F.col("l_orderkey") * 1000) < S.timestamp_of(F.col("l_orderkey") * 1000 + 1)},
        "strftime(make_timestamp(l_orderkey * 86400123 * 1000), '%Y-%m-%d %H:%M:%S.%g') AS at, true AS later",
    ),
    **_scalar(
        "f_date",
        lambda: {"parsed": S.parse_date(S.print_date(F.col("ship_d"))), "bad": S.parse_date(F.concat(F.year("ship_d").cast("string"), F.lit("-02-31"))), "printed": S.print_date(F.col("ship_d"))},
        "ship_d AS parsed, CAST(NULL AS DATE) AS bad, strftime(ship_d, '%Y-%m-%d') AS printed",
    ),
    **_scalar(
        "f_page_id",
        lambda: {"page_id": S.tid_page_id(S.tid_pack(F.col("l_orderkey"), F.col("l_suppkey")), F.col("l_linenumber")), "page": S.pid_page(S.pid_pack(F.col("l_linenumber"), F.col("l_orderkey")))},
        "l_orderkey + CAST(l_linenumber AS BIGINT) * 281474976710656 AS page_id, l_orderkey AS page",
    ),
    "m_offsets": (lambda spark, sf_dir: stats.column_offsets(_meta(spark, sf_dir), INTS, STRINGS), _offsets_sql()),
    **formats.CATALOG,
    **unsigned.CATALOG,
}


def queries() -> dict:
    return {name: run for name, (run, _) in CATALOG.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOG.items() if sql}
