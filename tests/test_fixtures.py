"""Literal and random fixtures: counts, positions and values against plain Python."""

import pytest
from pyspark.sql import functions as F

from slabscan.functions.scalars import XorShift64
from slabscan.operators import psma, stats
from slabscan.operators.scan import BlockTable
from slabscan.predicate import Between, Eq, Gt, Lt, conjunction
from slabscan.sources.blocks import BlockStore
from slabscan.types import U64_MAX, Unsigned, signed_bits, u64, unsigned

TEN = [(3, 16, 257, 20), (2, 32, 257, 40), (1, 30, 257, 16), (4, 40, 257, 32), (5, 50, 257, 48), (6, 60, 257, 256), (7, 70, 257, 128), (8, 80, 257, 64), (9, 90, 257, 16), (70000, 257, 257, 257)]
MODES = ("RAIL", "SHIP", "MAIL", "TRUCK", "FOB", "REG AIR", "AIR")
HOLDS = {Eq: lambda v, p: v == p.value, Gt: lambda v, p: v > p.value, Lt: lambda v, p: v < p.value, Between: lambda v, p: p.low <= v <= p.high}


def holds(row, predicates):
    return all(HOLDS[type(p)](row[p.name], p) for p in predicates)


def random_numbers(n):
    g = XorShift64()
    return [g.next() for _ in range(n)]


def table_of(spark, rows, schema):
    """Rows in their order as one block."""
    return spark.createDataFrame([(0, i, *r) for i, r in enumerate(rows)], f"block_id long, pos int, {schema}")


def u64_table(spark, columns):
    texts = [tuple(map(str, r)) for r in zip(*columns, strict=True)]
    names = [f"c{i}" for i in range(len(columns))]
    df = table_of(spark, texts, ", ".join(f"{c} string" for c in names))
    return df.select("block_id", "pos", *(F.col(c).cast("decimal(20,0)").alias(c) for c in names))


def check(df, rows, cases, positions=3):
    """Counts of all cases in one pass, and the positions of some of them."""
    got = df.agg(*(F.count(F.when(conjunction(case), 1)).alias(f"n{i}") for i, case in enumerate(cases))).first()
    want = [sum(holds(r, case) for r in rows) for case in cases]
    assert list(got) == want
    for case in cases[:positions]:
        found = sorted(r.pos for r in BlockTable(df).positions(case).collect())
        assert found == [i for i, r in enumerate(rows) if holds(r, case)]


def test_ten_rows(spark):
    one = table_of(spark, [(r[0],) for r in TEN[:9]] + [(15,)], "c0 long")
    assert BlockTable(one).count([Eq("c0", 257)]).first().matches == 0
    assert BlockTable(one).count().first().matches == 10
    four = table_of(spark, TEN, "c0 long, c1 long, c2 long, c3 long")
    names = [f"c{i}" for i in range(4)]
    meta = stats.block_meta(four, names)
    assert {r.column: r.encoding for r in stats.encodings(meta, names).collect()} == {"c0": "Byte4", "c1": "Byte1", "c2": "Singlevalue", "c3": "Byte1"}
    rows = [dict(zip(names, r, strict=True)) for r in TEN]
    # A constant column under an inclusive range, predicates that all rows pass, repeats of a column, and reversed bounds.
    cases = [[Between("c2", 257, 300)], [Gt("c0", 0), Lt("c1", 1000)], [Eq("c2", 257)], [], [Between("c0", 1, 70000), Between("c0", 4, 8), Gt("c0", 5)], [Between("c1", 90, 16)], [Between("c0", 2, 70000)], [Lt("c0", 70000), Gt("c3", 16)]]
    check(four, rows, cases, len(cases))
    assert {r.verdict for r in stats.prune_report(meta, [Gt("c0", 70000)]).collect()} == {"NONE"}
    assert {r.verdict for r in stats.prune_report(meta, [Gt("c0", 0), Between("c2", 257, 257)]).collect()} == {"ALL"}
    assert BlockTable(four).materialize([Eq("c2", 257)], "c0").count() == 10


def test_slots(spark):
    found = spark.range(1).select(psma.slot(F.lit(5).cast("bigint")).alias("a"), psma.slot(F.lit(996).cast("bigint")).alias("b"), psma.slot(signed_bits(u64(U64_MAX))).alias("c")).first()
    assert tuple(found) == (5, 259, 255 + 256 * 7)
    values = [1024, 2048, 256, 42, 100, 200, 300, 400, 500, 600]
    df = table_of(spark, [(v,) for v in values], "c0 long")
    index = psma.build(df, stats.block_meta(df, ["c0"]), "c0")
    for i, v in enumerate(values):
        near = psma.lookup(index, v).first()
        assert near.start <= i < near.end
        assert [r.pos for r in psma.search(df, index, "c0", v).collect()] == [i]
    assert psma.lookup(index, 7).collect() == []


@pytest.mark.parametrize("shift", [56, 48, 32])
@pytest.mark.parametrize("n", [1 << 8, 1 << 16])
def test_random_widths(spark, shift, n):
    values = [v >> shift for v in random_numbers(n)]
    df = table_of(spark, [(v,) for v in values], "c0 long")
    some = values[:: max(1, n // 8)][:8] + [random_numbers(n + 1)[-1] >> shift]
    cases = [[f("c0", v)] for f in (Eq, Gt, Lt) for v in some] + [[Between("c0", min(p), max(p))] for p in zip(some, reversed(some), strict=True)]
    cases += [[Lt("c0", max(some)), Gt("c0", min(some)), Between("c0", some[0], max(values))]]
    check(df, [{"c0": v} for v in values], cases)


def test_unsigned_domain(spark):
    n = 1 << 12
    values = [U64_MAX, 0, 1 << 63, (1 << 63) - 1, *random_numbers(n)]
    df = u64_table(spark, [values])
    some = [Unsigned(v) for v in values[:6]]
    cases = [[f("c0", v)] for f in (Eq, Gt, Lt) for v in some] + [[Between("c0", min(p), max(p))] for p in zip(some, some[1:], strict=False)]
    check(df, [{"c0": v} for v in values], cases, len(cases))
    meta = stats.block_meta(df, ["c0"])
    got = stats.encodings(meta, ["c0"]).first()
    assert (int(got.min), int(got.max), got.encoding) == (0, U64_MAX, "Byte8")
    assert stats.size_report(meta, ["c0"]).first().data_bytes == 32 + 8 * len(values)
    back = stats.from_reference(stats.frame_of_reference(df, meta, "c0"))
    assert {r.pos: int(r.value) for r in back.select("pos", "value").collect()} == dict(enumerate(values))
    index = psma.build(df, meta, "c0")
    for v in values[:4]:
        assert [r.pos for r in psma.search(df, index, "c0", v).collect()] == [values.index(v)]
    bits = df.select("c0", unsigned(signed_bits(F.col("c0"))).alias("again"))
    assert bits.where("c0 != again").count() == 0


def test_several_unsigned_columns(spark):
    n = 1 << 12
    numbers = random_numbers(4 * n + 4)
    columns = [numbers[i * n : (i + 1) * n] for i in range(4)]
    rows = [{f"c{i}": c[k] for i, c in enumerate(columns)} for k in range(n)]
    r = [Unsigned(v) for v in numbers[-4:]]
    cases = [[Lt("c0", r[0]), Eq("c1", r[1]), Gt("c2", r[2]), Lt("c3", r[3])], [Lt("c0", r[0]), Lt("c1", r[1]), Gt("c2", r[2]), Gt("c3", r[3])], [Lt("c0", r[0]), Gt("c3", r[3])]]
    check(u64_table(spark, columns), rows, cases)


def test_constant_column(spark):
    v = random_numbers(1)[0]
    df = u64_table(spark, [[v] * 1000])
    got = [BlockTable(df).count([p]).first().matches for p in (Eq("c0", Unsigned(v)), Gt("c0", Unsigned(v - 1)), Lt("c0", Unsigned(v + 1)), Gt("c0", Unsigned(v + 1)), Lt("c0", Unsigned(v - 1)))]
    assert got == [1000, 1000, 1000, 0, 0]
    assert stats.encodings(stats.block_meta(df, ["c0"]), ["c0"]).first().encoding == "Singlevalue"


def test_strings(spark):
    values = [MODES[v % 7] for v in random_numbers(1 << 12)]
    df = table_of(spark, [(v,) for v in values], "s0 string")
    some = [*MODES, "AIR MAIL", "", "ZZZ", "AI"]
    cases = [[f("s0", v)] for f in (Eq, Gt, Lt) for v in some] + [[Between("s0", min(p), max(p))] for p in zip(some, reversed(some), strict=True)]
    check(df, [{"s0": v} for v in values], cases, 8)
    codes = {r.s0: r.code for r in stats.dictionary_encode(df, "s0").select("s0", "code").distinct().collect()}
    assert codes == {v: i for i, v in enumerate(sorted(MODES))}


def test_hot_order_value(spark, tmp_path):
    """A block table of a constant leading key has full blocks, and ranks as a sort gives them."""
    rows = [(7 if i % 3 else i, (i * 7919) % 30_011) for i in range(30_000)]
    df = spark.createDataFrame(rows, "k long, v long").repartition(5)
    store = BlockStore.create(df, str(tmp_path / "t"), ("k", "v"), ("k", "v"), capacity=1000)
    got = {(r.block_id, r.pos): (r.k, r.v) for r in store.blocks.collect()}
    assert got == {(i // 1000, i % 1000): r for i, r in enumerate(sorted(rows))}
    assert sorted((r.block_id, r.tuple_count) for r in store.meta.collect()) == [(i, 1000) for i in range(30)]
    store.drop()
    assert not (tmp_path / "t").exists()


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "k long, v long")
    store = BlockStore.create(df, str(tmp_path / "e"), ("k",), ("k",), capacity=10)
    assert store.blocks.count() == 0 and store.meta.count() == 0
    assert BlockTable(store.blocks).count([Gt("k", 1)]).first().matches == 0
    assert stats.pruned_count(store.blocks, stats.prune_report(store.meta, [Gt("k", 1)]), [Gt("k", 1)]).first().matches == 0
