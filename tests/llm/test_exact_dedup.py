import hashlib
import re

import pytest
from oracle import assert_same
from pyspark.sql import functions as F

from slabscan.llm import queries
from slabscan.llm.common import CHUNK_ROWS, in_files, places, without_rows
from slabscan.llm.exact_dedup import BLOCK_BITS, RepeatFilter, digest_of, exact_dedup, keep_first

ROWS = [(1, "a b"), (2, "a \t b"), (3, None), (4, ""), (5, "x" * 200_000), (6, "a b"), (6, "a b"), (None, "a  b"), (None, "only"), (8, "ab"), (9, "a b")]


def brute(rows):
    groups = {}
    for i, (k, t) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append((k is None, k or 0, i, k))
    out = []
    for t, members in groups.items():
        first = min(members)
        out += [(m[3], first[3], len(members), m is first, hashlib.sha256(t.encode()).hexdigest()) for m in sorted(members)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("limit", [64 << 20, 0])
def test_cases(spark, limit):
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in ROWS], "doc_id long, text string, _id int, digest string, _metadata int").repartition(3)
    got = sorted((tuple(r) for r in exact_dedup(docs, max_broadcast_bytes=limit).collect()), key=repr)
    assert got == brute(ROWS)
    kept = keep_first(docs, max_broadcast_bytes=limit)
    assert kept.columns == docs.columns
    assert sorted(repr(r.doc_id) for r in kept.collect()) == sorted(repr(r[0]) for r in brute(ROWS) if r[3])


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup(docs).collect() == [] and keep_first(docs).collect() == []


def test_same_as_sql(spark):
    sf = "/root/testdata/sf0.01"
    assert_same(queries.op9_exact_dedup(spark, sf), queries.OP9_SQL, sf)


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.split("\n") if re.search(r"\bExchange\b", line) and "BroadcastExchange" not in line]


def test_documents_never_shuffle(spark, tmp_path):
    """Beyond the broadcast limit the filter and the flags go in several passes, and no document is exchanged."""
    spark.range(0, 3000, 1, 4).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 2500).cast("string")).alias("text")).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    digests = docs.select(F.col("doc_id").alias("_id"), digest_of(F.col("text")))
    repeats = RepeatFilter(digests, 3000, max_broadcast_bytes=BLOCK_BITS // 8)
    assert repeats.passes == 3
    flagged = repeats.flagged()
    assert exchanges(flagged) == []
    told = {r._id: r.maybe_repeated for r in flagged.collect()}
    assert len(told) == 3000 and all(told[i] for i in [*range(500), *range(2500, 3000)]) and sum(told.values()) < 1100
    kept = keep_first(docs, max_broadcast_bytes=BLOCK_BITS // 8)
    assert exchanges(kept) == []
    assert sorted(r.doc_id for r in kept.collect()) == list(range(2500))


def test_rows_are_dropped_by_place(spark, tmp_path):
    n = 2 * CHUNK_ROWS + 7
    spark.range(0, n, 1, 1).write.parquet(str(tmp_path / "a"))
    spark.range(n, n + 100, 1, 3).write.mode("append").parquet(str(tmp_path / "a"))
    df = in_files(spark.read.parquet(str(tmp_path / "a")))
    bad = {0, 1, 7, 8, CHUNK_ROWS - 1, CHUNK_ROWS, 2 * CHUNK_ROWS + 6, n, n + 99}
    dropped = df.where(F.col("id").isin(list(bad))).select(*places(df))
    for limit in (1 << 20, 4096):
        assert {r.id for r in without_rows(df, dropped, limit).collect()} == set(range(n + 100)) - bad
    assert without_rows(df, dropped.limit(0)).count() == n + 100
