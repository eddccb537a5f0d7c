"""Exact dedup with two passes over a Bloom filter, in DataFrame functions only.

Pass one sets, for each text hash, a few positions of the filter and keeps the
positions that two or more rows set.  Pass two tests each row: if any of its
positions was set once only, its text occurs once, and the row passes straight
through.  Only the other rows' hashes shuffle to their group, and never a text.

The filter has ``bits_per_row`` bits for each row and holds only repeated
positions, in blocks of 32768 bits.  It is broadcast; while its full size is
above ``max_broadcast_bytes``, the hashes are written by ranges of blocks and
each range is tested in a pass of its own, which reads only its own hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slabscan.llm.common import bit_is_set, in_files, places, stored, without_rows

BLOCK_BITS = 32768
HASHES = 2
BITS_PER_ROW = 32
MAX_BROADCAST_BYTES = 64 << 20


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null is empty."""
    one = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     ")
    return F.regexp_replace(one, " {2,}", " ")


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256)).alias("digest")


def _number(digest: str, start: int, size: int) -> Column:
    return F.conv(F.hex(F.substring(digest, start, size)), 16, 10).cast("bigint")


def _block(digest: str, blocks: int) -> Column:
    return _number(digest, 1, 7) % blocks


def _position(digest: str, i: int) -> Column:
    """One of the digest's positions inside its block, from bytes that choose nothing else."""
    return _number(digest, 9 + 4 * i, 4) % BLOCK_BITS


def repeated_filter(digests: DataFrame, blocks: int) -> DataFrame:
    """(_block, _bits) of the positions that two or more rows set; ``digests`` has the column ``digest``."""
    start = _block("digest", blocks) * BLOCK_BITS
    set_by = digests.select(F.explode(F.array_distinct(F.array(*(start + _position("digest", i) for i in range(HASHES))))).alias("_place"))
    twice = set_by.groupBy("_place").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    bit = F.bitmap_bit_position(F.col("_place") % BLOCK_BITS + 1)
    return twice.groupBy(F.expr(f"_place div {BLOCK_BITS}").alias("_block")).agg(F.bitmap_construct_agg(bit).alias("_bits"))


class RepeatFilter:
    """The filter of a table of digests: ``stored`` has them by ranges of blocks, ``flagged`` adds ``maybe_repeated``."""

    def __init__(self, digests: DataFrame, rows: int, bits_per_row: int = BITS_PER_ROW, max_broadcast_bytes: int = MAX_BROADCAST_BYTES):
        self.blocks = max(1, -(-rows * bits_per_row // BLOCK_BITS))
        self.passes = max(1, -(-self.blocks * (BLOCK_BITS // 8) // max(max_broadcast_bytes, BLOCK_BITS // 8)))
        if self.passes > 1:
            ranged = digests.withColumn("_range", self._range(_block("digest", self.blocks)))
            self.digests = stored(ranged, partition_by="_range")
        else:
            self.digests = stored(digests)
        self.bitmaps = stored(repeated_filter(self.digests, self.blocks))

    def _range(self, block: Column) -> Column:
        return F.floor(block * self.passes / self.blocks).cast("int")

    def flagged(self) -> DataFrame:
        """All digests, with ``maybe_repeated``: true for every one that occurs again, and for few others."""
        out = None
        for turn in range(self.passes):
            rows, bitmaps = self.digests, self.bitmaps
            if self.passes > 1:
                rows, bitmaps = rows.where(F.col("_range") == turn).drop("_range"), bitmaps.where(self._range(F.col("_block")) == turn)
            columns = rows.columns
            placed = rows.withColumns({"_block": _block("digest", self.blocks)} | {f"_bit{i}": _position("digest", i) for i in range(HASHES)})
            every = bit_is_set("_bits", "_bit0")
            for i in range(1, HASHES):
                every = every & bit_is_set("_bits", f"_bit{i}")
            tested = placed.join(F.broadcast(bitmaps), "_block", "left").select(*columns, F.coalesce(every, F.lit(False)).alias("maybe_repeated"))
            out = tested if out is None else out.unionByName(tested)
        return out


def _first() -> Column:
    """The row of a group that stays: the smallest id, a null id last, and one of several rows with it."""
    return F.min(F.struct(F.col("_id").isNull().alias("n"), F.col("_id").alias("id"), F.col("_row").alias("row"))).alias("_first")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Null text is empty text.  Of equal texts the row with the smallest id
    stays; a null id counts as larger than any other, so keep_id is null only
    when all ids of a group are.  Of rows that share that id, exactly one
    stays.  Very long texts are hashed whole.  An empty table gives no rows;
    other columns, whatever their names, are ignored.

    The digests, about 50 bytes a row, are written once; texts never shuffle.
    """
    digests = docs.select(F.col(id_col).alias("_id"), digest_of(F.col(text_col)), F.monotonically_increasing_id().alias("_row"))
    flagged = stored(RepeatFilter(digests, docs.count(), max_broadcast_bytes=max_broadcast_bytes).flagged())
    hexed = F.lower(F.hex("digest")).alias("text_sha256")
    once = flagged.where("not maybe_repeated").select(F.col("_id").alias(id_col), F.col("_id").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), F.lit(True).alias("kept"), hexed)
    again = flagged.where("maybe_repeated").select("_id", "digest", "_row")
    # A hot digest is one row of the written groups, so its many rows on the other side can be split as a skewed join.
    groups = stored(again.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), _first()))
    told = again.join(groups.hint("merge"), "digest").select(F.col("_id").alias(id_col), F.col("_first.id").alias("keep_id"), "group_size", (F.col("_row") == F.col("_first.row")).alias("kept"), hexed)
    return once.unionByName(told)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_broadcast_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """The rows that stay, with all their columns, by the rules of ``exact_dedup``.

    Only hashes shuffle, and only those that the filter doesn't clear; the
    rows to drop are told by their places in the files, so no document
    shuffles at any size.  A table that isn't read from files is written first.
    """
    docs = in_files(docs)
    digests = docs.select(docs[id_col].alias("_id"), digest_of(docs[text_col]), F.struct(*places(docs)).alias("_row"))
    again = RepeatFilter(digests, docs.count(), max_broadcast_bytes=max_broadcast_bytes).flagged().where("maybe_repeated").select("_id", "digest", "_row")
    again = stored(again)
    groups = stored(again.groupBy("digest").agg(F.count(F.lit(1)).alias("_n"), _first()).where("_n > 1").select("digest", F.col("_first.row").alias("_stays")))
    dropped = again.join(groups.hint("merge"), "digest").where("_row != _stays").select("_row.*")
    return without_rows(docs, dropped, max_broadcast_bytes)
