"""Shared storage for intermediate tables, and helpers that several operators use."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import re
import uuid

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _top(spark: SparkSession) -> str:
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        top = spark.conf.get("spark.sql.warehouse.dir")
    return f"{top.rstrip('/')}/slabscan-{spark.sparkContext.applicationId}"


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which every executor can read.

    Where it is unset, a session on one machine takes its warehouse, and any
    other is refused: a folder of one machine isn't seen by the others.
    """
    return f"{_top(spark)}/{uuid.uuid4().hex}"


def clear_shared(spark: SparkSession) -> None:
    """Delete all tables that this application has written; for when no result that reads them is needed any more."""
    drop_path(spark, _top(spark))


#: Bytes of an Arrow batch between the JVM and Python; two workers of an executor hold a few each.
BATCH_BYTES = 16 << 20
_UNITS = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's limit on the bytes of an Arrow batch to ``BATCH_BYTES``; a lower one stays.

    It holds for the session, as results are computed after the call that made them.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)\s*([a-z]*)", str(spark.conf.get(name)).strip().lower()).groups()
    now = int(number) * _UNITS[unit]
    if now < 0 or now > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def tidy(run):
    """A function of record batches that gives memory back once its task is done, as workers live on and wait beside the JVM."""

    def tidied(batches):
        yield from run(batches)
        POWERS.shrink()
        pa.default_memory_pool().release_unused()
        # Only glibc has it, and only there freed memory stays with the process.
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return tidied


#: The tables of the scopes that are open in this thread, innermost last.
_SCOPES: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("slabscan_scopes", default=())


def stored(df: DataFrame, path: str | None = None, partition_by: str | None = None) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends here, and a lost executor takes nothing along."""
    path = path or shared_dir(df.sparkSession)
    if scopes := _SCOPES.get():
        scopes[-1].append(path)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables written inside, by this thread, are deleted at the end, but for those given to the function that it yields."""
    kept: list[str] = []
    outer = _SCOPES.get()
    own: list[str] = []
    token = _SCOPES.set((*outer, own))
    try:
        yield lambda *tables: kept.extend(t._stored_at for t in tables)
    finally:
        _SCOPES.reset(token)
        for path in own:
            if path not in kept:
                drop_path(spark, path)
        if outer:
            outer[-1].extend(kept)


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of a file whose flags are one bitmap, which the bitmap functions fix at 4 KiB.
CHUNK_ROWS = 32768
#: Bytes of flags that are broadcast at once.
FLAG_BYTES = 64 << 20


def in_files(df: DataFrame) -> DataFrame:
    """The table itself if its rows have places in files, or else a stored copy of it."""
    try:
        df.select(df.metadataColumn("_metadata")["row_index"])
        return df
    except AnalysisException:
        return stored(df)


def places(df: DataFrame) -> list[Column]:
    """``_file`` and ``_at`` of each row of a table in files: they name the row in every run."""
    hidden = df.metadataColumn("_metadata")
    return [hidden["file_path"].alias("_file"), hidden["row_index"].alias("_at")]


def _at_places(df: DataFrame, marked: DataFrame, hit: bool, columns: list[Column], max_bytes: int) -> DataFrame:
    """``columns``, ``_file`` and ``_at`` of the rows whose places are among ``marked``, or aren't; no row of ``df`` shuffles.

    The places become bitmaps of 32768 rows, one bit a row, which are broadcast
    while they take at most ``max_bytes``.  Larger sets are split by file into
    as many passes as needed, and each pass reads only its own files.
    """
    chunk = F.expr(f"_at div {CHUNK_ROWS}").alias("_chunk")
    bit = F.bitmap_bit_position(F.col("_at") % CHUNK_ROWS + 1)
    flags = stored(marked.select("_file", chunk, "_at").groupBy("_file", "_chunk").agg(F.bitmap_construct_agg(bit).alias("_bits")))
    passes = max(1, -(-flags.count() * (CHUNK_ROWS // 8) // max(max_bytes, CHUNK_ROWS // 8)))
    hidden = df.metadataColumn("_metadata")
    file, at = hidden["file_path"], hidden["row_index"]

    def one(turn: int) -> DataFrame:
        rows, own = df, flags
        if passes > 1:
            rows, own = rows.where(F.pmod(F.xxhash64(file), F.lit(passes)) == turn), own.where(F.pmod(F.xxhash64("_file"), F.lit(passes)) == turn)
        placed = rows.select(F.struct(*columns).alias("_row"), file.alias("_file"), at.alias("_at"), F.floor(at / CHUNK_ROWS).alias("_chunk"), (at % CHUNK_ROWS).alias("_bit"))
        joined = placed.join(F.broadcast(own), ["_file", "_chunk"], "inner" if hit else "left")
        is_marked = bit_is_set("_bits", "_bit")
        return joined.where(is_marked if hit else F.col("_bits").isNull() | ~is_marked).select("_row", "_file", "_at")

    out = one(0)
    for turn in range(1, passes):
        out = out.unionAll(one(turn))
    return out


def without_rows(df: DataFrame, dropped: DataFrame, max_bytes: int = FLAG_BYTES) -> DataFrame:
    """The rows of a table in files but for those at the places (_file, _at) of ``dropped``, without a shuffle."""
    return _at_places(df, dropped, False, [df[c] for c in df.columns], max_bytes).select("_row.*")


def rows_at(df: DataFrame, wanted: DataFrame, columns: list[Column], max_bytes: int = FLAG_BYTES) -> DataFrame:
    """``columns``, _file and _at of the rows of a table in files that are at the places of ``wanted``, without a shuffle."""
    return _at_places(df, wanted, True, columns, max_bytes).select("_row.*", "_file", "_at")


def bit_is_set(bitmap: str, bit: str) -> Column:
    """Whether a bitmap's bit, counted from 0, is set."""
    byte = F.conv(F.hex(F.expr(f"substring({bitmap}, cast({bit} div 8 as int) + 1, 1)")), 16, 10).cast("int")
    return byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (F.col(bit) % 8).cast("int"))) != 0


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Two columns that tell rows apart even where ids are null or repeated with other texts."""
    return [F.coalesce(F.col(id_col), F.lit(-(1 << 63))).alias("_k"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_t")]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of unsigned 64-bit integers with well-spread bits (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary array, and the end-to-end offsets of its values; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = col.fill_null(b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def split_batch(batch: pa.RecordBatch, column: str, limit: int):
    """Slices of a batch that hold at most ``limit`` bytes of a column, or a single row."""
    _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < len(batch):
        end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end


class PowerTable:
    """Powers of an odd base and of its inverse modulo 2**64, for hashes of any substring."""

    BASE = 0x9E3779B97F4A7C15 | 1
    INVERSE = pow(BASE, -1, 1 << 64)

    def __init__(self):
        self.shrink()

    def shrink(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            self.up, self.down = (self._powers(b, n) for b in (self.BASE, self.INVERSE))

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.empty(n, np.uint64)
        out[0], done = 1, 1
        while done < n:
            step = min(done, n - done)
            out[done : done + step] = out[:step] * np.uint64(pow(base, done, 1 << 64))
            done += step
        return out

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """``prefix_of`` for bytes, without other arrays of its size."""
        self.reach(len(data) + 1)
        out = np.zeros(len(data) + 1, np.uint64)
        sums = out[1:]
        np.take(_BYTES, data, out=sums, mode="clip")
        sums *= self.up[: len(data)]
        np.cumsum(sums, out=sums)
        return out

    def prefix_of(self, values: np.ndarray) -> np.ndarray:
        """S with hash(a, b) = (S[b] - S[a]) * down[a]; equal subsequences have equal hashes anywhere."""
        self.reach(len(values) + 1)
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.up[: len(values)], out=out[1:])
        return out

    def window(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (prefix[end] - prefix[start]) * self.down[start]


_BYTES = mix64(np.arange(1, 257, dtype=np.uint64))


POWERS = PowerTable()
