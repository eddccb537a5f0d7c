"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with whole WARC
records, and a seek table in a skippable frame at its end.  The index maps a
record's id to its bundle, frame and the offset inside the frame, so that a
record is read by unpacking one frame.

Spark's text sink commits the bundles: it writes a row's bytes and a line
separator, and the separator is set to the last four bytes of the format, the
seek table's magic number.  So bundles go to any store that Spark can write
to, a lost task is written again, and no executor touches a local file.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slabscan.llm.common import in_files, places, shared_dir, split_batch, stored, without_rows

#: Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 8 << 20
LEVEL = 3
#: Bundles that ``fetch_records`` names in its scan; of more, all are read.
NAMED_BUNDLES = 1000

RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, bundle string, frame int, offset long, length long"


def _name(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def _page(name: str) -> int | None:
    value = name.strip("<>").rpartition(":")[2]
    return None if value == "none" else int(value)


def make_record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP head of its payload of ``size`` bytes and no body."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head
    target = "".join(c if c > " " else "%%%02X" % ord(c) for c in url) if url else None
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", _name(page_id)),
        ("WARC-Date", date),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{base64.b32encode(digest).decode()}"),
        ("WARC-Refers-To", None if refers_to is None else _name(refers_to)),
        ("WARC-Profile", None if refers_to is None else "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


class Bundler:
    """Collects records to frames and frames to bundles of about ``bundle_bytes``."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = LEVEL):
        import zstandard

        self.packer = zstandard.ZstdCompressor(level=level)
        self.frame_bytes, self.bundle_bytes = frame_bytes, bundle_bytes
        self.records: list[bytes] = []
        self.pending = 0
        self.frames: list[bytes] = []
        self.sizes: list[tuple[int, int]] = []
        self.packed = 0

    def _close_frame(self) -> None:
        if self.records:
            data = b"".join(self.records)
            self.frames.append(self.packer.compress(data))
            self.sizes.append((len(self.frames[-1]), len(data)))
            self.packed += len(self.frames[-1])
            self.records, self.pending = [], 0

    def add(self, record: bytes) -> bytes | None:
        """The bytes of a bundle once one is full."""
        self.records.append(record)
        self.pending += len(record)
        if self.pending >= self.frame_bytes:
            self._close_frame()
        return self.close() if self.packed >= self.bundle_bytes else None

    def close(self) -> bytes | None:
        self._close_frame()
        if not self.frames:
            return None
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        out = b"".join(self.frames) + struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table
        self.frames, self.sizes, self.packed = [], [], 0
        return out


def seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(start, packed size, unpacked size) of each frame, from the footer alone."""
    count, descriptor, magic = struct.unpack_from("<IBI", bundle, len(bundle) - 9)
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table at the end")
    each = 12 if descriptor & 0x80 else 8
    at, start, out = len(bundle) - 9 - count * each, 0, []
    for _ in range(count):
        packed, size = struct.unpack_from("<II", bundle, at)
        out.append((start, packed, size))
        start, at = start + packed, at + each
    return out


def read_frame(bundle: bytes, entry: tuple[int, int, int]) -> bytes:
    import zstandard

    start, packed, size = entry
    return zstandard.ZstdDecompressor().decompress(bundle[start : start + packed], max_output_size=size)


def parse_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """The fields and block of the record at an offset, and the offset after it."""
    end = data.index(b"\r\n\r\n", at)
    fields = dict(line.split(": ", 1) for line in data[at:end].decode().split("\r\n")[1:])
    size = int(fields["Content-Length"])
    block = data[end + 4 : end + 4 + size]
    return fields, block, end + 4 + size + 4


def payload_of(block: bytes) -> tuple[int, bytes]:
    """The payload's full length, as its HTTP head has it, and the bytes that are there."""
    head, _, body = block.partition(b"\r\n\r\n")
    return int(head.rpartition(b"Content-Length: ")[2]), body


def plan_revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_payload_bytes: int) -> DataFrame:
    """(_file, _at, _page, _url, _size, _digest, _refers_to) of the rows that revisit an equal payload with a larger id; no payload shuffles."""
    html = F.coalesce(pages[html_col], F.lit(""))
    size = F.octet_length(html).cast("bigint")
    rows = pages.where(size >= min_payload_bytes).select(*places(pages), pages[id_col].cast("bigint").alias("_page"), pages[url_col].alias("_url"), size.alias("_size"), F.unhex(F.sha1(html)).alias("_digest"))
    rows = stored(rows)
    groups = rows.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n"), F.max("_page").alias("_refers_to")).where("_n > 1 and _refers_to is not null")
    # A digest that many pages share is one row of the written groups, so its pages can be split as a skewed join.
    groups = stored(groups.select("_digest", "_refers_to"))
    return stored(rows.join(groups.hint("merge"), "_digest").where("_page is null or _page < _refers_to"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_payload_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> None:
    """Write a record for each row as bundles under ``path``.

    Of rows with equal payloads of at least ``min_payload_bytes`` the one with
    the largest id is a response (each, if that id is repeated), the others
    revisit it; without any id all are responses.  Null html is an empty
    payload, a null url is left out of the record, very long html is one
    record, other columns are ignored whatever their names, and an empty table
    writes no bundle.  Responses go straight from the pages' files to their
    bundle; only digests, and revisits without their payload, shuffle.
    """
    pages = in_files(pages)
    revisits = plan_revisits(pages, id_col, url_col, html_col, min_payload_bytes)
    rest = without_rows(pages, revisits.select("_file", "_at"))
    html = F.coalesce(rest[html_col], F.lit(""))
    responses = rest.select(rest[id_col].cast("bigint").alias("id"), rest[url_col].alias("url"), F.encode(html, "UTF-8").alias("html"), F.octet_length(html).cast("bigint").alias("size"), F.unhex(F.sha1(html)).alias("digest"), F.lit(None).cast("bigint").alias("refers_to"))
    again = revisits.select(F.col("_page").alias("id"), F.col("_url").alias("url"), F.lit(None).cast("binary").alias("html"), F.col("_size").alias("size"), F.col("_digest").alias("digest"), F.col("_refers_to").alias("refers_to"))
    rows = responses.unionAll(again)

    def run(batches: Iterator[pa.RecordBatch]):
        bundler = Bundler()
        for batch in batches:
            for part in split_batch(batch, "html", 8 << 20):
                for record in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    if done := bundler.add(make_record(*record, date)):
                        yield _row(done)
        if done := bundler.close():
            yield _row(done)

    def _row(bundle: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([bundle[:-4]], pa.binary())], names=["bundle"])

    magic = struct.pack("<I", SEEKABLE_MAGIC).decode("latin-1")
    bundles = rows.mapInArrow(run, "bundle binary").select(F.col("bundle").cast("string").alias("value"))
    bundles.write.option("encoding", "ISO-8859-1").option("lineSep", magic).option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record, from the frames that the seek tables name; payloads of responses are checked against their digests."""

    def run(batches: Iterator[pa.RecordBatch]):
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                bundle = content.as_py()
                rows = []
                for frame, entry in enumerate(seek_table(bundle) if bundle else []):
                    data, at = read_frame(bundle, entry), 0
                    while at < len(data):
                        fields, block, after = parse_record(data, at)
                        size, body = payload_of(block)
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if fields["WARC-Type"] == "response" and (len(body) != size or base64.b32encode(hashlib.sha1(body).digest()).decode() != digest):
                            raise ValueError(f"{name}: {fields['WARC-Record-ID']} is damaged")
                        refers_to = _page(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None
                        rows.append((_page(fields["WARC-Record-ID"]), size, digest, fields["WARC-Type"], refers_to, fields["WARC-Record-ID"], name, frame, at, after - at))
                        at = after
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(schema.types)], schema=schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, RECORDS)


def fetch_records(spark: SparkSession, path: str, wanted: DataFrame, named_bundles: int = NAMED_BUNDLES) -> DataFrame:
    """(record_id, record) for rows of the index: record_id, bundle, frame, offset, length.

    Reads the bundles that are named in ``wanted``, if those are few enough to
    name in the scan, and unpacks each wanted frame once.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        schema = pa.schema([("record_id", pa.string()), ("record", pa.binary())])
        for batch in batches:
            for content, records in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                bundle = content.as_py()
                entries, at, data = seek_table(bundle), None, b""
                for r in sorted(records, key=lambda r: (r["frame"], r["offset"])):
                    if r["frame"] != at:
                        at, data = r["frame"], read_frame(bundle, entries[r["frame"]])
                    yield pa.RecordBatch.from_pylist([{"record_id": r["record_id"], "record": data[r["offset"] : r["offset"] + r["length"]]}], schema=schema)

    files = spark.read.format("binaryFile").load(path)
    names = [r.name for r in wanted.select(F.element_at(F.split("bundle", "/"), -1).alias("name")).distinct().limit(named_bundles + 1).collect()]
    if len(names) <= named_bundles:
        files = files.where(files.metadataColumn("_metadata")["file_name"].isin(names))
    # At most the records of a bundle in a row.
    each = wanted.groupBy("bundle").agg(F.collect_list(F.struct("record_id", "frame", "offset", "length")).alias("records"))
    return files.select("path", "content").join(each, F.col("bundle") == F.col("path")).select("content", "records").mapInArrow(run, "record_id string, record binary")


def archive(pages: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write the archives (to the shared folder unless ``path`` is given) and return the index of what was read back."""
    path = path or shared_dir(pages.sparkSession)
    write_archives(pages, path, **options)
    return read_archives(pages.sparkSession, path)
