import base64
import hashlib

import zstandard

from slabscan.llm import queries
from slabscan.llm.common import without_rows
from slabscan.llm.warc import Bundler, archive, fetch_records, parse_record, payload_of, plan_revisits, read_archives, read_frame, seek_table, write_archives

ROWS = [(1, "http://a/", "same"), (2, None, "same"), (3, "http://c/", None), (4, "http://d/x y\r\nz", ""), (5, "e", "é" * 300_000), (6, "f", "alone"), (7, "g", "same"), (7, "g", "same"), (7, "g", "other"), (None, "n", "same"), (None, "n", "none")]


def brute(rows, least=0):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        top = max((p for p, _, h in rows if (h or "") == (html or "") and p is not None), default=None)
        revisit = len(data) >= least and top is not None and page != top
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=repr)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=repr)


def test_cases(spark):
    pages = spark.createDataFrame([(*r, 1) for r in ROWS], "page_id long, url string, html string, _file int").repartition(2)
    assert got(archive(pages)) == brute(ROWS)
    assert got(archive(pages, min_payload_bytes=5)) == brute(ROWS, 5)
    assert got(archive(pages.limit(0))) == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    assert got(queries.op3_warc(spark, sf)) == brute(rows)


def test_seekable_frames():
    b = Bundler(frame_bytes=100)
    data = [bytes([65 + i]) * 40 for i in range(10)]
    for d in data:
        b.add(d)
    bundle = b.close()
    entries = seek_table(bundle)
    assert len(entries) == 4 and read_frame(bundle, entries[1]) == b"".join(data[3:6])
    assert zstandard.ZstdDecompressor().stream_reader(bundle, read_across_frames=True).read() == b"".join(data)


def test_random_access(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"page {i} " * 2000) for i in range(100)], "page_id long, url string, html string").coalesce(1)
    path = str(tmp_path / "w")
    write_archives(pages, path)
    index = read_archives(spark, path).where("page_id % 10 = 3")
    found = fetch_records(spark, path, index).collect()
    assert len(found) == 10 and len(fetch_records(spark, path, index, named_bundles=0).collect()) == 10
    for r in found:
        fields, block, _ = parse_record(bytes(r.record), 0)
        page = int(fields["WARC-Record-ID"].strip("<>").split(":")[-1])
        assert payload_of(block)[1].decode() == f"page {page} " * 2000


def test_payloads_never_shuffle(spark, tmp_path):
    spark.createDataFrame([(i, "u", f"page {i % 7}") for i in range(50)], "page_id long, url string, html string").write.parquet(str(tmp_path / "p"))
    pages = spark.read.parquet(str(tmp_path / "p"))
    revisits = plan_revisits(pages, "page_id", "url", "html", 0)
    assert "html" not in revisits.columns and revisits.count() == 43
    plan = without_rows(pages, revisits.select("_file", "_at"))._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.split("\n") if "Exchange" in line and "BroadcastExchange" not in line]
