import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from slabscan.llm import queries
from slabscan.llm.suffix_dedup import remove_repeats, spans_of_groups, suffix_dedup, suffix_order, whole_groups


def brute(rows, length=200):
    seen = {}
    data = [(t or "").encode() for _, t in rows]
    for b in data:
        for i in range(len(b) - length + 1):
            s = hash(b[i : i + length])
            seen[s] = seen.get(s, 0) + 1
    out = []
    for (k, _), b in zip(rows, data, strict=True):
        cover = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[hash(b[i : i + length])] > 1:
                cover[i : i + length] = True
        edge = np.diff(np.concatenate([[0], cover.astype(int), [0]]))
        rest = np.frombuffer(b, np.uint8)[~cover].tobytes()
        out.append((k, len(b), int(cover.sum()), int((edge == 1).sum()), hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=repr)


def test_suffix_order():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(9))).encode() for _ in range(300)]
    group = np.sort(np.array([rng.randrange(20) for _ in texts]))
    size = np.array([len(t) for t in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    order, common = suffix_order(data, np.cumsum(size) - size, size, group)
    want = sorted(range(300), key=lambda i: (group[i], texts[i], i))
    assert order.tolist() == want
    for n, (a, b) in enumerate(zip(want[:-1], want[1:], strict=True), 1):
        if group[a] != group[b]:
            assert common[n] == -1
        else:
            least = min(len(texts[a]), len(texts[b]))
            assert common[n] == next((i for i in range(least) if texts[a][i] != texts[b][i]), least)


def cases():
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passage, line = word(260), word(100)
    rows = [(i, word(rng.randrange(50, 400)) + passage[: rng.randrange(150, 260)] + word(60)) for i in range(60)]
    rows += [(100 + i, word(150) + line + word(150)) for i in range(30)]
    rows += [(200, "z" * 450), (201, word(199)), (202, None), (203, ""), (204, passage), (204, passage), (None, word(500)), (None, rows[3][1]), (205, "q" * 199), (206, rows[5][1] + rows[5][1]), (207, word(30) + passage[30:231] + word(5))]
    return rows


@pytest.mark.parametrize(("part", "most_parts"), [(4096, 8), (7, 1000), (7, 8), (7, 0)])
def test_same_as_brute_force(spark, part, most_parts):
    rows = cases()
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, pos int, _k string").repartition(4)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in suffix_dedup(docs, part=part, most_parts=most_parts).collect()), key=repr)
    assert got == brute(rows)


def contexts(groups):
    """Rows of groups of contexts around equal grams, of which every other one has the same right side too."""
    rng = random.Random(7)
    word = lambda n: rng.randbytes(n)
    rows = []
    for g, size in enumerate(groups):
        gram, right = word(72), word(128)
        rows += [(g // 3, g % 3, 0, 1, g, i, 1000, 128, word(128) + gram + (right if i % 2 else word(128))) for i in range(size)]
    kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.int64()] * 4, pa.int16(), pa.binary()]
    names = ["h", "a", "b", "_n", "_k", "_t", "pos", "l", "context"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=names)


@pytest.mark.parametrize("step", [1, 3, 7, 40, 1000])
@pytest.mark.parametrize("limit", [1, 2000, 1 << 20])
def test_groups_stay_whole(step, limit):
    groups = [2, 2, 9, 30, 2, 3, 50, 2]
    rows = contexts(groups)
    batches = [rows.slice(a, step) for a in range(0, len(rows), step)]
    got = list(whole_groups([*batches[:2], rows.slice(0, 0), *batches[2:]], limit))
    assert pa.Table.from_batches(got).equals(pa.Table.from_batches([rows]))
    of = [sorted(set(b.column(4).to_pylist())) for b in got]
    assert [g for b in of for g in b] == list(range(len(groups)))
    assert all(len(b) == 1 or sum(groups[g] for g in b) * 328 <= limit for b in of)


def test_memory_of_many_groups():
    """An executor's workers live beside its JVM, so that a batch of many small groups must not be sorted at once."""
    rows = contexts([4] * 5000)
    tracemalloc.start()
    try:
        spans = sum(len(b) for b in spans_of_groups([rows.slice(0, 10_000), rows.slice(10_000)]))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert spans == 10_000
    assert peak < 80e6


def test_long_text_and_stage(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefghij") for _ in range(2_400_000))
    rows = [(1, long), (2, "x" + long[1_048_400:1_048_800] + "y"), (3, None)]
    docs = spark.createDataFrame([(*r, "s", 5) for r in rows], "doc_id long, text string, lang string, n_chars long")
    got = {r.doc_id: (r.n_removed, len(r.spans)) for r in suffix_dedup(docs).collect()}
    assert got == {1: (400, 1), 2: (400, 1), 3: (0, 0)}
    cut = remove_repeats(docs)
    assert cut.columns == docs.columns
    assert {r.doc_id: (r.text and r.text[:3], r.n_chars) for r in cut.collect()} == {1: (long[:3], 2_399_600), 2: ("xy", 2), 3: (None, 0)}
    assert suffix_dedup(docs.limit(0)).collect() == []


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((tuple(r) for r in queries.op7_suffix_dedup(spark, sf).collect()), key=repr)
    assert got == brute(rows)


def test_many_contexts_of_one_line(spark):
    """A line that 50,000 different texts share around it, some with more than the line in common."""
    rng = random.Random(6)
    word = lambda n: "".join(rng.choices("abcdefghij ", k=n))
    line, left, right = word(110), word(60), word(60)
    rows = [(i, word(130) + (left if i % 1000 == 0 else word(60)) + line + (right if i % 1000 < 2 else word(60)) + word(130)) for i in range(50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in suffix_dedup(docs).collect()), key=repr)
    assert got == brute(rows)
    assert sum(g[2] > 0 for g in got) >= 50
