import random

import numpy as np

from slabscan.llm import minhash, queries
from slabscan.llm.common import text_bytes


def shingle_set(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").split() if text else []
    words = [w for w in words if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(rows):
    """Smallest id of each document's component of pairs with a Jaccard similarity of 0.8 or more."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    index = {}
    for i, s in enumerate(sets):
        for g in s:
            index.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        counts = {}
        for g in s:
            for j in index[g]:
                if j < i:
                    counts[j] = counts.get(j, 0) + 1
        for j, both in counts.items():
            if both >= 0.8 * (len(s) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    least = {}
    for i, (k, _) in enumerate(rows):
        f = find(i)
        least[f] = min(least.get(f, (True, 0)), (k is None, k or 0))
    return sorted(((k, least[find(i)][1] if not least[find(i)][0] else None) for i, (k, _) in enumerate(rows)), key=repr)


def test_estimate_of_probability_jaccard():
    rng = np.random.default_rng(0)
    ids = rng.integers(1, 2**63, 60, dtype=np.uint64)
    a, b = rng.integers(0, 5, 60).astype(float), rng.integers(0, 5, 60).astype(float)
    owner = np.repeat([0, 1], 60)
    weight = np.concatenate([a, b])
    there = weight > 0
    got = minhash.prob_minhash(owner[there], np.concatenate([ids, ids])[there], weight[there], 2, 20_000)
    both = (a > 0) & (b > 0)
    want = sum(1 / np.maximum(a / a[i], b / b[i]).sum() for i in np.flatnonzero(both))
    assert abs((got[0] == got[1]).mean() - want) < 0.02


def test_shingles_are_the_same_anywhere():
    import pyarrow as pa

    texts = ["a b c d e f", "", None, "x", "  A b\tC d\n e  F ", "é b c d e", "a b c d e f g", " "]
    owner, shingle, whole = minhash.shingles(*text_bytes(pa.array(texts)))
    sets = [set(shingle[owner == i].tolist()) for i in range(len(texts))]
    assert [len(s) for s in sets] == [2, 0, 0, 1, 2, 1, 3, 0]
    assert sets[0] == sets[4] and sets[0] < sets[6]
    whole = list(map(tuple, whole.tolist()))
    assert whole[0] == whole[4] and whole[1] == whole[2] == whole[7] == (0, 0) and len(set(whole)) == 5
    # The hash is that of the words alone, with a space after each.
    import xxhash

    h = xxhash.xxh3_128_intdigest(b"a b c d e f ")
    assert whole[0] == (h >> 64, h & (2**64 - 1))


def family(rng, base, n):
    out = []
    for _ in range(n):
        words = base[:]
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_same_as_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for f in range(12):
        texts += family(rng, [f"w{f}_{rng.randrange(500)}" for _ in range(120)], 1 if f % 3 == 0 else 25)
    texts += texts[40:60] + ["", "  ", None, "one", "one", "ONE ", "long " * 200_000, "long " * 200_001]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [*zip(ids, texts, strict=True), (None, texts[3]), (None, "lonely words here"), (ids[7], texts[7])]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, _class int, _row string").repartition(5)
    got = minhash.near_duplicates(docs).collect()
    assert sorted(((r.doc_id, r.group_id) for r in got), key=repr) == brute_groups(rows)
    words = [r for r in got if r.class_id]
    groups = {}
    for r in words:
        groups.setdefault(r.group_id, []).append(r.kept)
    assert all(sum(k) == 1 for k in groups.values())
    kept = minhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(groups) + sum(not r.class_id for r in got)
    assert minhash.near_duplicates(docs.limit(0)).collect() == []


def test_equal_sets_meet_however_often_they_repeat(spark):
    words = [[f"w{i}_{j}" for j in range(100)] for i in range(300)]
    plain = [" ".join(w) for w in words]
    often = [" ".join(w[:50] * 50 + w[50:]) for w in words]
    docs = spark.createDataFrame(list(enumerate(plain + often)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.group_id for r in minhash.near_duplicates(docs).collect()}
    assert got == {i: i % 300 for i in range(600)}


def test_buckets_of_a_text_are_distinct_and_the_same_anywhere():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(1, 2**63, k, dtype=np.uint64)) for k in (30, 7, 30)]
    owner, shingle = np.repeat(np.arange(3), [len(s) for s in sets]), np.concatenate(sets)
    count = np.where(owner == 2, 1 + shingle % np.uint64(5), 1).astype(np.int64)
    text, bucket = minhash.buckets_of(owner, shingle, count, 4)
    assert len(set(zip(text.tolist(), bucket.tolist(), strict=True))) == len(text)
    assert (text == 0).sum() == (text == 1).sum() == (text == 3).sum() == minhash.BANDS and (text == 2).sum() > minhash.BANDS
    for i, s in enumerate(sets):
        alone, own = minhash.buckets_of(np.zeros(len(s), int), s, count[owner == i], 1)
        assert own.tolist() == bucket[text == i].tolist()


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(((r.doc_id, r.group_id) for r in queries.op5_minhash(spark, sf).collect()), key=repr)
    want = brute_groups(rows)
    assert got == want


def test_structured_texts_are_told_apart(spark):
    """Thue-Morse texts collide under any polynomial hash modulo 2**64."""
    flip = str.maketrans("ab", "ba")
    tm = "a"
    while len(tm) < 2048:
        tm += tm.translate(flip)
    texts = [f"x {tm}", f"x {tm.translate(flip)}", " ".join(tm), " ".join(tm.translate(flip)), f"x {tm}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()}
    assert got[0] == got[4] and len(set(got.values())) == 4
    assert {r.doc_id: r.group_id for r in minhash.near_duplicates(docs).collect()} == dict(brute_groups(list(enumerate(texts))))
    assert minhash.keep_first(docs.where("doc_id < 2")).count() == 2


def test_classes_of_one_half_are_split(spark):
    rows = [(1, 7, 1, 3), (2, 7, 2, 3), (3, 7, 1, 3), (4, 8, 1, 3), (5, 0, 0, 0), (6, 0, 0, 0)]
    flat = spark.createDataFrame(rows, "_id long, _class long, _check long, _words long")
    got = {r._id: r._class for r in minhash._apart(flat).collect()}
    assert got[1] == got[3] != got[2] and got[4] == 8 and got[5] == got[6] == 0 and len(set(got.values())) == 4
