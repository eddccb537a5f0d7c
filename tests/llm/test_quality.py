import collections
import math
import zlib

import numpy as np
import pytest

from slabscan.llm import queries
from slabscan.llm.quality import BUCKETS, estimate, fit, score, shape, votes


def test_estimate_finds_the_better_labellers():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.7
    accuracy = [0.95, 0.9, 0.85, 0.6]
    rows = np.stack([np.where(rng.random(len(truth)) < a, truth, ~truth) for a in accuracy], 1)
    counts, where = {}, []
    for r in rows:
        p = "".join("g" if v else "b" for v in r)
        counts[p] = counts.get(p, 0) + 1
        where.append(p)
    good = estimate(counts)
    found = np.array([good[p] >= 0.5 for p in where])
    assert (found == truth).mean() > max((rows[:, j] == truth).mean() for j in range(4)) - 0.002
    assert estimate({}) == {}


def test_cases(spark):
    texts = [None, "", "x " * 200_000, "Fine words make a good sentence here. " * 20, "### $$$ ||| %%% " * 30]
    docs = spark.createDataFrame([(i, t, 0.5, "p") for i, t in enumerate(texts)] * 2 + [(None, texts[3], 0.1, "q")], "doc_id long, text string, score double, votes string")
    rows = score(docs, fit(docs)).collect()
    assert len(rows) == 11 and all(0 <= r.score <= 1 for r in rows)
    assert all(r.votes == votes(texts[r.doc_id] or "", (texts[r.doc_id] or "").split()) for r in rows if r.doc_id is not None)
    assert score(docs.limit(0), fit(docs.limit(0))).collect() == []


def test_against_labels(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op8_quality(spark, sf).join(labels, "doc_id").select("quality", "predicted").collect()
    good = [r.predicted for r in rows if r.quality]
    bad = [r.predicted for r in rows if not r.quality]
    print("kept of good", sum(good) / len(good), "kept of bad", sum(bad) / len(bad), len(good), len(bad))
    assert sum(good) / len(good) > 0.95 and sum(bad) / len(bad) < 0.5


@pytest.mark.parametrize("train_rows", [300, 40_000])
def test_same_for_any_partitioning(spark, train_rows):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = []
    for n in (1, 64, 1000):
        dealt = docs.repartition(n)
        model = fit(dealt, train_rows=train_rows)
        found.append({(r.doc_id, r.score) for r in score(dealt, model).collect()})
    assert found[0] == found[1] == found[2] and len(found[0]) == 1000


def test_scores_by_brute_force(spark):
    """The score of each document of the query, from the model's weights, word by word."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = fit(docs)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in queries.op8_quality(spark, sf).collect():
        parts = collections.Counter()
        for w in texts[r.doc_id].split():
            parts[w] += 1
            parts["\t" + (w if len(w) < 2 else shape(w) if not w.isalpha() else "a")] += 1
        norm = max(1.0, math.sqrt(sum(parts.values())))
        x = model.bias + sum(math.sqrt(n) / norm * model.weights[zlib.crc32(p.encode()) % BUCKETS] for p, n in parts.items())
        assert abs(r.score - 1 / (1 + math.exp(-max(-30, min(30, x))))) < 1e-9
        assert r.predicted == (r.score >= 0.5) and r.votes == votes(texts[r.doc_id], texts[r.doc_id].split())
