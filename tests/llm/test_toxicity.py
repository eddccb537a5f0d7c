import math
import random
import re
import zlib

from slabscan.llm import queries
from slabscan.llm.toxicity import DRIFT, ToxicModel, _features, _segments, fit, reject_toxic, scan, score


def brute_segments(scores):
    """All maximal segments by their recursive definition: the best one, then those left and right of it."""

    def best(a, b):
        found = max(((sum(scores[i:j]), -(j - i), -i) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
        if not found or found[0] <= 1e-12:
            return []
        i, j = -found[2], -found[2] - found[1]
        return [*best(a, i), (i, j, found[0]), *best(j, b)]

    return best(0, len(scores))


def test_scan_finds_all_maximal_segments():
    rng = random.Random(3)
    for _ in range(200):
        weights = {f"w{i}": rng.choice([-1.3, 0.71, 1.93, 3.17, 0.2]) + rng.random() / 100 for i in range(6)}
        words = [rng.choice([*weights, "x", "y"]) for _ in range(rng.randrange(1, 22))]
        want = brute_segments([weights.get(w, 0.0) - DRIFT for w in words])
        got = scan(words, weights)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert all(abs(g[2] - w[2]) < 1e-9 for g, w in zip(got, want, strict=True))


def test_cases(spark):
    docs = spark.createDataFrame([(i, f"{'you idiot ' if i % 4 == 0 else 'good '}plain words here {i % 7} " * 5, "k") for i in range(400)], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(4, 1, 1), (None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    model = fit(docs, labels)
    odd = spark.createDataFrame([(1, None, "a"), (2, "", "b"), (3, "plain " * 100_000 + "you idiot you idiot idiot", "c"), (3, "good plain", "d"), (None, "idiot idiot idiot", "e")], "doc_id long, text string, score string")
    got = {(r.doc_id, r.predicted) for r in score(odd, model).collect()}
    assert (1, 0) in got and (2, 0) in got and (3, 0) in got and (None, 1) in got
    long = next(r for r in score(odd, model).collect() if r.doc_id == 3 and r.passages)
    assert long.passages[0].start >= 600_000 - 10
    assert sorted(r.score for r in reject_toxic(odd.where("score != 'c'"), model).collect()) == ["a", "b", "d"]
    assert score(odd.limit(0), model).collect() == [] and reject_toxic(odd.limit(0), model).collect() == []
    for r in score(docs, model).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert r.predicted == int(r.doc_id % 4 == 0)
    none = fit(docs, labels.limit(0))
    assert isinstance(none, ToxicModel) and {r.score for r in score(odd, none).collect()} == {0.5}


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.op6_toxicity(spark, sf).where("held_out").join(labels, "doc_id").collect()
    hits = sum(r.predicted and r.toxic for r in rows)
    print("recall", hits / sum(r.toxic for r in rows), "precision", hits / sum(r.predicted for r in rows), len(rows))
    assert hits / sum(r.toxic for r in rows) > 0.8
    assert hits / sum(r.predicted for r in rows) > 0.9


def test_rare_words_and_copies(spark):
    """A rare toxic word has weight beside common ones; the words of many near copies of a wrongly labelled text have none."""
    rng = random.Random(5)
    plain = [f"w{i}" for i in range(400)]
    docs, labels = [], []

    def add(words, toxic):
        docs.append((len(docs), " ".join(words)))
        labels.append((len(labels), 1, toxic))

    for i in range(3000):
        words = rng.choices(plain, k=60)
        if i < 300:
            words[rng.randrange(60)] = "common" if i % 10 else "rare"
        add(words, int(i < 300))
    wrong = [f"x{i}" for i in range(60)]
    for _ in range(60):
        copy = list(wrong)
        copy[rng.randrange(60)] = rng.choice(plain)
        add(copy, 1)
    model = fit(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    print("weights", sorted(model.weights.items(), key=lambda x: -x[1])[:5], len(model.weights))
    assert model.weights["rare"] > DRIFT and model.weights["common"] > DRIFT
    assert sum(w in model.weights for w in wrong) <= 3


def test_features_use_all_segments(spark):
    """A document of 200 passages is fitted on the features that it is scored with."""
    model = ToxicModel({"bad": 4.0}, rate=1.0, k=0.001)
    text = ("bad " + "plain " * 20) * 200
    rows = spark.createDataFrame([(text, 1)], "text string, _toxic int")
    words = text.split()
    x, y = _features(_segments(rows, model), model)
    assert y.tolist() == [1.0] and len(scan(words, model.weights)) == 200
    assert x[0].tolist() == list(model.features(len(words), scan(words, model.weights)))


def test_scores_by_brute_force(spark):
    """Scores, predictions and passages of short documents from all segments by their definition."""
    rng = random.Random(8)
    plain = [f"w{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(1500):
        words = rng.choices(plain, k=rng.randrange(0, 30))
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(["vile", "nasty", "awful"]))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    model = fit(table, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert len(model.weights) >= 3
    got = {r.doc_id: r for r in score(table, model).collect()}
    for i, text in docs:
        words = re.findall(r"\w+", text.lower())
        found = brute_segments([model.weights.get(w, 0.0) - DRIFT for w in words])
        expected = lambda s: model.k * max(len(words), 1) * math.exp(-model.rate * s)
        good = [s for s in found if expected(s[2]) <= 0.05]
        best = max((s[2] for s in found), default=0.0)
        x = [1, min(model.rate * best, 50) - math.log(model.k * max(len(words), 1)), math.log1p(model.rate * sum(s[2] for s in good)), math.log1p(len(good))]
        p = 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(model.coefficients, x, strict=True))))))
        assert abs(got[i].score - p) < 1e-9 and got[i].predicted == (p >= 0.5)
        assert [text[s.start : s.end].lower() for s in got[i].passages] == [" ".join(words[a:b]) for a, b, _ in good]


def test_query_gives_every_document(spark):
    sf = "/root/testdata/sf0.01"
    ids = sorted(r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    rows = queries.op6_toxicity(spark, sf).collect()
    assert sorted(r.doc_id for r in rows) == ids
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
