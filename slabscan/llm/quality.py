"""Quality from weak labels: heuristic labellers, expectation-maximisation, and a hashed linear scorer.

Each labeller says good, bad or nothing of a document.  The votes of all
documents are counted by pattern (at most 3 ** labellers patterns), and
expectation-maximisation estimates how often each labeller gives each vote for
good and for bad documents, and the share of good ones.  The posterior of a
document's pattern is its label; a logistic scorer over hashed words and word
shapes is trained on a bounded sample and scores every document.  The votes,
of which the label is a function, aren't among its features.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slabscan.llm.common import bound_batches, split_batch, stored, tidy

LABELLERS = ("length", "symbols", "word_length", "repeated_lines", "digits", "endings", "variety")
BUCKETS = 1 << 14
#: Documents that train the scorer, drawn by a hash of their id and text; labels come from all documents.
TRAIN_ROWS = 40_000
EPOCHS = 3
RATE = 0.5
_LETTERS = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")


def votes(text: str, words: list[str]) -> str:
    """A character for each labeller: g, b or - (says nothing)."""

    def say(value: float, bad, good) -> str:
        return "b" if bad(value) else "g" if good(value) else "-"

    n, size = len(words), max(len(text), 1)
    letters = sum(map(len, _LETTERS.findall(text)))
    digits = sum(map(len, _DIGITS.findall(text)))
    blank = size - len("".join(words)) if words else size
    symbols = (size - letters - digits - blank) / size
    lines = [s for s in map(str.strip, text.split("\n")) if s]
    repeated = 1 - len(set(lines)) / len(lines) if lines else 1.0
    ends = sum(s[-1] in ".!?\"'…:" for s in lines) / len(lines) if lines else 0.0
    mean = sum(map(len, words)) / n if n else 0.0
    variety = len(set(words)) / n if n else 0.0
    return "".join(
        (
            say(n, lambda v: v < 8, lambda v: v >= 40),
            say(symbols, lambda v: v > 0.08, lambda v: v < 0.05),
            say(mean, lambda v: v < 2.5 or v > 12, lambda v: 3 <= v <= 9),
            say(repeated, lambda v: v > 0.3, lambda v: v < 0.1),
            say(digits / size, lambda v: v > 0.15, lambda v: v < 0.05),
            say(ends, lambda v: v < 0.3, lambda v: v > 0.8),
            say(variety if n >= 30 else 0.5, lambda v: v < 0.15, lambda v: v > 0.3 and n >= 30),
        )
    )


def estimate(patterns: dict[str, int], rounds: int = 200) -> dict[str, float]:
    """The posterior that a document with each pattern is good; starts from the majority of votes."""
    if not patterns:
        return {}
    names = sorted(patterns)
    n = np.array([patterns[p] for p in names], float)
    vote = np.array([["b-g".index(c) for c in p] for p in names])
    spoke = (vote != 1).sum(axis=1)
    good = np.where(spoke > 0, (1 + (vote == 2).sum(axis=1)) / (2 + spoke), 0.5)
    for _ in range(rounds):
        share = float((n * good).sum() / n.sum())
        share = min(max(share, 1e-6), 1 - 1e-6)
        odds = np.full(len(names), math.log(share / (1 - share)))
        for j in range(vote.shape[1]):
            g = np.bincount(vote[:, j], n * good, 3) + 1.0
            b = np.bincount(vote[:, j], n * (1 - good), 3) + 1.0
            odds += np.log((g / g.sum()) / (b / b.sum()))[vote[:, j]]
        last, good = good, 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(good - last).max() < 1e-9:
            break
    return dict(zip(names, good.tolist(), strict=True))


def shape(word: str) -> str:
    return _DIGITS.sub("0", _LETTERS.sub("a", word))


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets, some more than once, and values of a document, of length 1."""
    counts = Counter(words)
    shapes: Counter[str] = Counter()
    for w, c in counts.items():
        shapes[w if len(w) < 2 else shape(w) if not w.isalpha() else "a"] += c
    names = [*counts, *(f"\t{s}" for s in shapes)]
    value = np.sqrt(np.array([*counts.values(), *shapes.values()], float))
    at = np.array([zlib.crc32(s.encode("utf-8", "surrogatepass")) for s in names], np.int64) % BUCKETS if names else np.zeros(0, np.int64)
    return at, value / max(float(np.sqrt((value * value).sum())), 1.0)


def train(rows: list[tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray:
    """The bias and the weights, by steps over the rows in their order; each row has a bucket once."""
    weights, bias = np.zeros(BUCKETS), 0.0
    for _ in range(EPOCHS):
        for at, value, label in rows:
            p = 1 / (1 + math.exp(-min(30.0, max(-30.0, bias + float(weights[at] @ value)))))
            step = RATE * (label - p)
            weights[at] += step * value
            bias += step
    return np.concatenate([[bias], weights])


@dataclass
class QualityModel:
    posterior: dict[str, float]
    weights: np.ndarray
    bias: float

    def score(self, words: list[str]) -> float:
        at, value = features(words)
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, self.bias + float(self.weights[at] @ value)))))


def _patterns(docs: DataFrame, text_col: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in split_batch(batch, "_text", 4 << 20):
                found = [votes(t or "", (t or "").split()) for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["pattern"])

    return docs.select(F.col(text_col).alias("_text")).mapInArrow(tidy(run), "pattern string")


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS) -> QualityModel:
    """Labels from the votes on all documents, and a scorer that learns them.

    The features of the sample, which ``train_rows`` bounds, go to one task and
    are learned there in the order of the rows' hashes, so the model is the
    same however the table is partitioned.
    """
    bound_batches(docs.sparkSession)
    counted = _patterns(docs, text_col).groupBy("pattern").count().collect()  # at most 3 ** 7 patterns
    posterior = estimate({r["pattern"]: r["count"] for r in counted})
    total = sum(r["count"] for r in counted)
    key = F.xxhash64(F.lit("train"), F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(key.alias("_key"), F.col(text_col).alias("_text"))
    if total > train_rows:
        rows = rows.where(F.pmod("_key", F.lit(total)) < train_rows)

    def describe(batches):
        for batch in batches:
            for part in split_batch(batch, "_text", 4 << 20):
                label, at, value = [], [], []
                for t in part.column(1).to_pylist():
                    words = (t or "").split()
                    label.append(posterior[votes(t or "", words)])
                    bucket, v = features(words)
                    buckets, where = np.unique(bucket, return_inverse=True)
                    at.append(buckets.astype(np.int32))
                    value.append(np.bincount(where, v, len(buckets)).astype(np.float32))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(label, pa.float64()), pa.array(at, pa.list_(pa.int32())), pa.array(value, pa.list_(pa.float32()))], names=["_key", "label", "at", "value"])

    def learn(batches):
        held = []
        for batch in batches:
            for label, at, value in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                held.append((at.values.to_numpy(), value.values.to_numpy(zero_copy_only=False), label))
        yield pa.RecordBatch.from_arrays([pa.array([train(held)], pa.list_(pa.float64()))], names=["w"])

    sample = stored(rows.mapInArrow(tidy(describe), "_key long, label double, at array<int>, value array<float>"))
    found = sample.repartition(1).sortWithinPartitions("_key", "label").mapInArrow(tidy(learn), "w array<double>").collect()
    w = np.array(found[0].w) if found else np.zeros(BUCKETS + 1)
    return QualityModel(posterior, w[1:], float(w[0]))


def score(docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, votes, posterior, score, predicted.

    Null text is empty, and empty text is scored as it is, by the bias alone.
    Very long texts are scored whole.  Repeated rows and null ids get a row
    each; an empty table gives none; other columns, whatever their names, are
    ignored.
    """

    def run(batches):
        for batch in batches:
            for part in split_batch(batch, "_text", 4 << 20):
                out = []
                for t in part.column(1).to_pylist():
                    words = (t or "").split()
                    pattern = votes(t or "", words)
                    out.append((pattern, model.posterior.get(pattern, 0.5), model.score(words)))
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array([o[i] for o in out], k) for i, k in enumerate((pa.string(), pa.float64(), pa.float64())))], names=["doc_id", "votes", "posterior", "score"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("_text"))
    out = rows.mapInArrow(tidy(run), "doc_id long, votes string, posterior double, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
