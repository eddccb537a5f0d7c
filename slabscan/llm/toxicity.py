"""Toxic passages as maximum-scoring segments of token log-odds.

Token weights are log-odds between toxic and clean labelled documents with an
informative Dirichlet prior, reduced by some standard deviations towards zero,
of the tokens that pass a false-discovery rate when near copies of a text count
as one text.  Every token also costs a drift, so clean text scores below zero.  A
linear scan finds all maximal scoring segments of a document.  Their scores
are calibrated by the extreme-value law of segment scores in clean text: of m
tokens, segments of score s or more are expected K m exp(-lambda s) times.
Segments with an expectation of at most ``SIGNIFICANT`` are passages; the
document's score is a logistic function of its best segment's expectation, the
sum of its passages' scores and their number.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slabscan.llm.common import bound_batches, mix64, split_batch, stored, tidy

WORD = re.compile(r"\w+")
#: Bounds of the model: labelled rows that are learned from, tokens with a weight.
TRAIN_ROWS = 400_000
VOCABULARY = 20_000
MIN_TOXIC_DOCS = 3
PRIOR_SHARE = 0.005
#: Weights are reduced by so many standard deviations.
Z = 2.0
#: Share of tokens with a weight that may have it by chance.
FALSE_SHARE = 0.05
#: Copies of a text are told by the smallest hashes of its shingles of so many words, under so many orders.
SHINGLE = 5
ORDERS = 7
_ODD = mix64(np.arange(1, ORDERS + 1)) | np.uint64(1)
LARGEST = 10.0
DRIFT = 0.3
SIGNIFICANT = 0.05
STRONGEST = 50.0
FEATURES = 3


@dataclass
class ToxicModel:
    weights: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0
    k: float = 1.0
    coefficients: tuple[float, ...] = (0.0,) * (FEATURES + 1)

    def expected(self, tokens: int, score: float) -> float:
        return self.k * max(tokens, 1) * math.exp(-min(self.rate * score, 700.0))

    def features(self, tokens: int, segments: list[tuple[int, int, float]]) -> tuple[float, ...]:
        best = max((s for _, _, s in segments), default=0.0)
        passages = [s for _, _, s in segments if self.expected(tokens, s) <= SIGNIFICANT]
        surprise = min(self.rate * best, STRONGEST) - math.log(self.k * max(tokens, 1))
        return (surprise, math.log1p(self.rate * sum(passages)), math.log1p(len(passages)))

    def probability(self, features: tuple[float, ...]) -> float:
        x = self.coefficients[0] + sum(c * f for c, f in zip(self.coefficients[1:], features, strict=True))
        return 1 / (1 + math.exp(-min(30.0, max(-30.0, x))))


def scan(words: list[str], weights: dict[str, float], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """(first word, word after the last, score) of all maximal scoring segments, in linear time.

    Only words with a weight above the drift can open a segment; the words
    between them only add to the running sum.
    """
    found: list[list[float]] = []  # start, end, sum before, sum up to the end
    total, last = 0.0, -1
    for at, word in enumerate(words):
        w = weights.get(word)
        if w is None:
            continue
        total -= drift * (at - last)
        last = at
        before, total = total, total + w
        if w <= drift:
            continue
        # Before the word is before its own drift, which belongs to its segment.
        now = [at, at + 1, before + drift, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= now[2]:
                j -= 1
            if j < 0 or found[j][3] >= now[3]:
                break
            now = [found[j][0], now[1], found[j][2], now[3]]
            del found[j:]
        found.append(now)
    return [(int(a), int(b), r - left) for a, b, left, r in found]


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: CRC-32 of its id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def training_labels(labels: DataFrame, max_rows: int = TRAIN_ROWS) -> DataFrame:
    """(doc_id, toxic) to learn from: of ids with several labels the largest, at most about ``max_rows`` by a hash of the id."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    known = stored(known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("_toxic")))
    n = known.count()
    if n > max_rows:
        known = known.where(F.pmod(F.xxhash64(F.lit("train"), "doc_id"), F.lit(n)) < max_rows)
    return known


def sketches(words: list[str], label: int) -> np.ndarray:
    """A key for the label and the smallest shingle under each order; near copies share most of them, other texts few."""
    h = mix64(np.array([zlib.crc32(w.encode("utf-8", "replace")) for w in words] or [0], np.uint64) + np.uint64(1))
    k = min(SHINGLE, len(h))
    n = len(h) - k + 1
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = mix64(total + h[j : j + n])
    least = np.array([(total * odd).min() for odd in _ODD])
    return mix64(least + np.arange(ORDERS, dtype=np.uint64) * np.uint64(2) + np.uint64(bool(label))).view(np.int64)


def _copies(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The keys that several of the training rows have, in order, and how many have them; the rows are bounded."""

    def run(batches):
        for batch in batches:
            for part in split_batch(batch, "text", 1 << 20):
                texts = zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
                keys = np.concatenate([sketches(WORD.findall((t or "").lower()), y) for t, y in texts])
                yield pa.RecordBatch.from_arrays([pa.array(keys)], names=["key"])

    found = rows.select("text", "_toxic").mapInArrow(tidy(run), "key long").groupBy("key").count().where("count > 1").toArrow()
    keys, counts = (found.column(c).to_numpy() for c in ("key", "count"))
    order = np.argsort(keys)
    return keys[order], counts[order].astype(np.int32)


def _texts_of(keys: np.ndarray, counts: np.ndarray, own: np.ndarray) -> int:
    """How many rows are copies of the one with the keys ``own``, itself included: the median over the orders."""
    if not len(keys):
        return 1
    at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
    return int(np.median(np.where(keys[at] == own, counts[at], 1)))


def _token_counts(rows: DataFrame) -> DataFrame:
    """(token, toxic_docs, clean_docs, in_clean, toxic_copies, clean_copies), summed in each task before the shuffle.

    Weights come from numbers of documents, so that a word that one document
    repeats a thousand times counts once; the calibration needs occurrences.
    Copies are documents beyond the first of each text, shared among all of it.
    """
    names = ["token", "toxic_docs", "clean_docs", "in_clean", "toxic_copies", "clean_copies"]
    keys, shared = _copies(rows)

    def run(batches):
        toxic: Counter[str] = Counter()
        clean: Counter[str] = Counter()
        uses: Counter[str] = Counter()
        again: tuple[Counter[str], Counter[str]] = (Counter(), Counter())

        def rows_of():
            tokens = list(toxic.keys() | clean.keys())
            counts = [pa.array([c[t] for t in tokens], pa.int64()) for c in (toxic, clean, uses)]
            extra = [pa.array([float(c[t]) for t in tokens], pa.float64()) for c in (again[1], again[0])]
            out = pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), *counts, *extra], names=names)
            for c in (toxic, clean, uses, *again):
                c.clear()
            return out

        for batch in batches:
            for part in split_batch(batch, "text", 1 << 20):
                for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = WORD.findall((text or "").lower())
                    once = set(words)
                    if label:
                        toxic.update(once)
                    else:
                        clean.update(once)
                        uses.update(words)
                    n = _texts_of(keys, shared, sketches(words, label))
                    if n > 1:
                        more = again[bool(label)]
                        for word in once:
                            more[word] += 1 - 1 / n
                if len(toxic) + len(clean) > 200_000:
                    yield rows_of()
        yield rows_of()

    parts = rows.select("text", "_toxic").mapInArrow(tidy(run), "token string, toxic_docs long, clean_docs long, in_clean long, toxic_copies double, clean_copies double")
    return parts.groupBy("token").agg(*(F.sum(c).alias(c) for c in names[1:]))


def _bar(able: DataFrame) -> float:
    """The least ``z`` that keeps the false-discovery rate of Benjamini and Hochberg, in steps of 0.01."""
    steps = able.groupBy(F.floor(F.abs("z") * 100).alias("step")).count().orderBy(F.desc("step")).collect()
    total = sum(r["count"] for r in steps)
    bar, kept = math.inf, 0
    for r in steps:
        kept += r["count"]
        if math.erfc(r.step / 100 / math.sqrt(2)) * total <= FALSE_SHARE * kept:
            bar = r.step / 100
    return bar


def _weights(counts: DataFrame, toxic_share: float) -> tuple[dict[str, float], dict[str, int], int]:
    """Weights of the tokens with the largest ones, how often each is in clean text, and the clean tokens."""
    n_toxic, n_clean, used = counts.agg(*(F.coalesce(F.sum(c), F.lit(0)) for c in ("toxic_docs", "clean_docs", "in_clean"))).first()
    if not n_toxic or not n_clean:
        return {}, {}, 0
    mass = max(1000.0, PRIOR_SHARE * (n_toxic + n_clean))
    prior = F.lit(mass / (n_toxic + n_clean)) * (F.col("toxic_docs") + F.col("clean_docs"))
    # Half a document at least: none seen is no proof that there are none.
    a, b = (F.greatest(F.col(c) + prior, F.lit(0.5)) for c in ("toxic_docs", "clean_docs"))
    odds = F.log(a / (F.lit(n_toxic + mass) - a)) - F.log(b / (F.lit(n_clean + mass) - b))
    spread = F.sqrt(1 / a + 1 / b)
    # Significance is that of the texts: the signed root of the binomial deviance from the share of toxic documents, with
    # half a text taken off.  All copies of a wrongly labelled text are one text, so its words don't pass by their number.
    k, n = F.col("toxic_docs") - F.col("toxic_copies"), F.col("toxic_docs") - F.col("toxic_copies") + F.col("clean_docs") - F.col("clean_copies")
    gap = k - n * toxic_share
    near = k - F.signum(gap) * F.least(F.abs(gap), F.lit(0.5))
    part = lambda x, share: F.when(x > 0, x * F.log(x / (n * share))).otherwise(0.0)
    deviance = F.greatest(2 * (part(near, toxic_share) + part(n - near, 1 - toxic_share)), F.lit(0.0))
    able = counts.where(F.col("toxic_docs") >= MIN_TOXIC_DOCS).withColumns({"odds": odds, "spread": spread, "z": F.signum(gap) * F.sqrt(deviance)})
    able = stored(able.where("z is not null"))
    shrunk = F.signum("odds") * F.greatest(F.abs("odds") - Z * F.col("spread"), F.lit(0.0))
    weighed = able.where(F.abs("z") >= _bar(able)).withColumn("w", F.least(shrunk, F.lit(LARGEST))).where("abs(w) > 0.05 and signum(w) = signum(z)")
    top = weighed.orderBy(F.desc(F.abs("w")), "token").limit(VOCABULARY).select("token", "w", "in_clean").collect()
    return {r.token: r.w for r in top}, {r.token: r.in_clean for r in top}, used


def _decay(weights: dict[str, float], clean: dict[str, int], n_clean: int) -> float:
    """The positive root of the mean of exp(rate * score) over clean tokens = 1."""
    w = np.array([weights[t] for t in weights], float) - DRIFT
    p = np.array([clean[t] + 0.5 for t in weights], float)
    p /= max(n_clean, 1) + 0.5 * len(p)
    rest = max(1 - p.sum(), 0.0)
    f = lambda rate: rest * math.exp(-rate * DRIFT) + float((p * np.exp(rate * w)).sum()) - 1
    low, high = 1e-6, 20.0
    if len(w) == 0 or w.max() <= 0 or f(high) <= 0:
        return 1.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return high


def _segments(rows: DataFrame, model: ToxicModel) -> DataFrame:
    """(label, number of tokens, scores of all segments) of the training rows."""
    weights = model.weights

    def run(batches):
        for batch in batches:
            for part in split_batch(batch, "text", 1 << 20):
                out = []
                for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    words = WORD.findall((text or "").lower())
                    out.append((label, len(words), [s for _, _, s in scan(words, weights)]))
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.list_(pa.float64()))], names=["label", "tokens", "scores"])

    return rows.select("text", "_toxic").mapInArrow(tidy(run), "label int, tokens long, scores array<double>")


def _features(segments: DataFrame, model: ToxicModel) -> tuple[np.ndarray, np.ndarray]:
    """The features and labels of the training rows, which are bounded, from all their segments as in scoring."""

    def run(batches):
        for batch in batches:
            known = zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)
            x = [model.features(tokens, [(0, 0, s) for s in scores]) for tokens, scores in known]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[i] for f in x], pa.float64()) for i in range(FEATURES))], names=["label", *(f"f{i}" for i in range(FEATURES))])

    found = segments.mapInArrow(tidy(run), "label int, " + ", ".join(f"f{i} double" for i in range(FEATURES))).toArrow()
    return np.column_stack([found.column(f"f{i}").to_numpy() for i in range(FEATURES)]), found.column("label").to_numpy().astype(float)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Coefficients, intercept first, by Newton's steps."""
    x = np.hstack([np.ones((len(x), 1)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        step = np.linalg.solve(hessian, x.T @ (y - p) - ridge * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> ToxicModel:
    """A model from the labelled documents that are not held out, at most ``max_rows``.

    ``labels`` has doc_id and toxic; rows where either is null are left out,
    and of an id's labels the largest holds.  Without any toxic or any clean
    document, or with an empty table, every score is the share of toxic
    labels, smoothed by one of each kind.
    """
    bound_batches(docs.sparkSession)
    # The labels are bounded by max_rows, 16 bytes each, so they may be broadcast.
    known = training_labels(labels, max_rows)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(known), "doc_id")
    counts = stored(_token_counts(rows))
    toxic_share = known.agg(F.avg("_toxic")).first()[0] or 0.0
    weights, clean, n_clean = _weights(counts, toxic_share)
    model = ToxicModel(weights)
    segments = stored(_segments(rows, model))
    known = segments.select("label", "tokens", F.greatest(F.coalesce(F.array_max("scores"), F.lit(0.0)), F.lit(0.0)).alias("best")).toArrow()
    y, tokens, best = (known.column(c).to_numpy().astype(float) for c in ("label", "tokens", "best"))
    if len(set(y.tolist())) < 2:
        share = (y.sum() + 1) / (len(y) + 2)
        model.coefficients = (math.log(share / (1 - share)), *(0.0,) * FEATURES)
        return model
    model.rate = _decay(weights, clean, n_clean)
    # exp(-rate * best score) is exponential with mean 1 / (K m) in clean text.
    background = (np.maximum(tokens, 1) * np.exp(-model.rate * best))[y == 0]
    model.k = float(len(background) / background.sum())
    x, y = _features(segments, model)
    model.coefficients = tuple(float(c) for c in _logistic(x, y))
    return model


def score(docs: DataFrame, model: ToxicModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, held_out, score, predicted, passages.

    A passage is (start, end, score, expected): character offsets in the text,
    the segment's score, and how often clean text as long has one as good.
    Null text is empty; repeated rows and null ids get a row each; very long
    texts are scanned whole; an empty table gives no rows; other columns,
    whatever their names, are ignored.
    """

    def run(batches):
        passage = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())]))
        for batch in batches:
            for part in split_batch(batch, "text", 1 << 20):
                scores, passages = [], []
                for text in part.column(2).to_pylist():
                    text = text or ""
                    words = WORD.findall(text.lower())
                    segments = scan(words, model.weights)
                    scores.append(model.probability(model.features(len(words), segments)))
                    best = [(a, b, s, e) for a, b, s in segments for e in [model.expected(len(words), s)] if e <= SIGNIFICANT]
                    spans = [m.span() for m in WORD.finditer(text)] if best else []
                    # Lower-casing a few letters changes the number of words; such passages have no offsets.
                    fits = len(spans) == len(words)
                    passages.append([{"start": spans[a][0] if fits else None, "end": spans[b - 1][1] if fits else None, "score": s, "expected": e} for a, b, s, e in best])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores, pa.float64()), pa.array(passages, passage)], names=["doc_id", "held_out", "score", "passages"])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(tidy(run), "doc_id long, held_out boolean, score double, passages array<struct<start:long,end:long,score:double,expected:double>>")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")


def reject_toxic(docs: DataFrame, model: ToxicModel, text_col: str = "text") -> DataFrame:
    """The rows whose text is not predicted toxic, with all their columns, in one pass without a shuffle."""
    schema = docs.schema
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            for part in split_batch(batch, text_col, 1 << 20):
                keep = []
                for text in part.column(at).to_pylist():
                    words = WORD.findall((text or "").lower())
                    keep.append(model.probability(model.features(len(words), scan(words, model.weights))) < 0.5)
                yield part.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(tidy(run), schema)
