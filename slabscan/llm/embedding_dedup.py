"""Near-duplicate vectors by a pivot-permutation index.

Each vector is described by its nearest reference points (pivots), nearest
first.  Pivots come from a bounded sample, and no two are closer than
``SPACING``: a dense group of vectors has hardly more than one pivot of its
own, so its members agree on it.  Inverted lists hold, for each label and
pivot, the vectors that have the pivot in their description.  A vector is at
home in the list of its nearest pivot.  Pairs of which at least one is at home
in a list are retrieved there, their shared pivots are counted, and those that
share ``SHARED`` or more are verified by their cosine.  A pair that two lists
retrieve counts in the one with the smaller pivot.

Long lists are dealt into parts, and every pair of parts is a unit of work, so
nothing is capped.  A unit gives a count of links and a local component for
each vector, never its pairs.  Equal vectors are one class from the start.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from slabscan.llm.common import bound_batches, stored, tidy
from slabscan.llm.components import connected_components, roots

COSINE = 0.93
#: Distinct vectors for each pivot, bounds of the number of pivots, and numbers that all pivots hold together.
PER_PIVOT = 24
LEAST_PIVOTS, MOST_PIVOTS = 16, 65_536
PIVOT_NUMBERS = 8_000_000
#: The largest cosine of two pivots.
SPACING = 0.6
#: Pivots that describe a vector, and those that candidates share at least.
PREFIX = 10
SHARED = 2
#: Vectors of a part of a long list, and how many of them are compared at once.
PART = 4096
STRIP = 256


def _valid(vec: str, label: str):
    x = F.col(vec)
    number = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.col(label).isNotNull() & x.isNotNull() & F.coalesce(number, F.lit(False)) & F.exists(x, lambda v: v != 0)


def unit_rows(lists: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows of length 1; scaled first, so that no square overflows."""
    x = np.asarray(lists.flatten(), float).reshape(len(lists), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def choose_pivots(sample: np.ndarray, most: int, spacing: float = SPACING) -> np.ndarray:
    """Rows of the sample in their order, but for those closer than ``spacing`` to an earlier choice."""
    chosen = np.zeros((0, sample.shape[1]))
    for start in range(0, len(sample), 1024):
        block = sample[start : start + 1024]
        block = block[~(block @ chosen.T >= spacing).any(axis=1)] if len(chosen) else block
        close = block @ block.T >= spacing
        free, own = np.ones(len(block), bool), []
        for i in range(len(block)):
            if free[i]:
                own.append(i)
                free &= ~close[i]
        chosen = np.concatenate([chosen, block[own]])
        if len(chosen) >= most:
            return chosen[:most]
    return chosen


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, prefix: int = PREFIX) -> np.ndarray:
    """The numbers of the nearest pivots of each vector, nearest first; of equal distances the smaller number."""
    k = min(prefix, len(pivots))
    out = np.empty((len(vectors), k), np.int32)
    step = max(1, 8_000_000 // len(pivots))
    for start in range(0, len(vectors), step):
        near = vectors[start : start + step] @ pivots.T
        some = np.sort(np.argpartition(-near, k - 1, axis=1)[:, :k], axis=1)
        order = np.argsort(-np.take_along_axis(near, some, axis=1), axis=1, kind="stable")
        out[start : start + step] = np.take_along_axis(some, order, axis=1)
    return out


class Unit:
    """The vectors of one pair of parts of the list of ``pivot``: links and local components of pairs with a home vector."""

    def __init__(self, vectors: np.ndarray, prefix: np.ndarray, weight: np.ndarray, pivot: int, cosine: float, shared: int):
        self.vectors, self.prefix, self.weight, self.pivot, self.cosine = vectors, prefix, weight, pivot, cosine
        self.need = min(shared, prefix.shape[1])
        self.links, self.root = np.zeros(len(vectors)), np.arange(len(vectors))

    def _has(self, rows: np.ndarray, names: np.ndarray) -> np.ndarray:
        """Which of the pivots ``names``, in order, each of the rows has in its description."""
        at = np.minimum(np.searchsorted(names, self.prefix[rows]), len(names) - 1)
        hit = names[at] == self.prefix[rows]
        out = np.zeros((len(rows), len(names)), np.float32)
        out[np.nonzero(hit)[0], at[hit]] = 1
        return out

    def compare(self, home: np.ndarray, other: np.ndarray, same: bool = False, visiting: bool = False) -> None:
        """Pairs of home vectors with others: with each other where ``same``, with vectors at home elsewhere where ``visiting``."""
        for start in range(0, len(home) if len(other) else 0, STRIP):
            own = home[start : start + STRIP]
            names = np.unique(self.prefix[own])
            candidate = self._has(own, names) @ self._has(other, names).T >= self.need
            if same:
                candidate &= own[:, None] < other[None, :]
            if visiting:
                # The other one's list retrieves the pair too if the home vector visits it; the smaller pivot counts it.
                homes, where = np.unique(self.prefix[other, 0], return_inverse=True)
                candidate &= ~((self._has(own, homes) > 0) & (homes < self.pivot))[:, where]
            rows, columns = np.flatnonzero(candidate.any(axis=1)), np.flatnonzero(candidate.any(axis=0))
            if not len(rows):
                continue
            a, b = own[rows], other[columns]
            near = (self.vectors[a] @ self.vectors[b].T >= self.cosine) & candidate[np.ix_(rows, columns)]
            self.links[a] += near @ self.weight[b]
            self.links[b] += self.weight[a] @ near
            i, j = np.nonzero(near)
            i, j = self.root[a[i]], self.root[b[j]]
            apart = i != j
            self.root = roots(len(self.root), i[apart], j[apart])[self.root]


def fit_pivots(classes: DataFrame, number: int, per_pivot: int = PER_PIVOT) -> dict[int, np.ndarray]:
    """Pivots for each length of vectors, from a sample of about twice as many distinct vectors as pivots are wanted.

    The sample is drawn by a hash of the vectors and bounded by ``MOST_PIVOTS``
    and ``PIVOT_NUMBERS``; all vectors are indexed.
    """
    length = classes.agg(F.max(F.size("_vec"))).first()[0] or 1
    wanted = min(max(LEAST_PIVOTS, -(-number // per_pivot)), MOST_PIVOTS, max(LEAST_PIVOTS, PIVOT_NUMBERS // length))
    drawn = classes.where(F.pmod(F.xxhash64("_vec"), F.lit(max(number, 1))) < 2 * wanted) if number > 2 * wanted else classes
    sample = drawn.select("_vec").distinct().orderBy(F.xxhash64("_vec"), "_vec").toArrow().column("_vec").combine_chunks()
    sizes = np.asarray(pc.list_value_length(sample))
    return {int(d): choose_pivots(unit_rows(sample.filter(pa.array(sizes == d))), wanted) for d in np.unique(sizes)}


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, part: int = PART, per_pivot: int = PER_PIVOT, prefix: int = PREFIX, shared: int = SHARED) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors of the same label (and length) with a cosine of at least
    ``cosine`` link.  A null label, a null, empty or zero vector and one with a
    null or non-finite component link with nothing.  Rows that repeat an id are
    vectors of their own; a null id is larger than any other.  Pivots at equal
    distance stand in the order of their numbers.  An empty table gives no
    rows; other columns, whatever their names, are ignored.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    kind = vectors.schema[vec_col].dataType
    vec = F.col(vec_col) if isinstance(kind.elementType, (T.FloatType, T.DoubleType)) else F.col(vec_col).cast("array<double>")
    rows = stored(vectors.select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label"), vec.alias("_vec"), _valid(vec_col, label_col).alias("_ok")))
    good = rows.where("_ok")
    classes = good.groupBy("_label", "_vec").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_low"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("_rep"), "_label", "_vec", "_n", "_low"))
    pivots = fit_pivots(classes, classes.count(), per_pivot)
    named = classes.select("_label", "_rep", "_n", "_vec")

    def describe(batches):
        for batch in batches:
            lists = batch.column(3)
            sizes = np.asarray(pc.list_value_length(lists))
            for d in np.unique(sizes).tolist():
                some = batch.filter(pa.array(sizes == d))
                known = pivots.get(d)
                # A length that the sample lacks has one list for all of its vectors.
                near = np.zeros((len(some), 1), np.int32) if known is None else nearest_pivots(unit_rows(some.column(3)), known, prefix)
                at = pa.array(np.arange(0, near.size + 1, near.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(np.full(len(some), d, np.int32)), pa.ListArray.from_arrays(at, pa.array(near.ravel()))], names=["_label", "_rep", "_n", "_vec", "_d", "_prefix"])

    schema = T.StructType([*named.schema.fields, T.StructField("_d", T.IntegerType()), T.StructField("_prefix", T.ArrayType(T.IntegerType()))])
    described = stored(named.mapInArrow(tidy(describe), schema))
    entries = described.select("*", F.posexplode("_prefix").alias("_rank", "_pivot")).withColumn("_home", F.col("_rank") == 0).drop("_rank")
    key = ["_label", "_d", "_pivot"]
    # One row for each list of several parts, so at most one for `part` entries.
    sized = entries.groupBy(*key).agg(F.count(F.when(F.col("_home"), 1)).alias("_h"), F.count(F.when(~F.col("_home"), 1)).alias("_v")).where(F.col("_h") + F.col("_v") > part)
    long = sized.select(*key, F.ceil(F.col("_h") / part).cast("int").alias("_hp"), F.greatest(F.ceil(F.col("_v") / part), F.lit(1)).cast("int").alias("_vp"))
    placed = entries.join(F.broadcast(long), key, "left").withColumns({"_hp": F.coalesce("_hp", F.lit(1)), "_vp": F.coalesce("_vp", F.lit(1))}).where("_hp > 0")
    placed = placed.withColumn("_side", F.pmod(F.xxhash64("_rep"), F.when(F.col("_home"), F.col("_hp")).otherwise(F.col("_vp"))).cast("int"))
    pair = lambda a, b: F.struct(a.alias("i"), b.alias("j"))
    side, homes, visitors = F.col("_side"), F.sequence(F.lit(0), F.col("_hp") - 1), F.sequence(F.lit(0), F.col("_vp") - 1)
    with_homes = F.transform(homes, lambda p: pair(F.least(p, side), F.greatest(p, side)))
    with_visitors = F.when(F.col("_vp") > 1, F.transform(visitors, lambda v: pair(side, F.col("_hp") + v))).otherwise(F.array().cast("array<struct<i:int,j:int>>"))
    visits = F.transform(homes, lambda p: pair(p, F.when(F.col("_vp") > 1, F.col("_hp") + side).otherwise(p)))
    units = F.when(F.col("_home"), F.concat(with_homes, with_visitors)).otherwise(visits)
    dealt = placed.select(*key, F.explode(units).alias("_unit"), "_home", "_side", "_rep", "_n", "_vec", "_prefix").select(*key, "_unit.i", "_unit.j", "_home", "_side", "_rep", "_n", "_vec", "_prefix")
    unit = [*key, "i", "j"]
    ordered = dealt.repartition(*unit).sortWithinPartitions(*unit)

    def solve(held: list[pa.RecordBatch]):
        column = lambda c: np.concatenate([np.asarray(b.column(c)) for b in held])
        pivot, i, j = (held[0].column(c)[0].as_py() for c in ("_pivot", "i", "j"))
        home, at, reps = column("_home"), column("_side"), column("_rep")
        own, far = np.flatnonzero(home & (at == i)), np.flatnonzero(home & (at != i))
        visiting = np.flatnonzero(~home)
        if len(own) and len(reps) > 1:
            described = np.concatenate([np.asarray(b.column("_prefix").flatten()).reshape(len(b), -1) for b in held])
            work = Unit(np.concatenate([unit_rows(b.column("_vec")) for b in held]), described, column("_n").astype(float), pivot, cosine, shared)
            if i == j:
                work.compare(own, own, same=True)
            work.compare(own, far)
            work.compare(own, visiting, visiting=True)
            hit = np.flatnonzero(work.links)
            return pa.RecordBatch.from_arrays([pa.array(reps[hit]), pa.array(work.links[hit].astype(np.int64)), pa.array(reps[work.root[hit]])], names=["a", "links", "b"])
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, names=["a", "links", "b"])

    def link(batches):
        held: list[pa.RecordBatch] = []
        names = lambda b: b.slice(len(b) - 1).select(unit).to_pylist() if len(b) else []
        for batch in batches:
            if not len(batch):
                continue
            new = np.zeros(len(batch) - 1, bool)
            for c in unit:
                new |= np.asarray(pc.not_equal(batch.column(c).slice(1), batch.column(c).slice(0, len(batch) - 1)))
            if held and names(held[-1]) != batch.slice(0, 1).select(unit).to_pylist():
                yield solve(held)
                held = []
            ends = [*(np.flatnonzero(new) + 1).tolist(), len(batch)]
            for start, end in zip([0, *ends[:-1]], ends, strict=True):
                if start:
                    yield solve(held)
                    held = []
                held.append(batch.slice(start, end - start))
        if held:
            yield solve(held)

    found = stored(ordered.mapInArrow(tidy(link), "a long, links long, b long"))
    groups = connected_components(found)
    counts = found.groupBy("a").agg(F.sum("links").alias("_links"))
    state = classes.select("_rep", "_label", "_vec", "_n", "_low").join(counts.hint("merge"), F.col("_rep") == F.col("a"), "left").join(groups.hint("merge"), F.col("_rep") == F.col("node"), "left")
    state = stored(state.select("_rep", "_label", "_vec", "_low", (F.col("_n") - 1 + F.coalesce("_links", F.lit(0))).alias("n_links"), F.coalesce("component", "_rep").alias("_group")))
    tops = stored(state.groupBy("_group").agg(F.min("_low").alias("component_id")))
    told = stored(state.join(tops.hint("merge"), "_group").select("_label", "_vec", "n_links", "component_id"))
    linked = good.join(told.hint("merge"), ["_label", "_vec"]).select(F.col("_id").alias(id_col), "n_links", "component_id")
    alone = rows.where("not _ok").select(F.col("_id").alias(id_col), F.lit(0).cast("bigint").alias("n_links"), F.col("_id").alias("component_id"))
    return linked.unionByName(alone).select(id_col, "n_links", "component_id", F.col(id_col).eqNullSafe(F.col("component_id")).alias("kept"))
