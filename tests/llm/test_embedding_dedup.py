import numpy as np
import pytest

from slabscan.llm import queries
from slabscan.llm.embedding_dedup import SPACING, choose_pivots, near_vectors, nearest_pivots


def brute(rows, cosine=0.93):
    n = len(rows)
    good = [lab is not None and v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v, lab in rows]
    unit = [np.array(v, float) / np.linalg.norm(np.array(v, float)) if g else None for g, (_, v, _) in zip(good, rows, strict=True)]
    root, links = list(range(n)), [0] * n
    by = {}
    for i in range(n):
        if good[i]:
            by.setdefault((rows[i][2], len(unit[i])), []).append(i)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for members in by.values():
        x = np.array([unit[i] for i in members])
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= cosine, 1)), strict=True):
            i, j = members[a], members[b]
            links[i] += 1
            links[j] += 1
            p, q = find(i), find(j)
            root[max(p, q)] = min(p, q)
    least = {}
    for i in range(n):
        key = rows[i][0]
        f = find(i)
        if key is not None and (f not in least or key < least[f]):
            least[f] = key
    return sorted(((rows[i][0], links[i], least.get(find(i))) for i in range(n)), key=repr)


@pytest.mark.parametrize("part", [1024, 40])
def test_cases(spark, part):
    rng = np.random.default_rng(0)
    rows = []
    for c in range(12):
        centre = rng.normal(size=16)
        for _ in range(30):
            rows.append([len(rows), (centre + rng.normal(size=16) * rng.choice([0.02, 0.1, 0.3])).astype(np.float32).tolist(), int(c % 3)])
    rows += [[1000 + i, rows[5][1], rows[5][2]] for i in range(60)] + [[2000, rows[5][1], 1 - rows[5][2]], [2001, None, 1], [2002, [0.0] * 16, 1], [2003, rows[7][1], None]]
    rows += [[2004, [float("nan")] * 16, 1], [2005, [None] + [1.0] * 15, 1], [2006, [], 1], [2007, [1.0, 2.0], 1], [2008, [2.0, 4.0], 1], [None, rows[9][1], rows[9][2]], [9, rows[9][1], rows[9][2]], [2009, [1e38] * 16, 1], [2010, [2e38] * 16, 1], [2011, [float("inf")] * 16, 1]]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, _rep string").repartition(3)
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in near_vectors(df, part=part).collect()), key=repr)
    want = brute(rows)
    assert got == want
    kept = {(r.vec_id, r.component_id) for r in near_vectors(df, part=part).collect() if r.kept}
    assert all(a == b for a, b in kept)
    assert near_vectors(df.limit(0)).collect() == []


def test_query(spark):
    """All rows of the query on a table without links of distinct vectors, and with all copies linked."""
    sf = "/root/testdata/sf0.1"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in queries.op4_embedding_dedup(spark, sf).collect()), key=repr)
    assert got == brute(rows)


def scattered_pairs(n, rng):
    """Pairs of distinct vectors with a cosine of about 0.935, in no group."""
    x = rng.normal(size=(n // 2, 64))
    return np.concatenate([x, x + rng.normal(size=x.shape) * 0.38])


@pytest.mark.parametrize("n", [2_000, 12_000])
def test_recall_of_scattered_pairs(spark, n):
    """The links that the index finds, of all that there are, at two sizes; each found one is a link."""
    x = scattered_pairs(n, np.random.default_rng(3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.93
    want = near.sum(axis=1) - 1
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int").repartition(8)
    rows = {r.vec_id: r for r in near_vectors(df).collect()}
    found = np.array([rows[i].n_links for i in range(n)])
    print("recall", found.sum() / want.sum(), want.sum())
    assert (found <= want).all() and found.sum() >= 0.98 * want.sum() > 500
    linked = np.flatnonzero(found)
    assert all(rows[i].component_id == i % (n // 2) for i in linked.tolist() if want[i] == 1)


def test_pivots_are_apart_and_ordered():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    pivots = choose_pivots(x, 500)
    close = pivots @ pivots.T
    assert (close[np.triu_indices(len(pivots), 1)] < SPACING).all() and (x @ pivots.T).max(axis=1).min() >= SPACING - 1e-9
    near = nearest_pivots(x, pivots, 5)
    assert (near == np.argsort(-(x @ pivots.T), axis=1, kind="stable")[:, :5]).all()
    assert nearest_pivots(x[:2], np.repeat(pivots[:1], 4, axis=0), 3).tolist() == [[0, 1, 2]] * 2


def test_dense_group(spark):
    """No link is missed in a group that holds a third of a table of 15,000 distinct vectors."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(15_000, 64))
    x[:5_000] = rng.normal(size=64) + rng.normal(size=(5_000, 64)) * 0.23
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= 0.93
    want = near.sum(axis=1) - 1
    assert want[:5_000].sum() > 1_000_000
    df = spark.createDataFrame([(i, v, 1) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int").repartition(8)
    rows = {r.vec_id: r for r in near_vectors(df).collect()}
    print("links", sum(r.n_links for r in rows.values()), want.sum())
    assert [rows[i].n_links for i in range(len(x))] == want.tolist()
    assert {rows[i].component_id for i in np.flatnonzero(want)} == {0}
