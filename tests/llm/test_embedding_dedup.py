"""Near-duplicate vectors against all pairs of a label."""

import numpy as np
import pytest

from siftline.llm import embedding_dedup as e


def usable(i, v, label):
    return i is not None and label is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)


def brute(rows, threshold=0.93):
    """(vec_id, n_links, component_id, kept) of every row."""
    n, out = len(rows), []
    links = [set() for _ in rows]
    ok = [usable(*r) for r in rows]
    unit = [np.array(r[1], float) / np.sqrt(np.square(np.array(r[1], float)).sum()) if k else None for r, k in zip(rows, ok)]
    for a in range(n):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= threshold:
                links[a].add(b)
                links[b].add(a)
    top = {}
    for a in range(n):
        if a in top:
            continue
        seen, todo = {a}, [a]
        while todo:
            for x in links[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        for x in seen:
            top[x] = min((rows[y][0] for y in seen if rows[y][0] is not None), default=None)
    for a, r in enumerate(rows):
        out.append((r[0], len(links[a]), top[a], r[0] is None or r[0] == top[a]))
    return sorted(out, key=repr)


def near(x, r, spread):
    y = x + r.normal(size=len(x)) * spread * np.linalg.norm(x) / np.sqrt(len(x))
    return y


def fixture(seed=3, dim=16):
    r = np.random.default_rng(seed)
    vectors = []
    for _ in range(60):
        x = r.normal(size=dim)
        vectors += [x] + [near(x, r, 0.25) for _ in range(int(r.integers(0, 4)))]
    hot = r.normal(size=dim)
    vectors += [hot] * 40 + [near(hot, r, 0.1) for _ in range(60)] + [near(hot, r, 0.38) for _ in range(25)]
    vectors += [x * s for x, s in zip(vectors[:10], (2.0, 1e-20, 1e15, 0.5, 3, 4, 5, 6, 7, 8))]
    rows = [(int(i) + 5, [float(np.float32(x)) for x in v], int(k)) for i, (v, k) in enumerate(zip(vectors, r.integers(0, 2, len(vectors))))]
    rows = [rows[i] for i in r.permutation(len(rows))]
    bad = [(900, None, 1), (901, [], 1), (902, [0.0] * dim, 1), (903, [None] + [1.0] * (dim - 1), 1), (904, [float("nan")] * dim, 1), (905, [float("inf")] + [1.0] * (dim - 1), 0)]
    bad += [(906, rows[0][1], None), (None, rows[0][1], rows[0][2]), (907, [1.0, 0.0], 1), (908, [1.0, -0.0], 1), (909, [0.999, 0.01], 1)]
    return rows + bad + rows[:5] + [(rows[0][0], rows[9][1], rows[9][2])]


@pytest.mark.parametrize("how", [e.Search(), e.Search(window=16, block=64, tile=30, passes_at_once=5), e.Search(window=8, block=8, tile=8, recall=0.999999, passes_at_once=40)])
def test_equals_brute_force(spark, how):
    rows = fixture()
    df = spark.createDataFrame([(*x, 1, "y") for x in rows], "vec_id long, embedding array<float>, label int, node int, dim string").repartition(4)
    got = sorted((tuple(x) for x in e.near_vectors(df, how).collect()), key=repr)
    assert got == brute(rows)


def test_doubles_strings_and_empty(spark):
    rows = [(1, [1e200, 1e200], "a"), (2, [1e-200, 1.01e-200], "a"), (3, [1e200, 1e200], "b")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = sorted(tuple(x) for x in e.near_vectors(df).collect())
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
    assert e.near_vectors(df.limit(0)).collect() == []


def test_passes_follow_the_largest_label():
    assert [e.n_passes(n, e.Search()) for n in (0, 1, 128)] == [1, 1, 1]
    assert e.n_passes(1000, e.Search()) < e.n_passes(100_000, e.Search()) < e.n_passes(10**9, e.Search()) < 200


def test_recall_of_pairs_at_the_threshold(spark):
    """Pairs just above the threshold in a crowd many windows large."""
    r = np.random.default_rng(8)
    crowd = r.normal(size=(3000, 12))
    crowd[:, :2] += 4  # signs that tell little
    crowd /= np.linalg.norm(crowd, axis=1, keepdims=True)
    other = r.normal(size=(200, 12))
    other -= (other * crowd[:200]).sum(axis=1, keepdims=True) * crowd[:200]
    other /= np.linalg.norm(other, axis=1, keepdims=True)
    twins = 0.935 * crowd[:200] + np.sqrt(1 - 0.935**2) * other
    x = np.concatenate((crowd, twins)).astype(np.float32)
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.93).sum(axis=1) - 1
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {v.vec_id: v.n_links for v in e.near_vectors(df, e.Search(window=64, recall=0.99)).collect()}
    got = np.array([got[i] for i in range(len(x))])
    assert (got <= want).all()
    assert got.sum() >= 0.97 * want.sum()
