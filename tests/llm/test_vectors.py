import numpy as np
import pytest

from tidemark.llm.vectors import encode, estimates, near_vectors, rotation, unit

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def brute(rows, cosine=0.98):
    ok = [r[0] is not None and r[2] is not None and bool(r[1]) and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    v = [unit(np.array([r[1]], dtype=np.float32))[0] if k else None for r, k in zip(rows, ok)]
    parent = {r[0]: r[0] for r in rows if r[0] is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i + 1, len(rows)):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(v[i]) == len(v[j]) and v[i] @ v[j] >= cosine:
                links[i] += 1
                links[j] += 1
                a, b = sorted((top(rows[i][0]), top(rows[j][0])))
                parent[b] = a
    return sorted(((r[0], n, None if r[0] is None else top(r[0])) for r, n in zip(rows, links)), key=str)


def got(spark, rows, **more):
    out = near_vectors(spark.createDataFrame(rows, SCHEMA), **more).collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in out), key=str)


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(1)
    a, b = unit(rng.standard_normal((4000, 64))), unit(rng.standard_normal((4000, 64)))
    codes, factors = encode(a, 5)
    guess, wide = estimates(codes, factors, (b @ rotation(64, 5).T).astype(np.float32), 5.0)
    true = np.einsum("ij,ij->i", a, b)
    assert abs((guess - true).mean()) < 0.01
    assert (np.abs(guess - true) <= wide).all()


@pytest.mark.parametrize("block", [4, 512])
def test_clusters_match_brute_force(spark, block):
    rng = np.random.default_rng(2)
    rows, k = [], 0
    for c in range(12):
        centre = rng.standard_normal(16)
        for _ in range(20):
            x = centre + rng.standard_normal(16) * rng.choice([0.02, 0.1, 0.15])
            for _ in range(rng.integers(1, 3)):
                rows.append((int(k), [float(np.float32(y)) for y in x], int(c % 3), "x"))
                k += 1
    rng.shuffle(rows)
    rows = [(int(a), [float(x) for x in b], int(c), d) for a, b, c, d in rows]
    assert got(spark, rows, block=block) == brute(rows)


def test_odd_rows(spark):
    v, w = [1.0, 2.0, 3.0], [3.0, -1.0, 0.0]
    rows = [
        (5, v, 1, "x"), (5, v, 1, "x"), (3, v, 1, "x"), (2, w, 1, "x"), (9, [2.0, 4.0, 6.0], 1, "x"), (8, v, 2, "x"), (7, v, None, "x"), (None, v, 1, "x"),
        (10, None, 1, "x"), (11, [], 1, "x"), (12, [0.0, 0.0, 0.0], 1, "x"), (13, [1.0, None, 3.0], 1, "x"), (14, [1.0, float("nan"), 3.0], 1, "x"),
        (15, [float("inf"), 1.0, 1.0], 1, "x"), (16, [1.0, 2.0], 1, "x"), (20, w, 1, "x"), (20, [0.0, 0.0, 1.0], 1, "x"), (21, [0.0, 0.0, 1.0], 1, "x"),
    ]
    assert got(spark, rows) == brute(rows)


def test_empty(spark):
    assert got(spark, []) == []
