import math
import random

import numpy as np

from casegraph.llm import top_k as tk


def brute(rows, k, scale=64.0, every=5):
    vectors = {}
    for vec, values in rows:
        if vec is None or not values or any(v is None or not math.isfinite(v) for v in values):
            continue
        own = [math.floor(scale * v) for v in values]
        vectors[vec] = max(vectors.get(vec, own), own)
    out = []
    for q, v in vectors.items():
        if q % every == 0:
            scores = sorted((-min(max(sum(a * b for a, b in zip(v, w)), -2 ** 63), 2 ** 63 - 1), c) for c, w in vectors.items() if c != q and len(w) == len(v))[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(scores)]
    return sorted(out)


def check(spark, rows, k=4, monkeypatch=None):
    frame = spark.createDataFrame([(v, e, 1.0, 2) for v, e in rows], "vec_id long, embedding array<float>, norm double, rank int")
    got = tk.top_k(frame, lambda c: c % 5 == 0, k=k)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, k)


def vectors(seed, n, dim, spread):
    rng = random.Random(seed)
    return [[round(rng.gauss(0, 1) * rng.choice(spread), 2) for _ in range(dim)] for _ in range(n)]


def test_norms_of_many_sizes(spark, monkeypatch):
    monkeypatch.setattr(tk, "BUCKET_ROWS", 40)
    monkeypatch.setattr(tk, "QUERY_ROWS", 16)
    check(spark, list(enumerate(vectors(1, 300, 8, [0.01, 0.1, 1, 10]))))


def test_clusters_use_coordinate_pruning(spark, monkeypatch):
    monkeypatch.setattr(tk, "BUCKET_ROWS", 30)
    rng = random.Random(2)
    centres = vectors(3, 6, 12, [1])
    rows = [(k, [c + rng.gauss(0, 0.02) for c in rng.choice(centres)]) for k in range(250)]
    check(spark, rows)


def test_ties_copies_and_bad_vectors(spark, monkeypatch):
    monkeypatch.setattr(tk, "BUCKET_ROWS", 20)
    rows = [(k, [0.5, -0.25, 0.125]) for k in range(90)] + [(k, [0.0, 0.0, 0.0]) for k in range(90, 110)]
    rows += [(k, [-0.5, 0.25, 0.1]) for k in range(110, 130)] + [(7, [0.5, -0.25, 0.125]), (5, [0.5, 0.5, 0.5])]
    rows += [(200, None), (205, []), (210, [1.0, None, 1.0]), (215, [float("nan"), 1.0, 1.0]), (220, [float("inf"), 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    rows += [(300, [1.0, 2.0]), (301, [3.0, 4.0]), (400, [1e30, 1.0, 1.0]), (405, [-1e30, 3e38, 1.0])]
    check(spark, rows, k=6)


def test_vectors_of_any_size_take_part(spark, monkeypatch):
    """Components beyond 32 bits, products beyond 53 and 64 bits, and lengths that differ by many orders."""
    check(spark, [(0, [1.0, 1.0]), (1, [4e7, 1.0]), (2, [0.5, 0.5])], k=2)
    monkeypatch.setattr(tk, "BUCKET_ROWS", 10)
    monkeypatch.setattr(tk, "QUERY_ROWS", 8)
    rng = random.Random(8)
    check(spark, [(k, [float(np.float32(rng.gauss(0, 1) * 10.0 ** rng.uniform(-3, 12))) for _ in range(3)]) for k in range(120)])


def test_large_components_are_exact(spark):
    rng = random.Random(5)
    check(spark, [(k, [float(np.float32(rng.uniform(-3e7, 3e7))) for _ in range(3)]) for k in range(40)])


def test_fewer_than_k_and_empty(spark):
    check(spark, [(0, [1.0, 2.0]), (5, [2.0, 1.0]), (6, [0.0, 1.0])], k=20)
    check(spark, [])


def test_survivors_never_lose_a_match():
    rng = np.random.default_rng(7)
    c = rng.integers(-60, 60, (400, 6)).astype(float)
    c = c[np.argsort(-np.linalg.norm(c, axis=1))]
    norms = np.linalg.norm(c, axis=1)
    for q in rng.integers(-60, 60, (60, 6)).astype(float):
        products = c @ q
        for threshold in np.quantile(products, [0.9, 0.99, 1.0]):
            alive = tk.survivors(q, float(np.linalg.norm(q)), c, norms, float(threshold))
            assert set(np.flatnonzero(products >= threshold)) <= set(alive)
