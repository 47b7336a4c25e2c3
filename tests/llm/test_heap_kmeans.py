"""Clusters against plain Lloyd rounds; bounds against full scans."""

import hashlib
import math
import random

import numpy as np

from tidemark.llm.heap_kmeans import cluster_report, distances, drifts, gaps, heap_kmeans, rescan

ROW = "vec_id long, embedding array<float>, label int, cluster int, v string"


def plain(rows, dims, k, rounds, scale, seed="1"):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(scale * float(np.float32(x))) for x in v]))
    ids = sorted({i for i, _ in kept if i is not None}, key=lambda i: hashlib.sha256(f"{seed}:{i}".encode()).hexdigest())[:k]
    centroids = [min(v for j, v in kept if j == i) for i in ids]
    if not centroids:
        return []

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            mine = [v for (_, v), a in zip(kept, at) if a == n]
            if mine:
                centroids[n] = [sum(c) // len(mine) for c in zip(*mine)]
    last = [(i, *nearest(v)) for i, v in kept]
    whole = sum(d for _, d, _ in last)
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, sum(e for _, e, m in last if m == n), whole, digest[n]) for i, d, n in last), key=str)


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, 0, 9, "x") for i, v in rows], ROW).repartition(3)
    assigned, centroids, log = heap_kmeans(df, **options)
    return sorted((tuple(r) for r in cluster_report(assigned, centroids).collect()), key=str), log


def test_same_as_plain_rounds(spark):
    rng = random.Random(1)
    middles = [[rng.uniform(-3, 3) for _ in range(5)] for _ in range(6)]
    rows = [(i, [m + rng.gauss(0, 0.3) for m in rng.choice(middles)]) for i in range(400)]
    rows += [(500 + i, [1.0, 1.0, 1.0, 1.0, 1.0]) for i in range(150)] + [(500, [1.0] * 5), (500, [-1.0] * 5), (None, [0.5] * 5)]
    rows += [(900, None), (901, [1.0] * 4), (902, [1.0, None, 1.0, 1.0, 1.0]), (903, [float("nan")] * 5), (904, [float("inf")] * 5), (905, [])]
    for rounds in (0, 1, 6):
        got, log = run(spark, rows, dims=5, k=6, rounds=rounds, scale=64.0, block_rows=50)
        assert got == plain(rows, 5, 6, rounds, 64.0)
    scanned = [r.scanned for r in log.orderBy("round").collect()]
    assert len(scanned) == 7 and scanned[0] == 553 and min(scanned) < 300  # settled vectors are not looked at again


def test_large_numbers_ties_and_few_rows(spark):
    rows = [(i, [(-1.0) ** i * 2.0**20, float(i % 3)]) for i in range(9)] + [(20 + i, [0.0, 0.0]) for i in range(4)]
    for k in (1, 3, 40):
        assert run(spark, rows, dims=2, k=k, rounds=3, scale=256.0, block_rows=4)[0] == plain(rows, 2, k, 3, 256.0)
    assert run(spark, [(1, None)], dims=2, k=3)[0] == []
    assert run(spark, [(None, [1.0, 2.0])], dims=2, k=3)[0] == []


def test_bounds_pop_all_that_may_have_moved():
    rng = np.random.default_rng(2)
    for _ in range(20):
        vectors = rng.integers(-40, 40, (200, 4))
        centroids = rng.integers(-40, 40, (7, 4)).tolist()
        nearest, gap = gaps(distances(vectors, centroids))
        heaps = [sorted((float(gap[r]), r) for r in np.flatnonzero(nearest == c).tolist()) for c in range(7)]
        offsets = [0.0] * 7
        for _ in range(5):
            fresh = [[x + int(d) for x, d in zip(c, rng.integers(-2, 3, 4))] for c in centroids]
            offsets = [o + d for o, d in zip(offsets, drifts(centroids, fresh))]
            centroids = fresh
            rescan(heaps, vectors, centroids, offsets)
            found = distances(vectors, centroids)
            for c, heap in enumerate(heaps):
                assert all(found[r].argmin() == c for _, r in heap)
