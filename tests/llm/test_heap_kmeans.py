import hashlib
import random

import numpy as np
import pytest

from endpointlens.llm import heap_kmeans


def brute(rows, k, rounds, salt="3"):
    """(vec_id, cluster, distance, cluster inertia, inertia, digest) by full scans."""
    rows = [(i, v) for i, v in rows if v is not None]
    first = sorted((hashlib.sha256(f"{salt}:{i}".encode()).hexdigest(), v) for i, v in rows if i is not None)[:k]
    centroids = [v for _, v in first]

    def scan():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids)) for _, v in rows]

    for _ in range(rounds):
        got = scan()
        for j in range(len(centroids)):
            mine = [v for (_, v), (_, at) in zip(rows, got) if at == j]
            if mine:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine)]
    got = scan()
    inertia = [sum(d for d, at in got if at == j) for j in range(len(centroids))]
    return sorted((repr(i), j, d, inertia[j], sum(inertia), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest())
                  for (i, _), (d, j) in zip(rows, got))


def found(spark, rows, **args):
    df = spark.createDataFrame([(i, v, 7, 8) for i, v in rows], "vec_id long, vector array<long>, cluster int, block int")
    return sorted((repr(r[0]), *r[1:]) for r in heap_kmeans.cluster(df, **args).collect())


@pytest.mark.parametrize("k,rounds,block", [(8, 10, 4096), (5, 4, 7), (1, 3, 10), (3, 0, 10)])
def test_equals_full_scans(spark, k, rounds, block):
    rng = random.Random(k)
    rows = [(i, [rng.randint(-40, 40) + 50 * (i % 3) for _ in range(4)]) for i in range(150)]
    rows += [(200 + i, [3, 3, 3, 3]) for i in range(60)] + [rows[5], rows[5], (5, [9, 9, 9, 9]), (None, [1, 1, 1, 1]), (400, None)]
    assert found(spark, rows, k=k, rounds=rounds, block=block) == brute(rows, k, rounds)


def test_ties_take_the_smaller_cluster(spark):
    rows = [(i, [x]) for i, x in enumerate([-2, 2, 0, 0, 0, -2, 2, 0])]
    assert found(spark, rows, k=4, rounds=5) == brute(rows, 4, 5)


def test_few_rows_and_large_components(spark):
    assert found(spark, [(1, [1 << 40, -5]), (2, [0, 0])], k=8, rounds=2) == brute([(1, [1 << 26, -5]), (2, [0, 0])], 8, 2)
    assert found(spark, []) == [] and found(spark, [(1, None)]) == []


def test_only_expired_gaps_are_scanned():
    """Once the centroids rest, no vector away from a boundary is popped."""
    rng = np.random.default_rng(1)
    rows = np.concatenate([rng.integers(0, 50, (300, 4)) + 1000 * j for j in range(3)]).astype(np.int32)
    centroids = heap_kmeans.Centroids(rows[[0, 300, 600]].astype(np.int64), np.zeros(3))
    heaps, moved = heap_kmeans.assign(None, rows, centroids)
    centroids = centroids.moved(moved[:, :-1], moved[:, -1])
    for _ in range(3):
        assert heaps.expired(centroids.drift) == ([], [])
        heaps, moved = heap_kmeans.assign(heaps, rows, centroids)
        assert not moved.any()
    assert (heaps.clusters() == centroids.distances(rows).argmin(axis=1)).all()
