import hashlib
import math
import random

import numpy as np
import pytest

from casewright.llm import table_kmeans
from tests.llm.frames import clashing, empty

SCHEMA = "vec_id long, embedding array<double>"


def brute(rows, clusters=16, components=4, rounds=3, scale=64):
    kept = []
    for i, e in rows:
        if e is not None and len(e) == components and all(x is not None and math.isfinite(x) for x in e):
            kept.append((i, e, [math.floor(x * scale) if abs(x) < 2 ** 53 else int(x) * scale for x in e]))
    digest = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "g"
    centroids = [v for _, _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:clusters]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min((far(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = {}
        for _, _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if n in groups else c
                     for n, c in enumerate(centroids)]
    found = [(i, *nearest(v)) for i, _, v in kept]
    top = 2 ** 63 - 1
    per = {n: sum(d for _, d, m in found if m == n) for n in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, min(d, top), min(per[n], top), min(sum(per.values()), top), sha[n]) for i, d, n in found), key=repr)


def run(spark, rows, **options):
    frame = clashing(spark.createDataFrame(rows, SCHEMA).repartition(3), "x", "cluster", "distance", "total")
    return sorted((tuple(r) for r in table_kmeans.clustered(frame, **{"components": 4, **options}).collect()), key=repr)


def sample(seed, n=400, spread=3.0):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(rng.choice([-2, 0, 2]), spread) for _ in range(4)]) for i in range(n)]
    rows += [(7, [0.5] * 4), (7, [0.5] * 4), (None, [0.25] * 4), (900, None), (901, [1.0, None, 0.0, 0.0]), (902, [float("nan")] * 4),
             (903, [1.0, float("inf"), 0.0, 0.0]), (904, [1.0] * 3), (905, [])]
    return rows + [(1000 + i, [-0.51, 0.49, 0.0, -1.0]) for i in range(300)]  # one vector at most rows


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = sample(seed)
    assert run(spark, rows) == brute(rows)


def test_few_vectors_equal_vectors_and_ties(spark):
    rows = [(i, [float(i % 2)] * 4) for i in range(9)]
    got = run(spark, rows)
    assert got == brute(rows)
    assert len({r[1] for r in got}) == 2  # the first of equal centroids takes all
    assert run(spark, [(3, [1.0, 2.0, 3.0, 4.0])], rounds=0)[0][:3] == (3, 0, 0)


def test_components_beyond_a_long(spark):
    rows = sample(4, 60) + [(2000, [1e300, -1e300, 0.0, 1.0]), (2001, [-3e38, 3e38, 1e18, -1e18]), (2002, [4.5e15, 1e10, -1e9, 0.1]),
                            (2003, [1.7e308, 1.7e308, -1.7e308, 0.0]), (2004, [1.7e308, 1.6e308, -1.7e308, 0.0])]
    assert run(spark, rows) == brute(rows)


def test_tables_equal_plain_distances():
    rng = np.random.default_rng(8)
    for top in (5, 2 ** 30):
        values, centroids = rng.integers(-top, top, (300, 8)), rng.integers(-top, top, (5, 8)).tolist()
        want = [[sum((int(a) - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids] for v in values]
        assert table_kmeans.distances(values, centroids).tolist() == want


def test_digits():
    for number in (0, -1, 2 ** 40, -2 ** 40, 12345 ** 30, -(7 ** 300)):
        digits = table_kmeans._digits(number)
        assert sum(d << (40 * i) for i, d in enumerate(digits)) == number
        assert all(abs(d) <= 2 ** 40 for d in digits)


def test_empty_table(spark):
    result = table_kmeans.clustered(empty(spark, SCHEMA))
    assert result.count() == 0 and result.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
