import math
import random

import pytest

from casewright.llm import histogram_topk as topk
from tests.llm.frames import clashing, empty

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k=5, step=50):
    usable = {}
    for i, e in rows:
        if i is not None and e is not None and all(x is not None and math.isfinite(x) for x in e):
            usable.setdefault(i, []).append([math.floor(256 * x) for x in e])
    out = []
    for q in usable:
        if q % step:
            continue
        query = min(usable[q])
        scored = [(-sum(a * b for a, b in zip(query, v, strict=False)), i) for i, vs in usable.items() if i != q for v in vs]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def run(spark, rows, **options):
    frame = clashing(spark.createDataFrame(rows, SCHEMA).repartition(3), "v", "score", "q")
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.topk(frame, **options).collect())


@pytest.mark.parametrize("block", [2, 1000])
def test_equals_brute_force_with_ties_and_bad_vectors(spark, block):
    rng = random.Random(4)
    rows = [(i, [rng.randrange(-40, 40) / 16 for _ in range(6)]) for i in range(220)]
    rows += [(1000 + i, [0.5] * 6) for i in range(300)]  # one vector at most rows
    rows += [(2000, None), (2050, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2100, [float("nan")] * 6), (2150, [float("inf")] * 6),
             (None, [1.0] * 6), (50, [0.25] * 6), (3, [0.25] * 6)]
    assert run(spark, rows, block=block) == brute(rows)


def test_fewer_candidates_than_k_and_large_components(spark):
    rows = [(0, [3e38, -3e38, 1.0]), (1, [1e9, 5.0, 2.0]), (2, [3e38, 0.0, 0.0]), (50, [1e-3, 0.0, -1e-3])]
    got = run(spark, rows)
    clip = lambda s: max(-2 ** 63, min(2 ** 63 - 1, s))
    import numpy as np
    as_float = [(i, [float(np.float32(x)) for x in e]) for i, e in rows]
    want = []
    for q, _, v, s in brute(as_float, k=9):
        want.append((q, v, clip(s)))
    assert sorted((q, v, s) for q, _, v, s in got) == sorted(want)
    assert run(spark, [(0, [1.0])]) == []


def test_empty_vectors_and_tables(spark):
    assert run(spark, [(0, []), (1, [])]) == [(0, 1, 1, 0)]
    assert topk.topk(empty(spark, SCHEMA)).count() == 0


def test_doubles_whose_products_exceed_doubles(spark):
    rows = [(0, [1.7e308, 1.0, -1.0]), (1, [1.6e308, 0.0, 0.5]), (2, [-1.7e308, 0.25, 0.0]), (3, [0.0, 2.0, -3.5]), (50, [1.0, 1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    exact = {i: [int(x) * 256 if abs(x) > 2 ** 53 else math.floor(256 * x) for x in e] for i, e in rows}
    clip = lambda s: max(-2 ** 63, min(2 ** 63 - 1, s))
    want = []
    for q in (0, 50):
        found = sorted((-clip(sum(a * b for a, b in zip(exact[q], v, strict=True))), i) for i, v in exact.items() if i != q)
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:5])]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.topk(frame).collect()) == sorted(want)
