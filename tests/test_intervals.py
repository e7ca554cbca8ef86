import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from casewright.operators import intervals, skew

BASE = dt.datetime(2026, 1, 1)
POINTS, SPANS = "k string, p int, at timestamp", "k string, s int, start timestamp, end timestamp"


def later(**time):
    return BASE + dt.timedelta(**time)


def run(spark, points, spans):
    got = intervals.holding(spark.createDataFrame(points, POINTS), spark.createDataFrame(spans, SPANS), ["k"], "at", "start", "end")
    return got, sorted((r.k, r.p, r.s) for r in got.collect())


def brute(points, spans):
    return sorted((k, p, s) for k, p, at in points for k2, s, start, end in spans
                  if k and k == k2 and at and start and start <= at and (end is None or at < end))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_comparing_every_pair(spark, seed):
    rng = random.Random(seed)
    moment = lambda: later(microseconds=rng.choice([60_000_000, 1, 10 ** 9]) * rng.randrange(-3000, 3000))
    points = [(rng.choice(["a", "b", None]), i, rng.choice([moment(), None]) if i % 9 == 0 else moment()) for i in range(200)]
    spans = []
    for i in range(150):
        start = moment()
        length = dt.timedelta(seconds=rng.choice([0, 1, 59, 60, 61, 3600, 86400 * 40, 86400 * 4000, -5]), microseconds=rng.randrange(3))
        spans.append((rng.choice(["a", "b", None]), i, start if i % 20 else None, start + length if i % 7 else None))
    spans += spans[:10] + [("a", 900, later(days=-30000), later(days=1))]
    points += points[:10] + [("a", 901, later(days=-29999))]
    _, got = run(spark, points, spans)
    assert got == brute(points, spans)


def test_bins_cover_a_range_once(spark):
    rng = random.Random(5)
    ranges = [(a, a + rng.choice([0, 1, 7, 8, 63, 500, 10 ** 6])) for a in (rng.randrange(-10 ** 7, 10 ** 7) for _ in range(60))]
    rows = spark.createDataFrame(ranges, "a long, b long").select("a", "b", intervals.covering_bins(F.col("a"), F.col("b")).alias("bins"))
    for r in rows.collect():
        parts = sorted((b["_bin"] << 3 * b["_width"], (b["_bin"] + 1) << 3 * b["_width"]) for b in r.bins)
        assert [x for part in parts for x in part[:1]] == sorted({x for x, _ in parts})
        assert all(one[1] == other[0] for one, other in zip(parts, parts[1:], strict=False))
        assert not parts and r.a == r.b or (parts[0][0], parts[-1][1]) == (r.a, r.b)
        assert len(parts) <= 14 * intervals.WIDTHS


def test_one_bin_holds_most_points_and_no_range_join_is_planned(spark, monkeypatch):
    points = [("a", i, later(seconds=i % 60)) for i in range(2000)] + [("b", i, later(days=i)) for i in range(20)]
    spans = [("a", i, later(days=-i), later(days=1)) for i in range(5)] + [("b", 9, later(days=3), None)]
    frame, got = run(spark, points, spans)
    assert got == brute(points, spans)
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert "_bin" in plan and "CartesianProduct" not in frame._jdf.queryExecution().executedPlan().toString()
    rows = spark.createDataFrame([("hot", i) for i in range(500)] + [(f"k{i}", i) for i in range(50)], "k string, i int")
    others = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3)], "k string, j int")
    joined = skew.spread_join(rows, others, ["k"], share=10)
    assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, rows.join(others, "k").collect()))
    assert skew.spread_join(rows.limit(0), others, ["k"]).count() == 0


def test_empty_sides(spark):
    assert run(spark, [], [("a", 1, BASE, None)])[1] == []
    assert run(spark, [("a", 1, BASE)], [])[1] == []
