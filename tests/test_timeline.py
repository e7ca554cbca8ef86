import datetime
import random
from bisect import bisect_left, bisect_right
from collections import defaultdict
from decimal import Decimal

import pytest

from casewright.operators import timeline

START = datetime.datetime(2024, 1, 1)
DAY = datetime.timedelta(days=1)


def draw_events(seed, n, span_seconds):
    """A third of all rows share one key; times repeat and lie close together."""
    draw = random.Random(seed)
    return [("hot" if draw.random() < 0.33 else f"u{draw.randint(0, 6)}",
             START + datetime.timedelta(seconds=draw.randint(0, span_seconds)), Decimal(draw.randint(1, 900)) / 100, i)
            for i in range(n)]


def by_key(rows):
    grouped = defaultdict(list)
    for key, ts, amount, i in rows:
        grouped[key].append((ts, amount, i))
    return grouped


@pytest.mark.parametrize("span", [600, 3 * 86400, 40 * 86400])
def test_rolling_activity_matches_brute_force(spark, span):
    rows = draw_events(span, 400, span)
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, amount decimal(18,2), i int")
    found = {(r.key, r.ts): (r.count_24h, r.total_24h) for r in timeline.rolling_activity(df, ["key"], "ts", "amount").collect()}
    expected = {}
    for key, events in by_key(rows).items():
        for ts, _, _ in events:
            inside = [amount for other, amount, _ in events if ts - DAY <= other <= ts]
            expected[key, ts] = (len(inside), sum(inside))
    assert found == expected


@pytest.mark.parametrize("forward", [False, True])
def test_as_of_matches_brute_force(spark, forward):
    probes, marks = draw_events(5, 300, 20 * 86400), draw_events(6, 80, 20 * 86400)
    columns = "key string, ts timestamp_ntz, amount decimal(18,2), i int"
    p, m = spark.createDataFrame(probes, columns), spark.createDataFrame(marks, columns).select("key", "ts", "i")
    found = timeline.as_of(p, m, ["key"], "ts", "ts", "24 hours", forward=forward)
    got = {(r.key, r.ts): (r.probe_count, (r.mark.ts, r.mark.i) if r.mark else None) for r in found.collect()}
    grouped_marks = {key: sorted((ts, i) for ts, _, i in events) for key, events in by_key(marks).items()}
    expected = {}
    for key, events in by_key(probes).items():
        times = [ts for ts, _, _ in events]
        candidates = grouped_marks.get(key, [])
        stamps = [ts for ts, _ in candidates]
        for ts in set(times):
            at = bisect_left(stamps, ts) if forward else bisect_right(stamps, ts) - 1
            hit = candidates[at] if 0 <= at < len(candidates) and abs(candidates[at][0] - ts) <= DAY else None
            expected[key, ts] = (times.count(ts), hit)
    assert got == expected


def test_episodes_match_brute_force(spark):
    rows = draw_events(9, 300, 3 * 86400)
    df = spark.createDataFrame(rows, "key string, ts timestamp_ntz, amount decimal(18,2), i int")
    found = sorted((r.key, r.first_at, r.last_at, r.event_count) for r in timeline.episodes(df, ["key"], "ts", 30).collect())
    expected = []
    for key, events in by_key(rows).items():
        times = sorted(ts for ts, _, _ in events)
        burst = [times[0]]
        for ts in times[1:]:
            if ts - burst[-1] > datetime.timedelta(minutes=30):
                expected.append((key, burst[0], burst[-1], len(burst)))
                burst = []
            burst.append(ts)
        expected.append((key, burst[0], burst[-1], len(burst)))
    assert found == sorted(expected)
