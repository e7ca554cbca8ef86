import datetime as dt
import random
from collections import Counter

import pytest

from casewright.operators import correlation, timeline
from casewright.streaming import episodes, pairs

BASE = dt.datetime(2026, 1, 1)
EVENTS = "k string, ts timestamp, kind string"


@pytest.fixture()
def stream(spark):
    """Files of events, read one per trigger; the state store that timers need."""
    store = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield lambda folder: spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(folder)
    spark.conf.unset(store)


def write(spark, folder, batches):
    for rows in batches:  # in order: each file is younger than the one before
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(folder)


def events(seed, n):
    rng = random.Random(seed)
    times = sorted(BASE + dt.timedelta(microseconds=rng.randrange(10 ** 6 * 86400 * 2)) for _ in range(n))
    return [(rng.choice(["a", "a", "b", "c"]), t, rng.choice(["queued", "sent"])) for t in times]


def told(spark, folder, name):
    columns = "k string, first_at timestamp, last_at timestamp, event_count long"
    return [tuple(r) for r in spark.read.schema(columns).parquet(f"{folder}/{name}/batch=*").collect()]


def run_episodes(spark, stream, tmp_path, batches):
    write(spark, str(tmp_path / "in"), batches)
    live = episodes.live_episodes(stream(str(tmp_path / "in")), ["k"], "ts", gap_minutes=30, lateness="10 minutes")
    query = episodes.write_episodes(live, str(tmp_path / "out"), str(tmp_path / "state"))
    assert query.awaitTermination(240)
    return [told(spark, str(tmp_path / "out"), kind) for kind in ("episode", "late")]


def test_episodes_equal_the_batch_and_late_events_are_told(spark, stream, tmp_path):
    rows = events(4, 240)
    rows += [rows[5]] * 3
    rows.sort(key=lambda r: r[1])
    far = BASE + dt.timedelta(days=40)
    late = [("a", BASE + dt.timedelta(hours=1), "queued"), ("a", BASE + dt.timedelta(hours=1), "sent"), ("new", BASE, "sent")]
    batches = [rows[:80], rows[80:160], [*rows[160:], *late], [("end", far, "sent")], [("end", far + dt.timedelta(days=1), "sent")],
               [(None, far, "sent"), ("end", None, "sent")]]
    done, behind = run_episodes(spark, stream, tmp_path, batches)
    batch = timeline.episodes(spark.createDataFrame(rows, EVENTS), ["k"], "ts", gap_minutes=30)
    want = sorted((r.k, r.first_at, r.last_at, r.event_count) for r in batch.collect())
    assert sorted(r for r in done if r[0] != "end") == want
    assert Counter((k, t) for k, t, _ in late) == {(r[0], r[1]): r[3] for r in behind}
    assert sum(r[3] for r in done if r[0] != "end") + sum(r[3] for r in behind) == len(rows) + len(late)


def test_pairs_equal_the_batch(spark, stream, tmp_path):
    rows = events(7, 200)
    rows += [next(r for r in rows if r[2] == "queued")] * 2
    rows.sort(key=lambda r: r[1])
    far = [(k, BASE + dt.timedelta(days=40 + i), kind) for i in range(3) for k in ("end",) for kind in ("queued", "sent")]
    write(spark, str(tmp_path / "in"), [rows[:70], rows[70:140], rows[140:], far[:2], far[2:4], far[4:]])
    source = stream(str(tmp_path / "in"))
    live = pairs.live_pairs(source.filter("kind = 'queued'"), source.filter("kind = 'sent'"), ["k"], "ts", "2 hours", "10 minutes")
    query = (live.writeStream.outputMode("append").format("memory").queryName("pairs").option("checkpointLocation", str(tmp_path / "state"))
             .trigger(availableNow=True).start())
    assert query.awaitTermination(240)
    got = {(r.k, r.started_at): (r.ended_at, r.start_count, r.latency_seconds) for r in spark.table("pairs").collect() if r.k != "end"}
    batch = correlation.event_latency(spark.createDataFrame(rows, EVENTS), "queued", "sent", ["k"], "2 hours").collect()
    want = {(r.k, r.started_at): (r.ended_at, r.start_count, r.latency_seconds) for r in batch}
    assert {key: value for key, value in got.items() if value[0] is not None} == want
    assert set(got) == {(k, t) for k, t, kind in rows if kind == "queued"}
