"""Operators over time: running totals, as-of lookups and episodes.

All of them are exact and linear. None sorts a whole key in one task: a key's
rows are split by time bucket, each bucket is scanned on its own, and only one
row per bucket crosses from bucket to bucket. Rows with equal key and time are
merged before, so a bucket holds at most one row per clock tick.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

ROLLING_WINDOW = "24 hours"
BUCKET = "1 minute"
TICK = "1 microsecond"


def running(rows: DataFrame, keys: list[str], at: str, values: dict[str, Callable[[Column], Column]],
            combine: Callable[[str, Column, Column], Column], wanted: Column, backwards: bool = False) -> DataFrame:
    """Replace each column of ``values`` by its aggregate over all rows of the key
    up to and including the row's own time (from it onwards if ``backwards``), and
    keep the ``wanted`` rows (a condition on the other columns).

    ``values`` maps a column to an aggregate that can be taken in parts, and
    ``combine`` joins the part of earlier buckets with the part inside the bucket.
    Both parts read the same columns of one shuffle, so Spark runs it once. Rows
    without a key or a time belong to no run and are left out.
    """
    way = F.desc if backwards else F.asc
    bucketed = rows.withColumn("_bucket", F.window(at, BUCKET).getField("start"))
    for name in (*keys, "_bucket"):  # stated here, or each part infers its own half
        bucketed = bucketed.filter(F.col(name).isNotNull())
    bucketed = bucketed.repartition(*keys, "_bucket")
    so_far = Window.partitionBy(*keys, "_bucket").orderBy(way(at)).rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*keys).orderBy(way("_from")).rowsBetween(Window.unboundedPreceding, -1)

    inside = bucketed.select(
        *[c for c in bucketed.columns if c not in values],
        *[aggregate(F.col(name)).over(so_far).alias(name) for name, aggregate in values.items()])
    per_bucket = bucketed.groupBy(*keys, "_bucket").agg(
        F.min(at).alias("_from"), F.bool_or(wanted).alias("_any_wanted"),
        *[aggregate(F.col(name)).alias(name) for name, aggregate in values.items()])
    carried = per_bucket.select(
        *keys, "_bucket", "_any_wanted",
        *[aggregate(F.col(name)).over(earlier).alias(f"_before_{name}") for name, aggregate in values.items()],
    ).filter("_any_wanted")
    joined = inside.filter(wanted).join(carried, [*keys, "_bucket"])
    return joined.select(
        *[c for c in rows.columns if c not in values],
        *[combine(name, F.col(f"_before_{name}"), F.col(name)).alias(name) for name in values])


def _add(_: str, before: Column, inside: Column) -> Column:
    return F.coalesce(before, F.lit(0)) + inside


def rolling_activity(rows: DataFrame, keys: list[str], at: str, amount: str) -> DataFrame:
    """Count and total over the 24 hours that end at each distinct time of a key.

    A row enters at its time and leaves one clock tick after the window's length,
    so the rolling figures are running sums of entries and exits.
    """
    points = rows.groupBy(*keys, at).agg(F.count("*").alias("count_24h"), F.sum(amount).alias("total_24h"))
    entry = F.struct(F.col(at), F.lit(True).alias("_entry"), "count_24h", "total_24h")
    leave = F.struct(
        (F.col(at) + F.expr(f"INTERVAL {ROLLING_WINDOW}") + F.expr(f"INTERVAL {TICK}")).alias(at), F.lit(False).alias("_entry"),
        (-F.col("count_24h")).alias("count_24h"), (-F.col("total_24h")).alias("total_24h"))
    moves = points.select(*keys, F.inline(F.array(entry, leave)))
    sums = running(moves, keys, at, {"count_24h": F.sum, "total_24h": F.sum}, _add, F.col("_entry"))
    return sums.drop("_entry")


def as_of(probes: DataFrame, marks: DataFrame, keys: list[str], at: str, mark_at: str,
          lookback: str | None = None, forward: bool = False) -> DataFrame:
    """For each distinct (key, time) of ``probes``, the latest row of ``marks`` of
    the same key at or before that time, at most ``lookback`` earlier if that is given.

    With ``forward`` the earliest mark at or after the probe. ``probe_count``
    says how many probes share the time; ``mark`` is NULL where none qualifies.
    """
    payload = [c for c in marks.columns if c not in keys and c != mark_at]
    pick = F.min if forward else F.max
    probe_times = probes.groupBy(*keys, F.col(at).alias("_at")).agg(F.count("*").alias("probe_count"))
    mark_times = (
        marks.withColumn("mark", F.struct(mark_at, *payload))
        .groupBy(*keys, F.col(mark_at).alias("_at")).agg(pick("mark").alias("mark"))
    )
    both = mark_times.unionByName(probe_times, allowMissingColumns=True)
    nearest = F.least if forward else F.greatest
    found = running(both, keys, "_at", {"mark": pick}, lambda _, before, inside: nearest(before, inside),
                    F.col("probe_count").isNotNull(), backwards=forward)
    distance_ok = F.lit(True)
    if lookback:
        limit = F.expr(f"INTERVAL {lookback}")
        distance_ok = (
            F.col(f"mark.{mark_at}") <= F.col("_at") + limit if forward
            else F.col(f"mark.{mark_at}") >= F.col("_at") - limit)
    return found.select(
        *keys, F.col("_at").alias(at), "probe_count",
        F.when(distance_ok, F.col("mark")).alias("mark"))


def episodes(rows: DataFrame, keys: list[str], at: str, gap_minutes: int = 30) -> DataFrame:
    """Bursts of rows separated by more than ``gap_minutes`` of silence.

    Rows first merge into buckets one gap wide: two rows of a bucket can never be
    further apart than the gap. The scan along a key therefore sees one row per
    bucket, bounded by the time span and not by the number of rows.
    """
    gap = F.expr(f"INTERVAL {gap_minutes} MINUTES")
    buckets = rows.groupBy(*keys, F.window(at, f"{gap_minutes} minutes").alias("_bucket")).agg(
        F.count("*").alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))
    along = Window.partitionBy(*keys).orderBy("first_at")
    opened = buckets.withColumn(
        "_opens", (F.col("first_at") > F.lag("last_at").over(along) + gap).cast("int"))
    numbered = opened.withColumn("episode", F.coalesce(F.sum("_opens").over(along), F.lit(0)))
    return numbered.groupBy(*keys, "episode").agg(
        F.sum("n").alias("event_count"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"))
