"""What a component's calls reach, however many paths lead there.

Listing paths is exponential where callees are shared. Here a pair (ancestor, component)
is kept once, with its least number of hops, and every round doubles the distance that is
known: a shortest path of more than d hops begins with one of exactly d. So a round joins
the pairs at distance d with all known pairs, and a tree of depth n takes log2(n) rounds.

Every round shuffles all pairs that are known. That is for incidents with many calls; the
calls of a small incident travel once, together, and are walked from every component.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from casewright.session import cut_lineage

PAIR = ["incident", "ancestor", "component"]
#: Distinct calls of an incident that are walked in one task, and pairs that are sent on together.
SMALL = 500
TOGETHER = 50_000


def component_reach(edges: DataFrame) -> DataFrame:
    """(incident, ancestor, component, hops): the least number of calls from each component
    to each other one it reaches. ``edges`` is (incident, parent, child).

    Cycles are allowed; a component is not listed as reaching itself (see ``call_cycles``).
    Repeated edges count once, edges with a null end or from a component to itself lead
    nowhere.
    """
    calls = cut_lineage(
        edges.filter("incident IS NOT NULL AND parent <> child")
        .select("incident", F.col("parent").alias("ancestor"), F.col("child").alias("component")).distinct())
    large = cut_lineage(calls.groupBy("incident").agg(F.count("*").alias("n")).filter(F.col("n") > SMALL).select("incident"))
    if large.isEmpty():
        return walked(calls)
    return walked(calls.join(large, "incident", "left_anti")).unionByName(doubled(calls.join(large, "incident", "left_semi")))


def walked(calls: DataFrame) -> DataFrame:
    """``component_reach`` of small incidents: breadth first from each of their components."""
    def pairs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for incident, called in zip(part["incident"].to_pylist(), part["called"].to_pylist(), strict=True):
                to = defaultdict(list)
                for call in called:
                    to[call["ancestor"]].append(call["component"])
                for start in to:
                    hops, queue = {start: 0}, [start]
                    for at in queue:
                        for component in to.get(at, ()):
                            if component not in hops:
                                hops[component] = hops[at] + 1
                                queue.append(component)
                    rows += [(incident, start, component, hops[component]) for component in queue[1:]]
                if len(rows) >= TOGETHER:
                    yield batch(rows)
                    rows = []
            if rows:
                yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(),) * 3 + (pa.int32(),), strict=True)]
        return pa.RecordBatch.from_arrays(columns, names=[*PAIR, "hops"])

    together = calls.groupBy("incident").agg(F.collect_list(F.struct("ancestor", "component")).alias("called"))
    return together.mapInArrow(pairs, "incident string, ancestor string, component string, hops int")


def doubled(calls: DataFrame) -> DataFrame:
    """``component_reach`` of incidents of any size. Every round is stored, so that none is computed twice."""
    known, distance = cut_lineage(calls.withColumn("hops", F.lit(1))), 1
    while not (far := known.filter(F.col("hops") == distance)).isEmpty():
        further = (
            far.select("incident", "ancestor", F.col("component").alias("_via"))
            .join(known.select("incident", F.col("ancestor").alias("_via"), "component", "hops"), ["incident", "_via"])
            .filter("ancestor <> component")
            .select(*PAIR, (F.col("hops") + distance).alias("hops")))
        known = cut_lineage(known.unionByName(further).groupBy(*PAIR).agg(F.min("hops").alias("hops")))
        distance *= 2
    return known


def call_cycles(reach: DataFrame) -> DataFrame:
    """(incident, component, cycle, members): components that call each other in a circle.
    ``cycle`` is the least name in it; components in no circle are not listed."""
    back = reach.select("incident", F.col("component").alias("ancestor"), F.col("ancestor").alias("component"))
    mutual = reach.select(*PAIR).join(back, PAIR)
    return mutual.groupBy("incident", F.col("ancestor").alias("component")).agg(
        F.least(F.min("component"), F.first("ancestor")).alias("cycle"), (F.count("*") + 1).alias("members"))
