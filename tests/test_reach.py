import random
from collections import deque

import pytest

from casewright.operators import reach

EDGES = "incident string, parent string, child string"


def brute(edges):
    """Breadth-first search from every component."""
    calls = {}
    for incident, a, b in edges:
        if incident and a and b and a != b:
            calls.setdefault((incident, a), set()).add(b)
    out = {}
    for incident, start in list(calls):
        seen, queue = {start: 0}, deque([start])
        while queue:
            at = queue.popleft()
            for to in calls.get((incident, at), ()):
                if to not in seen:
                    seen[to] = seen[at] + 1
                    queue.append(to)
        out.update({(incident, start, c): n for c, n in seen.items() if c != start})
    return out


def run(spark, edges):
    got = reach.component_reach(spark.createDataFrame(edges, EDGES))
    return got, {(r.incident, r.ancestor, r.component): r.hops for r in got.collect()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_breadth_first_search_with_cycles(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.choice("xy"), f"c{rng.randrange(25)}", f"c{rng.randrange(25)}") for _ in range(45)]
    edges += edges[:5] + [("x", "c1", None), ("x", None, "c1"), (None, "a", "b"), ("x", "c3", "c3")]
    frame, got = run(spark, edges)
    want = brute(edges)
    assert got == want
    cycles = {}
    for incident, a, c in want:
        if (incident, c, a) in want:
            cycles.setdefault((incident, a), {a}).add(c)
    assert {(r.incident, r.component): (r.cycle, r.members) for r in reach.call_cycles(frame).collect()} == {
        key: (min(some), len(some)) for key, some in cycles.items()}


def test_a_graph_with_two_to_the_forty_paths(spark):
    """Layers of two components, each of which calls both of the next layer."""
    edges = [("x", f"{layer:02d}{a}", f"{layer + 1:02d}{b}") for layer in range(40) for a in "pq" for b in "pq"]
    _, got = run(spark, edges)
    assert got == {("x", f"{i:02d}{a}", f"{j:02d}{b}"): j - i for i in range(41) for j in range(i + 1, 41) for a in "pq" for b in "pq"}


def test_rounds_grow_with_the_logarithm_of_the_depth(spark, monkeypatch):
    stored = []
    cut = reach.cut_lineage
    monkeypatch.setattr(reach, "cut_lineage", lambda df: stored.append(1) or cut(df))
    _, got = run(spark, [("x", f"c{i:03d}", f"c{i + 1:03d}") for i in range(100)])
    assert len(got) == 5050 and max(got.values()) == 100
    assert len(stored) <= 8


def test_one_component_is_called_by_most_and_no_edges(spark):
    edges = [("x", f"c{i}", "hub") for i in range(300)] + [("x", "hub", f"d{i}") for i in range(20)]
    assert run(spark, edges)[1] == brute(edges)
    assert run(spark, [])[1] == {}


@pytest.mark.parametrize("small", [0, 8, 500])
def test_small_incidents_are_walked_and_large_ones_doubled(spark, monkeypatch, small):
    monkeypatch.setattr(reach, "SMALL", small)
    stored = []
    cut = reach.cut_lineage
    monkeypatch.setattr(reach, "cut_lineage", lambda df: stored.append(1) or cut(df))
    edges = [("x", f"c{i:02d}", f"c{i + k:02d}") for i in range(20) for k in (1, 2)] + [("y", "a", "b"), ("y", "b", "a"), ("y", "b", "c")]
    assert run(spark, edges)[1] == brute(edges)
    assert len(stored) == 2 if small == 500 else len(stored) > 2
