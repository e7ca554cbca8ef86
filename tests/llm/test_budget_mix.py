import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewright.llm import budget_mix as mix
from tests.llm.frames import clashing, empty


def table(spark, rows):
    return clashing(spark.createDataFrame(
        [(i, t, s) for i, (t, s) in enumerate(rows)], "doc_id long, text string, source string"),
        "src", "size", "row", "h", "bucket", "rank")


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, left, free = {}, 1.5 * sum(sizes.values()), set(names)
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if 2 * sizes[s] < level * weight[s]}
        if not full:
            return target | {s: level * weight[s] for s in free}
        for s in full:
            target[s], left = 2.0 * sizes[s], left - 2 * sizes[s]
        free -= full
    return target


def run(docs):
    rows = mix.cut_lineage(mix.sized(docs, ["doc_id", "source"]))
    return mix.mix(rows, rows).select("row.*", "size", "source_size", "target", "copies").collect()


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_sums_and_limits(spark, seed):
    rng = random.Random(seed)
    rows = [("w " * rng.choice([1, 2, 3, 7, 50, 400]), rng.choice(["a", "b", "a", "a", "é", "Z", None])) for _ in range(400)]
    rows += [("same text here", "a")] * 200 + [(None, "b"), ("", "nothing"), ("long " * 3_000, "nothing")]
    docs = table(spark, rows)
    got = run(docs)
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.size == len((rows[r.doc_id][0] or "").split()) and 0 <= r.copies <= 2
        sizes[r.source] += r.size
        taken[r.source] += r.size * r.copies
    want = brute_targets(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
    for source in sizes:
        assert abs(taken[source] - want[source]) <= 1
    assert {(r.doc_id, r.copies) for r in got} == {(r.doc_id, r.copies) for r in run(docs.repartition(7))}
    out = mix.mixed(docs)
    assert out.columns == docs.columns
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == {
        r.doc_id: r.copies for r in got if r.copies and r.size}


def test_subset_sums_equal_brute_force():
    rng = random.Random(3)
    for _ in range(100):
        lengths = np.array(sorted(rng.sample(range(1, 40), 5)))
        counts = np.array([rng.randrange(4) for _ in lengths])
        budget = rng.randrange(1, 150)
        sums = {0}
        for length, count in zip(lengths, counts, strict=True):
            sums = {s + k * length for s in sums for k in range(count + 1)}
        take = mix.subset(lengths, counts, budget)
        assert (take <= counts).all() and (take * lengths).sum() == max(s for s in sums if s <= budget)


def test_wide_budgets_are_narrowed():
    lengths, counts = np.array([1, 900, 80_000, 200_001]), np.array([10, 500, 40, 9])
    for target in (1.0, 1e5, 1234567.4, 3e6):
        passes, extra = mix.choose(lengths, counts, target)
        assert (extra <= counts).all()
        total = int((lengths * counts).sum())
        assert abs(passes * total + (extra * lengths).sum() - target) <= 500


def test_repeated_rows_null_ids_and_empty_tables(spark):
    docs = table(spark, [("a b c", "s")] * 3 + [("d e", None)] * 2).withColumn("doc_id", F.lit(None).cast("long"))
    got = run(docs)
    assert sum(r.size * r.copies for r in got) == pytest.approx(1.5 * 13, abs=2)
    assert run(table(spark, [(None, None), ("", "x")]))[0].copies == 0
    assert mix.mixed(empty(spark)).count() == 0
