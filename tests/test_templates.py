import random
import re
from collections import Counter, defaultdict

import pytest

from casewright.operators import templates

FIXED = [
    ("Pool exhausted after 30 attempts", 1), ("Pool exhausted after 31 attempts", 1), ("Pool exhausted after 99 attempts", 1),
    ("user alice logged in", 1), ("user bob logged in", 1), ("user carol logged out", 1), ("timeout", 1), ("timeout", 1), (None, 0), ("  ", 0),
]


def brute(messages, depth=4, branches=8):
    rows = Counter(tuple(templates.WILDCARD if re.search("[0-9]", w) else w for w in m.split()) for m in messages if m and m.split())
    node = {row: (len(row),) for row in rows}
    for level in range(depth):
        children = defaultdict(set)
        for row in rows:
            if level < len(row):
                children[node[row]].add(row[level])
        node = {row: at + ((templates.WILDCARD if len(children[at]) > branches else row[level],) if level < len(row) else ())
                for row, at in node.items()}
    leaves = defaultdict(list)
    for row, at in node.items():
        leaves[at].append(row)
    out = defaultdict(lambda: [0, 0])
    for at, some in leaves.items():
        agreed = [column[0] if len(set(column)) == 1 else templates.WILDCARD for column in zip(*some, strict=True)]
        text = " ".join([*at[1:], *agreed[len(at) - 1:]])
        out[text][0] += sum(rows[row] for row in some)
        out[text][1] += len(some)
    return {text: tuple(n) for text, n in out.items()}


def run(spark, messages, **options):
    frame = spark.createDataFrame([(m, i) for i, m in enumerate(messages)], "message string, node int").repartition(3)
    return {r.template: (r.message_count, r.wording_count) for r in templates.message_templates(frame, **options).collect()}


def test_numbers_and_names_are_masked(spark):
    got = run(spark, [m for m, _ in FIXED], branches=2)
    assert got == {"Pool exhausted after <*> attempts": (3, 1), "user <*> logged in": (2, 2), "user <*> logged out": (1, 1), "timeout": (2, 1)}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force_in_any_order(spark, seed):
    rng = random.Random(seed)
    messages = [" ".join(rng.choice([f"w{chr(97 + rng.randrange(2 + 3 * i))}", "on", "on"]) for i in range(rng.randrange(0, 7))) for _ in range(400)]
    want = brute(messages, branches=5)
    assert run(spark, messages, branches=5) == want
    rng.shuffle(messages)
    assert run(spark, messages, branches=5) == want and len(want) > 20


def test_one_wording_is_most_rows_and_empty_table(spark):
    messages = ["same thing again"] * 3000 + ["other thing again", "same"]
    assert run(spark, messages) == brute(messages)
    assert run(spark, []) == {}
