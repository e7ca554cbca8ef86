import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from casewright.llm import golay_dedup as golay
from tests.llm.frames import documents, empty


def simhash(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute(fps):
    """Least index reachable by at most two differing bits."""
    label = list(range(len(fps)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(fps):
            for j, b in enumerate(fps):
                if (a ^ b).bit_count() <= 2 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def test_the_code_is_perfect():
    words = np.arange(1 << 23, dtype=np.int64)[:: 4099]
    several = golay.indices(words)
    assert {len(set(r)) for r in several.tolist()} == {1, 6}
    rng = random.Random(1)
    for w in words.tolist()[:200]:
        other = w ^ 1 << rng.randrange(23) ^ 1 << rng.randrange(23)
        a, b = golay.indices(np.array([w, other]))
        assert set(a) & set(b)


@pytest.mark.parametrize("paired", [1, 3, 1000])
def test_links_connect_what_brute_force_connects(spark, paired):
    rng = random.Random(2)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(200):
        fps.append(rng.choice(fps) ^ 1 << rng.randrange(64) ^ 1 << rng.choice([rng.randrange(64), 63]))
    fps = sorted({f - (1 << 64) if f >> 63 else f for f in fps})
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    roots = {r.node: r.root for r in golay.components(golay.links(frame, paired)).collect()}
    unsigned = [f % (1 << 64) for f in fps]
    assert [roots.get(f, f) for f in fps] == [fps[k] for k in brute(unsigned)]


def test_documents(spark):
    rng = random.Random(3)
    base = " ".join(rng.choice("abcdefghij") * rng.randrange(1, 6) for _ in range(400))
    texts = [base, base + " end", "x " + base, base.upper(), "one", "two words", None, "", " \n", "é ü", "Three small words",
             base.replace("a", "b"), "word " * 100_000]
    docs = documents(spark, texts, fp=1, row=1, h=1, key=1)
    rows, groups = golay.near_duplicates(docs.union(docs))
    got = {(r.doc_id, r.fp % (1 << 64), r.component_id) for r in rows.join(groups, "fp").collect()}
    fps = [simhash(t) for t in texts]
    assert got == {(i, f, c) for i, (f, c) in enumerate(zip(fps, brute(fps), strict=True))}
    kept = golay.one_of_each(docs.union(docs))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(brute(fps)))


def test_null_ids_and_empty_tables(spark):
    docs = documents(spark, ["a b c d", None, "a b c d"]).withColumn("doc_id", F.lit(None).cast("long"))
    rows, groups = golay.near_duplicates(docs)
    assert [r.component_id for r in rows.join(groups, "fp").collect()] == [None] * 3
    assert golay.one_of_each(docs).count() == 2
    assert golay.one_of_each(empty(spark)).count() == 0
