import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from casewright.llm import level_products
from tests.llm.frames import DOCS, clashing, documents, empty

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, least=3, top=200):
    """Term by term, without levels or tables."""
    n_docs, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        words = TERM.findall(lower(text or ""))
        n_docs[lang or ""].update(set(words))
        counts[lang or "", source or ""].update(words)
    out = []
    for lang in {lang for lang, _ in counts}:
        kept = [t for t, n in n_docs[lang].items() if n >= least]
        groups = {s: c for (g, s), c in counts.items() if g == lang}
        share = lambda c: {t: 1 + 10 ** 9 * (c[t] + 1) // (sum(c[k] for k in kept) + len(kept)) for t in kept}
        shares = {s: share(c) for s, c in groups.items()}
        whole = share(sum(groups.values(), Counter()))
        price = lambda p, q: (p - q) ** 2 // q
        for source, p in shares.items():
            for part, found in (
                    ("pair", [(sum(price(p[t], q[t]) for t in kept), s) for s, q in shares.items() if s != source]),
                    ("term", [(price(p[t], whole[t]), t) for t in kept if groups[source][t] and p[t] > whole[t]])):
                found.sort(key=lambda f: (-f[0], f[1].encode()))
                limit = top if part == "term" else len(found)
                out += [(lang, source, part, item, value, r + 1) for r, (value, item) in enumerate(found[:limit])]
    return sorted(out)


def run(spark, rows, **options):
    frame = spark.createDataFrame([(i % 7, t, lang, s, 0) for i, (t, lang, s) in enumerate(rows)], DOCS).repartition(3)
    frame = clashing(frame, "term", "n", "side", "value", "rank", "block", "total")
    return sorted(tuple(r) for r in level_products.divergences(frame, **options).collect())


def sample(seed, n=150, sources=12):
    rng = random.Random(seed)
    words = ["Der", "die", "ÉTÉ", "été", "x", "日本", "a", "b", "straße", *(f"w{chr(97 + i)}" for i in range(26))]
    rows = []
    for _ in range(n):
        source = rng.choice(["hot", f"s{rng.randrange(sources)}", None])
        text = rng.choice(["-", " ", "1", "\n"]).join(rng.choices(words, [1 / (i + 1) for i in range(len(words))], k=rng.randrange(40)))
        rows.append((rng.choice([text, text, text, None, ""]), rng.choice(["de", "de", "fr", None]), source))
    return rows + [("alone once", "xx", "only"), ("beside", "xx", "other"), ("\x00\x7f 12", "yy", "s0")]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = sample(seed)
    got = run(spark, rows)
    assert got == brute(rows)
    assert {r[2] for r in got} == {"pair", "term"} and any(r[0] == "xx" and r[4] == 0 for r in got)


def test_blocks_and_sides_do_not_change_the_result(spark, monkeypatch):
    rows = sample(3)
    for name, value in (("BLOCK_TERMS", 3), ("SIDE_GROUPS", 2)):
        monkeypatch.setattr(level_products, name, value)
    assert run(spark, rows, top=4) == brute(rows, top=4)


def test_products_of_few_terms_and_counts_handed_on_early(monkeypatch):
    rng = np.random.default_rng(6)
    counts = rng.poisson(3, (40, 5))
    arguments = (counts, counts.sum(1), 7, counts.sum(0), int(counts.sum()), 47)
    whole = level_products.priced(*arguments)
    monkeypatch.setattr(level_products, "PRODUCT_TERMS", 3)
    for one, other in zip(whole, level_products.priced(*arguments), strict=True):
        assert (one == other).all()
    batch = pa.RecordBatch.from_pydict({"lang": ["a", "a", "b"], "source": ["s"] * 3, "text": ["x y x", "x", ""]})
    for held in (1, 100):
        monkeypatch.setattr(level_products, "HELD", held)
        found = [r for b in level_products._counted([batch]) for r in b.to_pylist() if r["term"]]
        assert sum(r["n"] for r in found if r["term"] == b"x") == 3
        assert sum(r["n_docs"] for r in found if r["term"] == b"x") == 2


def test_one_source_holds_most_rows_and_repeated_rows_count(spark):
    rows = [("same words here", "en", "hot")] * 300 + [("same other words", "en", f"s{i}") for i in range(3)]
    assert run(spark, rows) == brute(rows)


def test_joint_tables_hold_the_terms_of_every_two_levels():
    rng = np.random.default_rng(5)
    levels = rng.integers(0, 4, (50, 3))
    weights = np.append(np.ones(49, np.int64), 900)
    group, level, _, shared = level_products.joint_tables(levels, weights)
    for i in range(len(group)):
        for j in range(len(group)):
            both = (levels[:, group[i]] == level[i]) & (levels[:, group[j]] == level[j])
            assert shared[i, j] == weights[both].sum()


def test_shares_are_exact_for_large_counts():
    counts = np.array([0, 1, 10 ** 15, 3 * 10 ** 15])
    for n in (0, 7, 4 * 10 ** 15):
        fits = counts[counts <= n]
        want = [1 + 10 ** 9 * (int(c) + 1) // (n + 5) for c in fits]
        assert level_products.share(fits, n, 5).tolist() == want


def test_long_texts_and_empty_tables(spark):
    rows = [("Long Word " * 200_000, "en", "a"), ("long", "en", "b"), ("word long " * 3, "en", "c")]
    assert run(spark, rows, least_docs=2) == brute(rows, least=2)
    assert level_products.divergences(empty(spark)).collect() == []
    only = level_products.divergences(documents(spark, ["same", None, ""])).collect()
    assert [tuple(r) for r in only if r.value] == [] and len(only) == 6
