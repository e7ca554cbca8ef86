import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from casewright.llm import repair_tokens
from tests.llm.frames import DOCS, clashing
from tests.llm.test_budget_mix import brute_targets
from tests.llm.test_golay_dedup import brute, simhash
from tests.llm.test_positional_index import expected as contaminated

ITEMS = [(1, "the exact words of one benchmark item that must not be found in any document"), (2, "short item here")]


def corpus(spark):
    import random
    rng = random.Random(8)
    words = [a + b for a in ("ka", "lo", "mi", "tu", "re") for b in ("na", "so", "pi", "ze", "du", "")]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randrange(5, 200))) for _ in range(120)]
    texts += [texts[0], texts[0].upper(), texts[1] + " na", None, "", "12 34", "x " + ITEMS[0][1], ITEMS[1][1].upper(),
              texts[2] + " " + ITEMS[1][1]]
    rows = [(i, t, "aa" if i % 2 else "bb", rng.choice(["s1", "s1", "s2", None]), len(t or "")) for i, t in enumerate(texts)]
    return rows, clashing(spark.createDataFrame(rows, DOCS).repartition(3), "row", "h", "size", "start")


def test_stages_equal_brute_force(spark, tmp_path):
    rows, docs = corpus(spark)
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    kept, out = {i: (t, s) for i, t, _, s, _ in rows}, {}
    for name, stage in pipeline.STAGES:
        docs = pipeline.cut_lineage(stage(spark, docs, str(tmp_path)))
        out[name] = docs.collect()
    names = [name for name, _ in pipeline.STAGES]

    kept = {i: v for i, v in kept.items() if any(map(str.isalpha, v[0] or ""))}
    assert Counter(r.doc_id for r in out[names[0]]) == Counter(list(kept))
    ids = sorted(kept)
    label = brute([simhash(kept[i][0]) for i in ids])
    kept = {i: kept[i] for k, i in enumerate(ids) if label[k] == k}
    assert Counter(r.doc_id for r in out[names[1]]) == Counter(list(kept))
    ids = sorted(kept)
    bad = {ids[r[0]] for r in contaminated([kept[i][0] for i in ids], ITEMS) if r[-1]}
    assert {126, 127} <= bad
    kept = {i: v for i, v in kept.items() if i not in bad}
    assert Counter(r.doc_id for r in out[names[2]]) == Counter(list(kept))

    mix, sizes, taken = out[names[3]], Counter(), Counter()
    for t, s in kept.values():
        sizes[s] += len(t.split())
    for r in mix:
        assert kept[r.doc_id] == (r.text, r.source)
        taken[r.source] += len(r.text.split())
    want = brute_targets(dict(sizes))
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes) and max(Counter(r.doc_id for r in mix).values()) <= 2
    assert all(tuple(r.__fields__) == (*("doc_id text lang source n_chars".split()), "row", "h", "size", "start")
               for name in names[:4] for r in out[name][:1])

    tokenizer, start = Tokenizer.from_file(public_tokenizers.path(repair_tokens.VOCABULARY)), 0
    for r, m in zip(sorted(out[names[4]], key=lambda r: r.start), sorted(mix, key=lambda m: m.doc_id), strict=True):
        coded = np.array([*tokenizer.encode(m.text, add_special_tokens=False).ids, 2], "<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (m.doc_id, start, len(coded), zlib.crc32(coded))
        start += len(coded)


def test_an_empty_table(spark, tmp_path):
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_nulls_in_every_column(spark, tmp_path):
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(None, "one two three", None, None, None), (1, None, None, None, None),
                                  (None, None, None, None, None), (2, "vier fünf", None, None, None),
                                  (3, "sechs sieben acht", "de", None, None)], DOCS)
    docs.union(docs).write.parquet(f"{tmp_path}/documents.parquet")
    rows = pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == {None, 2, 3}
