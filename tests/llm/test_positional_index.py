import hashlib
import random
import re

from casewright.llm import positional_index as index
from tests.llm.frames import documents, empty

ITEMS = "item_id long, text string"
ABC = [f"w{i}" for i in range(40)]


def tokens(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def expected(texts, items):
    out = []
    for k, text in enumerate(texts):
        doc, hit, names = tokens(text), set(), set()
        for name, item in items:
            ws = tokens(item)
            size = min(13, len(ws))
            for a in range(len(ws) - size + 1) if ws else ():
                for i in range(len(doc) - size + 1):
                    if doc[i:i + size] == ws[a:a + size]:
                        hit |= set(range(i, i + size))
                        names.add("" if name is None else str(name))
        digest = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out.append((k, len(doc), len(hit), len(names), digest, len(hit) > 0 and 20 * len(hit) >= len(doc)))
    return out


def cases():
    rng = random.Random(5)
    passage = [rng.choice(ABC) for _ in range(40)]
    items = [(3, " ".join(passage)), (20, " ".join(passage[5:20]).upper()), (100, "Only three words"), (7, None), (8, ""),
             (None, " ".join(passage[:13])), (3, "a second text of item three " + " ".join(passage[20:33]))]
    texts = [" ".join(rng.choice(ABC) for _ in range(60)) for _ in range(20)]
    texts += [" ".join(passage), "x, " + "; ".join(passage[:12]), "é " + " ".join(passage[:13]) + " é" * 300,
              None, "", "only THREE--words", "only three\nwordsé", " ".join(passage * 3), " ".join(ABC * 2000)]
    return texts, items


def test_equals_brute_force(spark):
    texts, items = cases()
    docs = documents(spark, texts, term=1, segment=1, start=1, h=1)
    bench = spark.createDataFrame(items, ITEMS)
    got = sorted(tuple(r) for r in index.decontamination(docs, bench).drop("text_hash").collect())
    assert got == expected(texts, items)
    again = index.decontamination(docs.union(docs), bench).drop("text_hash").collect()
    assert sorted(tuple(r) for r in again) == sorted(2 * expected(texts, items))


def test_small_segments_and_blocks_change_nothing(spark, monkeypatch):
    texts, items = cases()
    bench = spark.createDataFrame(items, ITEMS)
    monkeypatch.setattr(index, "CANDIDATES", 7)
    stored = index.cut_lineage(index.build_index(documents(spark, texts), segment_words=100))
    monkeypatch.setattr(index.blocks, "__defaults__", (13, 30))
    got = index.judge(stored, index.search(stored, bench)).drop("text_hash")
    assert sorted(tuple(r) for r in got.collect()) == expected(texts, items)


def test_proximity(spark):
    texts = ["a b c d", "a x b c d", "a x x x b c d", "d c b a"]
    stored = index.cut_lineage(index.build_index(documents(spark, texts)))
    bench = spark.createDataFrame([(1, "a b c d")], ITEMS)
    names = {d.doc: d.d.doc_id for d in stored.filter("docs is not null").selectExpr("posexplode(docs) as (doc, d)").collect()}
    rows = {(names[r.doc], r.exact) for r in index.search(stored.coalesce(1), bench, slop=1).collect()}
    assert (0, True) in rows and {d for d, _ in rows} == {0, 1}


def test_empty_tables(spark):
    docs, bench = documents(spark, ["a b", None]), spark.createDataFrame([(1, "a b")], ITEMS)
    assert index.decontamination(empty(spark), bench).count() == 0
    assert {r.n_hit for r in index.decontamination(docs, empty(spark, ITEMS)).collect()} == {0}


def test_clean_keeps_columns_and_clean_rows(spark):
    docs = documents(spark, ["a b", "c d " * 30, None], row=1, bad_id=1)
    kept = index.clean(docs, spark.createDataFrame([(1, "A b")], ITEMS))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 2}
