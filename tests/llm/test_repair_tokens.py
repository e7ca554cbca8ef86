import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from casewright.llm import repair_tokens as repair
from tests.llm.frames import documents, empty

TEXTS = ["a b  c", " lead", "trail ", "x   y", "tab\t z\n q \n r", "\n \n", "  ", " ", "", None, "Hello, world! it's 12345",
         "é ü 漢字   nbsp", "<|endoftext|> a<|endoftext|>b", "\0 zero \0x", "end\n ", "one\ntwo\nthree four\nfive", "\nlead", "two\n\nlines", "nbsp\n\xa0x", "\xa0\nx y", "a\n\n", "tail\n", "one two " * 9000, "###" * 500,
         "Is and retitioning ouen the of, nterti thorreou ndernt.\nIs ndble whst"]


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(public_tokenizers.path(repair.VOCABULARY))
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def expected(rows, plain):
    out, start = [], 0
    for name, text in rows:
        ids = np.array(plain(text), "<u4")
        out.append((name, start, len(ids), zlib.crc32(ids)))
        start += len(ids)
    return out


def test_remembered_units_give_the_tokenizers_ids(plain, monkeypatch):
    encoder, rng = repair.Encoder(), random.Random(1)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice("ab, .\n\t 1é'  \xa0\u2003\x1c\x85") for _ in range(30)) for _ in range(3000)]
    assert [e.tolist() for e in encoder.encode(texts)] == [plain(t) for t in texts]
    every = [chr(c) for c in range(0x2E80) if not 0xD800 <= c < 0xE000]
    texts = ["a " + " ".join("x" + c + "y" + c + m for m in ("", ".", ",", "!'", "'s", "<|", "%%%") for c in every)]
    assert [e.tolist() for e in encoder.encode(texts)] == [plain(t) for t in texts]
    monkeypatch.setattr(repair, "REMEMBERED", 1)
    encoder.known = {k: encoder.known[k] for k in ("b", repair.LINE_FEED)}
    assert [e.tolist() for e in encoder.encode(texts[:20])] == [plain(t) for t in texts[:20]]


def test_compression_round_trip_and_random_access():
    rng = np.random.default_rng(2)
    phrase = rng.integers(0, 50_000, 300)
    parts = [np.concatenate([rng.integers(0, 50, rng.integers(1, 400)), phrase[:rng.integers(1, 300)], [2]]) for _ in range(400)]
    parts += [np.zeros(5000, int), np.array([2]), np.array([2, 2])]
    data = repair.pack([p.astype("<u2") for p in parts], 50_257)
    assert len(data) < sum(map(len, parts))  # under half of two bytes an id
    shard = repair.Shard(data)
    assert shard.n_docs == len(parts) and len(shard.rules)
    assert [d.tolist() for d in shard.documents()] == [p.tolist() for p in parts]
    for k, part in enumerate(parts):
        assert shard.document(k).tolist() == part.tolist()
        a = int(rng.integers(0, len(part)))
        b = int(rng.integers(a + 1, len(part) + 1))
        assert shard.span(k, a, b).tolist() == part[a:b].tolist()


def test_documents_in_id_order(spark, plain):
    docs = documents(spark, TEXTS, first=-5, part=1, h=1, shard=1).repartition(3)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in repair.written_and_read(docs).collect())
    want = expected([(i - 5, t) for i, t in enumerate(TEXTS)], plain)
    assert [(d, s, n, c) for s, d, n, c in got] == want
    small = repair.cut_lineage(repair.write_shards(docs, shard_tokens=20))
    assert small.count() > 5
    assert sorted(tuple(r) for r in repair.read_shards(small).collect()) == sorted(want)


def test_repeated_and_null_ids_and_empty_tables(spark, plain):
    docs = documents(spark, ["a b", "c d e", None])
    docs = docs.union(docs).union(docs.withColumn("doc_id", F.lit(None).cast("long")))
    rows = repair.written_and_read(docs).orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None] * 3 + [0, 0, 1, 1, 2, 2]
    assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
    assert repair.written_and_read(empty(spark)).count() == 0


def test_rules_are_made_until_no_pair_is_frequent():
    ids = np.arange(20_000) % 20_011
    for k in range(16):  # a pair that covers well under a hundredth of the symbols
        ids[100 + 1000 * k:102 + 1000 * k] = 30_000, 30_001
    ends = np.zeros(len(ids), bool)
    ends[-1] = True
    symbols, _, rules = repair.compress(ids, ends, 50_000)
    assert rules.tolist() == [[30_000, 30_001]] and len(symbols) == len(ids) - 16


def test_a_word_is_remembered_once_whatever_marks_follow_it():
    encoder = repair.Encoder()
    text = " ".join(f"w{c}rd{mark}" for c in "aeiou" for mark in ("", ",", ".", ";", "!?", ")."))
    assert encoder.encode([text] * 2)[1].tolist() == [
        *encoder.tokenizer.encode(text, add_special_tokens=False).ids, repair.END_ID]
    assert len(encoder.known) <= 1 + 5 + 1 + 2  # the line feed, the words, the first unit
    assert set(encoder.marks) == {",", ".", ";", "!?", ")."}


def test_words_that_begin_a_line_are_merged_directly(plain, monkeypatch):
    encoder, asked = repair.Encoder(), []
    real = encoder._alone
    monkeypatch.setattr(encoder, "_alone", lambda texts: asked.extend(texts) or real(texts))
    text = "One two\nthree, four\nfünf!\nsix"
    assert encoder.encode([text, "Seven"])[0].tolist() == plain(text)
    assert [t for t in asked if t] == []


def test_texts_encoded_together_equal_texts_encoded_alone(plain):
    texts = ["a\nb c", "a  b", "x \n y", "a\n\nb a\nb", "", " ", "\nb\nc", "b\n", "a b   c", "p\x85\nq r\n\x1cs", "a\nb  c\nd", "c d"]
    encoder = repair.Encoder()
    assert [e.tolist() for e in encoder.encode(texts * 2)] == [plain(t) for t in texts * 2]
    assert [encoder.encode([t])[0].tolist() for t in texts] == [plain(t) for t in texts]
    assert encoder.encode([]) == []
