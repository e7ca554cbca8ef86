import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewright.llm import attention_lm as lm
from tests.llm.frames import clashing, empty

SCHEMA = "doc_id long, text string"


def held(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def tokens(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in text.translate({i: " " for i in range(9, 14)}).split(" ") if w]


def corpus():
    rng = random.Random(6)
    words = ["the", "of", "and", *("".join(rng.choice(["ka", "lo", "mi", "ta", "ré"]) for _ in range(rng.randrange(1, 5))) for _ in range(300))]
    rows = [(i, " ".join(rng.choice(words[:3]) if rng.random() < 0.4 else rng.choice(words) for _ in range(rng.randrange(1, 120))))
            for i in range(300)]
    return rows + [(300, None), (301, ""), (302, "The THE\x0bthe x é"), (303, "lo " * 60_000), (None, "of and"), (304, "x" * 5000),
                   rows[3], rows[3]]


def frame(spark, rows):
    return clashing(spark.createDataFrame(rows, SCHEMA).repartition(3), "uid", "word", "c", "score", "rest", "held_out")


def run(docs):
    return lm.score_documents(docs, lm.fold(F.col("doc_id"), 10) == 0).collect()


@pytest.mark.parametrize("room", [5, 150_000])
def test_unigram_equals_brute_force(spark, monkeypatch, room):
    monkeypatch.setattr(lm, "DICTIONARY", room)
    monkeypatch.setattr(lm, "STEPS", 5)
    rows = corpus()
    counts, ends = Counter(), 0
    for name, text in rows:
        if not held(name):
            counts.update(tokens(text))
            ends += 1
    total, distinct = sum(counts.values()) + ends, len(counts) + 1
    log = lambda c: math.log10((c + 0.1) / (total + 0.1 * (distinct + 1)))
    got = run(frame(spark, rows))
    assert len(got) == len(rows) and {r.train_tokens for r in got} == {total}
    want = {}
    for name, text in rows:
        ws = tokens(text)
        want[name] = (held(name), len(ws) + 1, sum(counts[w] > 0 for w in ws) + 1, sum(log(counts[w]) for w in ws) + log(ends))
    for r in got:
        assert (r.held_out, r.n_tokens, r.n_known) == want[r.doc_id][:3]
        assert r.base_score == pytest.approx(want[r.doc_id][3], rel=1e-9)
        assert r.score < 0 and math.isfinite(r.score)


def test_gradients_equal_finite_differences():
    rng = np.random.default_rng(1)
    windows = rng.integers(0, 30, (40, lm.WINDOW + 1))
    model = lm.trained(windows, np.bincount(windows.ravel(), minlength=lm.SIZE), np.zeros(0, int), np.zeros(0), steps=2)
    model.weights = {k: w.astype(np.float64) for k, w in model.weights.items()}
    ids, targets = windows[:3, :9], model.group[windows[:3, 1:10]]
    _, gradients = model.loss_and_gradients(ids, targets)
    for name, w in model.weights.items():
        at = np.unravel_index(np.abs(gradients[name]).argmax(), w.shape)
        before, e = w[at], 1e-5
        w[at] = before + e
        up, _ = model.loss_and_gradients(ids, targets)
        w[at] = before - e
        down, _ = model.loss_and_gradients(ids, targets)
        w[at] = before
        assert gradients[name][at] == pytest.approx((up - down) / (2 * e), rel=1e-4, abs=1e-9)


def trained_on(seed=2, steps=60):
    rng = np.random.default_rng(seed)
    windows = np.cumsum(rng.integers(1, 3, (300, lm.WINDOW + 1)), axis=1) % 40
    counts = np.bincount(windows.ravel(), minlength=lm.SIZE)
    pairs, times = np.unique(windows[:, :-1] * lm.SIZE + windows[:, 1:], return_counts=True)
    return lm.trained(windows, counts, pairs, times.astype(float), steps=steps), windows


def test_probabilities_add_up_to_one():
    model, windows = trained_on()
    every = np.arange(lm.SIZE)
    inputs = np.repeat(np.concatenate([[lm.END], windows[0, :3]])[None], lm.SIZE, 0)
    targets = np.concatenate([np.repeat(windows[:1, :3], lm.SIZE, 0), every[:, None]], axis=1)
    p = 10.0 ** model.log10(inputs, targets, 1)[:, 0].astype(float)
    assert p.sum() == pytest.approx(1, abs=1e-3)
    words = [np.array([windows[0, 2], k]) for k in every]
    assert (p * 10.0 ** model.changes(words)).sum() == pytest.approx(1, abs=1e-3)


def test_every_subword_is_scored_once_with_causal_context(monkeypatch):
    model, windows = trained_on()
    texts = [np.append(windows.ravel()[a:a + n] % 40, lm.END) for a, n in ((0, 0), (3, 30), (5, 31), (7, 32), (9, 200), (50, 55))]
    slow = []
    for text in texts:
        total = 0.0
        for t in range(len(text)):
            w = 0 if t < lm.WINDOW else -(-(t + 1 - lm.WINDOW) // lm.STEP) * lm.STEP
            before = np.concatenate([[lm.END], text[:-1]])[w:t + 1]
            total += float(model.log10(before[None], text[None, w:t + 1], 1)[0, 0])
        slow.append(total)
    assert model.score(texts) == pytest.approx(slow, rel=1e-4)
    monkeypatch.setattr(lm, "WINDOWS", 3)
    assert model.score(texts) == pytest.approx(slow, rel=1e-4)


def test_training_lowers_the_loss():
    (weak, windows), (strong, _) = trained_on(steps=1), trained_on(steps=200)
    loss = lambda m: m.loss_and_gradients(windows[:, :-1], m.group[windows[:, 1:]])[0]
    assert loss(strong) < 0.7 * loss(weak)


def test_empty_tables_and_nothing_to_learn_from(spark):
    assert run(empty(spark, SCHEMA)) == []
    only = [i for i in range(100) if held(i)][:3]
    got = run(spark.createDataFrame([(i, "a b") for i in only], SCHEMA))
    assert {(r.n_tokens, r.n_known, r.train_tokens) for r in got} == {(3, 0, 0)}


def test_scores_do_not_depend_on_the_pairs_that_tasks_hold(spark, monkeypatch):
    monkeypatch.setattr(lm, "STEPS", 5)
    rows = corpus()
    docs = frame(spark, rows + [(1000 + i, "kalomi'ta-ré42 zzyzx") for i in range(3)])
    by_row = lambda: sorted((str(r.doc_id), r.n_tokens, r.base_score, r.score) for r in run(docs))
    want = by_row()
    for room in (20, 0):
        monkeypatch.setattr(lm, "PAIRS", room)
        got = by_row()
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert [g[3] for g in got] == pytest.approx([w[3] for w in want], rel=1e-9)


def test_the_training_sample_grows_with_the_texts(spark, monkeypatch):
    monkeypatch.setattr(lm, "SAMPLE_DOCS", 10)
    monkeypatch.setattr(lm, "TEXTS_PER_SAMPLE", 2, raising=False)
    seen, trained = [], lm.trained
    monkeypatch.setattr(lm, "trained", lambda windows, *more: seen.append(len(windows)) or trained(windows, *more))
    for n in (100, 200):
        run(spark.createDataFrame([(i, "a b") for i in range(n)], SCHEMA))
    train = [sum(not held(i) for i in range(n)) for n in (100, 200)]
    assert seen == [t // 2 for t in train]


def test_weights_learn_from_every_training_text(spark, monkeypatch):
    """Without any sample, and with equal counts of words and subwords, the order of the words decides."""
    models, real = [], lm.scored
    monkeypatch.setattr(lm, "scored", lambda docs, held_out, words, model, more: models.append(model) or real(docs, held_out, words, model, more))
    monkeypatch.setattr(lm, "sample", lambda *_: np.zeros((0, lm.WINDOW + 1), np.int64))
    monkeypatch.setattr(lm, "SHARD_TOKENS", 20_000)
    monkeypatch.setattr(lm, "BATCH", 4)
    words = "the of and that with from this have not are but had".split()
    texts = [[words[(i + k) % len(words)] for k in range(20 + i % 7)] for i in range(2000)]
    forward = [(i, " ".join(t)) for i, t in enumerate(texts)]
    backward = [(i, " ".join(t[::-1])) for i, t in enumerate(texts)]
    for rows, parts in ((forward, 1), (forward, 4), (backward, 4)):
        run(spark.createDataFrame(rows, SCHEMA).repartition(parts))
    one, four, other = models
    for name, weights in one.weights.items():
        assert np.array_equal(weights, four.weights[name])  # no matter how the table is cut
    coder = lm.Subwords()
    stream = np.concatenate([coder.encode([*t]).flat for t in texts[:40]])
    ids = stream[:20 * (lm.WINDOW + 1)].reshape(20, -1).astype(np.int64)
    loss = lambda m: m.loss_and_gradients(ids[:, :-1], m.group[ids[:, 1:]])[0]
    assert loss(one) < loss(other) - 0.3


def test_words_encoded_together_equal_words_encoded_alone():
    from casewright.llm.common import words_of
    import pyarrow as pa

    texts = [" a\tb\x0bThe  'S it's ", None, "", "x y   z  1\x1c2 ÉÉ 漢字", "n" * 2500 + " 12ab-- \n", "\u0085"]
    found, size = lm.words_in(pa.array(texts))
    want = [words_of(t) for t in texts]
    assert size.tolist() == [len(w) for w in want]
    words = [w.decode() for t in want for w in t]
    assert found.to_pylist() == words
    coder = lm.Subwords()
    coded = coder.encode(words)
    assert [coded.flat[a:a + n].tolist() for a, n in zip(coded.start, coded.size, strict=True)] == [coder._word(w) for w in words]


def test_full_memory_keeps_the_words_met_most_often(monkeypatch):
    import pyarrow as pa

    texts = [f"the of w{k}ka w{k}lo x{k}" for k in range(60)]
    batches = [pa.RecordBatch.from_arrays([pa.array([k]), pa.array([t])], names=["h", "text"]) for k, t in enumerate(texts)]
    coder = lm.subwords()
    coder.clear()
    want = [b["ids"].drop_null().to_pylist() for b in lm._read(iter(batches)) if b["ids"].null_count < len(b)]
    monkeypatch.setattr(lm, "REMEMBERED", 10)
    coded, real = [], coder.encode
    monkeypatch.setattr(coder, "encode", lambda words: coded.extend(words) or real(words))
    coder.clear()
    assert [b["ids"].drop_null().to_pylist() for b in lm._read(iter(batches)) if b["ids"].null_count < len(b)] == want
    assert coded.count("the") == coded.count("of") == 1
    assert len(coder.number) <= 10 + 5 and len(coder.number) + 1 == len(coder.ids.size) == len(coder.met)
    coder.clear()


def test_texts_are_taken_apart_once(spark, monkeypatch):
    """Scoring reads the ids that the first pass stored, of every text, and no text."""
    monkeypatch.setattr(lm, "STEPS", 5)
    seen, real = [], lm.scored
    monkeypatch.setattr(lm, "scored", lambda texts, *more: seen.append(texts) or real(texts, *more))
    rows = corpus()
    run(frame(spark, rows))
    assert "ids" in seen[0].columns and "text" not in seen[0].columns
    assert Counter(r.doc_id for r in seen[0].select("doc_id").collect()) == Counter(name for name, _ in rows)


def test_ids_tell_words_apart_and_only_training_texts_are_counted():
    import pyarrow as pa

    texts = [" a\tb\x0bThe  'S it's ", "", "x y   z  1\x1c2 ÉÉ 漢字", "n" * 2500 + " 12ab-- a", "\u0085", "the held x\u00a0y"]
    use = [5, 6, 7, 8, 9, None]
    lm.subwords().clear()
    parts = [pa.RecordBatch.from_arrays([pa.array(use, pa.int64()), pa.array(range(6)), pa.array(texts)], names=["h", "doc_id", "text"])]
    read = pa.Table.from_batches(lm._read(iter(parts))).to_pylist()
    coder = lm.Subwords()
    write = lambda words: [np.array(coder._word(w), "<u2").tobytes() for w in words]
    want = Counter(w for h, text in zip(use, texts, strict=True) if h for w in write(tokens(text)))
    assert {r["word"]: r["n"] for r in read if r["word"] is not None} == want
    kept = [r for r in read if r["ids"] is not None]
    assert [(r["h"], r["doc_id"]) for r in kept] == list(zip(use, range(6), strict=True))
    assert sum(r["n"] for r in read if r["key"] is not None) == sum(len(tokens(t)) + 1 for t in texts[:5])
    for text, found in zip(texts, lm.Lists.read(pa.array([b"", *(r["ids"] for r in kept)])[1:]).written().to_pylist(), strict=True):
        flat = np.frombuffer(found, "<u2")
        begin = np.flatnonzero(lm.beginnings()[flat])
        assert [w.tobytes() for w in np.split(flat, begin[1:])] == [*write(tokens(text)), np.array([lm.END], "<u2").tobytes()]


@pytest.mark.parametrize("shift", [0.0, 300.0, -300.0])
def test_loss_of_logits_out_of_the_range_of_exp(shift):
    model, windows = trained_on(steps=5)
    ids, targets = windows[:30, :-1], model.group[windows[:30, 1:]]
    want, gradients = model.loss_and_gradients(ids, targets)
    model.weights["b"] = model.weights["b"] + np.float32(shift)  # the same for all classes
    got, moved = model.loss_and_gradients(ids, targets)
    assert got == pytest.approx(want, rel=1e-4)
    for name, g in gradients.items():
        assert moved[name] == pytest.approx(g, rel=1e-2, abs=1e-4)
