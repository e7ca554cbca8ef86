import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from casewright.llm import gru_language as gru
from tests.llm.frames import clashing, empty

WORDS = {"aa": ["kala", "talo", "mino", "vesi"], "bb": ["strum", "plock", "grent", "drisk"], "cc": ["éçoû", "ñandú", "çaîr"]}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(spark, n=240):
    rng = random.Random(1)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        rows.append((i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randrange(3, 60))), lang, "s", 0))
    rows += [(n, None, "aa", "s", 0), (n + 1, "", "bb", "s", 0), (n + 2, "123 !?", "aa", None, 0), (n + 3, "é", None, "s", 0),
             (n + 4, "kala talo " * 20_000, None, "s", 0), (None, "strum plock", "bb", "s", 0), (5, rows[5][1], rows[5][2], "s", 0)]
    return clashing(spark.createDataFrame(rows, SCHEMA).repartition(3), "row", "h", "lang_pred", "score", "use"), rows


def test_gradients_equal_finite_differences():
    rng = np.random.default_rng(3)
    model = gru.Model(["a", "b", "c"], hidden=3)
    for part in (model, model.ahead, model.back):
        for name, value in vars(part).items():
            if isinstance(value, np.ndarray):
                setattr(part, name, value.astype(np.float64))
    codes, used = rng.integers(0, 5, (7, 4)).astype(np.uint8), rng.random((7, 4)) < 0.8
    labels = np.array([0, 1, 2, 1])
    _, gradients = model.loss_and_gradients(codes, used, labels)
    for p, g in zip(model.parameters(), gradients, strict=True):
        for at in [np.unravel_index(k, p.shape) for k in rng.integers(0, p.size, 6)]:
            before, e = p[at], 1e-5
            p[at] = before + e
            up, _ = model.loss_and_gradients(codes, used, labels)
            p[at] = before - e
            down, _ = model.loss_and_gradients(codes, used, labels)
            p[at] = before
            assert g[at] == pytest.approx((up - down) / (2 * e), abs=1e-7, rel=1e-4)


def test_held_out_accuracy_and_awkward_rows(spark):
    docs, rows = corpus(spark)
    model = gru.trained(docs, gru.learnable())
    assert model.languages == sorted(WORDS)
    out = gru.predict(docs.select("doc_id", "text"), model, "doc_id").withColumn("held_out", gru.fold(F.col("doc_id"), 3) == 1)
    got = out.collect()
    assert len(got) == len(rows)
    truth = {r[0]: r for r in rows}
    held = [r for r in got if r.held_out and r.lang_pred != gru.UNKNOWN and truth[r.doc_id][2]]
    assert len(held) > 40 and np.mean([truth[r.doc_id][2] == r.lang_pred for r in held]) > 0.95
    assert {r.doc_id for r in got if r.lang_pred == gru.UNKNOWN} == {240, 241, 242}
    assert all(0 <= r.score <= 1 for r in got) and {r.score for r in got if r.lang_pred == gru.UNKNOWN} == {0.0}
    assert next(r.lang_pred for r in got if r.doc_id == 244) == "aa"
    again = gru.predict(docs.repartition(5).select("doc_id", "text"), gru.trained(docs.repartition(2), gru.learnable()), "doc_id")
    assert {(r.doc_id, r.lang_pred) for r in again.collect()} == {(r.doc_id, r.lang_pred) for r in got}
    kept = gru.known_language(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3


def test_a_document_is_the_mean_of_its_positions():
    model = gru.Model(["a", "b"])
    text = "some text é " * 30
    data = text.encode()
    codes, _ = gru._codes([data[a:a + gru.WINDOW] for a in range(0, len(data), gru.WINDOW)])
    p = model.probabilities(codes).transpose(0, 2, 1).reshape(2, -1)[:, :len(data)].mean(1)
    (lang,), (score,) = model.documents([text])
    assert score == pytest.approx(p.max(), rel=1e-4) and lang == "ab"[p.argmax()]
    assert len(model.labels(text)) == len(data)
    many = model.documents([text] * 200 + [None, "7"])
    assert many[0][-2:] == ["und", "und"] and np.allclose(many[1][:200], score, rtol=1e-4)


def test_nothing_to_learn_from(spark):
    docs, _ = corpus(spark, 20)
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert gru.trained(unlabelled, gru.learnable()) is None
    assert gru.known_language(unlabelled).count() == 24
    assert gru.known_language(empty(spark)).count() == 0


def test_the_sample_is_the_least_hashes_whatever_repeats(spark):
    rows = [(i, f"text {i}", "aa" if i % 3 else "bb", "s", 0) for i in range(900)]
    rows += [(None, f"text {i % 40}", "bb", "s", 0) for i in range(4000)]  # most rows of a language are copies
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    every = docs.select("lang", F.xxhash64(F.lit(gru.SEED), "doc_id", "text").alias("h")).distinct().collect()
    for wanted in (1, 10, 320, 2000):
        want = {lang: sorted(r.h for r in every if r.lang == lang)[:wanted] for lang in ("aa", "bb")}
        got = gru.sample(docs, F.lit(True), wanted)
        assert [(r.lang, r.h) for r in got] == [(lang, h) for lang in ("aa", "bb") for h in want[lang]]
