import random

import pytest
from pyspark.sql import functions as F

from casewright.operators import index_segments, retrieval
from casewright.operators.index_segments import SegmentedIndex

TEXTS = "source string, text string"


def rebuilt(spark, documents):
    rows = [(source, text) for source, texts in documents.items() for text in texts]
    return retrieval.with_norm(retrieval.index_rows(retrieval.chunk_documents(spark.createDataFrame(rows, TEXTS))))


def contents(rows):
    return sorted((r.chunk_id, r.source, r.text, tuple(r.words), r.n_words, r.norm) for r in rows.select(*index_segments._ROWS).collect())


def figures(rows):
    return sorted(map(tuple, rows.select("term", "chunk_count", "term_count").collect()))


def same(spark, index, documents):
    whole = rebuilt(spark, documents)
    assert contents(index.live()) == contents(whole)
    assert figures(index.term_statistics()) == figures(retrieval.term_statistics(whole))
    assert tuple(index.sizes().first()) == (whole.count(), whole.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0])


def test_random_changes_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(3)
    text = lambda: "\n\n".join(" ".join(rng.choices(["a", "b", "review", "of", "payments"], k=rng.randrange(6))) for _ in range(2))
    index, documents = SegmentedIndex(spark, str(tmp_path / "index")), {}
    for _ in range(7):
        new = [(f"s{rng.randrange(12)}", text()) for _ in range(rng.randrange(1, 6))]
        new += [(f"s{rng.randrange(12)}", rng.choice([None, "", "..."]))]
        gone = [(f"s{rng.randrange(14)}",) for _ in range(2)]
        index.change(spark.createDataFrame(new, TEXTS), spark.createDataFrame(gone, "source string"))
        for (source,) in gone:
            documents.pop(source, None)
        for source in {s for s, _ in new}:
            documents[source] = [t for s, t in new if s == source]
    same(spark, index, documents)
    assert len(index.commits()) < 7  # some were merged
    same(spark, SegmentedIndex(spark, str(tmp_path / "index")), documents)  # opened anew


def test_merging_keeps_marks_that_are_still_needed(spark, tmp_path):
    index = SegmentedIndex(spark, str(tmp_path / "index"))
    large = {f"d{i}": [f"word{i} common"] for i in range(40)}
    index.change(spark.createDataFrame([(s, t[0]) for s, t in large.items()], TEXTS))
    for i in range(4):
        index.change(removed=spark.createDataFrame([(f"d{i}",)], "source string"))
        large.pop(f"d{i}")
    commits = index.commits()
    assert any(row.segment.startswith("merged") for row in commits) and len(commits) < 5
    same(spark, index, large)


def test_removed_rows_are_counted_without_tokenising_again(spark, tmp_path, monkeypatch):
    index = SegmentedIndex(spark, str(tmp_path / "index"))
    index.change(spark.createDataFrame([("a", "one two"), ("b", "two three")], TEXTS))
    seen = []
    tokenize = retrieval.tokenize
    monkeypatch.setattr(retrieval, "tokenize", lambda column: seen.append(1) or tokenize(column))
    index.change(removed=spark.createDataFrame([("a",)], "source string"))
    assert not seen
    same(spark, index, {"b": ["two three"]})


def test_a_change_that_died_is_not_seen(spark, tmp_path, monkeypatch):
    index = SegmentedIndex(spark, str(tmp_path / "index"))
    index.change(spark.createDataFrame([("a", "one")], TEXTS))
    with monkeypatch.context() as patch:
        patch.setattr(SegmentedIndex, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            index.change(spark.createDataFrame([("a", "two"), ("b", "two")], TEXTS))
    same(spark, index, {"a": ["one"]})
    index.change(spark.createDataFrame([("b", "three")], TEXTS))
    same(spark, index, {"a": ["one"], "b": ["three"]})


def test_searches_run_on_live_rows(spark, tmp_path):
    index = SegmentedIndex(spark, str(tmp_path / "index"))
    index.change(spark.createDataFrame([("a", "review of payments"), ("b", "review review payments"), (None, "no source")], TEXTS))
    assert index.live().count() == 3
    index.change(removed=spark.createDataFrame([("b",), (None,)], "source string"))
    assert [r.source for r in retrieval.search_policy(index.live(), "review payments").collect()] == ["a"]
    index.change()
    assert SegmentedIndex(spark, str(tmp_path / "other")).live().count() == 0
