"""What the plans must not contain, with every automatic broadcast switched off."""

import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registered
from casewright.operators import retrieval, rules, structuring
from casewright.plans import catalog
from casewright.sources import warehouse


@pytest.fixture()
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def physical(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_cross_join_no_python_no_single_task_window(no_broadcast, name):
    plan = physical(registered.queries()[name](no_broadcast, registered.SMOKE_DIR))
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|EvalPython|InPandas", plan)
    for window in re.finditer(r"Window \[.*\], \[(.*?)\], \[", plan):
        assert window.group(1)


def test_scan_reads_only_needed_columns_and_filters_before_the_order_join(no_broadcast):
    df = rules.review_decisions(
        warehouse.payments(no_broadcast, registered.SMOKE_DIR), warehouse.clients(no_broadcast, registered.SMOKE_DIR),
        rules.standard_rules(no_broadcast))
    plan = physical(df)
    lineitem = re.search(r"ReadSchema: struct<(l_orderkey[^>]*)>", plan).group(1)
    assert [c.split(":")[0] for c in lineitem.split(",")] == [
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]
    order_join = plan.index("SortMergeJoin [l_orderkey")
    assert plan.index("array_contains(Subquery") > order_join


def test_a_payment_is_read_by_its_keys(no_broadcast):
    no_broadcast.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = physical(registered.queries()["payment_lookup"](no_broadcast, registered.SMOKE_DIR))
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(l_orderkey", plan) and "EqualTo(o_orderkey" in plan
    no_broadcast.conf.unset("spark.sql.maxMetadataStringLength")


def test_aggregates_hash_and_combine_before_the_shuffle(no_broadcast):
    plan = physical(structuring.beneficiary_windows(warehouse.payments(no_broadcast, registered.SMOKE_DIR)))
    assert "SortAggregate" not in plan and "partial_sum" in plan


def test_top_k_keeps_few_rows_per_task(no_broadcast):
    for name, operator in (("bm25_topk", "TakeOrderedAndProject"), ("policy_evidence", "WindowGroupLimit")):
        assert operator in physical(registered.queries()[name](no_broadcast, registered.SMOKE_DIR))


@pytest.mark.parametrize("postings_rows, weight_rows", [(0, 10), (0, 10_000), (10_000, 10)])
def test_every_way_of_scoring_a_batch_agrees(spark, monkeypatch, postings_rows, weight_rows):
    draw = random.Random(3)
    vocabulary = ["the"] * 20 + [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    chunks = spark.createDataFrame([(f"c{i}", "s", text(12)) for i in range(60)], "chunk_id string, source string, text string")
    questions = spark.createDataFrame([(f"q{i}", text(6)) for i in range(15)], "question_id string, question string")
    index = retrieval.index_rows(chunks)
    as_dict = lambda df: {(r.question_id, r.chunk_id): r.score for r in df.collect()}
    expected = as_dict(retrieval.score_all(index, questions))
    monkeypatch.setattr(retrieval, "POSTINGS_ROWS", postings_rows)
    monkeypatch.setattr(retrieval, "WEIGHT_ROWS", weight_rows)
    assert as_dict(retrieval.score_all(index, questions)) == expected
    assert len(expected) > 300


def test_pairs_of_a_batch_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "POSTINGS_ROWS", 0)
    chunks = spark.range(50).select(F.col("id").cast("string").alias("chunk_id"), F.lit("s").alias("source"), F.lit("a b").alias("text"))
    more = chunks.withColumn("text", F.concat_ws(" ", "text", "chunk_id"))
    questions = spark.createDataFrame([("q", "a 7 9")], "question_id string, question string")
    plan = physical(retrieval.score_all(retrieval.index_rows(more), questions))
    assert plan.count("Exchange hashpartitioning") == 1 and "hashpartitioning(chunk_id" in plan


@pytest.mark.parametrize("name, scans", [("rolling_24h_activity", 1), ("asof_prior_event", 2), ("event_pair_latency", 2)])
def test_both_parts_of_a_running_aggregate_share_one_shuffle(no_broadcast, name, scans):
    df = registered.queries()[name](no_broadcast, registered.SMOKE_DIR)
    df.collect()
    final = physical(df).split("Initial Plan")[0]
    assert "ReusedExchange" in final and final.count("FileScan") == scans
