import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from casewright.functions.currency import currency_code, currency_number
from casewright.operators import rules, structuring
from casewright.operators.skew import salted_join


def test_the_split_payment_is_found_once(spark, payments, clients):
    found = structuring.structuring_triggers(payments, clients, rules.standard_rules(spark)).collect()
    assert {r.rule_id for r in found} == {"global-structuring", "switzerland-escalation"}
    for row in found:
        assert (row.client_id, row.beneficiary_name, str(row.payment_date)) == ("C2003", "Northstar Trading", "2026-04-11")
        assert (row.payment_count, row.total_amount, row.currency) == (3, Decimal("110000.00"), "CHF")


def test_members_keep_their_ids(payments):
    windows = structuring.beneficiary_windows(payments).filter("payment_count >= 2")
    members = structuring.window_members(payments, windows)
    assert {r.payment_id for r in members.collect()} == {"P50003", "P50180", "P50181"}


def test_adjacent_days_are_two_windows(spark, make_payments, clients):
    df = make_payments([
        ("A", "C2000", "X", "GB", "60000.00", "USD", "2026-06-23"),
        ("B", "C2000", "X", "GB", "60000.00", "USD", "2026-06-24"),
    ])
    assert structuring.structuring_triggers(df, clients, rules.standard_rules(spark)).count() == 0
    assert structuring.find_repeated_beneficiaries(df).first().payment_count == 2


def test_one_payment_alone_and_an_exact_total_do_not_trigger(spark, make_payments, clients):
    df = make_payments([
        ("A", "C2000", "X", "GB", "150000.00", "USD", "2026-06-23"),
        ("B", "C2000", "Y", "GB", "60000.00", "USD", "2026-06-24"),
        ("C", "C2000", "Y", "GB", "40000.00", "USD", "2026-06-24"),
    ])
    assert structuring.structuring_triggers(df, clients, rules.standard_rules(spark)).count() == 0


def test_mixed_currencies_are_marked_and_split(make_payments):
    df = make_payments([
        ("A", "C2000", "X", "GB", "60000.00", "USD", "2026-06-23"),
        ("B", "C2000", "X", "GB", "50000.00", "CHF", "2026-06-23"),
    ])
    window = structuring.aggregate_beneficiary_24h(df, "C2000", "X").first()
    assert (window.payment_count, window.total_amount, window.currency) == (2, Decimal("110000.00"), "mixed")
    totals = {r.currency: r.total_amount for r in structuring.currency_totals(df).collect()}
    assert totals == {"USD": Decimal("60000.00"), "CHF": Decimal("50000.00")}


def test_currency_codes_survive_the_number(spark):
    df = spark.createDataFrame([("USD",), ("CHF",), ("HKD",), ("USDT",), ("dollar",), ("long code",), (None,)], "c string")
    back = df.select("c", currency_code(currency_number(F.col("c"))).alias("back")).collect()
    assert {r.c: r.back for r in back} == {"USD": "USD", "CHF": "CHF", "HKD": "HKD", "USDT": "USDT", "dollar": "dollar", "long code": None, None: None}


@pytest.mark.parametrize("small_rows", [0, 1000])
def test_salted_join_equals_a_plain_join(spark, small_rows):
    draw = random.Random(1)
    rows = [(0 if draw.random() < 0.4 else draw.randint(1, 50), i) for i in range(3000)]
    left = spark.createDataFrame(rows, "key int, value int")
    right = left.groupBy("key").agg(F.count("*").alias("n"), F.sum("value").alias("total")).filter("key % 3 = 0")
    joined = salted_join(left, right, ["key"], "n", share=20, small_rows=small_rows)
    expected = left.join(right, "key")
    assert joined.columns == expected.columns
    assert sorted(joined.collect()) == sorted(expected.collect())


def test_salted_join_spreads_the_heavy_key(spark):
    left = spark.range(4000).select((F.when(F.col("id") < 3000, 0).otherwise(F.col("id"))).alias("key"), "id")
    right = left.groupBy("key").agg(F.count("*").alias("n"))
    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {key: spark.conf.get(key) for key in plain}
    for key, value in plain.items():
        spark.conf.set(key, value)
    try:
        joined = salted_join(left, right, ["key"], "n", share=40, small_rows=0)
        per_task = joined.filter("key = 0").groupBy(F.spark_partition_id()).count().collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert sum(r["count"] for r in per_task) == 3000
    assert len(per_task) == 4


def test_one_currency_of_any_length_is_never_mixed(make_payments):
    rows = [("1", "C1", "B", "GB", "5.00", "USDT", "2026-01-01"), ("2", "C1", "B", "GB", "5.00", "USDT", "2026-01-01"),
            ("3", "C2", "B", "GB", "5.00", "A-LONG-CODE", "2026-01-01"), ("4", "C2", "B", "GB", "5.00", "A-LONG-CODE", "2026-01-01"),
            ("5", "C3", "B", "GB", "5.00", "USDT", "2026-01-01"), ("6", "C3", "B", "GB", "5.00", "USD", "2026-01-01")]
    found = {r.client_id: r.currency for r in structuring.beneficiary_windows(make_payments(rows)).collect()}
    assert found == {"C1": "USDT", "C2": None, "C3": "mixed"}


def test_without_a_heavy_key_there_is_no_salt(spark):
    rows = spark.range(200).selectExpr("id % 100 AS key", "id AS value")
    per_key = spark.range(100).selectExpr("id AS key", "2L AS n")
    joined = salted_join(rows, per_key, ["key"], "n", share=10, small_rows=0)
    assert joined.count() == 200
    assert "_salt" not in joined._jdf.queryExecution().optimizedPlan().toString()
