"""Structuring windows over a stream of payments.

The batch operator's aggregates run incrementally; the watermark lets Spark drop
the state of days that can no longer change.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, functions as F

from casewright import schemas
from casewright.operators.structuring import PAIR


def live_structuring(payments: DataFrame, limit: Decimal, lateness: str = "1 day") -> DataFrame:
    """Client, beneficiary and day as soon as two or more payments pass ``limit``.

    Use the ``update`` output mode to see a window when it first passes (and again
    when it grows), ``append`` to see it once after its day has closed.
    """
    paid_at = F.col("payment_date").cast("timestamp")
    return (
        payments.withColumn("paid_at", paid_at)
        .withWatermark("paid_at", lateness)
        .groupBy(*PAIR, F.window("paid_at", "1 day").alias("day"))
        .agg(F.count("*").alias("payment_count"), F.sum("amount").cast(schemas.TOTAL).alias("total_amount"))
        .filter((F.col("payment_count") >= 2) & (F.col("total_amount") > F.lit(limit)))
        .select(*PAIR, F.col("day.start").cast("date").alias("payment_date"), "payment_count", "total_amount")
    )
