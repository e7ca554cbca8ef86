"""Keyed lookups and data-quality checks over clients and payments."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from casewright.functions.text import choose

# The country code that belongs to each country name.
CODE_OF_COUNTRY = {
    "Hong Kong": "HK",
    "Singapore": "SG",
    "Switzerland": "CH",
    "UAE": "AE",
    "UK": "GB",
}


def get_client_profile(clients: DataFrame, client_id) -> DataFrame:
    """Zero rows for an unknown ID."""
    return clients.filter(F.col("client_id") == F.lit(client_id))


def get_clients_by_country(clients: DataFrame, country: str) -> DataFrame:
    return clients.filter(F.col("country") == country)


def get_payment(payments: DataFrame, payment_id) -> DataFrame:
    """Zero rows for an unknown ID."""
    return payments.filter(F.col("payment_id") == F.lit(payment_id))


def get_client_payments(payments: DataFrame, client_id) -> DataFrame:
    """Payment history of one client, oldest first."""
    return payments.filter(F.col("client_id") == F.lit(client_id)).orderBy("payment_date", "payment_id")


def get_policy_document(policy_docs: DataFrame, source: str) -> DataFrame:
    return policy_docs.filter(F.col("source") == source)


def clients_without_payments(clients: DataFrame, payments: DataFrame) -> DataFrame:
    """Each paying client counts once, so a busy one weighs no more than others."""
    return clients.join(payments.select("client_id").distinct(), "client_id", "left_anti")


def country_code_mismatches(payments: DataFrame) -> DataFrame:
    """Payments whose country name and code disagree; the code is authoritative."""
    expected = choose(F.col("beneficiary_country"), CODE_OF_COUNTRY)
    return (
        payments.withColumn("code_of_name", expected)
        .filter(F.col("code_of_name") != F.col("beneficiary_country_code"))
    )
