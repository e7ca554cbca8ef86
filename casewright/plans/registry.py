"""The five registered tools: name, description, parameters and a DataFrame result.

Results stay DataFrames, so a caller can go on computing with them. ``record``
and ``records`` turn them into plain dicts at the edge, ``records`` lazily.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from casewright.operators import lookups, retrieval, structuring


@dataclass(frozen=True)
class Tool:
    name: str
    description: str
    parameters: dict[str, str]
    run: Callable[..., DataFrame]

    def schema(self) -> dict:
        """The tool as a JSON-schema function description."""
        return {
            "name": self.name,
            "description": self.description,
            "parameters": {
                "type": "object",
                "properties": {name: {"type": kind} for name, kind in self.parameters.items()},
                "required": [name for name in self.parameters if name != "top_k"],
            },
        }


def tools(payments: DataFrame, clients: DataFrame, index: DataFrame) -> dict[str, Tool]:
    entries = [
        Tool("get_client_profile", "One client's country, risk rating, type and relationship duration.",
             {"client_id": "string"}, lambda client_id: lookups.get_client_profile(clients, client_id)),
        Tool("get_payment", "One payment by ID.",
             {"payment_id": "string"}, lambda payment_id: lookups.get_payment(payments, payment_id)),
        Tool("get_client_payments", "Payment history of a client, oldest first.",
             {"client_id": "string"}, lambda client_id: lookups.get_client_payments(payments, client_id)),
        Tool("aggregate_beneficiary_24h", "Count and total per 24-hour window of one client and beneficiary.",
             {"client_id": "string", "beneficiary_name": "string"},
             lambda client_id, beneficiary_name: structuring.aggregate_beneficiary_24h(
                 payments, client_id, beneficiary_name)),
        Tool("search_policy", "Best policy passages for a question, with their source.",
             {"query": "string", "top_k": "integer"},
             lambda query, top_k=5: retrieval.search_policy(index, query, top_k)),
    ]
    return {tool.name: tool for tool in entries}


def record(df: DataFrame) -> dict:
    """The first row as a dict; empty for an unknown key."""
    row = df.first()
    return row.asDict(recursive=True) if row else {}


def records(df: DataFrame) -> Iterator[dict]:
    """Rows as dicts, fetched partition by partition."""
    return (row.asDict(recursive=True) for row in df.toLocalIterator())


def largest_window(payments: DataFrame, client_id, beneficiary_name: str) -> dict:
    """count, total_amount and payments of the pair's largest 24-hour window; of
    equal totals the earliest. ``payments`` is an iterator over the members."""
    windows = structuring.aggregate_beneficiary_24h(payments, client_id, beneficiary_name)
    best = record(windows.orderBy(F.desc("total_amount"), "payment_date").limit(1))
    if not best:
        return {"count": 0, "total_amount": 0, "payments": iter(())}
    members = payments.filter(
        (F.col("client_id") == F.lit(client_id)) & (F.col("beneficiary_name") == F.lit(beneficiary_name))
        & (F.col("payment_date") == F.lit(best["payment_date"])))
    return {"count": best["payment_count"], "total_amount": best["total_amount"],
            "currency": best["currency"], "payment_date": best["payment_date"],
            "payments": records(members.orderBy("payment_id"))}
