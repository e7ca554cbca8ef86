"""The tools and both entry points as plain functions over dicts.

Each call builds a small plan and fetches its result. Lists come as iterators,
read partition by partition, because a client's history may be of any length.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import SparkSession

from casewright import schemas
from casewright.operators import lookups, retrieval, rules, structuring
from casewright.plans import incident, investigation
from casewright.plans.registry import largest_window, record, records
from casewright.session import cut_lineage
from casewright.sources import corpus as corpora, tabular


class PaymentDesk:
    """Lookups, policy search and question answering over one data folder. The
    policy index is built on the first search and reused."""

    def __init__(self, spark: SparkSession, data_dir: str) -> None:
        self.spark = spark
        self.payments = tabular.read_payments(spark, f"{data_dir}/payments.csv")
        self.clients = tabular.read_clients(spark, f"{data_dir}/clients.csv")
        self.policies = corpora.load_policy_documents(spark, f"{data_dir}/policies")
        self._index = None

    @property
    def index(self):
        if self._index is None:
            self._index = investigation.policy_index(self.policies)
        return self._index

    def get_client_profile(self, client_id: str) -> dict:
        return record(lookups.get_client_profile(self.clients, client_id))

    def get_clients_by_country(self, country: str) -> Iterator[dict]:
        return records(lookups.get_clients_by_country(self.clients, country))

    def get_payment(self, payment_id: str) -> dict:
        return record(lookups.get_payment(self.payments, payment_id))

    def get_client_payments(self, client_id: str) -> Iterator[dict]:
        return records(lookups.get_client_payments(self.payments, client_id))

    def aggregate_beneficiary_24h(self, client_id: str, beneficiary_name: str) -> dict:
        return largest_window(self.payments, client_id, beneficiary_name)

    def find_repeated_beneficiaries(self, client_id: str) -> Iterator[dict]:
        own = self.payments.filter(self.payments.client_id == client_id)
        return records(structuring.find_repeated_beneficiaries(own))

    def search_policy(self, query: str, top_k: int = 5) -> list[dict]:
        return [row.asDict() for row in retrieval.search_policy(self.index, query, top_k).collect()]

    def get_policy_document(self, source: str) -> dict:
        return record(lookups.get_policy_document(self.policies, source))

    def run_agent(self, question: str, payment_id: str) -> dict:
        asked = self.spark.createDataFrame([("question", payment_id, question)], schemas.QUESTIONS)
        answer = record(investigation.answer_questions(
            asked, self.payments, self.clients, rules.parse_rules(self.policies), self.policies, self.index, lists=True))
        return {"answer": answer["answer"], "citations": answer["citations"],
                "facts": json.loads(answer["facts"]), "tools_used": answer["tools_used"]}


def load_incident(spark: SparkSession, data_dir: str, name: str) -> tuple[str, dict[str, str]]:
    """The query of one incident and its documents by file name, in corpus order."""
    queries, corpus = corpora.load_incidents(spark, data_dir)
    query = record(queries.filter(queries.incident == name))["query"]
    documents = corpus.filter(corpus.incident == name).orderBy("ordinal")
    return query, {row["source"]: row["text"] for row in records(documents)}


def investigate(spark: SparkSession, query: str, corpus: dict[str, str]) -> dict:
    """One incident given as texts; exactly the seven report keys."""
    name = "incident"
    documents = spark.createDataFrame(
        [(name, source, i, text) for i, (source, text) in enumerate(corpus.items(), start=1)], schemas.CORPUS)
    asked = spark.createDataFrame([(name, query)], "incident string, query string")
    report = record(incident.reports_of(asked, cut_lineage(documents)))
    return {key: report[key] for key in incident.REPORT_KEYS}
