"""A training corpus from ``documents``, in stages that are written and read again.

Each stage takes all that the one before kept. The first four return the columns of
``documents``; the last returns the place and checksum of every document's ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from casewright.llm.budget_mix import mixed
from casewright.llm.common import table
from casewright.llm.golay_dedup import one_of_each
from casewright.llm.gru_language import known_language
from casewright.llm.positional_index import clean
from casewright.llm.repair_tokens import written_and_read
from casewright.session import cut_lineage


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a language go: null texts and texts without any letter."""
    return known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked fingerprints stays, the least id. Null and empty texts
    are one group; of repeated rows one stays. All columns are carried, whatever their names."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows go of which a twentieth or more of the words are benchmark windows. Texts without
    words stay; without benchmark items all rows do."""
    return clean(docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it: not at all, once or twice. Texts without words
    go, a null source is one of its own."""
    return mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Compressed shards of token ids are written, and each document is decoded from them: one
    row per row, in the order of ids (null first), also where ids repeat."""
    return written_and_read(docs)


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing),
    ("token-ID output", token_ids),
]

#: The first and the last stage hold a trained model and a tokenizer, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs
