"""Text corpora: policy folders and incident folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

FILE_NAME = "_metadata.file_name"
FILE_PATH = "_metadata.file_path"


def load_policy_documents(spark: SparkSession, policy_directory: str) -> DataFrame:
    """(source, text, metadata): one row per Markdown file of the folder."""
    return (
        spark.read.text(policy_directory, wholetext=True, pathGlobFilter="*.md")
        .select(
            F.col(FILE_NAME).alias("source"),
            F.col("value").alias("text"),
            F.create_map(F.lit("path"), F.col(FILE_PATH)).alias("metadata"),
        )
    )


def _incident_name() -> Column:
    return F.element_at(F.split(F.col(FILE_PATH), "/"), -2)


def load_incidents(spark: SparkSession, data_dir: str) -> tuple[DataFrame, DataFrame]:
    """All incident folders below ``data_dir`` as (queries, corpus).

    ``queries`` is (incident, query); ``corpus`` is (incident, source, ordinal,
    text) with Markdown files first, then CSV files, each sorted by name.
    """
    folders = f"{data_dir.rstrip('/')}/*/"
    queries = (
        spark.read.text(folders, wholetext=True, pathGlobFilter="query.txt")
        .select(
            _incident_name().alias("incident"),
            F.regexp_replace("value", r"^\s+|\s+$", "").alias("query"),
        )
    )
    by_kind_then_name = Window.partitionBy("incident").orderBy(F.col("source").endswith(".csv"), "source")
    corpus = (
        spark.read.text(folders, wholetext=True, pathGlobFilter="*.{md,csv}")
        .select(
            _incident_name().alias("incident"),
            F.col(FILE_NAME).alias("source"),
            F.col("value").alias("text"),
        )
        .withColumn("ordinal", F.row_number().over(by_kind_then_name))
        .select("incident", "source", "ordinal", "text")
    )
    return queries, corpus


def scan_lines(spark: SparkSession, data_dir: str, source: str) -> DataFrame:
    """(incident, line) of one document type of every incident folder. Files are
    read in splits, so a log of any size is parsed in parallel."""
    return (
        spark.read.text(f"{data_dir.rstrip('/')}/*/", pathGlobFilter=source)
        .select(_incident_name().alias("incident"), F.col("value").alias("line"))
    )


def corpus_lines(corpus: DataFrame, source: str) -> DataFrame:
    """The same relation from documents that are already in memory as texts."""
    return (
        corpus.filter(F.col("source") == source)
        .select("incident", F.explode(F.split("text", r"\r?\n")).alias("line"))
    )
