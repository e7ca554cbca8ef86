"""CSV and JSON sources and sinks of the payment workload."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from casewright import schemas


def _read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema, mode="FAILFAST", enforceSchema=False)


def read_clients(spark: SparkSession, path: str) -> DataFrame:
    return _read_csv(spark, path, schemas.CLIENTS)


def read_payments(spark: SparkSession, path: str) -> DataFrame:
    return _read_csv(spark, path, schemas.PAYMENTS)


def read_data_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return _read_csv(spark, path, schemas.DATA_DICTIONARY)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions in file order (``position``): JSON Lines, which are read in splits,
    where the name ends in .jsonl, else one JSON array, which one task has to parse."""
    return (
        spark.read.schema(schemas.QUESTIONS).json(path, multiLine=not path.endswith(".jsonl"))
        .withColumn("position", F.monotonically_increasing_id())
    )


def describe_columns(df: DataFrame, dictionary: DataFrame, file: str) -> DataFrame:
    """Attach the dictionary's descriptions to ``df`` as column comments."""
    described = {
        row.field: row.description
        for row in dictionary.filter(F.col("file") == file).select("field", "description").collect()
    }
    for name in df.columns:
        if name in described:
            df = df.withMetadata(name, {"comment": described[name]})
    return df


def write_answer_file(answers: DataFrame, path: str, order_by: str = "question_id", drop: list[str] | None = None) -> None:
    """One indented JSON array, the submission format of a question batch.

    Rows are streamed to the file one partition at a time in output order, so
    the driver never holds the whole batch.
    """
    _stream_json(answers.orderBy(order_by).drop(*(drop or [])), path, opening="[", closing="]",
                 render=lambda row: json.dumps(_plain(row.asDict(recursive=True)), indent=2))


def write_answer_lines(answers: DataFrame, path: str) -> None:
    """The distributed form of the same sink: JSON Lines, one file per task."""
    answers.write.mode("error").json(path)


def write_report_file(reports: DataFrame, path: str) -> None:
    """One JSON object keyed by incident name."""

    def render(row) -> str:
        record = _plain(row.asDict(recursive=True))
        name = record.pop("incident")
        return f"{json.dumps(name)}: {json.dumps(record, indent=2)}"

    _stream_json(reports.orderBy("incident"), path, opening="{", closing="}", render=render)


def _stream_json(ordered: DataFrame, path: str, opening: str, closing: str, render) -> None:
    with open(path, "w", encoding="utf-8") as sink:
        sink.write(opening)
        for index, row in enumerate(ordered.toLocalIterator()):
            sink.write(",\n" if index else "\n")
            sink.write(render(row))
        sink.write(f"\n{closing}\n")


def _plain(record: dict) -> dict:
    """``facts`` travels as JSON text inside Spark and as an object outside."""
    if isinstance(record.get("facts"), str):
        record["facts"] = json.loads(record["facts"])
    return record
