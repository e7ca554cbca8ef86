"""The tools as SQL table functions, to be called by name and joined laterally.

    SELECT * FROM get_payment('P50001')
    SELECT q.question_id, t.* FROM questions q, LATERAL get_client_payments(q.client_id) t

A function is a query over a view, so Spark plans it with the query that calls it: an
argument reaches the scan as a filter, and a lateral call becomes a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from casewright.functions.text import WORD_BREAK
from casewright.operators import retrieval, structuring

VIEWS = ("tool_payments", "tool_clients", "tool_windows", "tool_chunks", "tool_postings", "tool_terms")


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _function(name: str, parameters: str, rows: DataFrame, query: str) -> str:
    columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) RETURN {query}"


def register(payments: DataFrame, clients: DataFrame, index: DataFrame) -> list[str]:
    """Create the five tools as temporary functions of the session, over temporary views
    ``tool_*``; returns their names.

    ``index`` is a stored index (``retrieval.build_index``). Unknown and null arguments give
    no rows. ``search_policy`` gives every passage with a positive score; ordered by score and
    chunk, its first rows are those of ``retrieval.search_policy``.
    """
    spark = payments.sparkSession
    windows = structuring.beneficiary_windows(payments)
    postings = retrieval._postings(retrieval.with_norm(index), []).select("chunk_id", "term", "chunk_weight")
    n = index.agg(F.count("*")).scalar()
    terms = postings.groupBy("term").agg(F.count("*").alias("df")).select("term", F.ln(n / F.col("df")).alias("idf"))
    chunks = index.select("chunk_id", "source", "text")
    for view, rows in zip(VIEWS, (payments, clients, windows, chunks, postings, terms), strict=True):
        rows.createOrReplaceTempView(view)

    client = _kind(payments, "client_id")
    hits = spark.createDataFrame([], "chunk_id string, source string, text string, score double")
    pattern = WORD_BREAK.replace("\\", "\\\\")
    functions = {
        "get_client_profile": _function(
            "get_client_profile", f"wanted {_kind(clients, 'client_id')}", clients,
            f"SELECT {', '.join(clients.columns)} FROM tool_clients WHERE client_id = wanted"),
        "get_payment": _function(
            "get_payment", f"wanted {_kind(payments, 'payment_id')}", payments,
            f"SELECT {', '.join(payments.columns)} FROM tool_payments WHERE payment_id = wanted"),
        "get_client_payments": _function(
            "get_client_payments", f"wanted {client}", payments,
            f"SELECT {', '.join(payments.columns)} FROM tool_payments WHERE client_id = wanted"),
        "aggregate_beneficiary_24h": _function(
            "aggregate_beneficiary_24h", f"wanted {client}, beneficiary string", windows,
            f"SELECT {', '.join(windows.columns)} FROM tool_windows WHERE client_id = wanted AND beneficiary_name = beneficiary"),
        "search_policy": _function(
            "search_policy", "question string", hits, f"""
            WITH asked AS (SELECT term, count(*) AS tf FROM explode(array_remove(split(lower(question), '{pattern}'), '')) AS w(term) GROUP BY term),
            weights AS (SELECT term, (1 + ln(CAST(tf AS DOUBLE))) * idf AS weight FROM asked JOIN tool_terms USING (term)),
            scores AS (SELECT chunk_id, round(sum(weight * chunk_weight) / (SELECT sqrt(sum(weight * weight)) FROM weights), {retrieval.SCORE_DIGITS}) AS score
                       FROM weights JOIN tool_postings USING (term) WHERE weight > 0 GROUP BY chunk_id)
            SELECT chunk_id, source, text, score FROM scores JOIN tool_chunks USING (chunk_id) WHERE score > 0"""),
    }
    for statement in functions.values():
        spark.sql(statement)
    return list(functions)
