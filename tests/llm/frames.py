"""Fixtures: documents with every awkward case, and columns whose names clash."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, first=0, **columns):
    """``texts`` as a documents table; ``columns``: further columns by name, one value for all rows."""
    rows = [(first + i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return clashing(spark.createDataFrame(rows, DOCS).coalesce(2), *columns)


def clashing(df, *names):
    from pyspark.sql import functions as F
    for name in names:
        df = df.withColumn(name, F.lit("clash"))
    return df


def empty(spark, schema=DOCS):
    return spark.createDataFrame([], schema)
