"""Relations of the two workloads, declared once so that no scan infers types."""

from __future__ import annotations

from pyspark.sql import types as T


def _fields(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in pairs])


STRING = T.StringType()
AMOUNT = T.DecimalType(18, 2)
TOTAL = T.DecimalType(28, 2)

CLIENTS = _fields(
    ("client_id", STRING),
    ("country", STRING),
    ("risk_rating", STRING),
    ("client_type", STRING),
    ("relationship_years", T.DecimalType(4, 1)),
)

PAYMENTS = _fields(
    ("payment_id", STRING),
    ("client_id", STRING),
    ("beneficiary_name", STRING),
    ("beneficiary_country", STRING),
    ("beneficiary_country_code", STRING),
    ("amount", AMOUNT),
    ("currency", STRING),
    ("channel", STRING),
    ("payment_date", T.DateType()),
)

DATA_DICTIONARY = _fields(("file", STRING), ("field", STRING), ("description", STRING))

QUESTIONS = _fields(("question_id", STRING), ("payment_id", STRING), ("question", STRING))

POLICY_DOCS = _fields(
    ("source", STRING), ("text", STRING), ("metadata", T.MapType(STRING, STRING)),
)

RULES = _fields(
    ("rule_id", STRING),
    ("source", STRING),
    ("scope_country", STRING),
    ("kind", STRING),
    ("threshold", AMOUNT),
    ("currency", STRING),
    ("destination_code", STRING),
    ("action", STRING),
)

CORPUS = _fields(
    ("incident", STRING), ("source", STRING), ("ordinal", T.IntegerType()), ("text", STRING),
)

KNOWN_ISSUE_ROW = "issue_id STRING, title STRING, signature STRING, affected_component STRING, notes STRING"
