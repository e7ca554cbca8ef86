import datetime
import sys
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from casewright import schemas  # noqa: E402
from casewright.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g"})
    session.sparkContext.setLogLevel("FATAL")
    yield session
    session.stop()


# The wording of the policy corpus.
POLICIES = {
    "global_payment_policy.md": (
        "# Global Payment Monitoring Policy 2026\n\n"
        "- Payments above USD 100,000 equivalent require enhanced review before release.\n"
        "- Payments to high-risk jurisdictions require additional review.\n"
        "- Multiple payments to the same beneficiary by the same client within 24 hours\n"
        "  should be reviewed for potential structuring if their combined value exceeds\n"
        "  USD 100,000 equivalent.\n"
        "- A policy trigger does not by itself establish suspicious activity.\n"),
    "high_risk_jurisdictions.md": (
        "# High-Risk Jurisdiction List 2026\n\n"
        "For this exercise AE (UAE) is a high-risk destination.\nPayments to AE require additional review.\n"),
    "investigation_procedure.md": (
        "# Payment Investigation Procedure\n\n1. Establish client and payment facts.\n"
        "2. Identify the applicable policy.\n3. Check high-risk destination indicators.\n"
        "4. Check for possible transaction splitting.\n5. Separate observed facts from assumptions.\n"
        "6. Record the evidence supporting the recommendation.\n"),
    "regional_singapore.md": (
        "# Singapore Payment Procedure 2026\n\n"
        "- Payments above USD 75,000 equivalent require RM review.\n"
        "- Payments above USD 100,000 equivalent require enhanced review.\n"
        "- High-risk destinations require additional review.\n"),
    "regional_switzerland.md": (
        "# Switzerland Payment Procedure 2026\n\n"
        "- Payments above CHF 80,000 equivalent require RM review.\n"
        "- Payments above CHF 120,000 equivalent require enhanced review.\n"
        "- Potential structuring should be escalated to Compliance.\n"),
    "decoy_operational_1.md": "# Administrative Note\nThis document contains no payment-monitoring thresholds.\n",
}

# The payments and clients that the worked examples speak of.
PAYMENTS = [
    ("P50000", "C2000", "Redwood Services", "UK", "SG", "12000.00", "USD", "Branch", "2026-01-23"),
    ("P50001", "C2001", "Desert Star LLC", "UAE", "AE", "125000.00", "USD", "Branch", "2026-05-11"),
    ("P50002", "C2002", "Pacific Holdings", "Hong Kong", "AE", "85000.00", "USD", "Branch", "2026-04-27"),
    ("P50003", "C2003", "Northstar Trading", "Singapore", "CH", "45000.00", "CHF", "Branch", "2026-04-11"),
    ("P50004", "C2003", "Redwood Services", "UK", "CH", "48000.00", "CHF", "RM-assisted", "2026-01-26"),
    ("P50005", "C2003", "Pacific Holdings", "UAE", "AE", "47000.00", "CHF", "Online", "2026-02-18"),
    ("P50006", "C2023", "Pacific Holdings", "Hong Kong", "HK", "24110.41", "SGD", "RM-assisted", "2026-01-19"),
    ("P50180", "C2003", "Northstar Trading", "Singapore", "CH", "35000.00", "CHF", "Online", "2026-04-11"),
    ("P50181", "C2003", "Northstar Trading", "Singapore", "CH", "30000.00", "CHF", "RM-assisted", "2026-04-11"),
    ("P50182", "C2006", "Northstar Trading", "Singapore", "CH", "15000.00", "USD", "Online", "2026-04-11"),
    ("P50183", "C2003", "Desert Star LLC", "UAE", "AE", "25000.00", "CHF", "Online", "2026-04-11"),
]
CLIENTS = [
    ("C2000", "UAE", "Medium", "Individual", "13.0"),
    ("C2001", "Singapore", "Low", "Individual", "3.1"),
    ("C2002", "Singapore", "Medium", "Individual", "11.5"),
    ("C2003", "Switzerland", "Low", "Corporate", "12.1"),
    ("C2006", "UK", "Low", "Individual", "2.0"),
    ("C2021", "UK", "Low", "Individual", "2.0"),
    ("C2023", "UK", "Medium", "Individual", "2.0"),
]


def payment_rows(rows):
    return [(*r[:5], Decimal(r[5]), *r[6:8], datetime.date.fromisoformat(r[8])) for r in rows]


@pytest.fixture(scope="session")
def payments(spark):
    return spark.createDataFrame(payment_rows(PAYMENTS), schemas.PAYMENTS)


@pytest.fixture(scope="session")
def clients(spark):
    return spark.createDataFrame([(*c[:4], Decimal(c[4])) for c in CLIENTS], schemas.CLIENTS)


@pytest.fixture(scope="session")
def policies(spark):
    return spark.createDataFrame([(s, t, {}) for s, t in POLICIES.items()], schemas.POLICY_DOCS)


@pytest.fixture()
def make_payments(spark):
    """Payments from (id, client, beneficiary, code, amount, currency, date)."""
    def make(rows):
        full = [(i, c, b, "UK", code, amount, cur, "Online", day) for i, c, b, code, amount, cur, day in rows]
        return spark.createDataFrame(payment_rows(full), schemas.PAYMENTS)
    return make
