import pytest

from casewright import schemas
from casewright.operators import lookups, rules


def test_rules_are_parsed_from_prose(spark, policies):
    parsed = rules.parse_rules(policies)
    expected = rules.standard_rules(spark)
    assert parsed.exceptAll(expected).count() == 0 == expected.exceptAll(parsed).count()


def triggered(payments, clients, spark):
    found = rules.review_decisions(payments, clients, rules.standard_rules(spark)).collect()
    result = {}
    for row in found:
        result.setdefault(row.payment_id, set()).add(row.rule_id)
    return result


def test_one_row_per_triggered_rule(spark, payments, clients):
    assert triggered(payments, clients, spark) == {
        "P50001": {"global-enhanced", "singapore-rm", "singapore-enhanced", "high-risk-AE"},
        "P50002": {"singapore-rm", "high-risk-AE"},
        "P50005": {"high-risk-AE"},
        "P50183": {"high-risk-AE"},
    }


def test_limits_are_strict(spark, make_payments, clients):
    exact = make_payments([
        ("A", "C2001", "X", "GB", "75000.00", "USD", "2026-01-01"),
        ("B", "C2003", "X", "GB", "80000.00", "CHF", "2026-01-01"),
        ("C", "C2000", "X", "GB", "100000.00", "USD", "2026-01-01"),
    ])
    assert triggered(exact, clients, spark) == {}
    above = make_payments([
        ("A", "C2001", "X", "GB", "75000.01", "USD", "2026-01-01"),
        ("B", "C2003", "X", "GB", "120000.01", "CHF", "2026-01-01"),
        ("C", "C2000", "X", "GB", "100000.01", "USD", "2026-01-01"),
    ])
    assert triggered(above, clients, spark) == {
        "A": {"singapore-rm"},
        "B": {"switzerland-rm", "switzerland-enhanced", "global-enhanced"},
        "C": {"global-enhanced"},
    }


def test_currency_basis_is_stated(spark, make_payments, clients):
    df = make_payments([("B", "C2003", "X", "AE", "130000.00", "CHF", "2026-01-01")])
    basis = {row.rule_id: row.comparison_basis for row in
             rules.review_decisions(df, clients, rules.standard_rules(spark)).collect()}
    assert basis == {
        "switzerland-rm": "native", "switzerland-enhanced": "native",
        "global-enhanced": "one_to_one_assumed", "high-risk-AE": "not_a_comparison"}


def test_destination_uses_the_code_not_the_name(spark, payments):
    ids = {r.payment_id for r in rules.high_risk_payments(payments, rules.standard_rules(spark)).collect()}
    assert ids == {"P50001", "P50002", "P50005", "P50183"}


def test_lookups(payments, clients):
    assert lookups.get_payment(payments, "P50006").first().currency == "SGD"
    assert lookups.get_payment(payments, "P99999").count() == 0
    assert lookups.get_client_profile(clients, "C2003").first().country == "Switzerland"
    assert lookups.get_clients_by_country(clients, "Singapore").count() == 2
    history = [r.payment_id for r in lookups.get_client_payments(payments, "C2003").collect()]
    assert history == ["P50004", "P50005", "P50003", "P50180", "P50181", "P50183"]
    assert [r.client_id for r in lookups.clients_without_payments(clients, payments).collect()] == ["C2021"]


def test_mismatched_country_and_code(payments):
    ids = {r.payment_id for r in lookups.country_code_mismatches(payments).collect()}
    assert ids == {"P50000", "P50002", "P50003", "P50004", "P50180", "P50181", "P50182"}


def test_unknown_clients_still_meet_the_global_rules(spark, make_payments, clients):
    orphan = make_payments([("A", "C9999", "X", "AE", "130000.00", "CHF", "2026-01-01")])
    assert triggered(orphan, clients, spark) == {"A": {"global-enhanced", "high-risk-AE"}}


def test_regions_and_destinations_come_from_the_documents(spark):
    docs = [("regional_uk.md", "# United Kingdom Payment Procedure 2026\n\n- Payments above GBP 10,000 equivalent require RM review.\n", {}),
            ("high_risk_jurisdictions.md", "IR (Iran) and KP (North Korea) are high-risk destinations.\n", {})]
    found = {r.rule_id: r for r in rules.parse_rules(spark.createDataFrame(docs, schemas.POLICY_DOCS)).collect()}
    assert found["united kingdom-rm"].scope_country == "United Kingdom"
    assert {r.destination_code for r in found.values()} == {None, "IR", "KP"}
    nameless = spark.createDataFrame([("regional_x.md", "- Payments above GBP 10,000 equivalent require RM review.\n", {})], schemas.POLICY_DOCS)
    with pytest.raises(Exception, match="without a country"):
        rules.parse_rules(nameless).collect()
