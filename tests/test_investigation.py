import json

import pytest

from pyspark.sql import functions as F

from casewright import schemas
from casewright.operators import retrieval, rules
from casewright.plans import cli, facade, investigation, registry
from casewright.sources import tabular

from conftest import CLIENTS, PAYMENTS, POLICIES

QUESTIONS = [
    ("Q01", "P50000", "Has anyone to look at P50000 before it is released?"),
    ("Q02", "P50001", "Who has to approve P50001, and on what grounds?"),
    ("Q04", "P50003", "Could C2003 have split one transfer into parts?"),
    ("Q07", "P50003", "Which details are still missing before this goes to Compliance?"),
    ("Q08", "P50004", "From what amount on does the payer's country ask for a review?"),
    ("Q10", "P50006", "Which steps come next for this case?"),
    ("Q11", "P50004", "Was this transfer split, or does the client do that elsewhere?"),
    ("Q99", "P99999", "Who has to approve P99999, and on what grounds?"),
]


@pytest.fixture(scope="module")
def answers(spark, payments, clients, policies):
    questions = spark.createDataFrame(QUESTIONS, schemas.QUESTIONS)
    rows = investigation.answer_questions(questions, payments, clients, rules.parse_rules(policies), policies, lists=True).collect()
    assert len(rows) == len(QUESTIONS)
    return {r.question_id: r for r in rows}


def test_no_review(answers):
    row = answers["Q01"]
    assert row.citations == ["global_payment_policy.md"]
    assert row.tools_used == ["get_payment", "get_client_profile", "search_policy"]
    facts = json.loads(row.facts)
    assert (facts["amount"], facts["currency"], facts["beneficiary_country_code"]) == (12000.0, "USD", "SG")
    assert (facts["client_id"], facts["client_country"], facts["client_risk_rating"]) == ("C2000", "UAE", "Medium")
    assert "standard monitoring" in row.answer
    assert "A policy trigger does not by itself establish suspicious activity." in row.answer  # quoted from the policy


def test_layered_rules(answers):
    row = answers["Q02"]
    assert row.citations == ["global_payment_policy.md", "high_risk_jurisdictions.md", "regional_singapore.md"]
    assert all(text in row.answer for text in ("RM review", "enhanced review", "additional review", "USD 125,000"))


def test_structuring_answer(answers):
    row = answers["Q04"]
    facts = json.loads(row.facts)
    assert row.citations == ["global_payment_policy.md", "regional_switzerland.md"]
    assert row.tools_used == [
        "get_payment", "get_client_profile", "get_client_payments", "aggregate_beneficiary_24h", "search_policy"]
    assert facts["payment_ids"] == ["P50003", "P50180", "P50181"]
    assert facts["individual_amounts"] == [45000.0, 35000.0, 30000.0]
    assert (facts["combined_amount"], facts["threshold"], facts["combined_currency"]) == (110000.0, 100000.0, "CHF")
    assert facts["channels"] == ["Branch", "Online", "RM-assisted"]
    assert "escalate to Compliance" in row.answer and "does not show intent" in row.answer


def test_other_intents(answers):
    assert "where the money comes from" in answers["Q07"].answer
    assert "CHF 80,000" in answers["Q08"].answer and "75,000" not in answers["Q08"].answer
    assert "1. Establish client and payment facts." in answers["Q10"].answer
    assert "investigation_procedure.md" in answers["Q10"].citations


def test_unknown_payment(answers):
    row = answers["Q99"]
    assert "no payment P99999" in row.answer and row.citations == [] and row.tools_used == ["get_payment"]


def test_a_client_is_judged_by_all_of_its_windows(answers):
    row = answers["Q11"]
    facts = json.loads(row.facts)
    assert (facts["payment_count"], facts["structuring_windows_of_client"], facts["payment_ids"]) == (1, 1, ["P50004"])
    assert "does not look split" in row.answer and "Northstar Trading on 2026-04-11, CHF 110,000" in row.answer
    assert "structuring review" in row.answer


def test_limits_of_another_country_do_not_count(spark, make_payments, clients):
    paid = make_payments([(f"P{i}", "C2003", "B", "GB", "6000.00", "CHF", "2026-01-01") for i in range(2)])
    table = rules.standard_rules(spark)
    british = spark.createDataFrame([("uk", "regional_uk.md", "UK", "combined", None, "GBP", None, "structuring review")], table.schema)
    both = table.union(british.withColumn("threshold", F.lit(10_000).cast("decimal(18,2)")))
    (swiss,) = investigation.client_windows(paid, paid, clients, both).collect()
    assert (swiss.is_structuring, float(swiss.structuring_threshold), swiss.structuring_currency) == (False, 100000.0, "USD")
    (uk,) = investigation.client_windows(*2 * (paid.withColumn("client_id", F.lit("C2021")),), clients, both).collect()
    assert (uk.is_structuring, uk.structuring_currency) == (True, "GBP")


@pytest.mark.parametrize("question, intent", [
    ("Does the data show a possible structuring pattern?", "structuring"), ("Name the documents I need", "documents"),
    ("What evidence do we lack?", "missing_evidence"), ("Tell facts from assumptions", "separation"), ("How would you investigate it?", "workflow"),
    ("Is the beneficiary in a listed jurisdiction below the limit?", "destination"), ("Which limits hold here?", "threshold"), ("May it go out?", "review")])
def test_intents_follow_word_stems(spark, question, intent):
    asked = spark.createDataFrame([(question,)], "q string")
    assert asked.select(investigation.question_intent(F.col("q")).alias("i")).first().i == intent


def test_no_decoy_is_ever_cited(answers):
    assert not any("decoy" in source for row in answers.values() for source in row.citations)
    assert not any("decoy" in row.answer for row in answers.values())


def test_members_of_any_number(spark, payments, make_payments, clients):
    questions = spark.createDataFrame(QUESTIONS, schemas.QUESTIONS)
    members = investigation.answer_members(questions, payments)
    assert {r.payment_id for r in members.collect()} == {"P50003", "P50180", "P50181", "P50004"}
    many = make_payments([(f"M{i:04d}", "C2003", "B", "CH", "100.00", "CHF", "2026-01-01") for i in range(1001)])
    asked = spark.createDataFrame([("Q", "M0000", "Was this split?")], schemas.QUESTIONS)
    assert investigation.answer_members(asked, many).count() == 1001
    for lists in (False, True):
        (row,) = investigation.answer_questions(asked, many, clients, rules.standard_rules(spark), lists=lists).collect()
        facts = json.loads(row.facts)
        assert facts["payment_count"] == 1001 and len(facts.get("payment_ids", [])) == 1001 * lists
        assert row.tools_used == ["get_payment", "get_client_profile", "get_client_payments", "aggregate_beneficiary_24h"]


def test_registry(payments, clients, policies):
    index = retrieval.build_index(retrieval.chunk_documents(policies))
    tools = registry.tools(payments, clients, index)
    assert list(tools) == ["get_client_profile", "get_payment", "get_client_payments", "aggregate_beneficiary_24h", "search_policy"]
    assert registry.record(tools["get_payment"].run("P50001"))["client_id"] == "C2001"
    assert registry.record(tools["get_payment"].run("none")) == {}
    assert len(list(registry.records(tools["get_client_payments"].run("C2003")))) == 6
    assert tools["search_policy"].schema()["parameters"]["required"] == ["query"]
    assert tools["search_policy"].run("structuring", top_k=1).count() == 1


def test_largest_window_record(payments):
    window = registry.largest_window(payments, "C2003", "Northstar Trading")
    assert (window["count"], float(window["total_amount"])) == (3, 110000.0)
    assert [p["payment_id"] for p in window["payments"]] == ["P50003", "P50180", "P50181"]
    assert registry.largest_window(payments, "C2003", "Nobody")["count"] == 0


@pytest.fixture()
def data_dir(tmp_path):
    data = tmp_path / "data"
    (data / "policies").mkdir(parents=True)
    for name, text in POLICIES.items():
        (data / "policies" / name).write_text(text)
    for name, schema, rows in (("payments", schemas.PAYMENTS, PAYMENTS), ("clients", schemas.CLIENTS, CLIENTS)):
        lines = [",".join(schema.fieldNames()), *[",".join(row) for row in rows]]
        (data / f"{name}.csv").write_text("\n".join(lines) + "\n")
    return data


def test_command_line_writes_one_array(spark, data_dir):
    reversed_questions = [dict(zip(schemas.QUESTIONS.fieldNames(), q)) for q in QUESTIONS[::-1]]
    (data_dir / "questions.json").write_text(json.dumps(reversed_questions))
    target = data_dir / "submission.json"
    cli.main(["questions", "--data", str(data_dir), "--questions", str(data_dir / "questions.json"), "--output", str(target)])
    written = json.loads(target.read_text())
    assert [w["question_id"] for w in written] == [q["question_id"] for q in reversed_questions]
    assert set(written[0]) == set(investigation.ANSWER_FIELDS)
    assert written[-1]["facts"]["client_country"] == "UAE"


def test_questions_and_answers_as_lines(spark, data_dir):
    lines = [json.dumps(dict(zip(schemas.QUESTIONS.fieldNames(), q))) for q in QUESTIONS]
    (data_dir / "questions.jsonl").write_text("\n".join(lines) + "\n")
    asked = tabular.read_questions(spark, str(data_dir / "questions.jsonl")).orderBy("position").collect()
    assert [r.question_id for r in asked] == [q[0] for q in QUESTIONS]
    target = data_dir / "answers"
    cli.main(["questions", "--lines", "--data", str(data_dir), "--questions", str(data_dir / "questions.jsonl"), "--output", str(target)])
    assert {r.question_id for r in spark.read.json(str(target)).collect()} == {q[0] for q in QUESTIONS}


def test_tools_as_plain_functions(spark, data_dir):
    desk = facade.PaymentDesk(spark, str(data_dir))
    assert desk.get_client_profile("C2003")["country"] == "Switzerland"
    assert desk.get_client_profile("none") == {} == desk.get_payment("none")
    assert {c["client_id"] for c in desk.get_clients_by_country("Singapore")} == {"C2001", "C2002"}
    assert len(list(desk.get_client_payments("C2003"))) == 6
    assert desk.aggregate_beneficiary_24h("C2003", "Northstar Trading")["count"] == 3
    assert [r["beneficiary_name"] for r in desk.find_repeated_beneficiaries("C2003")] == ["Northstar Trading"]
    hits = desk.search_policy("high value payment enhanced review threshold", top_k=2)
    assert len(hits) == 2 and set(hits[0]) == {"source", "text", "score"}
    assert desk.index is desk.index
    assert desk.get_policy_document("high_risk_jurisdictions.md")["text"].startswith("# High-Risk")
    answer = desk.run_agent("What review requirement applies to P50001 and why?", "P50001")
    assert set(answer) == {"answer", "citations", "facts", "tools_used"}
    assert answer["facts"]["client_country"] == "Singapore"


def test_sections_are_kept_apart(spark, payments, clients):
    questions = spark.createDataFrame(QUESTIONS[:4], schemas.QUESTIONS)
    rows = {r.question_id: r for r in investigation.case_sections(
        questions, payments, clients, rules.standard_rules(spark)).collect()}
    assert rows["Q01"].next_action == "standard monitoring" and rows["Q01"].policy_triggers == ""
    assert rows["Q02"].next_action == "RM review and additional review and enhanced review"
    assert rows["Q04"].policy_triggers == "structuring review by combined value"
    assert "one 24-hour window" in rows["Q04"].assumptions and rows["Q04"].missing_evidence


def test_csv_scan_declares_types_and_rejects_bad_rows(spark, tmp_path):
    good = tmp_path / "p.csv"
    good.write_text(",".join(schemas.PAYMENTS.fieldNames()) + "\n" + ",".join(PAYMENTS[0]) + "\n")
    assert tabular.read_payments(spark, str(good)).schema == schemas.PAYMENTS
    bad = tmp_path / "bad.csv"
    bad.write_text(",".join(schemas.PAYMENTS.fieldNames()) + "\n" + ",".join(PAYMENTS[0]).replace("12000.00", "a lot") + "\n")
    with pytest.raises(Exception):
        tabular.read_payments(spark, str(bad)).collect()


def test_column_descriptions(spark, tmp_path, payments):
    path = tmp_path / "d.csv"
    path.write_text('file,field,description\npayments.csv,channel,"Branch, Online or RM-assisted"\n')
    described = tabular.describe_columns(payments, tabular.read_data_dictionary(spark, str(path)), "payments.csv")
    assert described.schema["channel"].metadata == {"comment": "Branch, Online or RM-assisted"}


def test_a_payment_asked_about_very_often(spark, payments, clients, monkeypatch):
    rows = [(f"H{i}", "P50003", QUESTIONS[2][2]) for i in range(60)] + [(q, p, t) for q, p, t in QUESTIONS]
    questions = spark.createDataFrame(rows, schemas.QUESTIONS)
    answer = lambda: sorted(investigation.answer_questions(
        questions, payments, clients, rules.standard_rules(spark)).collect())
    usual = answer()
    monkeypatch.setattr(investigation, "WIDE_ROWS", 0)
    assert answer() == usual and len(usual) == len(rows)
