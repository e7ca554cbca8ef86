"""Batch entry points.

    python -m casewright.plans.cli questions --data DIR --questions FILE --output FILE
    python -m casewright.plans.cli incidents --data DIR --output FILE
"""

from __future__ import annotations

import argparse

from casewright.operators import rules
from casewright.plans import incident, investigation
from casewright.session import build_session
from casewright.sources import corpus, tabular


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Answer payment questions or report on incidents.")
    commands = parser.add_subparsers(dest="command", required=True)
    ask = commands.add_parser("questions", help="answer a JSON file of questions")
    ask.add_argument("--questions", required=True)
    ask.add_argument("--lines", action="store_true", help="write a folder of JSON Lines, one file per task, without lists of payments")
    report = commands.add_parser("incidents", help="report on every incident folder")
    for command in (ask, report):
        command.add_argument("--data", required=True, help="folder with the input data")
        command.add_argument("--output", required=True, help="JSON file to write")
    args = parser.parse_args(argv)

    spark = build_session()
    if args.command == "questions":
        policies = corpus.load_policy_documents(spark, f"{args.data}/policies")
        answers = investigation.answer_questions(
            tabular.read_questions(spark, args.questions),
            tabular.read_payments(spark, f"{args.data}/payments.csv"),
            tabular.read_clients(spark, f"{args.data}/clients.csv"),
            rules.parse_rules(policies), policies, lists=not args.lines)
        if args.lines:
            tabular.write_answer_lines(answers, args.output)
        else:
            tabular.write_answer_file(answers, args.output, order_by="position", drop=["position"])
    else:
        tabular.write_report_file(incident.investigate(spark, args.data), args.output)


if __name__ == "__main__":
    main()
