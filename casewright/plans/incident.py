"""The incident plan: corpus text to one report per incident, all incidents at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from casewright.operators import correlation as c, retrieval
from casewright.session import cut_lineage
from casewright.sources import corpus as corpora, incident_parsers as parse

# Which document of an incident folder holds which source type.
FILE_OF_SOURCE = {
    "logs": "logs.md",
    "deployment": "deployment_history.md",
    "known_issue": "known_issues.csv",
    "runbook": "runbooks.md",
    "previous_incident": "previous_incidents.md",
}
REPORT_KEYS = [
    "root_cause", "supporting_evidence", "impacted_systems", "mttr_minutes",
    "remediation", "confidence_score", "needs_human_review",
]


def typed_tables(corpus: DataFrame, lines: Callable[[str], DataFrame] | None = None) -> dict[str, DataFrame]:
    """The five evidence relations of a corpus of (incident, source, text).

    ``lines`` gives the (incident, line) rows of a line-oriented file; by default
    they are split out of the corpus texts.
    """
    lines = lines or (lambda source: corpora.corpus_lines(corpus, source))
    of = lambda kind: lines(FILE_OF_SOURCE[kind])
    docs = lambda kind: corpus.filter(F.col("source") == FILE_OF_SOURCE[kind])
    return {
        "logs": parse.log_events(of("logs")),
        "deployments": parse.deployments(of("deployment")),
        "known_issues": parse.known_issues(of("known_issue")),
        "runbooks": parse.runbooks(docs("runbook")),
        "previous_incidents": parse.previous_incidents(docs("previous_incident")),
    }


def incident_reports(tables: dict[str, DataFrame], calibration: c.Calibration = c.Calibration(),
                     relevance: DataFrame | None = None) -> DataFrame:
    """(incident + the seven report keys) from the typed tables.

    ``relevance`` (incident, source, score), when given, only orders the
    excerpts; it never adds to the confidence.
    """
    scored = c.corroborate(c.gather_evidence(**tables, calibration=calibration), calibration)
    leaders = cut_lineage(c.leading_hypothesis(scored))
    impacted = c.impacted_systems(leaders, tables["logs"])

    review = F.col("needs_human_review")
    subject = F.concat(F.col("component"), F.lit(": "), F.col("signature"))
    cause = F.coalesce(
        F.col("previous_incident.root_cause"), F.col("known_issue.excerpt"), F.lit("no recorded cause matches"))
    trigger = F.when(F.col("deployment").isNotNull(), F.concat(F.lit(" after "), F.col("deployment.excerpt"))).otherwise("")
    items = F.array_compact(F.array(*[
        F.when(F.col(f"{source}.id").isNotNull(),
               F.struct(F.lit(FILE_OF_SOURCE[source]).alias("source"), F.col(f"{source}.excerpt").alias("excerpt")))
        for source in c.SOURCES]))
    reports = leaders.join(impacted, "incident").withColumn("_items", items)
    if relevance is not None:
        ranks = relevance.groupBy("incident").agg(F.map_from_entries(F.collect_list(F.struct("source", "score"))).alias("_scores"))
        by_score = F.array_sort(F.transform(
            "_items", lambda item: F.struct(
                (-F.coalesce(F.col("_scores")[item["source"]], F.lit(0.0))).alias("order"), item["source"].alias("source"),
                item["excerpt"].alias("excerpt"))))
        reports = reports.join(ranks, "incident", "left").withColumn(
            "_items", F.transform(by_score, lambda item: F.struct(item["source"], item["excerpt"])))
    return reports.select(
        "incident",
        F.when(review, F.concat(F.lit("Unconfirmed. Best lead is "), subject, F.lit("; the evidence is too thin to name a cause.")))
        .otherwise(F.concat(subject, trigger, F.lit(". Recorded cause: "), cause)).alias("root_cause"),
        F.col("_items").alias("supporting_evidence"),
        "impacted_systems",
        F.when(~review, F.col("runbook.mttr_minutes")).alias("mttr_minutes"),
        F.when(review, F.concat(
            F.lit("Unconfirmed: collect per-stage timing and metrics for "), F.col("component"),
            F.lit(" before acting"), F.coalesce(F.concat(F.lit(". Candidate step: "), F.col("runbook.remediation")), F.lit("."))))
        .otherwise(F.coalesce("runbook.remediation", F.lit("no matching runbook; escalate to the component owner"))).alias("remediation"),
        "confidence_score",
        "needs_human_review",
    )


def rank_corpus(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """(incident, source, score): each document of an incident by its best passage
    for the incident's query, known issues as one candidate per row
    (``known_issues.csv#KI-101``)."""
    is_table = F.col("source").endswith(".csv")
    issue_rows = (
        corpus.filter(is_table).select("incident", "source", F.explode(F.split("text", r"\r?\n")).alias("text"))
        .filter(~F.col("text").startswith("issue_id,") & (F.trim("text") != ""))
        .withColumn("source", F.concat_ws("#", "source", F.substring_index("text", ",", 1)))
    )
    units = corpus.filter(~is_table).select("incident", "source", "text").unionByName(issue_rows)
    chunks = retrieval.chunk_documents(units)
    asked = queries.select("incident", F.col("incident").alias("question_id"), F.col("query").alias("question"))
    hits = retrieval.score_all(retrieval.index_rows(chunks), asked, within=["incident"])
    source = F.regexp_replace("chunk_id", r"#\d+#\d+$", "")
    return hits.groupBy("incident", source.alias("source")).agg(F.max("score").alias("score"))


def investigate(spark: SparkSession, data_dir: str, calibration: c.Calibration = c.Calibration()) -> DataFrame:
    """Reports for every incident folder below ``data_dir``."""
    queries, corpus = corpora.load_incidents(spark, data_dir)
    return reports_of(queries, corpus, calibration, lambda source: corpora.scan_lines(spark, data_dir, source))


def reports_of(queries: DataFrame, corpus: DataFrame, calibration: c.Calibration = c.Calibration(),
               lines: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """Reports from (incident, query) and (incident, source, text)."""
    by_file = (
        rank_corpus(queries, corpus)
        .groupBy("incident", F.substring_index("source", "#", 1).alias("source")).agg(F.max("score").alias("score"))
    )
    return incident_reports(typed_tables(corpus, lines), calibration, relevance=by_file)
