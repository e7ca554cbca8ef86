"""Evidence correlation, corroboration and calibrated confidence.

A hypothesis is a (component, message signature) seen in WARN or ERROR log
lines. It gains one point for each source type that independently agrees on
*both* parts; half a point where the agreement is thin or carries a caveat.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from casewright.functions.text import tokenize
from casewright.operators import timeline
from casewright.operators.skew import salted_join
from casewright.session import cut_lineage
from casewright.sources.incident_parsers import mentioned_components

HYPOTHESIS = ["incident", "component", "signature"]
STAMP = "yyyy-MM-dd HH:mm:ss"
SOURCES = ["logs", "deployment", "known_issue", "runbook", "previous_incident"]


@dataclass(frozen=True)
class Calibration:
    """Weights of the confidence score; review is due below ``review_below``."""

    points_per_source: float = 20.0
    ceiling: float = 95.0
    thin: float = 0.5
    lookback: str = "24 hours"
    review_below: float = 50.0


def candidates(logs: DataFrame) -> DataFrame:
    """Hypotheses with how often, how badly and when their lines appear."""
    return (
        logs.filter(F.col("level").isin("WARN", "ERROR"))
        .groupBy(*HYPOTHESIS)
        .agg(
            F.count("*").alias("line_count"),
            F.count_if(F.col("level") == "ERROR").alias("error_count"),
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
        )
    )


def deployment_before(hypotheses: DataFrame, deployments: DataFrame, lookback: str) -> DataFrame:
    """The latest deployment of the same component at or before the first line."""
    found = timeline.as_of(
        hypotheses, deployments.select("incident", "component", "ts", "version", "change"),
        keys=["incident", "component"], at="first_ts", mark_at="ts", lookback=lookback)
    return found.filter("mark IS NOT NULL").select(
        "incident", "component", "first_ts",
        F.struct(F.col("mark.version").alias("id"),
                 F.concat_ws(" ", F.col("mark.version"), F.date_format("mark.ts", "yyyy-MM-dd HH:mm"),
                             F.col("component"), F.col("mark.change")).alias("excerpt"),
                 F.lit(1.0).alias("weight")).alias("deployment"))


def catalogue(records: DataFrame, record_id: str, text: list[str], excerpt: Column, thin: float,
              caveat: Column | None = None, extra: list[str] | None = None) -> DataFrame:
    """Bring a record type into the common shape that ``match_records`` takes."""
    scope = ["incident"] if "incident" in records.columns else []
    weight = F.lit(1.0) if caveat is None else F.when(caveat, thin).otherwise(1.0)
    return records.select(
        *scope, "component",
        F.array_sort(F.array_distinct(tokenize(F.concat_ws(" ", *text)))).alias("terms"),
        F.struct((-weight).alias("order"), F.col(record_id).alias("id"), excerpt.alias("excerpt"),
                 weight.alias("weight"), *(extra or [])).alias("record"))


def match_records(signatures: DataFrame, records: DataFrame, name: str) -> DataFrame:
    """Add to each row of ``signatures`` the best record whose component is equal
    and whose words contain every word of the signature (NULL if none does).

    Records with equal words are one record for this purpose and merge first.
    Signature and record then meet on one word, the signature's longest, instead
    of pairing up within a component.
    """
    part = [c for c in ("incident", "component") if c in signatures.columns]
    best = F.min("record").alias(name)
    by_word = (
        records.groupBy(*part, "terms").agg(F.min("record").alias("record"))
        .withColumn("_word", F.explode("terms"))
    )
    matched = (
        signatures.select(*part, "signature", "_terms", "_word")
        .join(by_word, [*part, "_word"])
        .filter(F.size(F.array_except("_terms", "terms")) == 0)
        .groupBy(*part, "signature").agg(best)
    )
    return signatures.join(matched, [*part, "signature"], "left")


def distinct_signatures(hypotheses: DataFrame, part: list[str]) -> DataFrame:
    """The signatures to look up, once each, with the number of hypotheses."""
    longest = lambda term: F.struct(F.length(term).alias("length"), term.alias("term"))
    return (
        hypotheses.groupBy(*part, "signature").agg(F.count("*").alias("hypothesis_count"))
        .withColumn("_terms", F.array_distinct(tokenize(F.col("signature"))))
        .withColumn("_word", F.array_max(F.transform("_terms", longest))["term"])
    )


def gather_evidence(logs: DataFrame, deployments: DataFrame, known_issues: DataFrame, runbooks: DataFrame,
                    previous_incidents: DataFrame, calibration: Calibration = Calibration()) -> DataFrame:
    """One row per hypothesis with one struct (or NULL) for each source type.

    Catalogues either belong to an incident (they have an ``incident`` column) or
    are shared by all of them.
    """
    thin = calibration.thin
    # Read by the deployment, signature and final joins: parse the logs once.
    found = cut_lineage(candidates(logs)).withColumn("logs", F.struct(
        F.col("component").alias("id"),
        F.format_string("%dx %s: %s, first %s, last %s", F.col("line_count"), F.col("component"), F.col("signature"),
                        F.date_format("first_ts", STAMP), F.date_format("last_ts", STAMP)).alias("excerpt"),
        F.when((F.col("error_count") > 0) | (F.col("line_count") >= 2), 1.0).otherwise(thin).alias("weight")))
    issue = catalogue(
        known_issues.withColumnRenamed("affected_component", "component"), "issue_id", ["title", "signature"],
        F.concat_ws(": ", "issue_id", "title"), thin, F.col("notes").rlike("(?i)unverified|unconfirmed|may not apply"))
    runbook = catalogue(
        mentioned_components(runbooks, "symptoms"), "runbook_id", ["title", "symptoms"],
        F.concat_ws(": ", "runbook_id", "title"), thin, F.col("caveat").isNotNull(),
        extra=["mttr_minutes", "remediation"])
    precedent = catalogue(
        mentioned_components(previous_incidents, "summary"), "incident_id", ["summary"],
        F.concat_ws(": ", "incident_id", "root_cause"), thin, F.col("caveat").isNotNull(), extra=["root_cause"])

    catalogues = {"known_issue": issue, "runbook": runbook, "previous_incident": precedent}
    scoped = all("incident" in records.columns for records in catalogues.values())
    part = ["incident", "component"] if scoped else ["component"]
    matches = distinct_signatures(found, part)
    for name, records in catalogues.items():
        matches = match_records(matches, records, name)
    matches = matches.drop("_terms", "_word")

    timed = found.join(
        deployment_before(found, deployments, calibration.lookback), ["incident", "component", "first_ts"], "left")
    if scoped:
        return timed.join(matches, HYPOTHESIS).drop("hypothesis_count")
    # Catalogues shared by all incidents: one signature may recur in very many.
    return salted_join(timed, cut_lineage(matches), ["component", "signature"], "hypothesis_count").drop("hypothesis_count")


def corroborate(evidence: DataFrame, calibration: Calibration = Calibration()) -> DataFrame:
    """Distinct agreeing source types, their weight and the confidence score."""
    weight = lambda source: F.coalesce(F.col(f"{source}.weight"), F.lit(0.0))
    total = sum((weight(source) for source in SOURCES[1:]), weight(SOURCES[0]))
    agreeing = sum((F.col(f"{source}.id").isNotNull().cast("int") for source in SOURCES[1:]),
                   F.col(f"{SOURCES[0]}.id").isNotNull().cast("int"))
    return (
        evidence.withColumn("source_count", agreeing)
        .withColumn("confidence_score",
                    F.least(F.lit(calibration.ceiling), F.round(calibration.points_per_source * total, 1)))
        .withColumn("needs_human_review", F.col("confidence_score") < calibration.review_below)
    )


def evidence_rows(evidence: DataFrame) -> DataFrame:
    """The evidence of all source types as one relation, one row per item."""
    items = [F.struct(F.lit(source).alias("source_type"), F.col(f"{source}.id").alias("record_id"),
                      F.col(f"{source}.weight").alias("weight"), F.col(f"{source}.excerpt").alias("excerpt"))
             for source in SOURCES]
    return evidence.select(*HYPOTHESIS, F.inline(F.array(*items))).filter("record_id IS NOT NULL")


def before_and_after(logs: DataFrame, marks: DataFrame) -> DataFrame:
    """Clean and failing lines of a component before and from a moment on, for one
    ``mark_ts`` per (incident, component).

    Lines of one second merge before the join, so a busy component joins with at
    most one row per second.
    """
    per_second = logs.groupBy("incident", "component", "ts").agg(
        F.count_if(F.col("level") == "ERROR").alias("failed"), F.count_if(F.col("level") != "ERROR").alias("clean"))
    before = F.col("ts") < F.col("mark_ts")
    part = lambda name, when: F.sum(F.when(when, F.col(name)).otherwise(0)).alias
    return (
        per_second.join(marks.select("incident", "component", "mark_ts"), ["incident", "component"])
        .groupBy("incident", "component", "mark_ts")
        .agg(part("clean", before)("clean_before"), part("failed", before)("failed_before"),
             part("clean", ~before)("clean_after"), part("failed", ~before)("failed_after"))
    )


def leading_hypothesis(scored: DataFrame) -> DataFrame:
    """One hypothesis per incident: best corroborated, then most frequent, then
    earliest; the name settles what is left."""
    payload = [c for c in scored.columns if c != "incident"]
    rank = F.struct(
        (-F.col("confidence_score")).alias("a"), (-F.col("line_count")).alias("b"), F.col("first_ts").alias("c"),
        F.col("component").alias("d"), F.col("signature").alias("e"))
    return (
        scored.groupBy("incident").agg(F.min_by(F.struct(*payload), rank).alias("lead"))
        .select("incident", "lead.*")
    )


def impacted_systems(leaders: DataFrame, logs: DataFrame) -> DataFrame:
    """(incident, impacted_systems): the leading component and every component
    with an ERROR in a second in which the leading one failed too."""
    failures = logs.filter("level = 'ERROR'").select("incident", "ts", "component", "signature").distinct()
    moments = (
        failures.join(leaders.select("incident", "component", "signature"), HYPOTHESIS, "left_semi")
        .select("incident", "ts").distinct()
    )
    together = (
        failures.select("incident", "ts", "component").join(moments, ["incident", "ts"], "left_semi")
        .select("incident", "component")
        .union(leaders.select("incident", "component"))
        .distinct()
    )
    return together.groupBy("incident").agg(F.array_sort(F.collect_list("component")).alias("impacted_systems"))


def component_paths(edges: DataFrame) -> DataFrame:
    """(incident, ancestor, component, hops): every path along the edges, of any length.

    One row per path. A path never comes back to a component it has passed, so a
    cycle of calls ends. Each step is stored, so a deep tree is never recomputed.
    """
    step = edges.select("incident", F.col("parent").alias("component"), F.col("child").alias("next"))
    frontier = edges.filter("parent <> child").select(
        "incident", F.col("parent").alias("ancestor"), F.col("child").alias("component"), F.array("parent", "child").alias("route"))
    paths = None
    while True:
        frontier = cut_lineage(frontier)
        found = frontier.select("incident", "ancestor", "component", (F.size("route") - 1).alias("hops"))
        paths = found if paths is None else paths.unionByName(found)
        if frontier.isEmpty():
            return paths
        frontier = (
            frontier.join(step, ["incident", "component"]).filter(~F.array_contains("route", F.col("next")))
            .select("incident", "ancestor", F.col("next").alias("component"), F.array_append("route", F.col("next")).alias("route"))
        )


def event_latency(events: DataFrame, start: str, end: str, key: list[str], lookahead: str | None = None) -> DataFrame:
    """Seconds from each ``start`` event to the next ``end`` event of its key, at most
    ``lookahead`` later if that is given. ``start_count``: starts at this very time."""
    begun = events.filter(F.col("kind") == start)
    ended = events.filter(F.col("kind") == end).select(*key, "ts")
    return (
        timeline.as_of(begun, ended, key, "ts", "ts", lookahead, forward=True)
        .filter("mark IS NOT NULL")
        .select(*key, F.col("ts").alias("started_at"), F.col("mark.ts").alias("ended_at"), F.col("probe_count").alias("start_count"))
        .withColumn("latency_seconds", F.timestamp_diff("SECOND", "started_at", "ended_at"))
    )
