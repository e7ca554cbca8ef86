import datetime
import json

import pytest
from pyspark.sql import functions as F

from casewright.operators import correlation
from casewright.plans import cli, facade, incident
from casewright.sources import corpus as corpora, incident_parsers as parse

LOGS = """# Application logs

```
2024-03-01 08:00:00 INFO  web         Request served request_id=R-1
2024-03-01 09:05:00 ERROR cache-node  EvictionStormException: no memory after 200ms
2024-03-01 09:05:00 ERROR web         Request failed request_id=R-2 reason=CACHE_DOWN
2024-03-01 09:20:00 ERROR cache-node  EvictionStormException: no memory after 310ms
2024-03-01 09:20:00 ERROR web         Request failed request_id=R-3 reason=CACHE_DOWN
2024-03-01 09:30:00 WARN  billing     Invoice run late 90s run_id=B-4
```

The cache-node was mentioned in prose and must not count as a log line.
"""
DEPLOYMENTS = """| Version | Timestamp (UTC) | Component | Change |
|---|---|---|---|
| v1 | 2024-02-01 09:00 | web | new header |
| **v2** | **2024-03-01 09:00** | **cache-node** | **halved the memory limit** |
| v3 | 2024-03-01 09:10 | cache-node | log format |

No deployment touched `billing`.
"""
ISSUES = """issue_id,title,signature,affected_component,notes
KI-1,Eviction storms,"EvictionStormException in cache-node, seen under pressure",cache-node,memory limit too low
KI-2,Slow cache warmup,Warmup takes minutes,cache-node,cosmetic
"""
RUNBOOKS = """# Runbooks

## RB-1: Eviction storm

**Symptoms**: `EvictionStormException` in `cache-node` logs;
`web` logging `CACHE_DOWN`.

**Diagnostic steps**:
1. Check memory.
2. Check deployments
   of the cache.

**Remediation**: restore the memory limit.

**Typical MTTR: 12 minutes.**

## RB-2: Late invoices

**Symptoms**: `billing` logging invoice run late warnings.

**Remediation**: rerun (unverified).

**Typical MTTR: 30 minutes.**
"""
HISTORY = """# Previous incidents

## INC-7 (2023-11-05)

**Summary**: `cache-node` raised `EvictionStormException` all day.

**Root cause**: memory limit below the working set.

**Resolution**: raised the limit.

**MTTR**: 14 minutes (to the fix).
"""
ARCHITECTURE = """# Overview

```
Client
  -> Gateway
       -> web        (serves pages)
            -> cache-node   (keeps hot
                             entries)
       -> billing    (invoices)
```

## Components

- **web**: stateless.
- **cache-node** / **billing**: stateful; see
  the runbooks.
"""
API = """# API

## `GET /page`

Owned by: `web`, asks `cache-node`.

| Field | Type | Notes |
|---|---|---|
| `id` | string | required |

**Timeout**: waits up to 300ms.

**Response codes**: `200 OK`, `503 CACHE_DOWN`.
"""
QUIET_LOGS = LOGS.replace("ERROR", "INFO ")
QUIET_DEPLOYMENTS = DEPLOYMENTS.split("| v1")[0]
NO_HISTORY = "# Previous incidents\n\nNone involves `billing`.\n"


@pytest.fixture(scope="module")
def data_dir(tmp_path_factory):
    root = tmp_path_factory.mktemp("incidents")
    loud = {"logs.md": LOGS, "deployment_history.md": DEPLOYMENTS, "known_issues.csv": ISSUES, "runbooks.md": RUNBOOKS,
            "previous_incidents.md": HISTORY, "architecture.md": ARCHITECTURE, "api_specs.md": API,
            "query.txt": "Why do pages fail?\n\n"}
    quiet = {**loud, "logs.md": QUIET_LOGS, "deployment_history.md": QUIET_DEPLOYMENTS, "previous_incidents.md": NO_HISTORY,
             "query.txt": "Why are invoices late?"}
    for name, files in {"loud": loud, "quiet": quiet}.items():
        (root / name).mkdir()
        for file, text in files.items():
            (root / name / file).write_text(text, encoding="utf-8")
    return str(root)


@pytest.fixture(scope="module")
def corpus(spark, data_dir):
    return corpora.load_incidents(spark, data_dir)[1]


def of(corpus, source, name="loud"):
    return corpus.filter((F.col("source") == source) & (F.col("incident") == name))


def test_corpus_order_and_query(spark, data_dir):
    queries, corpus = corpora.load_incidents(spark, data_dir)
    assert {r.incident: r.query for r in queries.collect()} == {"loud": "Why do pages fail?", "quiet": "Why are invoices late?"}
    sources = [r.source for r in corpus.filter("incident = 'loud'").orderBy("ordinal").collect()]
    assert sources == ["api_specs.md", "architecture.md", "deployment_history.md", "logs.md", "previous_incidents.md",
                       "runbooks.md", "known_issues.csv"]


def test_log_lines(corpus):
    rows = parse.log_events(corpora.corpus_lines(corpus, "logs.md")).filter("incident = 'loud'").orderBy("ts", "component").collect()
    assert len(rows) == 6
    assert (rows[2].level, rows[2].component, rows[2].signature) == ("ERROR", "web", "Request failed")
    assert rows[2].attrs == {"request_id": "R-2", "reason": "CACHE_DOWN"}
    assert rows[1].signature == "EvictionStormException"
    assert rows[5].signature == "Invoice run late"
    assert rows[1].ts == datetime.datetime(2024, 3, 1, 9, 5)


def test_deployments_and_known_issues(corpus):
    lines = lambda source: corpora.corpus_lines(corpus, source).filter("incident = 'loud'")
    assert [(r.version, r.component, r.change) for r in parse.deployments(lines("deployment_history.md")).orderBy("ts").collect()] == [
        ("v1", "web", "new header"), ("v2", "cache-node", "halved the memory limit"), ("v3", "cache-node", "log format")]
    issues = parse.known_issues(lines("known_issues.csv")).orderBy("issue_id").collect()
    assert [i.issue_id for i in issues] == ["KI-1", "KI-2"]
    assert issues[0].signature == "EvictionStormException in cache-node, seen under pressure"


def test_sections(corpus):
    runbook = parse.runbooks(of(corpus, "runbooks.md")).orderBy("runbook_id").collect()
    assert [(r.runbook_id, r.title, r.mttr_minutes, r.caveat) for r in runbook] == [
        ("RB-1", "Eviction storm", 12, None), ("RB-2", "Late invoices", 30, "unverified")]
    assert runbook[0].diagnostics == ["Check memory.", "Check deployments of the cache."]
    past = parse.previous_incidents(of(corpus, "previous_incidents.md")).collect()
    assert [(p.incident_id, str(p.date), p.mttr_minutes, p.root_cause) for p in past] == [
        ("INC-7", "2023-11-05", 14, "memory limit below the working set.")]
    assert parse.previous_incidents(of(corpus, "previous_incidents.md", "quiet")).count() == 0


def test_architecture_and_api(corpus):
    docs = of(corpus, "architecture.md")
    assert {(r.component, r.description) for r in parse.components(docs).collect()} == {
        ("web", "stateless."), ("cache-node", "stateful; see the runbooks."), ("billing", "stateful; see the runbooks.")}
    edges = parse.call_tree(docs)
    assert {(r.parent, r.child) for r in edges.collect()} == {("Gateway", "web"), ("web", "cache-node"), ("Gateway", "billing")}
    paths = {(r.ancestor, r.component, r.hops) for r in correlation.component_paths(edges).collect()}
    assert ("Gateway", "cache-node", 2) in paths
    endpoint = parse.api_endpoints(of(corpus, "api_specs.md")).first()
    assert (endpoint.method, endpoint.path, endpoint.owner, endpoint.timeout_ms) == ("GET", "/page", "web", 300)
    assert [tuple(f) for f in endpoint.fields] == [("id", "string", "required")]
    assert endpoint.response_codes == ["200 OK", "503 CACHE_DOWN"]


def test_reports(spark, data_dir):
    reports = {r.incident: r for r in incident.investigate(spark, data_dir).collect()}
    loud, quiet = reports["loud"], reports["quiet"]
    assert loud.asDict().keys() - {"incident"} == set(incident.REPORT_KEYS)
    assert "cache-node: EvictionStormException after v2" in loud.root_cause
    assert {e.source for e in loud.supporting_evidence} == {
        "logs.md", "deployment_history.md", "known_issues.csv", "runbooks.md", "previous_incidents.md"}
    assert (loud.confidence_score, loud.needs_human_review, loud.mttr_minutes) == (95.0, False, 12)
    assert loud.impacted_systems == ["cache-node", "web"]
    assert loud.remediation == "restore the memory limit."
    assert (quiet.confidence_score, quiet.needs_human_review, quiet.mttr_minutes) == (20.0, True, None)
    assert quiet.impacted_systems == ["billing"] and quiet.remediation.startswith("Unconfirmed")


@pytest.mark.parametrize("sources, expected", [(1, 20.0), (2, 40.0), (3, 60.0), (4, 80.0), (5, 95.0)])
def test_confidence_follows_the_number_of_sources(spark, sources, expected):
    named = ", ".join(
        f"named_struct('id', {chr(39) + 'x' + chr(39) if i < sources else 'string(null)'}, 'weight', {'1.0D' if i < sources else 'double(null)'}) {name}"
        for i, name in enumerate(correlation.SOURCES))
    row = correlation.corroborate(spark.sql(f"SELECT {named}")).first()
    assert (row.source_count, row.confidence_score) == (sources, expected)
    assert row.needs_human_review == (expected < 50)


def test_shared_catalogues_give_the_same_match(spark, corpus):
    tables = incident.typed_tables(corpus.filter("incident = 'loud'"))
    shared = {name: df.drop("incident") if name in ("known_issues", "runbooks", "previous_incidents") else df
              for name, df in tables.items()}
    summary = lambda t: sorted(
        (r.component, r.signature, r.source_count, r.confidence_score)
        for r in correlation.corroborate(correlation.gather_evidence(**t)).collect())
    assert summary(tables) == summary(shared)


def test_rank_corpus_splits_the_issue_catalogue(spark, data_dir):
    queries, corpus = corpora.load_incidents(spark, data_dir)
    ranked = incident.rank_corpus(queries.withColumn("query", F.lit("eviction storm memory")), corpus)
    sources = {r.source for r in ranked.filter("incident = 'loud'").collect()}
    assert "known_issues.csv#KI-1" in sources and "known_issues.csv" not in sources


def test_latency_pairs(spark):
    rows = [("a", "queued", "2024-01-01 00:00:00"), ("a", "sent", "2024-01-01 00:46:35"), ("b", "queued", "2024-01-01 01:00:00"),
            ("b", "sent", "2024-01-01 00:59:00")]
    events = spark.createDataFrame(rows, "order_id string, kind string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    found = correlation.event_latency(events, "queued", "sent", ["order_id"], "2 hours").collect()
    assert [(r.order_id, r.latency_seconds) for r in found] == [("a", 2795)]


def test_one_incident_as_plain_texts(spark, data_dir):
    query, texts = facade.load_incident(spark, data_dir, "loud")
    assert query == "Why do pages fail?"
    assert list(texts)[-1] == "known_issues.csv" and texts["logs.md"] == LOGS
    report = facade.investigate(spark, query, texts)
    assert list(report) == incident.REPORT_KEYS
    assert report["mttr_minutes"] == 12 and report["needs_human_review"] is False


def test_lines_around_the_deployment(corpus):
    tables = incident.typed_tables(corpus.filter("incident = 'loud'"))
    marks = tables["deployments"].filter("version = 'v2'").withColumnRenamed("ts", "mark_ts")
    row = correlation.before_and_after(tables["logs"], marks).first()
    assert (row.component, row.clean_before, row.failed_before, row.clean_after, row.failed_after) == ("cache-node", 0, 0, 0, 2)


def test_report_file(spark, data_dir, tmp_path):
    target = tmp_path / "answers.json"
    cli.main(["incidents", "--data", data_dir, "--output", str(target)])
    written = json.loads(target.read_text())
    assert list(written) == ["loud", "quiet"]
    assert set(written["loud"]) == set(incident.REPORT_KEYS)
    assert all(r["needs_human_review"] == (r["confidence_score"] < 50) for r in written.values())


def test_long_and_circular_paths(spark):
    chain = [("x", f"n{i}", f"n{i + 1}") for i in range(6)]
    edges = spark.createDataFrame([*chain, ("y", "a", "b"), ("y", "b", "a"), ("y", "c", "c")], "incident string, parent string, child string")
    paths = correlation.component_paths(edges).collect()
    assert sum(r.incident == "x" for r in paths) == 21 and max(r.hops for r in paths) == 6
    assert sorted((r.ancestor, r.component) for r in paths if r.incident == "y") == [("a", "b"), ("b", "a")]


def test_latency_without_a_limit_and_with_equal_starts(spark):
    rows = [("a", "queued", "2024-01-01 00:00:00"), ("a", "queued", "2024-01-01 00:00:00"), ("a", "sent", "2024-01-04 03:24:00")]
    events = spark.createDataFrame(rows, "order_id string, kind string, ts string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    (row,) = correlation.event_latency(events, "queued", "sent", ["order_id"]).collect()
    assert (row.latency_seconds, row.start_count) == (75 * 3600 + 24 * 60, 2)


def test_log_stamps_and_rejected_lines(spark):
    lines = ["2024-01-01 10:00:00 ERROR web down", "2024-01-01T10:00:00Z ERROR web down", "2024-01-01 10:00:00,250 WARN web slow",
             "2024-01-01T10:00:00.5 INFO web", "no stamp here", "  "]
    frame = spark.createDataFrame([(line,) for line in lines], "line string")
    rows = parse.log_events(frame).collect()
    assert [(str(r.ts), r.level, r.component, r.message) for r in rows] == [
        ("2024-01-01 10:00:00", "ERROR", "web", "down"), ("2024-01-01 10:00:00", "ERROR", "web", "down"),
        ("2024-01-01 10:00:00.250000", "WARN", "web", "slow"), ("2024-01-01 10:00:00.500000", "INFO", "web", "")]
    assert [r.line for r in parse.rejected_log_lines(frame).collect()] == ["no stamp here"]
