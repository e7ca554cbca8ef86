"""Every operator as a named query over the star-schema tables.

A query takes (spark, sf_dir) and reads whole tables. Results hold only plain
types, so that any SQL engine can be compared: decimals become doubles after
the exact arithmetic is done, dates and times become text.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from casewright.functions.rows import once
from casewright.operators import (
    correlation, impact_index, intervals, lookups, reach, retrieval, rules, structuring, templates,
    timeline)
from casewright.operators.index_segments import SegmentedIndex
from casewright.plans import incident, investigation, sql_tools
from casewright.session import cut_lineage, own_folder
from casewright.sources import incident_parsers as parse, warehouse as w

Query = Callable[[SparkSession, str], DataFrame]

QUESTION = "Is the thintion of estion to be nding for the ingor and the oution?"
SINGLE_CLIENT = 7
INCIDENT_CALIBRATION = correlation.Calibration(lookback="7 days")
FACTS_READ_BACK = ("amount double, payment_count bigint, combined_amount double, "
                   "structuring_windows_of_client bigint, review_actions array<string>")
TIME_TEXT = "yyyy-MM-dd HH:mm:ss.SSSSSS"

# One question per payment, worded by the payment's currency.
QUESTION_OF_CURRENCY = {
    "USD": "Is a review due before this transfer goes out, and on what grounds?",
    "CHF": "Could the payer have split one transfer into several smaller ones?",
    "SGD": "From what amount on is a review asked for in the payer's country?",
    "HKD": "The sum is small, but is the receiving jurisdiction listed, and what follows?",
    "GBP": "List the policies that bear on this transfer.",
}


def plain(df: DataFrame) -> DataFrame:
    """Columns as text, double, bigint or boolean."""
    def simple(field: T.StructField):
        column = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, T.DateType):
            column = column.cast("string")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, TIME_TEXT)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType)):
            column = column.cast("bigint")
        elif isinstance(field.dataType, T.ArrayType):
            column = F.array_join(column, ",")
        return column.alias(field.name)

    return df.select(*map(simple, df.schema.fields))


# --- lookups ----------------------------------------------------------------

def client_profiles(spark, sf_dir):
    return plain(w.client_profiles(spark, sf_dir))


def client_profile_lookup(spark, sf_dir):
    return plain(lookups.get_client_profile(w.client_profiles(spark, sf_dir), SINGLE_CLIENT))


def tool_calls_in_sql(spark, sf_dir):
    """Each client's payment history by a lateral call of the tool, counted and summed."""
    sql_tools.register(w.payments(spark, sf_dir), w.clients(spark, sf_dir), _index(spark, sf_dir))
    return plain(spark.sql("""
        SELECT c.client_id, c.country, count(*) AS payment_count, sum(p.amount) AS total_amount
        FROM tool_clients c, LATERAL get_client_payments(c.client_id) p GROUP BY ALL"""))


def clients_by_country(spark, sf_dir):
    return plain(lookups.get_clients_by_country(w.clients(spark, sf_dir), "Singapore"))


def payment_lookup(spark, sf_dir):
    """The payment with the largest amount, by its ID: found once, then read by its keys."""
    payments = w.payments(spark, sf_dir)
    largest = payments.agg(F.max_by("payment_id", F.struct("amount", "payment_id"))).first()[0]
    return plain(w.payment(spark, sf_dir, largest) if largest else payments.limit(0))


def client_payments(spark, sf_dir):
    return plain(lookups.get_client_payments(w.payments(spark, sf_dir), SINGLE_CLIENT))


def clients_without_large_payments(spark, sf_dir):
    large = w.payments(spark, sf_dir).filter("amount > 104000")
    return plain(lookups.clients_without_payments(w.clients(spark, sf_dir), large))


def country_code_mismatches(spark, sf_dir):
    return plain(lookups.country_code_mismatches(w.payments(spark, sf_dir)).select(
        "payment_id", "beneficiary_country", "beneficiary_country_code", "code_of_name"))


# --- rules and structuring --------------------------------------------------

def review_decisions(spark, sf_dir):
    return plain(rules.review_decisions(
        w.payments(spark, sf_dir), w.clients(spark, sf_dir), rules.standard_rules(spark)))


def high_risk_payments(spark, sf_dir):
    return plain(rules.high_risk_payments(w.payments(spark, sf_dir), rules.standard_rules(spark)))


def beneficiary_windows(spark, sf_dir):
    return plain(structuring.beneficiary_windows(w.payments(spark, sf_dir)))


def currency_totals(spark, sf_dir):
    return plain(structuring.currency_totals(w.payments(spark, sf_dir)))


def beneficiary_24h(spark, sf_dir):
    """The windows of one client with its most paid beneficiary."""
    payments = w.payments(spark, sf_dir)
    favourite = (
        payments.filter(F.col("client_id") == SINGLE_CLIENT).groupBy("beneficiary_name").agg(F.count("*").alias("n"))
        .agg(F.min_by("beneficiary_name", F.struct(-F.col("n"), "beneficiary_name"))).scalar())
    return plain(structuring.aggregate_beneficiary_24h(payments, SINGLE_CLIENT, favourite))


def structuring_triggers(spark, sf_dir):
    return plain(structuring.structuring_triggers(
        w.payments(spark, sf_dir), w.clients(spark, sf_dir), rules.standard_rules(spark)))


def structuring_members(spark, sf_dir):
    payments = w.payments(spark, sf_dir)
    windows = structuring.beneficiary_windows(payments).filter("payment_count >= 2 AND total_amount > 100000")
    return plain(structuring.window_members(payments, windows).select(
        "client_id", "beneficiary_name", "payment_date", "payment_id", "amount", "channel",
        "payment_count", "window_total"))


def repeated_beneficiaries(spark, sf_dir):
    return plain(structuring.find_repeated_beneficiaries(w.payments(spark, sf_dir)))


# --- time -------------------------------------------------------------------

def _events(spark, sf_dir):
    return w.table(spark, sf_dir, "events").withColumn("amount", F.col("value").cast("decimal(18,2)"))


def rolling_24h_activity(spark, sf_dir):
    return plain(timeline.rolling_activity(_events(spark, sf_dir), ["user_id"], "ts", "amount"))


def asof_prior_event(spark, sf_dir):
    """Each error with the latest sign-up of the same user in the week before."""
    events = _events(spark, sf_dir)
    signups = events.filter("event_type = 'signup'").select("user_id", "ts", "event_id")
    found = timeline.as_of(events.filter("event_type = 'error'"), signups, ["user_id"], "ts", "ts", "7 days")
    return plain(found.select(
        "user_id", "ts", "probe_count", F.coalesce("mark.event_id", F.lit(-1)).alias("prior_event_id"),
        F.coalesce(F.date_format("mark.ts", TIME_TEXT), F.lit("")).alias("prior_ts")))


def event_pair_latency(spark, sf_dir):
    """Seconds from each view to the user's next click, however much later."""
    events = _events(spark, sf_dir).withColumnRenamed("event_type", "kind")
    return plain(correlation.event_latency(events, "view", "click", ["user_id"]))


def error_episodes(spark, sf_dir):
    errors = _events(spark, sf_dir).filter("event_type = 'error'")
    return plain(timeline.episodes(errors, ["user_id"], "ts", gap_minutes=720))


# --- retrieval --------------------------------------------------------------

def _chunks(spark, sf_dir):
    documents = w.table(spark, sf_dir, "documents").select("doc_id", "text")
    return retrieval.chunk_documents(documents, source="doc_id")


def _index(spark, sf_dir):
    """Built by the first query that asks, and read by all others."""
    return retrieval.kept_index(_chunks(spark, sf_dir), f"{sf_dir}/documents.parquet")


def clean_documents(spark, sf_dir):
    documents = w.table(spark, sf_dir, "documents").select("doc_id", "text")
    return plain(retrieval.clean_documents(documents).select("doc_id", F.md5("text").alias("text_md5")))


def chunk_documents(spark, sf_dir):
    return plain(_chunks(spark, sf_dir).select("chunk_id", "source", F.md5("text").alias("text_md5")))


def term_statistics(spark, sf_dir):
    return plain(retrieval.term_statistics(_index(spark, sf_dir)))


def _search(scorer) -> Query:
    def query(spark, sf_dir):
        hits = retrieval.retrieve(_index(spark, sf_dir), QUESTION, 10, scorer)
        return plain(hits.select("chunk_id", "source", "score"))
    return query


def policy_document(spark, sf_dir):
    """The full texts of one source."""
    documents = lookups.get_policy_document(w.table(spark, sf_dir, "documents"), "src7")
    return plain(documents.select("doc_id", "source", F.md5("text").alias("text_md5")))


def rank_documents(spark, sf_dir):
    return plain(retrieval.rank_documents(_index(spark, sf_dir), QUESTION, retrieval.bm25))


def _user_questions(spark, sf_dir):
    return w.table(spark, sf_dir, "conversations").filter("role = 'user'").select(
        F.concat_ws("-", "conv_id", "turn").alias("question_id"), F.col("text").alias("question"))


def policy_evidence(spark, sf_dir):
    """Best passages of the benchmark texts for every user turn."""
    questions = _user_questions(spark, sf_dir)
    passages = retrieval.index_rows(retrieval.chunk_documents(w.table(spark, sf_dir, "benchmark"), source="item_id"))
    return plain(retrieval.retrieve_policy_evidence(passages, questions).select(
        "question_id", "rank", "chunk_id", "score"))


def evidence_topk_pruned(spark, sf_dir):
    """Best passages of all documents for every user turn, through an impact index."""
    index = impact_index.build(_index(spark, sf_dir))
    return plain(impact_index.evidence_topk(index, _user_questions(spark, sf_dir)).select(
        "question_id", "rank", "chunk_id", "score"))


def index_after_changes(spark, sf_dir):
    """Term figures of a document index that went through four changes: all documents, the
    French ones taken away, one source's put back with a line more, the benchmark added."""
    documents, benchmark = w.table(spark, sf_dir, "documents"), w.table(spark, sf_dir, "benchmark")
    texts = documents.select(F.col("doc_id").cast("string").alias("source"), "text", "lang", F.col("source").alias("origin"))
    index = SegmentedIndex(spark, f"{own_folder(spark)}/segments-{uuid.uuid4().hex}")
    index.change(texts)
    index.change(removed=texts.filter("lang = 'fr'"))
    index.change(texts.filter("origin = 'src3'").withColumn("text", F.concat("text", F.lit("\n\nAmended afterwards."))))
    index.change(benchmark.select(F.concat(F.lit("item-"), F.col("item_id")).alias("source"), "text"))
    return plain(index.term_statistics())


def vector_search(spark, sf_dir):
    """Nearest embeddings to the mean of all embeddings."""
    vectors = w.table(spark, sf_dir, "embeddings")
    sums = vectors.select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    query = [round(row.x, 9) for row in sums.orderBy("i").collect()]
    return plain(retrieval.vector_search(vectors, query).select("vec_id", "label", "score"))


# --- incidents --------------------------------------------------------------

def _tables(spark, sf_dir):
    return {
        "logs": parse.log_events(w.log_lines(spark, sf_dir)),
        "deployments": parse.deployments(w.deployment_lines(spark, sf_dir)),
        "known_issues": parse.known_issues(w.known_issue_lines(spark, sf_dir)),
        "runbooks": parse.runbooks(w.runbook_sections(spark, sf_dir)),
        "previous_incidents": parse.previous_incidents(w.previous_incident_sections(spark, sf_dir)),
    }


def log_events(spark, sf_dir):
    return plain(_tables(spark, sf_dir)["logs"].select(
        "incident", "ts", "level", "component", "message", F.col("attrs")["event_id"].alias("event_id"), "signature"))


def deployments(spark, sf_dir):
    return plain(_tables(spark, sf_dir)["deployments"])


def known_issues(spark, sf_dir):
    return plain(_tables(spark, sf_dir)["known_issues"])


def runbooks(spark, sf_dir):
    return plain(_tables(spark, sf_dir)["runbooks"].select(
        "runbook_id", "title", "symptoms", "remediation", "mttr_minutes", F.coalesce("caveat", F.lit("")).alias("caveat")))


def previous_incidents(spark, sf_dir):
    return plain(_tables(spark, sf_dir)["previous_incidents"].select(
        "incident_id", "date", "summary", "root_cause", "resolution", "mttr_minutes",
        F.coalesce("caveat", F.lit("")).alias("caveat")))


def call_tree(spark, sf_dir):
    return plain(parse.call_tree(w.architecture_documents(spark, sf_dir)))


def components(spark, sf_dir):
    return plain(parse.components(w.architecture_documents(spark, sf_dir)))


def api_endpoints(spark, sf_dir):
    endpoints = parse.api_endpoints(w.api_documents(spark, sf_dir))
    named = F.transform("fields", lambda f: F.concat_ws(":", f["field"], f["type"], f["notes"]))
    return plain(endpoints.withColumn("fields", named))


def hypotheses(spark, sf_dir):
    return plain(correlation.candidates(_tables(spark, sf_dir)["logs"]))


def corroboration(spark, sf_dir):
    scored = correlation.corroborate(
        correlation.gather_evidence(**_tables(spark, sf_dir), calibration=INCIDENT_CALIBRATION), INCIDENT_CALIBRATION)
    identified = [F.coalesce(f"{name}.id", F.lit("")).alias(name) for name in correlation.SOURCES[1:]]
    return plain(scored.select(
        *correlation.HYPOTHESIS, "line_count", "source_count", "confidence_score", "needs_human_review", *identified))


def evidence_rows(spark, sf_dir):
    evidence = correlation.gather_evidence(**_tables(spark, sf_dir), calibration=INCIDENT_CALIBRATION)
    return plain(correlation.evidence_rows(evidence).select(*correlation.HYPOTHESIS, "source_type", "record_id", "weight"))


def before_and_after(spark, sf_dir):
    """Clean and failing lines around the latest deployment of each component."""
    tables = _tables(spark, sf_dir)
    latest = tables["deployments"].groupBy("incident", "component").agg(F.max("ts").alias("mark_ts"))
    return plain(correlation.before_and_after(tables["logs"], latest))


def component_paths(spark, sf_dir):
    """Regions over nations over their customers and suppliers, and orders under customers, as a call tree."""
    table = lambda name: w.table(spark, sf_dir, name)
    nation = table("nation").join(table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    tops = nation.select(F.col("r_name").alias("incident"), F.col("r_name").alias("parent"), F.col("n_name").alias("child"))
    leaves = [
        table(name).join(nation, F.col(f"{key}_nationkey") == F.col("n_nationkey")).select(
            F.col("r_name").alias("incident"), F.col("n_name").alias("parent"), F.col(f"{key}_name").alias("child"))
        for name, key in (("customer", "c"), ("supplier", "s"))]
    orders = table("orders").join(table("customer"), F.col("o_custkey") == F.col("c_custkey")).join(
        nation, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("r_name").alias("incident"), F.col("c_name").alias("parent"), F.concat(F.lit("Order#"), "o_orderkey").alias("child"))
    return plain(correlation.component_paths(tops.unionByName(leaves[0]).unionByName(leaves[1]).unionByName(orders)))


def component_reach(spark, sf_dir):
    """Orders of a customer as calls, each to the next two by date: as many paths as rabbits,
    of which only the shortest count."""
    along = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    called = F.array(*(F.lead("o_orderkey", n).over(along).cast("string") for n in (1, 2)))
    edges = w.table(spark, sf_dir, "orders").withColumn("called", called).select(
        F.col("o_custkey").cast("string").alias("incident"), F.col("o_orderkey").cast("string").alias("parent"),
        F.explode("called").alias("child"))
    return plain(reach.component_reach(edges))


def call_cycles(spark, sf_dir):
    """Nations that supply each other in a circle, by priority: each calls the nation that
    supplies most of its quantity."""
    table = lambda name: w.table(spark, sf_dir, name)
    traded = (
        table("lineitem").join(table("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(table("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .filter("s_nationkey <> c_nationkey")
        .groupBy(F.col("o_orderpriority").alias("incident"), "c_nationkey", "s_nationkey").agg(F.sum(F.col("l_quantity").cast("long")).alias("quantity")))
    most = Window.partitionBy("incident", "c_nationkey").orderBy(F.desc("quantity"), "s_nationkey")
    edges = traded.withColumn("place", F.row_number().over(most)).filter("place = 1").select(
        "incident", *(F.format_string("N%02d", c).alias(n) for c, n in (("c_nationkey", "parent"), ("s_nationkey", "child"))))
    return plain(reach.call_cycles(reach.component_reach(edges)))


def message_templates(spark, sf_dir):
    """Templates of log lines with their level and component."""
    logs = _tables(spark, sf_dir)["logs"]
    lines = logs.select(F.concat_ws(" ", "level", "component", "message").alias("message"))
    return plain(templates.message_templates(lines))


def deployments_in_force(spark, sf_dir):
    """Every deployment that was less than twelve hours old when its component wrote an
    error line, whatever the incident."""
    tables = _tables(spark, sf_dir)
    errors = tables["logs"].filter("level = 'ERROR'").select("component", F.col("attrs")["event_id"].alias("event_id"), "ts")
    spans = tables["deployments"].select(
        "component", "version", F.col("ts").alias("deployed_at"), (F.col("ts") + F.expr("INTERVAL 12 HOURS")).alias("until"))
    return plain(intervals.holding(errors, spans, ["component"], "ts", "deployed_at", "until").select(
        "component", "event_id", "version"))


def incident_reports(spark, sf_dir):
    reports = incident.incident_reports(_tables(spark, sf_dir), INCIDENT_CALIBRATION)
    return plain(reports.select(
        "incident", "root_cause", F.size("supporting_evidence").alias("evidence_count"), "impacted_systems",
        F.coalesce("mttr_minutes", F.lit(-1)).alias("mttr_minutes"), "remediation", "confidence_score", "needs_human_review"))


# --- answers ----------------------------------------------------------------

def _questions(payments):
    return payments.select(
        F.concat(F.lit("Q-"), "payment_id").alias("question_id"), "payment_id",
        w.choose(F.col("currency"), QUESTION_OF_CURRENCY).alias("question"))


def case_sections(spark, sf_dir):
    payments = cut_lineage(w.payments(spark, sf_dir))
    return plain(investigation.case_sections(
        _questions(payments), payments, w.clients(spark, sf_dir), rules.standard_rules(spark)))


def answer_members(spark, sf_dir):
    """The payments of all windows that questions ask about."""
    payments = cut_lineage(w.payments(spark, sf_dir))
    return plain(investigation.answer_members(_questions(payments), payments).select(
        "client_id", "beneficiary_name", "payment_date", "payment_id", "amount", "channel"))


def payment_answers(spark, sf_dir):
    """One question on every payment, answered in one plan. The payment view is
    read by six steps of it, so its joins run once and the result is stored."""
    payments = cut_lineage(w.payments(spark, sf_dir))
    answers = investigation.answer_questions(
        _questions(payments), payments, w.clients(spark, sf_dir), rules.standard_rules(spark))
    read = once(answers, "fact", F.from_json("facts", FACTS_READ_BACK))
    return plain(read.select(
        "question_id", "payment_id", "citations", "tools_used", "fact.amount",
        F.coalesce("fact.payment_count", F.lit(0)).alias("payment_count"),
        F.coalesce("fact.combined_amount", F.lit(0.0)).alias("combined_amount"),
        F.coalesce("fact.structuring_windows_of_client", F.lit(-1)).alias("client_windows"),
        F.coalesce(F.array_join("fact.review_actions", ","), F.lit("")).alias("review_actions")))


QUERIES: dict[str, Query] = {
    "client_profiles": client_profiles,
    "client_profile_lookup": client_profile_lookup,
    "tool_calls_in_sql": tool_calls_in_sql,
    "clients_by_country": clients_by_country,
    "payment_lookup": payment_lookup,
    "client_payments": client_payments,
    "clients_without_large_payments": clients_without_large_payments,
    "country_code_mismatches": country_code_mismatches,
    "review_decisions": review_decisions,
    "high_risk_payments": high_risk_payments,
    "beneficiary_windows": beneficiary_windows,
    "currency_totals": currency_totals,
    "beneficiary_24h": beneficiary_24h,
    "structuring_triggers": structuring_triggers,
    "structuring_members": structuring_members,
    "repeated_beneficiaries": repeated_beneficiaries,
    "rolling_24h_activity": rolling_24h_activity,
    "asof_prior_event": asof_prior_event,
    "event_pair_latency": event_pair_latency,
    "error_episodes": error_episodes,
    "clean_documents": clean_documents,
    "chunk_documents": chunk_documents,
    "term_statistics": term_statistics,
    "tfidf_topk": _search(retrieval.tfidf_cosine),
    "bm25_topk": _search(retrieval.bm25),
    "keyword_overlap_topk": _search(retrieval.keyword_overlap),
    "policy_document": policy_document,
    "rank_documents": rank_documents,
    "policy_evidence": policy_evidence,
    "evidence_topk_pruned": evidence_topk_pruned,
    "index_after_changes": index_after_changes,
    "vector_topk": vector_search,
    "log_events": log_events,
    "deployments": deployments,
    "known_issues": known_issues,
    "runbooks": runbooks,
    "previous_incidents": previous_incidents,
    "call_tree": call_tree,
    "components": components,
    "api_endpoints": api_endpoints,
    "hypotheses": hypotheses,
    "corroboration": corroboration,
    "evidence_rows": evidence_rows,
    "before_and_after": before_and_after,
    "component_paths": component_paths,
    "component_reach": component_reach,
    "call_cycles": call_cycles,
    "deployments_in_force": deployments_in_force,
    "message_templates": message_templates,
    "incident_reports": incident_reports,
    "case_sections": case_sections,
    "answer_members": answer_members,
    "payment_answers": payment_answers,
}
