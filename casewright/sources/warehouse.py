"""The star-schema tables seen as the two workloads' relations.

Every view derives from whole tables: lineitem with its order is a payment, the
supplier its beneficiary, the customer the client, the region its country;
events are log lines and deployments, parts the three incident catalogues.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from casewright import schemas
from casewright.functions.rows import once
from casewright.functions.text import choose

# How the tables' codes stand for the workloads' domains.
COUNTRY_OF_REGION = {
    "AFRICA": "UK",
    "AMERICA": "Hong Kong",
    "ASIA": "Singapore",
    "EUROPE": "Switzerland",
    "MIDDLE EAST": "UAE",
}
CODE_OF_REGION = {
    "AFRICA": "GB",
    "AMERICA": "HK",
    "ASIA": "SG",
    "EUROPE": "CH",
    "MIDDLE EAST": "AE",
}
# One European nation is booked under the code AE, so that name and code disagree.
CODE_OF_NATION = {"NATION_23": "AE"}
CURRENCY_OF_PRIORITY = {
    "1-URGENT": "USD",
    "2-HIGH": "CHF",
    "3-MEDIUM": "SGD",
    "4-NOT SPECIFIED": "HKD",
    "5-LOW": "GBP",
}
CHANNEL_OF_STATUS = {"F": "Branch", "O": "Online", "P": "RM-assisted"}
CLIENT_TYPE_OF_SEGMENT = {
    "AUTOMOBILE": "Corporate",
    "BUILDING": "Corporate",
    "FURNITURE": "Individual",
    "HOUSEHOLD": "Individual",
    "MACHINERY": "Family Office",
}
LEVEL_OF_EVENT = {"error": "ERROR", "click": "WARN"}
ADJECTIVES = ["blue", "cold", "hot", "large", "new", "old", "red", "small"]
NOUNS = ["anvil", "bolt", "gear", "gizmo", "plate", "ring", "rod", "widget"]
CATALOGUE_OF_TYPE = {
    "ECONOMY": "known_issue",
    "PROMO": "known_issue",
    "STANDARD": "runbook",
    "MEDIUM": "runbook",
    "LARGE": "previous_incident",
    "SMALL": "previous_incident",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        "n_nationkey",
        choose(F.col("r_name"), COUNTRY_OF_REGION).alias("country"),
        F.coalesce(choose(F.col("n_name"), CODE_OF_NATION), choose(F.col("r_name"), CODE_OF_REGION)).alias("code"),
    )


def clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    nations = _nations(spark, sf_dir)
    balance = F.col("c_acctbal")
    return customer.join(nations, customer.c_nationkey == nations.n_nationkey).select(
        F.col("c_custkey").alias("client_id"),
        "country",
        F.when(balance < 2000, "High").when(balance < 6000, "Medium").otherwise("Low").alias("risk_rating"),
        choose(F.col("c_mktsegment"), CLIENT_TYPE_OF_SEGMENT).alias("client_type"),
    )


def client_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients with the length of their relationship: years from the first order
    to the last order date in the table."""
    orders = table(spark, sf_dir, "orders")
    last_day = orders.agg(F.max("o_orderdate").cast("date")).scalar()
    first_orders = orders.groupBy(F.col("o_custkey").alias("client_id")).agg(
        F.min("o_orderdate").cast("date").alias("first_day"))
    years = F.datediff(last_day, F.col("first_day")) / F.lit(365.25)
    return (
        clients(spark, sf_dir).join(first_orders, "client_id", "left")
        .withColumn("relationship_years", F.coalesce(F.round(years, 1), F.lit(0.0)))
        .drop("first_day")
    )


def payment(spark: SparkSession, sf_dir: str, payment_id: str) -> DataFrame:
    """One payment by its ID. The ID is made of keys, so they reach the scans as filters."""
    order, line, part, supplier = map(int, payment_id.split("-"))
    return payments(spark, sf_dir, (F.col("l_orderkey") == order) & (F.col("l_linenumber") == line)
                    & (F.col("l_partkey") == part) & (F.col("l_suppkey") == supplier))


def payments(spark: SparkSession, sf_dir: str, only: Column | None = None) -> DataFrame:
    """Line items (``only`` some of them) as payments. The supplier join comes first: it is
    the small side, and filters on amount and destination then run below the order join."""
    lineitem, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    if only is not None:
        lineitem = lineitem.filter(only)
    supplier, nations = table(spark, sf_dir, "supplier"), _nations(spark, sf_dir)
    beneficiaries = supplier.join(nations, supplier.s_nationkey == nations.n_nationkey)
    return (
        lineitem.join(beneficiaries, lineitem.l_suppkey == beneficiaries.s_suppkey)
        .join(orders, F.col("l_orderkey") == orders.o_orderkey)
        .select(
            F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("payment_id"),
            F.col("o_custkey").alias("client_id"),
            F.col("s_name").alias("beneficiary_name"),
            F.col("country").alias("beneficiary_country"),
            F.col("code").alias("beneficiary_country_code"),
            F.col("l_extendedprice").cast(schemas.AMOUNT).alias("amount"),
            choose(F.col("o_orderpriority"), CURRENCY_OF_PRIORITY).alias("currency"),
            choose(F.col("o_orderstatus"), CHANNEL_OF_STATUS).alias("channel"),
            F.col("o_orderdate").cast("date").alias("payment_date"),
        )
    )


def _words(k: Column) -> Column:
    """Two words chosen by a small number, shared by events and part names."""
    pick = lambda words, index: F.element_at(F.array(*map(F.lit, words)), index + 1)
    return F.concat_ws(" ", pick(ADJECTIVES, k % 8), pick(NOUNS, F.floor(k / 8).cast("int") % 8))


def _operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("incident"),
        "event_id", "ts", "event_type", "value",
        F.concat(F.lit("svc-"), (k % 25 + 1).cast("string")).alias("component"),
        _words(k).alias("words"),
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as application-log lines, one incident per user."""
    line = F.format_string(
        "%s %-5s %-24s %s: event_id=%d",
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss"),
        F.coalesce(choose(F.col("event_type"), LEVEL_OF_EVENT), F.lit("INFO")),
        F.col("component"), F.col("words"), F.col("event_id"))
    return once(_operations(spark, sf_dir), "line", line).select("incident", "line")


def deployment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sign-up events as rows of a Markdown deployment table."""
    line = F.format_string(
        "| **v%d** | **%s** | **%s** | changed %s |",
        F.col("event_id"), F.date_format("ts", "yyyy-MM-dd HH:mm"), F.col("component"), F.col("words"))
    signups = _operations(spark, sf_dir).filter("event_type = 'signup'")
    return once(signups, "line", line).select("incident", "line")


def _catalogue(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.filter(choose(F.col("p_type"), CATALOGUE_OF_TYPE) == kind).select(
        "p_partkey", "p_name", "p_size",
        F.concat(F.lit("svc-"), F.substring_index("p_brand", "#", -1)).alias("component"),
        F.when(F.col("p_retailprice") > 1000, "unverified").otherwise("confirmed").alias("standing"),
    )


def known_issue_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.format_string(
        'KI-%d,%s fault,"seen as %s, in logs",%s,%s',
        *map(F.col, ("p_partkey", "p_name", "p_name", "component", "standing")))
    return once(_catalogue(spark, sf_dir, "known_issue"), "line", line).select("line")


def runbook_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string(
        "## RB-%d: Fault of %s\n\n**Symptoms**: `%s` logging %s.\n\n**Remediation**: restart %s (%s).\n\n"
        "**Typical MTTR: %d minutes.**",
        *map(F.col, ("p_partkey", "component", "component", "p_name", "component", "standing", "p_size")))
    return once(_catalogue(spark, sf_dir, "runbook"), "text", text).select("text")


def previous_incident_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.format_string(
        "## INC-%d (2023-05-01)\n\n**Summary**: `%s` logging %s.\n\n**Root cause**: %s.\n\n"
        "**Resolution**: restarted.\n\n**MTTR**: %d minutes.",
        *map(F.col, ("p_partkey", "component", "p_name", "standing", "p_size")))
    return once(_catalogue(spark, sf_dir, "previous_incident"), "text", text).select("text")


def architecture_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One architecture overview per order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    text = F.format_string(
        "# Overview\n\n```\nClient\n  -> client-%d\n       -> order-%d      (priority %s,\n"
        "                              checked)\n            -> status-%s\n       -> billing\n```\n\n"
        "## Components\n\n- **order-%d**: has priority\n  %s.\n- **billing**: shared.\n\nNo others.\n",
        *map(F.col, ("o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus", "o_orderkey", "o_orderpriority")))
    return once(orders, "text", text).select(F.col("o_orderkey").cast("string").alias("incident"), "text")


def api_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One API section per part."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    text = F.format_string(
        "# API\n\n## `GET /parts/%d`\n\nOwned by: `%s`, nobody else.\n\n| Field | Type | Notes |\n|---|---|---|\n"
        "| `size` | integer | up to %d |\n| `type` | string | %s |\n\n**Timeout**: waits %dms.\n\n"
        "**Response codes**: `200 OK`, `404 NO_%s`.\n",
        *map(F.col, ("p_partkey", "p_brand", "p_size", "p_type", "p_partkey", "p_type")))
    return once(part, "text", text).select(F.col("p_partkey").cast("string").alias("incident"), "text")
