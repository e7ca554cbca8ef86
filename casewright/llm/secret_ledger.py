"""Secret scans with an incremental ledger of blobs.

Every version of every path is addressed by the SHA-256 of its content. The ledger
keeps which (blob, rule version) pairs were scanned and what was found, so a run
scans each unseen pair once and joins the findings back to all paths that hold the
blob. A changed pattern is a new rule version, and only that rule runs again.

Only DataFrame functions are used; nothing runs in Python.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from casewright.llm.common import table
from casewright.operators.skew import spread_join
from casewright.session import cut_lineage, own_folder


@dataclass(frozen=True)
class Rule:
    """``least`` characters are asked of ``group`` of a match; ``literals``: one of
    them occurs in any text that matches; ``base``: part of the contract's digest."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    literals: tuple[str, ...] = ()
    base: bool = False

    @property
    def version(self) -> str:
        return f"{self.kind}-{hashlib.sha256(f'{self.pattern} {self.group} {self.least}'.encode()).hexdigest()[:12]}"


#: Matches of ``+`` that are long enough equal those of a least count for the two
#: rules without a gap inside; only ``assign`` has to see its short matches.
RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
         group=2, least=12, base=True),
    Rule("access", r"AKIA[A-Z0-9]{14,}", literals=("AKIA",), base=True),
    Rule("hex", r"[0-9a-f]{16,}", base=True),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", literals=("PRIVATE KEY-----",)),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", literals=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
)


class Ledger:
    """Two tables in ``folder``: ``scanned`` (blob, rule_version) and ``findings``.

    Findings are written before the pairs that led to them, so a run that breaks
    off between the two is repeated, and repeated findings merge when read.
    """

    SCANNED = "blob string, rule_version string"
    FINDINGS = "blob string, rule_version string, start long, end long"

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        for name, schema in (("scanned", self.SCANNED), ("findings", self.FINDINGS)):
            empty = spark.range(0).select(*(F.lit(None).cast(kind).alias(column) for column, kind in
                                            (field.strip().split() for field in schema.split(","))))
            empty.write.mode("ignore").parquet(f"{folder}/{name}")

    def scanned(self) -> DataFrame:
        return self.spark.read.schema(self.SCANNED).parquet(f"{self.folder}/scanned").distinct()

    def findings(self) -> DataFrame:
        return self.spark.read.schema(self.FINDINGS).parquet(f"{self.folder}/findings").distinct()

    def add(self, findings: DataFrame, pairs: DataFrame) -> None:
        findings.write.mode("append").parquet(f"{self.folder}/findings")
        pairs.write.mode("append").parquet(f"{self.folder}/scanned")


def address(versions: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    """(path, blob) of every version; a null text is the empty blob."""
    return versions.select(F.col(path).alias("path"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("blob"))


def unseen(addressed: DataFrame, scanned: DataFrame, rules=RULES) -> DataFrame:
    """(blob, path, todo): one path that holds the blob, and the rule versions it still needs."""
    wanted = F.array(*(F.lit(rule.version) for rule in rules))
    seen = scanned.groupBy("blob").agg(F.collect_set("rule_version").alias("seen"))
    blobs = addressed.groupBy("blob").agg(F.min("path").alias("path"))
    todo = F.array_except(wanted, F.coalesce(F.col("seen"), F.array().cast("array<string>")))
    return (blobs.join(seen, "blob", "left").select("blob", "path", todo.alias("todo"))
            .filter(F.size("todo") > 0))


def _matches(rule: Rule, text: Column) -> Column:
    """Of one rule in one text: the gap before each match, its length, and the length that counts."""
    pattern = F.lit(rule.pattern)
    wanted = F.array_contains("todo", rule.version)
    if rule.literals:
        found = F.lit(False)
        for literal in rule.literals:
            found = found | F.contains(text, F.lit(literal))
        wanted = wanted & found
    lengths = [F.transform(values, F.char_length) for values in (
        F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0)),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)))]
    zipped = F.transform(
        F.arrays_zip(*(values.alias(name) for values, name in zip(lengths, ("gap", "whole", "value"), strict=True))),
        lambda m: F.struct(F.lit(rule.version).alias("rule_version"), F.lit(rule.least).alias("least"),
                           m["gap"].alias("gap"), m["whole"].alias("whole"), m["value"].alias("value")))
    return F.when(wanted & F.rlike(text, pattern), zipped)


def scan(blobs: DataFrame, rules=RULES) -> DataFrame:
    """Findings (blob, rule_version, start, end) of ``blobs`` (blob, text, todo).

    Regular expressions give texts without places, so a match's start is the sum of
    all gaps and matches before it: one running sum over the matches of one text.
    A blob that came twice (a repeated version row) counts once.
    """
    per_rule = F.explode(F.array(*(_matches(rule, F.col("text")) for rule in rules)))
    match = blobs.select("blob", per_rule.alias("found")).filter(F.col("found").isNotNull()).select(
        "blob", F.posexplode("found").alias("i", "m")).select("blob", "i", "m.*").filter(F.col("whole").isNotNull()).dropDuplicates(["blob", "rule_version", "i"])
    so_far = Window.partitionBy("blob", "rule_version").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    placed = match.withColumn("end", F.sum(F.col("gap") + F.col("whole")).over(so_far))
    return placed.filter(F.col("value") >= F.col("least")).select(
        "blob", "rule_version", (F.col("end") - F.col("whole")).cast("long").alias("start"),
        F.col("end").cast("long").alias("end"))


def scan_versions(spark: SparkSession, versions: DataFrame, folder: str, path: str = "doc_id", text: str = "text",
                  rules=RULES) -> DataFrame:
    """Bring the ledger in ``folder`` up to date and return findings of every path.

    Returns path, kind, base, rank (of the kind), start, end: one row per version
    row and finding, and one row with null kind for a version row without any.
    A null path is a path like any other; repeated version rows give repeated rows;
    null texts are empty. Characters are code points, ``end`` is exclusive.
    """
    ledger = Ledger(spark, folder)
    addressed = cut_lineage(address(versions, path, text))
    todo = cut_lineage(unseen(addressed, ledger.scanned(), rules))
    texts = versions.select(F.col(path).alias("at"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn(
        "sha", F.sha2("text", 256))
    # The narrow side is hashed, so that the texts are shuffled but never sorted.
    blobs = texts.join(todo.hint("shuffle_hash"), (F.col("sha") == F.col("blob")) & F.col("at").eqNullSafe(
        F.col("path"))).select("blob", "text", "todo")
    ledger.add(scan(blobs, rules), todo.select("blob", F.explode("todo").alias("rule_version")))
    return at_paths(addressed, ledger.findings(), rules)


def at_paths(addressed: DataFrame, findings: DataFrame, rules=RULES) -> DataFrame:
    """Findings of the given rules at every path. Blobs have one row each before the join; a
    blob at very many paths is spread over tasks, and its row copied to each of them."""
    known = F.create_map(*(part for rank, rule in enumerate(rules) for part in (
        F.lit(rule.version), F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.base).alias("base"),
                                      F.lit(rank).alias("rank")))))
    named = findings.select("blob", F.struct(known[F.col("rule_version")].alias("rule"), "start", "end").alias("f"))
    per_blob = named.filter(F.col("f.rule").isNotNull()).groupBy("blob").agg(
        F.array_sort(F.collect_list(F.struct("f.start", F.col("f.rule.rank").alias("rank"), "f.end",
                                             F.col("f.rule.kind").alias("kind"),
                                             F.col("f.rule.base").alias("base")))).alias("found"))
    return spread_join(addressed, cut_lineage(per_blob), ["blob"], how="left")


def _digest(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def report(per_path: DataFrame) -> DataFrame:
    """One row per version row: counts by kind, digest of the base spans, all spans."""
    nothing = F.array().cast("array<struct<start:bigint,rank:int,end:bigint,kind:string,base:boolean>>")
    rows = per_path.select("path", F.coalesce("found", nothing).alias("found"))
    count = lambda kind: F.size(F.filter("found", lambda f: f["kind"] == kind)).cast("long")
    base = F.filter("found", lambda f: f["base"])
    return rows.select(
        F.col("path").alias("doc_id"), *(count(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")),
        F.sha2(_digest(base), 256).alias("base_sha256"), _digest(F.col("found")).alias("spans"))


def op8_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, from a ledger that starts empty."""
    folder = f"{own_folder(spark)}/secret-ledger-{uuid.uuid4().hex}"
    return report(scan_versions(spark, table(spark, sf_dir, "documents"), folder))


_SQL_RULE = """
SELECT doc_id, n, t, '{kind}' AS kind, {rank} AS rank, {base} AS base, {least} AS least,
       string_split_regex(t, '{pattern}') AS gaps, regexp_extract_all(t, '{pattern}', 0) AS wholes,
       regexp_extract_all(t, '{pattern}', {group}) AS vals
FROM d"""

ORACLE_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS n FROM documents),
r AS ({rules}),
m AS (SELECT *, unnest(generate_series(1, len(wholes))) AS i FROM r),
s AS (SELECT n, kind, rank, base,
             list_sum(list_transform(gaps[1:i], lambda x: length(x)))
             + coalesce(list_sum(list_transform(wholes[1:i - 1], lambda x: length(x))), 0) AS start,
             length(wholes[i]) AS size
      FROM m WHERE length(vals[i]) >= least),
f AS (SELECT n, kind, rank, base, start, concat(kind, ':', start::BIGINT, ':', (start + size)::BIGINT) AS span FROM s),
g AS (SELECT n, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
             count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(span, ',' ORDER BY start, rank) FILTER (base) AS base_spans,
             string_agg(span, ',' ORDER BY start, rank) AS spans
      FROM f GROUP BY n)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
       coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base_spans, '')) AS base_sha256,
       coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (n)
""".replace("{rules}", " UNION ALL ".join(_SQL_RULE.format(
    kind=rule.kind, rank=rank, base=str(rule.base).lower(), least=rule.least, group=rule.group,
    pattern=rule.pattern.replace("'", "''")) for rank, rule in enumerate(RULES)))
