"""Parsers from incident text to typed relations.

Line-oriented sources (logs, Markdown tables, CSV text) take one row per line,
so large files are scanned in splits. Section-oriented sources (runbooks,
previous incidents, architecture, API specs) take one row per document or per
section. Every parser keeps the ``incident`` column where its input has one and
drops what does not fit its shape, prose included.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from casewright import schemas
from casewright.functions.rows import once
from casewright.functions.text import (
    code_spans, message_attributes, message_signature, mttr_minutes, unwrap,
)

LOG_LINE = r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:[.,]\d{1,9})?Z?\s+[A-Z]+\s+\S"
CAVEAT = r"(?i)unverified|unconfirmed|may not apply"


def _scope(df: DataFrame) -> list[str]:
    return ["incident"] if "incident" in df.columns else []


def log_events(lines: DataFrame) -> DataFrame:
    """(incident, ts, level, component, message, attrs, signature) per log line."""
    part = lambda index: F.get("parts", index)
    matching = lines.filter(F.col("line").rlike(LOG_LINE))
    # A stamp with T, a comma before the fraction or a final Z reads like the plain one.
    line = F.regexp_replace("line", r"^(\S{10})[ T](\d{2}:\d{2}:\d{2})[.,]?(\d*)Z?", "$1 $2.$3")
    return (
        once(matching, "parts", F.split(F.regexp_replace(line, r"^(\S+ \S{8})\.(?=\s)", "$1"), r"\s+", 5))
        .select(*_scope(lines), F.concat_ws(" ", part(0), part(1)).try_cast("timestamp_ntz").alias("ts"),
                part(2).alias("level"), part(3).alias("component"), F.coalesce(part(4), F.lit("")).alias("message"))
        .withColumn("attrs", message_attributes(F.col("message")))
        .withColumn("signature", message_signature(F.col("message")))
    )


def rejected_log_lines(lines: DataFrame) -> DataFrame:
    """Lines that are not blank and that ``log_events`` leaves out, to be counted or read."""
    line = F.col("line")
    return lines.filter(line.rlike(r"\S") & ~line.rlike(LOG_LINE))


def table_cells(line: Column) -> Column:
    """Cells of a Markdown table row, trimmed and without bold marks or code quotes."""
    inner = F.regexp_replace(line, r"^\s*\|\s*|\s*\|\s*$", "")
    return F.transform(F.split(inner, r"\s*\|\s*"), lambda cell: F.regexp_replace(cell, r"\*\*|`", ""))


def deployments(lines: DataFrame) -> DataFrame:
    """(incident, version, ts, component, change); header and rule rows have no
    timestamp in the second cell and fall out."""
    cell = lambda index: F.get("cells", index)
    stamp = r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$"
    return (
        lines.filter(F.col("line").rlike(r"^\s*\|"))
        .select(*_scope(lines), table_cells(F.col("line")).alias("cells"))
        .filter((F.size("cells") == 4) & cell(1).rlike(stamp))
        .select(*_scope(lines), cell(0).alias("version"),
                cell(1).try_cast("timestamp_ntz").alias("ts"),
                cell(2).alias("component"), cell(3).alias("change"))
    )


def known_issues(lines: DataFrame) -> DataFrame:
    """Rows of the raw CSV text; quoting is honoured, the header is dropped."""
    return (
        lines.filter((F.trim("line") != "") & ~F.col("line").startswith("issue_id,"))
        .select(*_scope(lines), F.from_csv("line", schemas.KNOWN_ISSUE_ROW).alias("row"))
        .select(*_scope(lines), "row.*")
    )


def _sections(docs: DataFrame) -> DataFrame:
    """One row per ``## `` heading with the text up to the next one."""
    return (
        docs.select(*_scope(docs), F.explode(F.split("text", r"(?m)^## ")).alias("section"))
        .filter(F.col("section").rlike(r"^[A-Z]+-\d+"))
    )


def _field(label: str) -> Column:
    """The paragraph that starts with a bold label."""
    return unwrap(F.regexp_extract("section", rf"(?s)\*\*{label}\*\*:\s*(.*?)(?=\n\s*\n|$)", 1))


def runbooks(docs: DataFrame) -> DataFrame:
    steps = F.regexp_extract_all(_field("Diagnostic steps"), F.lit(r"(?:^|\s)(?:\d+\. )?(.+?)(?=\s\d+\. |$)"), F.lit(1))
    return _sections(docs).select(
        *_scope(docs),
        F.regexp_extract("section", r"^([A-Z]+-\d+)", 1).alias("runbook_id"),
        unwrap(F.regexp_extract("section", r"^[A-Z]+-\d+: ([^\n]*)", 1)).alias("title"),
        _field("Symptoms").alias("symptoms"),
        steps.alias("diagnostics"),
        _field("Remediation").alias("remediation"),
        mttr_minutes(F.col("section")).alias("mttr_minutes"),
        F.nullif(F.regexp_extract("section", CAVEAT, 0), F.lit("")).alias("caveat"),
    )


def previous_incidents(docs: DataFrame) -> DataFrame:
    return _sections(docs).select(
        *_scope(docs),
        F.regexp_extract("section", r"^([A-Z]+-\d+)", 1).alias("incident_id"),
        F.regexp_extract("section", r"^[A-Z]+-\d+ \(([\d-]+)\)", 1).try_cast("date").alias("date"),
        _field("Summary").alias("summary"),
        _field("Root cause").alias("root_cause"),
        _field("Resolution").alias("resolution"),
        mttr_minutes(F.col("section")).alias("mttr_minutes"),
        F.nullif(F.regexp_extract("section", CAVEAT, 0), F.lit("")).alias("caveat"),
    )


def components(docs: DataFrame) -> DataFrame:
    """(incident, component, description) from the bold bullets of an architecture
    document; a bullet that names several components gives one row each."""
    item = F.col("item")
    names = F.regexp_extract_all(item, F.lit(r"\*\*([^*]+)\*\*"), F.lit(1))
    return (
        docs.select(*_scope(docs), F.explode(F.split("text", r"\n- (?=\*\*)|\n\s*\n")).alias("item"))
        .withColumn("item", F.regexp_replace("item", r"^- ", ""))
        .filter(item.startswith("**"))
        .select(*_scope(docs), F.explode(names).alias("component"),
                unwrap(F.regexp_extract("item", r"(?s)^[^:]*:\s*(.*)$", 1)).alias("description"))
    )


def call_tree(docs: DataFrame) -> DataFrame:
    """(incident, parent, child) edges from the indented arrows of the overview.

    Arrows are numbered within their document; the parent is the nearest earlier
    arrow with less indent, found among the arrows of that one diagram.
    """
    line = lambda raw: F.struct(
        F.length(F.regexp_extract(raw, r"^(\s*)->", 1)).alias("indent"),
        F.trim(F.regexp_extract(raw, r"->\s*([^\s(][^(]*?)\s*(?:\(|$)", 1)).alias("name"))
    arrows = F.transform(F.filter(F.split("text", r"\n"), lambda raw: raw.rlike(r"^\s*->")), line)
    parent = F.element_at(
        F.filter(F.slice("arrows", 1, F.col("pos")), lambda earlier: earlier["indent"] < F.col("arrow.indent")), -1)
    return (
        docs.select(*_scope(docs), arrows.alias("arrows"))
        .select(*_scope(docs), "arrows", F.posexplode("arrows").alias("pos", "arrow"))
        .filter(F.exists(F.slice("arrows", 1, F.col("pos")), lambda earlier: earlier["indent"] < F.col("arrow.indent")))
        .select(*_scope(docs), parent["name"].alias("parent"), F.col("arrow.name").alias("child"))
    )


def api_endpoints(docs: DataFrame) -> DataFrame:
    """(incident, method, path, owner, fields, timeout_ms, response_codes)."""
    section = F.col("section")
    heading = r"^`([A-Z]+) (\S+)`"
    rows = F.filter(F.split("section", r"\n"), lambda raw: raw.rlike(r"^\|\s*`"))
    fields = F.transform(F.transform(rows, table_cells), lambda cell: F.struct(
        F.get(cell, 0).alias("field"), F.get(cell, 1).alias("type"), F.get(cell, 2).alias("notes")))
    return (
        docs.select(*_scope(docs), F.explode(F.split("text", r"(?m)^## ")).alias("section"))
        .filter(section.rlike(heading))
        .select(
            *_scope(docs),
            F.regexp_extract("section", heading, 1).alias("method"),
            F.regexp_extract("section", heading, 2).alias("path"),
            F.regexp_extract("section", r"Owned by:? `([^`]+)`", 1).alias("owner"),
            fields.alias("fields"),
            F.regexp_extract("section", r"(\d+)ms", 1).try_cast("int").alias("timeout_ms"),
            F.regexp_extract_all(F.regexp_extract("section", r"\*\*Response codes\*\*:([^\n]*)", 1),
                                 F.lit(r"`(\d{3} [^`]+)`"), F.lit(1)).alias("response_codes"),
        )
    )


def investigation_steps(docs: DataFrame) -> DataFrame:
    """(step, text) of the numbered list of a procedure document."""
    return (
        docs.select(F.explode(F.split("text", r"\n")).alias("line"))
        .filter(F.col("line").rlike(r"^\d+\. "))
        .select(F.regexp_extract("line", r"^(\d+)\.", 1).cast("int").alias("step"),
                F.regexp_extract("line", r"^\d+\. (.*)$", 1).alias("text"))
        .orderBy("step")
    )


def mentioned_components(df: DataFrame, text: str) -> DataFrame:
    """One row per name in back-quotes; only real component names survive the
    later equi-join on ``component``."""
    return df.withColumn("component", F.explode(code_spans(F.col(text))))
