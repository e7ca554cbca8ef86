"""Templates of log messages, mined from the messages themselves.

A message is cut into tokens, and a tree of fixed depth is grown over the first of them:
messages of equal length that begin alike share a branch. Where a node has more different
next tokens than it may have branches, that place holds a name, not wording, and becomes a
wildcard that all of them share. Behind the tree's depth a place is wording if all messages
of a leaf agree on it. What a node becomes depends on the set of messages alone, so neither
order nor partitioning matters, and every level is one count of distinct tokens per node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from casewright.session import cut_lineage

DEPTH = 4
BRANCHES = 8
WILDCARD = "<*>"
_GAP = "\u0001"


def masked_tokens(message: Column) -> Column:
    """Words between blanks; a word with a digit is a value from the start."""
    words = F.array_remove(F.split(message, r"\s+"), "")
    return F.transform(words, lambda word: F.when(word.rlike("[0-9]"), F.lit(WILDCARD)).otherwise(word))


def _stepped(rows: DataFrame, level: int) -> DataFrame:
    """The node below by the token of this level, which becomes a wildcard where ``_wide`` says so."""
    token = F.get("tokens", F.lit(level))
    step = F.when(F.col("_wide"), F.lit(WILDCARD)).otherwise(token)
    return rows.select(
        F.when(F.col("_wide"), F.transform("tokens", lambda word, place: F.when(place == level, F.lit(WILDCARD)).otherwise(word)))
        .otherwise(F.col("tokens")).alias("tokens"), "n",
        F.when(token.isNull(), F.col("node")).otherwise(F.concat_ws(_GAP, "node", step)).alias("node"))


def message_templates(messages: DataFrame, column: str = "message", depth: int = DEPTH, branches: int = BRANCHES) -> DataFrame:
    """(template, message_count, wording_count): each template with how many messages it
    covers and how many different ones, once words with digits are masked.

    Null messages and those without a word have no template. Repeated messages count in
    ``message_count``. A hot wording is merged before anything is grouped by node.
    """
    rows = cut_lineage(
        messages.select(masked_tokens(F.col(column)).alias("tokens")).filter(F.size("tokens") > 0)
        .groupBy("tokens").agg(F.count("*").alias("n"))
        .withColumn("node", F.size("tokens").cast("string")))
    for level in range(depth):
        token = F.get("tokens", F.lit(level))
        children = rows.filter(token.isNotNull()).select("node", token.alias("token")).distinct()
        # Nodes with too many children: each stands for more than ``branches`` rows.
        wide = children.groupBy("node").agg(F.count("*").alias("_children")).filter(F.col("_children") > branches).select(
            "node", F.lit(True).alias("_wide"))
        rows = _stepped(rows.join(wide, "node", "left"), level)
    rows = cut_lineage(rows)
    places = rows.select("node", F.posexplode("tokens").alias("place", "token")).groupBy("node", "place").agg(
        F.min("token").alias("least"), F.max("token").alias("most"))
    # As many places as a message has words.
    agreed = F.when(F.col("least") == F.col("most"), F.col("least")).otherwise(WILDCARD)
    texts = places.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("place", agreed.alias("token")))).alias("all")).select(
        "node", F.array_join("all.token", " ").alias("template"))
    counts = rows.groupBy("node").agg(F.sum("n").alias("message_count"), F.count("*").alias("wording_count"))
    # Leaves whose wording came out alike are one template.
    return counts.join(texts, "node").groupBy("template").agg(
        F.sum("message_count").alias("message_count"), F.sum("wording_count").alias("wording_count"))
