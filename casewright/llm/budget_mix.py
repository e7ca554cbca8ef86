"""Mixing sources to target weights by subset sums over exact document lengths.

The corpus is reduced to one count per source and length in words. Per source, whole
passes and an even share of every length are taken first; what is left of the budget is
filled by a bounded-knapsack dynamic program over the documents that remain, which hits
it exactly where any choice does. The counts go back to documents by a seeded hash:
each length is cut into hash buckets, and only the one bucket where its quota ends needs
a ranking, so a length that a third of all documents share is never sorted in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from casewright.llm.common import WORD, table
from casewright.session import cut_lineage

WEIGHTS = (3, 1, 2)
SHARE = 1.5
#: No source and no document is taken more often.
COPIES = 2
SEED = 7
#: Hash buckets of one source and length.
BUCKETS = 4096
#: Widest budget of the dynamic program, in words; a wider one is first narrowed by the longest documents.
BUDGET = 65_536

PLAN = "src string, size long, source_size long, target double, passes long, extra long"
_PLAN_ARROW = pa.schema([("src", pa.string()), ("size", pa.int64()), ("source_size", pa.int64()),
                         ("target", pa.float64()), ("passes", pa.int64()), ("extra", pa.int64())])


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame, kept: list[str], seed: int = SEED) -> DataFrame:
    """row (the ``kept`` columns), src (never null), size, h and bucket (seeded hashes) of each document.

    A null text has size 0, a null source is a source of its own, after all others. Every
    row is a document, also where ids or whole rows repeat; ``kept`` columns are carried in
    a struct, so that none can clash. An empty table gives no rows.
    """
    h = F.xxhash64(F.lit(seed), "doc_id", "text")
    return docs.select(
        F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"),
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("src"),  # "" stands for null
        word_count(F.col("text")).alias("size"), h.alias("h"), F.pmod(h, F.lit(BUCKETS)).cast("int").alias("bucket"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, copies: int = COPIES) -> DataFrame:
    """(src, source_size, target) from (src, source_size), one row per source.

    Sources in code point order (null last) have ``weights`` in turn and share
    ``share`` times all words. A target stops at ``copies`` times its source; in order
    of that limit over the weight, sources stop until the first that need not, and the
    rest share what is left by weight. The only rows in one task are one per source.
    """
    by_name = Window.orderBy(F.col("src") == "", "src")
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), "place")
    before, rest = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(0, Window.unboundedFollowing)
    ranked = sizes.select("*", F.row_number().over(by_name).alias("place"),
                          F.element_at(F.array(*(F.lit(float(w)) for w in weights)), turn + 1).alias("weight"),
                          (F.sum("source_size").over(every) * share).alias("budget"),
                          (F.col("source_size") * float(copies)).alias("limit"))
    level = (F.col("budget") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    stepped = ranked.withColumn("level", level).withColumn("free", F.col("limit") > F.col("level") * F.col("weight"))
    first = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(by_limit)
    return stepped.withColumn("final", first).select("src", "source_size", F.when(
        F.col("final").isNull(), F.col("limit")).otherwise(F.col("final") * F.col("weight")).alias("target"))


def subset(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of ``counts`` documents of each length to take so that their sum is the
    greatest not above ``budget`` (at most ``BUDGET``): a bounded knapsack.

    For each sum it keeps the length that first reached it and how many of it; going
    through a length's multiples of one remainder, a sum is reachable if a sum reached
    before lies at most ``count`` steps back.
    """
    reached = np.zeros(budget + 1, bool)
    reached[0] = True
    by, many = np.full(budget + 1, -1), np.zeros(budget + 1, np.int64)
    for k in np.argsort(lengths, kind="stable"):
        length = int(lengths[k])
        if length > budget or reached[budget]:
            break
        if not length or not counts[k]:
            continue
        rows = -(-(budget + 1) // length)
        grid = np.zeros(rows * length, bool)
        grid[:budget + 1] = reached
        step = np.arange(rows)[:, None]
        last = np.maximum.accumulate(np.where(grid.reshape(rows, length), step, -1 - budget), axis=0)
        steps = (step - last).ravel()[:budget + 1]
        fresh = ~reached & (steps <= counts[k])
        by[fresh], many[fresh] = k, steps[fresh]
        reached |= fresh
    take, at = np.zeros(len(lengths), np.int64), int(np.flatnonzero(reached)[-1])
    while at:
        take[by[at]] += many[at]
        at -= int(many[at] * lengths[by[at]])
    return take


def choose(lengths: np.ndarray, counts: np.ndarray, target: float) -> tuple[int, np.ndarray]:
    """Whole passes over a source, and how many documents of each length to take once more."""
    total = int((lengths * counts).sum())
    goal = min(int(target + 0.5), COPIES * total)
    if not total:
        return 0, np.zeros(len(lengths), np.int64)
    passes, rest = divmod(goal, total)
    extra = np.array([int(c) * rest // total for c in counts], np.int64)
    left, short = counts - extra, rest - int((extra * lengths).sum())
    for k in np.argsort(-lengths, kind="stable"):  # narrow the budget
        if short <= BUDGET:
            break
        if lengths[k]:
            n = min(int(left[k]), short // int(lengths[k]), -(-(short - BUDGET) // int(lengths[k])))
            extra[k], left[k], short = extra[k] + n, left[k] - n, short - n * int(lengths[k])
    if short:
        take = subset(lengths, left, min(short, BUDGET))
        extra, left, short = extra + take, left - take, short - int((take * lengths).sum())
        more = np.flatnonzero((left > 0) & (lengths > 0))
        if len(more):  # one document over is nearer than this much under
            k = more[np.argmin(lengths[more])]
            if lengths[k] - short < short:
                extra[k] += 1
    return passes, extra


def _plan(counted: pa.Table) -> pa.Table:
    counted = counted.sort_by("size")
    lengths, counts = (counted[c].to_numpy() for c in ("size", "n"))
    passes, extra = choose(lengths, counts, counted["target"][0].as_py())
    return pa.table([counted["src"], counted["size"], counted["source_size"], counted["target"],
                     pa.array(np.full(len(lengths), passes)), pa.array(extra)], schema=_PLAN_ARROW)


def mix(rows: DataFrame, lengths: DataFrame) -> DataFrame:
    """row, size, source_size, target, copies of ``rows``; ``lengths``: the same documents
    as (src, size, bucket), which may be a narrower table.

    A document of size 0 is never needed and gets no copies of use; a source without words
    has target 0. Documents of equal source, size and hash are taken in any order, which
    changes no count of words. An empty table gives no rows.
    """
    buckets = cut_lineage(lengths.groupBy("src", "size", "bucket").agg(F.count("*").alias("n")))
    counted = buckets.groupBy("src", "size").agg(F.sum("n").alias("n"))
    wanted = targets(counted.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")))
    plan = counted.join(wanted, "src").groupBy("src").applyInArrow(_plan, PLAN)
    lower = F.sum("n").over(Window.partitionBy("src", "size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    quota = F.greatest(F.lit(0), F.least("n", F.col("extra") - F.coalesce("lower", F.lit(0)))).cast("long")
    quotas = cut_lineage(buckets.withColumn("lower", lower).join(plan, ["src", "size"]).select(
        "src", "size", "bucket", "source_size", "target", "passes", quota.alias("quota")))
    rank = F.row_number().over(Window.partitionBy("src", "size", "bucket").orderBy("h"))
    return rows.withColumn("rank", rank).join(quotas.hint("shuffle_hash"), ["src", "size", "bucket"]).select(
        "row", "size", "source_size", "target", (F.col("passes") + (F.col("rank") <= F.col("quota")).cast("long")).alias("copies"))


def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` as the mix has them: each row as often as it is taken, all columns kept.

    A document without words is never taken. Equal rows count as so many documents.
    """
    rows = sized(docs, docs.columns)
    copies = mix(rows, rows.select("src", "size", "bucket")).filter((F.col("size") > 0) & (F.col("copies") > 0))
    return copies.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def op2_budget_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of every document the mix takes."""
    rows = cut_lineage(sized(table(spark, sf_dir, "documents"), ["doc_id"]))
    return mix(rows, rows).select("row.doc_id", "size", "source_size", "target",
                                  (F.col("size") * F.col("copies")).alias("taken"))
