"""Joins and running aggregates that stay even when one key dominates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

HEAVY_SHARE = 1000
SMALL_ROWS = 10_000


def broadcast_if_small(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Mark a reference table for broadcast once its row count is known to fit;
    a larger one is left to the ordinary shuffle join."""
    fits = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if fits else df


def salted_join(rows: DataFrame, per_key: DataFrame, keys: list[str], weight: str,
                share: int = HEAVY_SHARE, small_rows: int = SMALL_ROWS,
                weights: DataFrame | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``per_key``, whose ``weight`` counts the rows
    of each (unique) key.

    A small ``per_key`` is broadcast: no row moves, so no key can be hot. Beyond
    that size, a key that carries more than ``1/share`` of the total weight is
    spread over several salts. Fewer than ``share`` keys can be that heavy, so the
    salt table is small by construction and safe to broadcast. The salt is a hash
    of the row, so a recomputed task places its rows exactly as before. Without such a
    key there is no salt, and a side that is placed by the keys already does not move.

    The weights are read several times: give a stored ``per_key``, or its keys and
    weights alone as a stored ``weights``.
    """
    weights = per_key if weights is None else weights
    if weights.limit(small_rows + 1).count() <= small_rows:
        return rows.join(F.broadcast(per_key), keys)
    total = weights.agg(F.sum(weight)).scalar()
    salts = (
        F.when(F.col(weight) * share > total, F.ceil(F.col(weight) * share / total))
        .otherwise(1).cast("int")
    )
    heavy = weights.select(*keys, salts.alias("_salts")).filter("_salts > 1")
    if heavy.isEmpty():
        return rows.join(per_key, keys)
    placed = (
        rows.join(F.broadcast(heavy), keys, "left")
        .withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.coalesce("_salts", F.lit(1))).cast("int"))
        .drop("_salts")
    )
    copies = per_key.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return placed.join(copies, [*keys, "_salt"]).drop("_salt")


def spread_join(rows: DataFrame, others: DataFrame, keys: list[str], share: int = HEAVY_SHARE, how: str = "inner") -> DataFrame:
    """Equi-join (``inner`` or ``left``) of two sides that may both repeat their keys.

    A key that carries more than ``1/share`` of ``rows`` is spread over several salts and
    its ``others`` are copied to each. Fewer than ``share`` keys can be that heavy, which
    bounds the broadcast table. The salt is a hash of the row, so a recomputed task places
    its rows exactly as before. Both sides are read several times.
    """
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    total = rows.agg(F.count("*")).scalar()
    heavy = F.broadcast(
        counts.filter(F.col("_n") * share > total)
        .select(*keys, F.ceil(F.col("_n") * share / total).cast("int").alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    placed = rows.join(heavy, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), salts).cast("int")).drop("_salts")
    copies = others.join(heavy, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return placed.join(copies, [*keys, "_salt"], how).drop("_salt")
