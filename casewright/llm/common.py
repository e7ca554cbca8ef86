"""Small helpers shared by the operators of this folder."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case; every other character stays."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def packed(docs: DataFrame, *keys: Column, name: str = "row") -> DataFrame:
    """All columns of ``docs`` in one struct beside computed columns, so that no
    extra column can clash with a name that an operator uses."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(name), *keys)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case: ``bytes`` fold and split by ASCII
    rules only, which is what the contracts ask."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def chunks(items: list, size: int) -> Iterable[list]:
    for at in range(0, len(items), size):
        yield items[at:at + size]
