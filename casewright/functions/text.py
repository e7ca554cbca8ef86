"""Column expressions over text. All are built-ins, so they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

WORD_BREAK = r"[^\p{L}\p{N}]+"


def tokenize(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), WORD_BREAK), "")


def clean_document(text: Column) -> Column:
    """Uniform line ends, no trailing or doubled blanks; wording is untouched."""
    text = F.regexp_replace(text, r"\r\n?", "\n")
    text = F.regexp_replace(text, r"[ \t]+\n", "\n")
    text = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def unwrap(text: Column) -> Column:
    """Join hard-wrapped lines into one line of single-spaced text."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def message_attributes(message: Column) -> Column:
    """``key=value`` pairs of a log message as a map; the first of a key wins."""
    pattern = F.lit(r"(\w+)=(\S+)")
    names = F.regexp_extract_all(message, pattern, F.lit(1))
    values = F.regexp_extract_all(message, pattern, F.lit(2))
    pairs = F.arrays_zip(names.alias("key"), values.alias("value"))
    first_of_key = F.filter(
        pairs, lambda pair, i: F.array_position(names, pair["key"]) == i + 1)
    return F.map_from_entries(first_of_key)


def message_signature(message: Column) -> Column:
    """What stays of a log message once values are removed: cut at the first
    colon, drop ``key=value`` pairs, parentheses and words that hold a digit."""
    text = F.regexp_replace(message, r":.*$", "")
    text = F.regexp_replace(text, r"\S+=\S+|\([^)]*\)", "")
    text = F.regexp_replace(text, r"\S*\d\S*", "")
    return unwrap(text)


def mttr_minutes(section: Column) -> Column:
    """``Typical MTTR: 20 minutes`` and ``**MTTR**: 22 minutes`` both give the number."""
    return F.regexp_extract(section, r"MTTR[*]*:\s*(\d+)\s*minutes", 1).try_cast("int")


def code_spans(text: Column) -> Column:
    """Distinct names set in back-quotes."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"`([^`\s]+)`"), F.lit(1)))


def choose(column: Column, mapping: dict) -> Column:
    """The mapped value of ``column``; NULL where the mapping has none."""
    result = F.lit(None)
    for key, value in reversed(mapping.items()):
        result = F.when(column == key, F.lit(value)).otherwise(result)
    return result
