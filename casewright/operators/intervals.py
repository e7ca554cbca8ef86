"""Which intervals hold at a point in time, as an equi-join.

A range condition alone makes Spark compare every interval with every point of a key. Here
time is cut into bins of several widths, each eight times the one before. An interval is
covered by few bins, wide ones inside and narrow ones at its ends, that do not overlap; a
point lies in one bin of each width. So a pair meets in exactly one bin, and the join is
one on key, width and bin. Only at the two ends of an interval, which need not lie on a
bin's edge, does the exact time decide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from casewright.operators.skew import spread_join

#: Narrowest bin.
BIN_SECONDS = 60
#: Each width is 2 ** STEP of the one before; the widest, of WIDTHS, spans 16,000 years.
STEP, WIDTHS = 3, 12
_BIN = ["_width", "_bin"]


def _number(at: Column) -> Column:
    """Number of the narrowest bin that holds a time; times before 1970 have negative ones.
    Times without a zone are taken as UTC, which is this library's session zone."""
    micros, size = F.unix_micros(at.cast("timestamp")), F.lit(BIN_SECONDS * 1_000_000)
    return F.call_function("div", micros - F.pmod(micros, size), size)


def _run(begin: Column, end: Column) -> Column:
    """Whole numbers from ``begin`` up to, not including, ``end``."""
    return F.when(begin < end, F.sequence(begin, end - 1)).otherwise(F.array().cast("array<bigint>"))


def _named(bins: Column, width: int) -> Column:
    return F.transform(bins, lambda b: F.struct(F.lit(width).alias("_width"), b.alias("_bin")))


def covering_bins(begin: Column, end: Column) -> Column:
    """array<struct<_width, _bin>>: bins that cover the narrowest bins from ``begin`` up to
    ``end`` without overlap; at most 14 of each width.

    The bins of a width are those that wider ones leave at both ends.
    """
    parts = []
    for width in range(WIDTHS):
        first = lambda w: -F.shiftright(-begin, STEP * w)  # noqa: E731  (rounded up)
        last = lambda w: F.shiftright(end, STEP * w)  # noqa: E731  (rounded down)
        if width == WIDTHS - 1:
            bins = _run(first(width), last(width))
        else:
            inner, outer = F.shiftleft(first(width + 1), STEP), F.shiftleft(last(width + 1), STEP)
            bins = F.when(inner < outer, F.concat(_run(first(width), inner), _run(outer, last(width)))).otherwise(
                _run(first(width), last(width)))
        parts.append(_named(bins, width))
    return F.concat(*parts)


def holding(points: DataFrame, intervals: DataFrame, keys: list[str], at: str, start: str, end: str) -> DataFrame:
    """Every row of ``points`` with every interval of its keys that holds at its time:
    ``start <= at < end``. Columns of both sides, whose names differ but for the keys.

    An interval without an end goes on; one that ends before it starts never holds. Rows
    with a null key, time or start meet nothing. Bins with very many points are spread
    over tasks; repeated rows on either side all count.
    """
    last = F.coalesce(_number(F.col(end) - F.expr("INTERVAL 1 MICROSECOND")) + 1, F.lit(1 << STEP * WIDTHS))
    spans = (
        intervals.filter(f"`{start}` IS NOT NULL AND (`{end}` IS NULL OR `{start}` < `{end}`)")
        .select("*", F.inline(covering_bins(_number(F.col(start)), last))))
    # At most as many numbers as there are widths.
    widths = spans.agg(F.collect_set("_width")).scalar()
    placed = points.select("*", F.explode(widths).alias("_width")).withColumn(
        "_bin", F.call_function("shiftright", _number(F.col(at)), F.col("_width") * STEP))
    known = lambda df: df.filter(" AND ".join(f"`{key}` IS NOT NULL" for key in keys))
    met = spread_join(known(placed), known(spans), [*keys, *_BIN])
    inside = (F.col(start) <= F.col(at)) & (F.col(end).isNull() | (F.col(at) < F.col(end)))
    return met.filter(inside).drop(*_BIN)
