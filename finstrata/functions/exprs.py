"""Column builders shared by every operator: null-safe arithmetic and calendar helpers.

A missing input gives NULL, and so does a division by zero. Where a ratio only makes sense over a
positive base, ``over_positive`` says so explicitly.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def div(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL when either is missing or b is zero."""
    a, b = col(a), col(b)
    return F.when(b != 0, a / F.nullif(b, F.lit(0.0)))


def over_positive(a: Column | str, b: Column | str) -> Column:
    """a / b only where b > 0."""
    b = col(b)
    return F.when(b > 0, col(a) / F.nullif(b, F.lit(0.0)))


def zero_if_null(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(0.0))


def sum_present(*cols: Column | str) -> Column:
    """Sum of the present parts, NULL when none is present."""
    parts = [col(c) for c in cols]
    total = reduce(lambda x, y: x + y, [F.coalesce(p, F.lit(0.0)) for p in parts])
    return F.when(F.coalesce(*parts).isNotNull(), total)


def clamp(c: Column | str, low: Column | float, high: Column | float) -> Column:
    """c held within [low, high]; NULL stays NULL (greatest/least skip NULLs, so guard)."""
    c = col(c)
    low = low if isinstance(low, Column) else F.lit(float(low))
    high = high if isinstance(high, Column) else F.lit(float(high))
    return F.when(c.isNotNull(), F.greatest(F.least(c, high), low))


def higher(a: Column, b: Column) -> Column:
    """Tri-state a > b."""
    return F.when(a.isNotNull() & b.isNotNull(), a > b)


def quarter_end(d: Column | str) -> Column:
    return F.last_day(F.add_months(F.trunc(col(d), "QUARTER"), 2))


def previous_quarter_end(d: Column | str) -> Column:
    return F.date_sub(F.trunc(col(d), "QUARTER"), 1)


def next_quarter_end(d: Column | str) -> Column:
    return F.last_day(F.add_months(F.trunc(col(d), "QUARTER"), 5))


def day_number(d: Column | str) -> Column:
    return F.unix_date(col(d))


def cagr(last: Column, first: Column, years: Column | float) -> Column:
    """(last/first)^(1/years) - 1 where both ends are positive."""
    years = years if isinstance(years, Column) else F.lit(float(years))
    return F.when((last > 0) & (first > 0) & (years > 0),
                  F.pow(last / first, F.lit(1.0) / years) - 1.0)


def sorted_median(s: Column) -> Column:
    """Median of a sorted, bounded array without NULLs; NULL when empty."""
    n = F.size(s)
    hi = F.get(s, F.floor(n / 2).cast("int"))
    lo = F.get(s, (F.floor((n + 1) / 2) - 1).cast("int"))
    return F.when(n > 0, (lo + hi) / 2.0)


def array_median(arr: Column) -> Column:
    """Median of a short, bounded array without NULLs; NULL when empty."""
    return sorted_median(F.array_sort(arr))


def sorted_quantile(s: Column, q: float) -> Column:
    """Inclusive (linear interpolation) quantile of a sorted, bounded array; NULL when empty."""
    pos = (F.size(s) - 1) * F.lit(float(q))
    lo = F.floor(pos).cast("int")
    a, b = F.get(s, lo), F.get(s, F.ceil(pos).cast("int"))
    return F.when(F.size(s) > 0, a + (b - a) * (pos - lo))


def array_quantile(arr: Column, q: float) -> Column:
    """Inclusive (linear interpolation) quantile of a short, bounded array; NULL when empty."""
    return sorted_quantile(F.array_sort(arr), q)


def compact(*cols: Column) -> Column:
    """Array of the non-NULL values."""
    return F.array_compact(F.array(*cols))
