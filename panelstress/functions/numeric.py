"""Missing values, coercion, rounding and month arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from panelstress.spec import CLASS_UPPER_BOUNDS, STD_FLOOR


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def numeric(c: str | Column) -> Column:
    """Text or number to DOUBLE; bad text and NaN become NULL."""
    value = col(c).try_cast("double")
    return F.when(~F.isnan(value), value)


def calendar_date(c: str | Column) -> Column:
    """Text or timestamp to DATE; bad text becomes NULL."""
    return col(c).try_cast("timestamp").cast("date")


def month_start(year: str | Column, month: str | Column) -> Column:
    return F.make_date(col(year), col(month), F.lit(1))


def month_number(date: str | Column) -> Column:
    """Months on one integer axis."""
    return F.year(col(date)) * 12 + F.month(col(date))


def guarded_std(std: Column) -> Column:
    """A missing or vanishing standard deviation divides by one."""
    return F.when(std > STD_FLOOR, std).otherwise(F.lit(1.0))


def rounded(value: Column, digits: int) -> Column:
    return F.round(value, digits) + F.lit(0.0)


def mean_of(columns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c) for c in columns]) / float(len(columns))


def classify(value: str | Column, missing: str | None = "Unknown") -> Column:
    """Half-open classes of the index."""
    v = col(value)
    result = F.when(v.isNull() | F.isnan(v), F.lit(missing))
    for name, upper in CLASS_UPPER_BOUNDS:
        result = result.otherwise(F.lit(name)) if upper is None else result.when(v < upper, F.lit(name))
    return result


def linear_quantile(lower: Column, upper: Column, fraction: Column) -> Column:
    """The bound itself when both neighbours are equal or none of the upper one is wanted, so infinities stay."""
    return F.when((lower == upper) | (fraction == 0.0) | (lower == float("-inf")), lower).otherwise(lower + (upper - lower) * fraction)
