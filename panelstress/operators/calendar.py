"""Balanced calendar, period splits and forecast-origin policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelstress.functions.numeric import col
from panelstress.spec import PanelSpec


def build_calendar(entities: DataFrame, spec: PanelSpec, start: str | None = None, end: str | None = None) -> DataFrame:
    """Every entity crossed with every month start; months are generated per row, nothing is joined."""
    months = F.sequence(
        F.to_date(F.lit(start or spec.start)), F.to_date(F.lit(end or spec.end)), F.expr("interval 1 month")
    )
    return (
        entities.select(spec.entity)
        .distinct()
        .select(spec.entity, F.explode(months).alias(spec.date))
        .withColumn("year", F.year(spec.date))
        .withColumn("month", F.month(spec.date))
    )


def split_of(date: str | Column, spec: PanelSpec) -> Column:
    d = col(date)
    return (
        F.when(d <= F.lit(spec.train_end).cast("date"), "train")
        .when(d <= F.lit(spec.val_end).cast("date"), "validation")
        .otherwise("test")
    )


def add_splits(df: DataFrame, spec: PanelSpec) -> DataFrame:
    df = df.withColumn("split", split_of(spec.date, spec))
    flags = {"is_train": "train", "is_val": "validation", "is_test": "test"}
    return df.withColumns({name: (F.col("split") == value).cast("int") for name, value in flags.items()})


def add_origin_flags(df: DataFrame, ranges: dict[str, tuple[str, str]], spec: PanelSpec) -> DataFrame:
    """0/1 columns, one per named date range (inclusive)."""
    return df.withColumns(
        {name: F.col(spec.date).between(F.lit(a).cast("date"), F.lit(b).cast("date")).cast("int")
         for name, (a, b) in ranges.items()}
    )


def default_origin_ranges(spec: PanelSpec) -> dict[str, tuple[str, str]]:
    """Row-flag ranges: each period from its first month, cut one horizon before its end."""
    from datetime import date

    def shift(text: str, months: int) -> str:
        d = date.fromisoformat(text)
        n = d.year * 12 + d.month - 1 + months
        return date(n // 12, n % 12 + 1, 1).isoformat()

    return {
        "is_forecast_origin_train": (spec.start, shift(spec.train_end, -spec.horizon)),
        "is_forecast_origin_val": (shift(spec.train_end, 1), shift(spec.val_end, -spec.horizon)),
        "is_forecast_origin_test": (shift(spec.val_end, 1), shift(spec.end, -spec.horizon)),
    }


def origin_split(origin: str | Column, spec: PanelSpec) -> Column:
    """Split of a forecast origin; NULL when the origin is left out between two splits."""
    o = col(origin)
    result = None
    for name, first, last in spec.origins.ranges():
        hit = o.between(F.lit(first).cast("date"), F.lit(last).cast("date"))
        result = F.when(hit, name) if result is None else result.when(hit, name)
    return result
