"""Assembly of the wide panel and the composite index."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstress.functions.numeric import classify, mean_of
from panelstress.spec import INDEX, PanelSpec


def assemble(calendar: DataFrame, features: list[DataFrame], spec: PanelSpec, how: str = "inner") -> DataFrame:
    """Join feature tables on (entity, month); columns the panel already has are taken once."""

    def attach(panel: DataFrame, part: DataFrame) -> DataFrame:
        fresh = [c for c in part.columns if c in spec.keys or c not in panel.columns]
        return panel.join(part.select(*fresh), spec.keys, how)

    return reduce(attach, features, calendar)


def null_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: number of missing or NaN values per column."""
    return df.agg(
        *[F.count(F.when(F.col(c).isNull() | F.isnan(c), 1)).alias(c) for c in columns]
    )


def add_index(df: DataFrame, spec: PanelSpec, strict: bool = True) -> DataFrame:
    """Mean of the components and its class.

    Missing columns raise at once. With ``strict`` a missing value raises while the rows are
    computed, in the same pass; otherwise it gives a NULL index.
    """
    components = list(spec.components)
    absent = [c for c in components if c not in df.columns]
    if absent:
        raise KeyError(f"index components are missing: {absent}")
    value = mean_of(components)
    if strict:
        value = F.when(value.isNull(), F.raise_error(F.lit("an index component is missing")).cast("double")).otherwise(value)
    return df.withColumn(INDEX, value).withColumn("wsi_category", classify(INDEX))
