"""Targets relative to the index at the origin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelstress.spec import INDEX, PanelSpec


def origin_index(panel: DataFrame, meta: DataFrame, spec: PanelSpec) -> DataFrame:
    """Index at each sequence's origin; a missing or ambiguous origin raises while rows are computed."""
    source = panel.groupBy(*spec.keys).agg(
        F.count(F.lit(1)).alias("_n"), F.max(INDEX).alias("_value")
    )
    value = F.when((F.col("_n") == 1) & F.col("_value").isNotNull(), F.col("_value")).otherwise(
        F.raise_error(F.concat(F.lit("no single index value at the origin of sequence "), F.col("sequence_id"))).cast("double")
    )
    return (
        meta.select("sequence_id", spec.entity, "forecast_origin")
        .join(source.withColumnRenamed(spec.date, "forecast_origin"), [spec.entity, "forecast_origin"], "left")
        .select("sequence_id", spec.entity, "forecast_origin", value.alias("wsi_at_origin"))
    )


def add_residual_targets(sequences: DataFrame, spec: PanelSpec) -> DataFrame:
    """``residual_t<h>`` = target h minus the index at the origin."""
    return sequences.withColumns(
        {f"residual_t{h}": F.col("y")[h - 1].cast("double") - F.col("wsi_at_origin") for h in range(1, spec.horizon + 1)}
    )


def residual_columns(spec: PanelSpec) -> list[str]:
    return [f"residual_t{h}" for h in range(1, spec.horizon + 1)]


def residual_report(residuals: DataFrame, spec: PanelSpec, tolerance: float = 1e-6) -> DataFrame:
    """Identity error against the single-precision stored form, id uniqueness and finiteness."""
    names = residual_columns(spec)
    gaps = [
        F.abs(
            F.col(n).cast("float").cast("double")
            - (F.col("y")[i].cast("double") - F.col("wsi_at_origin").cast("float").cast("double"))
        )
        for i, n in enumerate(names)
    ]
    missing = F.lit(False)
    for c in ["wsi_at_origin", *names]:
        missing = missing | F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    per_id = residuals.groupBy("sequence_id", "split").agg(
        F.count(F.lit(1)).alias("_n"), F.max(F.greatest(*gaps)).alias("_gap"), F.sum(missing.cast("int")).alias("_bad")
    )
    return per_id.groupBy("split").agg(
        F.sum("_n").alias("sequences"),
        F.sum(F.col("_n") - 1).alias("duplicate_ids"),
        F.sum("_bad").alias("non_finite"),
        F.max("_gap").alias("max_identity_diff"),
        (F.max("_gap") <= tolerance).alias("passed"),
    )


def reconstruct(residual_predictions: Column, origin: Column) -> Column:
    """Index forecasts from residual forecasts."""
    return F.transform(residual_predictions, lambda r: r + origin)


def reconstruction_check(df: DataFrame, residual_predictions: str, spec: PanelSpec, tolerance: float = 1e-6) -> DataFrame:
    """The error of the residual equals the error of the reconstructed index."""
    gaps, residual_errors, index_errors = [], [], []
    for h in range(1, spec.horizon + 1):
        r_hat = F.col(residual_predictions)[h - 1].cast("double")
        e_res = F.abs(r_hat - F.col(f"residual_t{h}"))
        e_idx = F.abs(F.col("wsi_at_origin") + r_hat - F.col("y")[h - 1].cast("double"))
        gaps.append(F.abs(e_res - e_idx))
        residual_errors.append(e_res)
        index_errors.append(e_idx)
    count = float(spec.horizon)
    return df.agg(
        F.count(F.lit(1)).alias("sequences"),
        F.max(F.greatest(*gaps)).alias("max_error_gap"),
        F.avg(sum(residual_errors[1:], residual_errors[0]) / count).alias("residual_mae"),
        F.avg(sum(index_errors[1:], index_errors[0]) / count).alias("wsi_mae"),
        (F.max(F.greatest(*gaps)) <= tolerance).alias("passed"),
    )
