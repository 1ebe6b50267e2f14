"""Sinks: every table is written by Spark tasks, partitioned where readers prune."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstress.operators.impute import MedianStats
from panelstress.spec import MODEL_COLUMNS, PanelSpec


def write_panel(panel: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Full panel as Parquet, one folder per split."""
    panel.write.mode(mode).partitionBy("split").parquet(path)


def write_exports(panel: DataFrame, audit_path: str, model_path: str, spec: PanelSpec, mode: str = "overwrite") -> None:
    """Audit export (all columns) and model export (the model projection) as CSV."""
    panel.write.mode(mode).option("header", True).csv(audit_path)
    panel.select(spec.entity, *MODEL_COLUMNS).write.mode(mode).option("header", True).csv(model_path)


def statistics_long(
    spec: PanelSpec, gamma: DataFrame | None = None, climatologies: dict[str, DataFrame] | None = None,
    z_parameters: dict[str, DataFrame] | None = None, medians: MedianStats | None = None,
    wells: DataFrame | None = None,
) -> DataFrame:
    """All fitted parameters as one table (statistic, entity, month, value)."""
    e = spec.entity
    none_month = F.lit(None).cast("int").alias("month")
    parts = []
    if gamma is not None:
        names = ["q", "alpha", "scale", "n_samples", "n_zeros"]
        typed = gamma.select(e, "month", *[F.col(n).cast("double").alias(n) for n in names])
        parts.append(
            typed.unpivot([e, "month"], names, "statistic", "value").withColumn(
                "statistic", F.concat(F.lit("spi_gamma_"), "statistic")
            )
        )
    for name, df in (climatologies or {}).items():
        value = [c for c in df.columns if c not in (e, "month")][0]
        parts.append(df.select(F.lit(f"{name}_climatology").alias("statistic"), e, "month", F.col(value).alias("value")))
    for name, df in (z_parameters or {}).items():
        for p in ("mean", "std"):
            parts.append(df.select(F.lit(f"{name}_{p}").alias("statistic"), e, none_month, F.col(p).alias("value")))
    for name in medians.columns if medians is not None else ():
        parts.append(
            medians.long(name).select(
                F.concat(F.lit(f"{name}_median_"), "level").alias("statistic"), e, "month", F.col("median").alias("value")
            )
        )
    if wells is not None:
        kind = F.when(F.col("month").isNull(), "groundwater_entity_mean").otherwise("groundwater_climatology")
        parts.append(wells.select(kind.alias("statistic"), e, "month", F.col("mean_depth").alias("value")))
    out = parts[0].select("statistic", e, "month", "value")
    for p in parts[1:]:
        out = out.unionByName(p.select("statistic", e, "month", "value"))
    return out


def write_statistics(stats: DataFrame, path: str, mode: str = "overwrite") -> None:
    stats.write.mode(mode).json(path)


def write_report(report: DataFrame, path: str, mode: str = "overwrite") -> None:
    report.write.mode(mode).json(path)


def write_sequences(sequences: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Inputs, targets and metadata in one table, one folder per split."""
    sequences.write.mode(mode).partitionBy("split").parquet(path)


def write_residuals(residuals: DataFrame, path: str, spec: PanelSpec, mode: str = "overwrite") -> None:
    columns = ["sequence_id", spec.entity, "forecast_origin", "wsi_at_origin"]
    columns += [f"residual_t{h}" for h in range(1, spec.horizon + 1)]
    residuals.select(*columns, "split").write.mode(mode).partitionBy("split").parquet(path)


def write_predictions(predictions: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Long predictions, one folder per model, so that evaluation of one model reads only its rows."""
    predictions.write.mode(mode).partitionBy("model").parquet(path)


def write_table(table: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Metric and report tables as CSV."""
    table.write.mode(mode).option("header", True).csv(path)
