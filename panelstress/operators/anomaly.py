"""Climatology, physical anomaly and sign-oriented z-score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelstress.functions.numeric import guarded_std
from panelstress.spec import PanelSpec


def _in_train(spec: PanelSpec):
    return F.col(spec.date) <= F.lit(spec.train_end).cast("date")


@dataclass(frozen=True)
class Anomaly:
    """Names of one stream's feature tiers; ``sign`` orients the z-score so that stress is positive."""

    value: str
    climatology: str
    anomaly: str
    z: str
    sign: int


# Column names and orientation of the anomaly features.
SOIL = Anomaly("soil_water_storage_mm", "soil_water_climatology_mm", "soil_water_anomaly_mm", "soil_stress_z", -1)
VEGETATION = Anomaly("ndvi", "ndvi_climatology", "ndvi_anomaly", "ndvi_stress_z", -1)
TEMPERATURE = Anomaly("lst_celsius", "lst_climatology_celsius", "lst_anomaly_celsius", "lst_stress_z", 1)
SURFACE_WATER = Anomaly(
    "surface_water_frequency", "surface_water_climatology", "surface_water_anomaly", "surface_water_stress_z", -1
)


def anomaly_z(df: DataFrame, streams: list[Anomaly], spec: PanelSpec) -> DataFrame:
    """Train climatology per (entity, calendar month), anomaly, and anomaly divided by its train deviation.

    All streams share two window operators. Both cluster by the entity, which is the panel's partitioning,
    so no shuffle is added. The z-score is not re-centred.
    """
    train = _in_train(spec)
    by_month = Window.partitionBy(spec.entity, "month")
    by_entity = Window.partitionBy(spec.entity)
    return (
        df.withColumns({s.climatology: F.avg(F.when(train, F.col(s.value))).over(by_month) for s in streams})
        .withColumns({s.anomaly: F.col(s.value) - F.col(s.climatology) for s in streams})
        .withColumns(
            {
                s.z: float(s.sign) * F.col(s.anomaly)
                / guarded_std(F.stddev_pop(F.when(train, F.col(s.anomaly))).over(by_entity))
                for s in streams
            }
        )
    )


def centred_z(df: DataFrame, value: str, z: str, spec: PanelSpec) -> DataFrame:
    """(value - train mean) / train deviation per entity; an entity unseen in training keeps its value."""
    train = _in_train(spec)
    by_entity = Window.partitionBy(spec.entity)
    mean = F.coalesce(F.avg(F.when(train, F.col(value))).over(by_entity), F.lit(0.0))
    std = guarded_std(F.stddev_pop(F.when(train, F.col(value))).over(by_entity))
    return df.withColumn(z, (F.col(value) - mean) / std)


def fit_climatology(df: DataFrame, value: str, spec: PanelSpec, name: str = "climatology") -> DataFrame:
    """Train climatology as a statistics table (entity, month, mean)."""
    return (
        df.where(_in_train(spec) & F.col(value).isNotNull())
        .groupBy(spec.entity, "month")
        .agg(F.avg(value).alias(name))
    )


def fit_z_parameters(df: DataFrame, value: str, spec: PanelSpec) -> DataFrame:
    """Train mean and guarded population deviation per entity, as a statistics table."""
    return (
        df.where(_in_train(spec))
        .groupBy(spec.entity)
        .agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("_std"))
        .withColumn("std", guarded_std(F.col("_std")))
        .drop("_std")
    )


def soil_features(df: DataFrame, spec: PanelSpec) -> DataFrame:
    return anomaly_z(df, [SOIL], spec)


def vegetation_features(df: DataFrame, spec: PanelSpec) -> DataFrame:
    return anomaly_z(df, [VEGETATION], spec)


def temperature_features(df: DataFrame, spec: PanelSpec) -> DataFrame:
    return anomaly_z(df, [TEMPERATURE], spec)


def lag_surface_water(stream: DataFrame, spec: PanelSpec, use_lag: bool | None = None) -> DataFrame:
    """Keep the raw frequency and, on request, use the previous row's value instead.

    Runs on the stream before it meets the calendar, as the lag counts stream rows.
    """
    out = stream.withColumn("surface_water_frequency_raw", F.col("surface_water_frequency"))
    if spec.water_lag if use_lag is None else use_lag:
        previous = F.lag("surface_water_frequency_raw", 1).over(
            Window.partitionBy(spec.entity).orderBy(spec.date)
        )
        out = out.withColumn("surface_water_frequency", previous)
    return out


def fall_back_to_raw(df: DataFrame) -> DataFrame:
    """A missing lagged frequency takes the raw one; expects the columns of :func:`lag_surface_water`."""
    return df.withColumn(
        "surface_water_frequency", F.coalesce("surface_water_frequency", "surface_water_frequency_raw")
    )


def surface_water_features(df: DataFrame, spec: PanelSpec) -> DataFrame:
    return anomaly_z(fall_back_to_raw(df), [SURFACE_WATER], spec)
