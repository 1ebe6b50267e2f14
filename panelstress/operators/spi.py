"""Standardised precipitation index: rolling sums, gamma fit, normal score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelstress.functions.special import gamma_cdf, gamma_shape_mle, normal_cdf, normal_quantile
from panelstress.operators.anomaly import centred_z
from panelstress.spec import PROBABILITY_CLIP, ZERO_RAIN, PanelSpec

_MIN_POSITIVES = 3
_DEGENERATE_GAP = 1e-12


def rolling_sum(df: DataFrame, value: str, out: str, spec: PanelSpec, window: int = 3) -> DataFrame:
    """Sum of the current and previous rows of the entity; NULL unless all of them carry a value."""
    w = Window.partitionBy(spec.entity).orderBy(spec.date).rowsBetween(-(window - 1), 0)
    return df.withColumn(out, F.when(F.count(value).over(w) == window, F.sum(value).over(w)))


def fit_gamma(df: DataFrame, value: str, spec: PanelSpec, start: str | None = None, end: str | None = None) -> DataFrame:
    """Zero share and gamma parameters per (entity, month) over the calibration period.

    Only counts, means and mean logarithms leave the scan; the likelihood equation is solved by
    column expressions on that small table.
    """
    x = F.col(value)
    wet = x > ZERO_RAIN
    stats = (
        df.where(
            (F.col(spec.date) >= F.lit(start or spec.calibration_start).cast("date"))
            & (F.col(spec.date) <= F.lit(end or spec.train_end).cast("date"))
        )
        .groupBy(spec.entity, "month")
        .agg(
            F.count(x).alias("n_samples"),
            F.count(F.when(~wet, 1)).alias("n_zeros"),
            F.avg(x).alias("_mean_all"),
            F.avg(F.when(wet, x)).alias("_mean"),
            F.avg(F.when(wet, F.ln(x))).alias("_mean_log"),
        )
    )
    gap = F.ln("_mean") - F.col("_mean_log")
    fitted = (F.col("n_samples") - F.col("n_zeros") >= _MIN_POSITIVES) & (gap > _DEGENERATE_GAP)
    return (
        stats.withColumn("q", F.when(F.col("n_samples") > 0, F.col("n_zeros") / F.col("n_samples")).otherwise(0.0))
        .withColumn("alpha", F.when(fitted, gamma_shape_mle(gap)).otherwise(F.lit(1.0)))
        .withColumn(
            "scale",
            F.when(F.col("n_samples") == 0, F.lit(1.0))
            .when(fitted, F.col("_mean") / F.col("alpha"))
            .otherwise(F.greatest(F.col("_mean_all"), F.lit(1.0))),
        )
        .select(spec.entity, "month", "q", "alpha", "scale", "n_samples", "n_zeros")
    )


def mixed_probability(x: Column, q: Column, alpha: Column, scale: Column) -> Column:
    """Clipped distribution function with a point mass at zero."""
    h = F.when(x <= ZERO_RAIN, q).otherwise(q + (1.0 - q) * gamma_cdf(x / scale, alpha))
    return F.when(x.isNotNull(), F.greatest(F.lit(PROBABILITY_CLIP), F.least(h, F.lit(1.0 - PROBABILITY_CLIP))))


def add_spi(df: DataFrame, value: str, params: DataFrame, spec: PanelSpec) -> DataFrame:
    """Adds ``spi_probability`` and ``spi_3``; parameters are packed per entity, so the join key is the entity."""
    profile = params.groupBy(spec.entity).agg(
        F.map_from_entries(
            F.collect_list(F.struct("month", F.struct("q", "alpha", "scale")))
        ).alias("_gamma")
    )
    p = F.try_element_at("_gamma", F.col("month"))
    joined = (
        df.join(profile, spec.entity, "left")
        .withColumn("_q", F.coalesce(p["q"], F.lit(0.0)))
        .withColumn("_a", F.coalesce(p["alpha"], F.lit(1.0)))
        .withColumn("_s", F.coalesce(p["scale"], F.lit(1.0)))
    )
    return (
        joined.withColumn(
            "spi_probability", mixed_probability(F.col(value), F.col("_q"), F.col("_a"), F.col("_s"))
        )
        .withColumn("spi_3", normal_quantile(F.col("spi_probability")))
        .drop("_gamma", "_q", "_a", "_s")
    )


def add_spi_stress(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Dry is positive: stress is the negated index, centred and scaled on training rows."""
    return centred_z(df.withColumn("spi_stress", -F.col("spi_3")), "spi_stress", "spi_stress_z", spec)


def spi_round_trip(df: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """One row: the largest gap between Phi(spi) and the probability it came from."""
    gap = F.max(F.abs(normal_cdf(F.col("spi_3")) - F.col("spi_probability")))
    return df.agg(F.count("spi_3").alias("n_values"), F.coalesce(gap, F.lit(0.0)).alias("max_gap")).select(
        "n_values", "max_gap", (F.col("max_gap") < tolerance).alias("passed")
    )
