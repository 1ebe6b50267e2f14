"""Irregular well readings: monthly aggregates, causal carry, staleness and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelstress.functions.numeric import month_number
from panelstress.operators.anomaly import centred_z
from panelstress.operators.quantiles import counted_quantiles, counted_values
from panelstress.spec import DEFAULT_DEPTH, NEVER_OBSERVED_AGE, PanelSpec


def aggregate_wells(obs: DataFrame, level: str, spec: PanelSpec, min_wells: int | None = None) -> DataFrame:
    """Count, median, mean, deviation and interquartile range of the levels per (entity, month).

    Order statistics come from the quantile operator, which splits a month holding a large share of all wells.
    """
    keys = [spec.entity, "obs_date"]
    quantiles = {"median_depth_m_bgl": 0.5, "_p25": 0.25, "_p75": 0.75}
    values = counted_values(obs.where(F.col(level).isNotNull()), keys, level)
    return (
        counted_quantiles(values, keys, quantiles, moments=True)
        .withColumnsRenamed({"n": "n_wells", "mean": "mean_depth_m_bgl", "std": "std_depth_m_bgl"})
        .withColumn("iqr_depth_m_bgl", F.col("_p75") - F.col("_p25"))
        .withColumn("year", F.year("obs_date"))
        .withColumn("month", F.month("obs_date"))
        .withColumn("is_qualifying", F.col("n_wells") >= (spec.min_wells if min_wells is None else min_wells))
        .select(*keys, "n_wells", "median_depth_m_bgl", "mean_depth_m_bgl", "std_depth_m_bgl",
                "iqr_depth_m_bgl", "year", "month", "is_qualifying")
    )


def fit_well_climatology(agg: DataFrame, spec: PanelSpec) -> DataFrame:
    """(entity, month) and entity means of qualifying medians inside the training period, long form."""
    train = agg.where(
        F.col("is_qualifying")
        & F.col("obs_date").between(F.lit(spec.start).cast("date"), F.lit(spec.train_end).cast("date"))
    )
    return train.groupingSets(
        [[F.col(spec.entity), F.col("month")], [F.col(spec.entity)]], spec.entity, "month"
    ).agg(F.avg("median_depth_m_bgl").alias("mean_depth"))


def well_profile(climatology: DataFrame, spec: PanelSpec) -> DataFrame:
    """One row per entity: map month -> mean depth, and the overall mean."""
    return climatology.groupBy(spec.entity).agg(
        F.map_from_entries(
            F.collect_list(F.when(F.col("month").isNotNull(), F.struct("month", "mean_depth")))
        ).alias("_clim"),
        F.max(F.when(F.col("month").isNull(), F.col("mean_depth"))).alias("_overall"),
    )


def observation_anomaly(agg: DataFrame, climatology: DataFrame, spec: PanelSpec) -> DataFrame:
    """Depth against the month mean, else the entity mean, else itself; only qualifying rows carry one."""
    depth = F.col("median_depth_m_bgl")
    base = F.coalesce(F.try_element_at("_clim", F.col("month")), F.col("_overall"), depth)
    return (
        agg.join(well_profile(climatology, spec), spec.entity, "left")
        .withColumn("obs_climatology", F.when(F.col("is_qualifying"), base))
        .withColumn("obs_anomaly", depth - F.col("obs_climatology"))
        .drop("_clim", "_overall")
    )


def carry_observations(calendar: DataFrame, agg: DataFrame, climatology: DataFrame, spec: PanelSpec) -> DataFrame:
    """Each month takes the latest qualifying observation at or before it, also from before the calendar.

    Calendar and observations are merged on (entity, month) and carried by one ordered window per
    entity. A month is one row on either side, so the window is bounded by the length of history.
    """
    e, d = spec.entity, spec.date
    observed = observation_anomaly(agg, climatology, spec).select(
        e,
        F.col("obs_date").alias(d),
        F.col("n_wells").alias("_n"),
        F.col("median_depth_m_bgl").alias("_depth"),
        F.col("is_qualifying").alias("_q"),
        F.when(
            F.col("is_qualifying"),
            F.struct(
                F.col("obs_date").alias("obs"),
                F.col("median_depth_m_bgl").alias("depth"),
                F.col("obs_climatology").alias("climatology"),
                F.col("obs_anomaly").alias("anomaly"),
            ),
        ).alias("_obs"),
    )
    overall = climatology.where(F.col("month").isNull()).select(e, F.col("mean_depth").alias("_overall"))
    w = Window.partitionBy(e).orderBy(d).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = (
        calendar.withColumn("_cal", F.lit(True))
        .join(observed, [e, d], "full")
        .withColumn("_last", F.last("_obs", ignorenulls=True).over(w))
        .where("_cal")
        .join(overall, e, "left")
    )
    seen = F.col("_last").isNotNull()
    age = F.when(
        seen, F.greatest(F.lit(0), month_number(d) - month_number("_last.obs"))
    ).otherwise(NEVER_OBSERVED_AGE)
    unseen_depth = F.coalesce("_overall", F.lit(DEFAULT_DEPTH))
    n = F.coalesce("_n", F.lit(0))
    qualifying = F.coalesce(F.col("_q"), F.lit(False))
    return (
        carried.withColumn("groundwater_depth_m_bgl_raw", F.col("_depth"))
        .withColumn("groundwater_n_wells", n.cast("int"))
        .withColumn("groundwater_is_qualifying", qualifying.cast("int"))
        .withColumn("groundwater_low_sample_flag", (~qualifying & (n > 0)).cast("int"))
        .withColumn("groundwater_as_of_depth_m_bgl", F.when(seen, F.col("_last.depth")).otherwise(unseen_depth))
        .withColumn("groundwater_climatology_m_bgl", F.when(seen, F.col("_last.climatology")).otherwise(unseen_depth))
        .withColumn("groundwater_anomaly_m_bgl", F.when(seen, F.col("_last.anomaly")).otherwise(F.lit(0.0)))
        .withColumn("months_since_last_gw_obs", age.cast("int"))
        .withColumn("last_gw_obs_date", F.col("_last.obs"))
        .withColumn("groundwater_stale_flag", (F.col("months_since_last_gw_obs") > spec.stale_months).cast("int"))
        .drop("_cal", "_n", "_depth", "_q", "_obs", "_last", "_overall")
    )


def well_features(calendar: DataFrame, agg: DataFrame, climatology: DataFrame, spec: PanelSpec) -> DataFrame:
    """Carried observation, audit columns and the as-of z-score."""
    carried = carry_observations(calendar, agg, climatology, spec)
    return centred_z(carried, "groundwater_anomaly_m_bgl", "groundwater_stress_z", spec)


def _coverage_rows(calendar: DataFrame, agg: DataFrame, thresholds: list[int], spec: PanelSpec) -> DataFrame:
    """Calendar rows per threshold with age and the gap closed by a qualifying month.

    Before the first qualifying month the age is 1; a gap still open at the end is not counted.
    """
    e, d = spec.entity, spec.date
    counts = agg.select(e, F.col("obs_date").alias(d), "n_wells")
    rows = (
        calendar.select(e, d)
        .join(counts, [e, d], "left")
        .withColumn("min_wells_threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
        .withColumn("_q", F.coalesce(F.col("n_wells") >= F.col("min_wells_threshold"), F.lit(False)))
    )
    ordered = Window.partitionBy(e, "min_wells_threshold").orderBy(d)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("_rn", F.row_number().over(ordered))
        .withColumn("_prev", F.max(F.when(F.col("_q"), F.col("_rn"))).over(before))
        .withColumn(
            "_age",
            F.when(F.col("_q"), 0).when(F.col("_prev").isNull(), 1).otherwise(F.col("_rn") - F.col("_prev")),
        )
        .withColumn("_gap", F.when(F.col("_q"), F.col("_rn") - 1 - F.coalesce("_prev", F.lit(0))))
    )


def _coverage_measures() -> list:
    return [
        F.count(F.lit(1)).alias("total_months"),
        F.sum(F.col("_q").cast("long")).alias("qualifying_count"),
        F.sum((~F.col("_q")).cast("long")).alias("low_sample_or_missing_count"),
        (100.0 * F.sum((~F.col("_q")).cast("long")) / F.count(F.lit(1))).alias("pct_non_qualifying"),
        F.coalesce(F.max("_gap"), F.lit(0)).alias("max_gap_months"),
        F.avg("_age").alias("mean_age_months"),
    ]


def well_coverage(calendar: DataFrame, agg: DataFrame, spec: PanelSpec, min_wells: int | None = None) -> DataFrame:
    """Coverage per entity and, with a NULL entity, overall."""
    threshold = spec.min_wells if min_wells is None else min_wells
    rows = _coverage_rows(calendar, agg, [threshold], spec)
    per_entity = rows.groupBy(spec.entity).agg(*_coverage_measures())
    overall = rows.agg(*_coverage_measures()).select(F.lit(None).cast("string").alias(spec.entity), "*")
    return per_entity.unionByName(overall).withColumn("min_wells_threshold", F.lit(threshold))


def well_sensitivity(calendar: DataFrame, agg: DataFrame, spec: PanelSpec) -> DataFrame:
    """Overall coverage for several thresholds in one job; the aggregates do not depend on the threshold."""
    rows = _coverage_rows(calendar, agg, list(spec.well_thresholds), spec)
    return rows.groupBy("min_wells_threshold").agg(*_coverage_measures())
