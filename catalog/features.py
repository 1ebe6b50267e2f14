"""Stress features, wells, index and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import base, forecast_ctes  # noqa: F401 - defines CTEs
from catalog.base import SPEC, cte, query, r, rs
from catalog.ctes import END, START, TRAIN_END, VAL_END, classify, normal_cdf
from catalog.forecast_ctes import ORIGIN_CASE
from panelstress.functions.numeric import classify as classify_column
from panelstress.operators import anomaly, audit, calendar, index, spi, wells
from panelstress.plans import panel as panel_plan
from panelstress.plans import proxy
from panelstress.session import materialize
from panelstress.spec import COMPONENTS


def grid(spark, sf_dir):
    return calendar.build_calendar(proxy.suppliers(spark, sf_dir), SPEC)


def on_calendar(spark, sf_dir, imputed=False):
    h = base.history(spark, sf_dir)
    h = panel_plan.impute_streams(h, SPEC) if imputed else h
    return h.where(F.col("date").between(SPEC.start, SPEC.end))


@query("d1_rolling_sum", f"SELECT entity, date, {rs('rainfall_3m_mm')} FROM c_prep")
def d1(spark, sf_dir):
    return spi.rolling_sum(proxy.history(spark, sf_dir), "rainfall_mm", "rainfall_3m_mm", SPEC).select(
        "entity", "date", "rainfall_3m_mm"
    )


@query("d2_gamma_fit", f"SELECT entity, month, {rs('q', 'alpha', 'scale', digits=5)}, n_samples, n_zeros FROM c_gamma", digits=5)
def d2(spark, sf_dir):
    return spi.fit_gamma(base.history(spark, sf_dir), "rainfall_3m_mm", SPEC)


def spi_rows(spark, sf_dir):
    gamma = spi.fit_gamma(base.history(spark, sf_dir), "rainfall_3m_mm", SPEC)
    return spi.add_spi(on_calendar(spark, sf_dir), "rainfall_3m_mm", gamma, SPEC)


@query("d3_spi", f"SELECT entity, date, {r('x')} AS rainfall_3m_mm, {r('h')} AS spi_probability, {r('spi_3')} AS spi_3 FROM c_spi")
def d3(spark, sf_dir):
    return spi_rows(spark, sf_dir).select("entity", "date", "rainfall_3m_mm", "spi_probability", "spi_3")


@query("d4_spi_round_trip", f"""
SELECT count(spi_3) AS n_values, {r(f'max(abs({normal_cdf("spi_3")} - h))')} AS max_gap,
  max(abs({normal_cdf('spi_3')} - h)) < 1e-6 AS passed FROM c_spi
""")
def d4(spark, sf_dir):
    return spi.spi_round_trip(spi_rows(spark, sf_dir))


@query("d5_spi_stress", f"SELECT entity, date, {rs('spi_stress', 'spi_stress_z')} FROM c_spi_z")
def d5(spark, sf_dir):
    return spi.add_spi_stress(spi_rows(spark, sf_dir), SPEC).select("entity", "date", "spi_stress", "spi_stress_z")


@query("d6_climatology", f"""
SELECT entity, month, {r('avg(lst_celsius)')} AS climatology FROM c_imp WHERE date BETWEEN {START} AND {TRAIN_END} GROUP BY entity, month
""")
def d6(spark, sf_dir):
    return anomaly.fit_climatology(on_calendar(spark, sf_dir, True), "lst_celsius", SPEC)


@query("d7_anomaly", f"SELECT entity, date, {rs('lst_climatology_celsius', 'lst_anomaly_celsius')} FROM c_lst_z")
def d7(spark, sf_dir):
    return anomaly.temperature_features(on_calendar(spark, sf_dir, True), SPEC).select(
        "entity", "date", "lst_climatology_celsius", "lst_anomaly_celsius"
    )


def _feature(name, table, feature, columns, imputed):
    @query(name, f"SELECT entity, date, {rs(*columns)} FROM {table}")
    def run(spark, sf_dir):
        return feature(on_calendar(spark, sf_dir, imputed), SPEC).select("entity", "date", *columns)


_feature("d8_soil_features", "c_soil_z", anomaly.soil_features,
         ["soil_water_climatology_mm", "soil_water_anomaly_mm", "soil_stress_z"], False)
_feature("d9_vegetation_features", "c_ndvi_z", anomaly.vegetation_features,
         ["ndvi_climatology", "ndvi_anomaly", "ndvi_stress_z"], True)
_feature("d10_temperature_features", "c_lst_z", anomaly.temperature_features,
         ["lst_climatology_celsius", "lst_anomaly_celsius", "lst_stress_z"], True)


@query("d11_surface_water_lagged", f"""
SELECT entity, date, {rs('surface_water_frequency_raw', 'surface_water_frequency', 'surface_water_climatology', 'surface_water_anomaly', 'surface_water_stress_z')}
FROM c_waterlag_z
""")
def d11(spark, sf_dir):
    lagged = anomaly.lag_surface_water(proxy.history(spark, sf_dir), SPEC, use_lag=True)
    rows = lagged.where(F.col("date").between(SPEC.start, SPEC.end))
    return anomaly.surface_water_features(rows, SPEC).select(
        "entity", "date", "surface_water_frequency_raw", "surface_water_frequency", "surface_water_climatology",
        "surface_water_anomaly", "surface_water_stress_z",
    )


@query("d12_well_aggregates", f"""
SELECT entity, obs_date, n_wells, {rs('median_depth_m_bgl', 'mean_depth_m_bgl', 'std_depth_m_bgl', 'iqr_depth_m_bgl')}, year, month, is_qualifying FROM c_wagg
""")
def d12(spark, sf_dir):
    return proxy.well_aggregates(spark, sf_dir).select(
        "entity", "obs_date", "n_wells", "median_depth_m_bgl", "mean_depth_m_bgl", "std_depth_m_bgl", "iqr_depth_m_bgl", "year",
        "month", "is_qualifying",
    )


@query("d13_well_climatology", f"SELECT entity, month, {rs('mean_depth')} FROM c_wclim")
def d13(spark, sf_dir):
    return wells.fit_well_climatology(base.well_aggregates(spark, sf_dir), SPEC)


def well_inputs(spark, sf_dir):
    agg = base.well_aggregates(spark, sf_dir)
    return agg, wells.fit_well_climatology(agg, SPEC)


@query("d14_observation_anomaly", f"SELECT entity, obs_date, {rs('obs_climatology', 'obs_anomaly')} FROM c_wanom")
def d14(spark, sf_dir):
    agg, clim = well_inputs(spark, sf_dir)
    return wells.observation_anomaly(agg, clim, SPEC).select("entity", "obs_date", "obs_climatology", "obs_anomaly")


def carried(spark, sf_dir):
    agg, clim = well_inputs(spark, sf_dir)
    return wells.carry_observations(grid(spark, sf_dir), agg, clim, SPEC)


@query("d15_carried_observation", f"""
SELECT entity, date, last_gw_obs_date, {rs('groundwater_as_of_depth_m_bgl', 'groundwater_climatology_m_bgl', 'groundwater_anomaly_m_bgl')} FROM c_wcarry
""")
def d15(spark, sf_dir):
    return carried(spark, sf_dir).select(
        "entity", "date", "last_gw_obs_date", "groundwater_as_of_depth_m_bgl", "groundwater_climatology_m_bgl",
        "groundwater_anomaly_m_bgl",
    )


@query("d16_staleness", "SELECT entity, date, months_since_last_gw_obs, groundwater_stale_flag FROM c_gw_z")
def d16(spark, sf_dir):
    return carried(spark, sf_dir).select("entity", "date", "months_since_last_gw_obs", "groundwater_stale_flag")


@query("d17_same_month_audit", f"""
SELECT entity, date, {rs('groundwater_depth_m_bgl_raw')}, groundwater_n_wells, groundwater_is_qualifying, groundwater_low_sample_flag FROM c_wcarry
""")
def d17(spark, sf_dir):
    return carried(spark, sf_dir).select(
        "entity", "date", "groundwater_depth_m_bgl_raw", "groundwater_n_wells", "groundwater_is_qualifying",
        "groundwater_low_sample_flag",
    )


@query("d18_as_of_z", f"SELECT entity, date, {rs('groundwater_stress_z')} FROM c_gw_z")
def d18(spark, sf_dir):
    agg, clim = well_inputs(spark, sf_dir)
    return wells.well_features(grid(spark, sf_dir), agg, clim, SPEC).select("entity", "date", "groundwater_stress_z")


cte("c_cov", f"""
SELECT *, CASE WHEN q THEN 0 WHEN prev IS NULL THEN 1 ELSE rn - prev END AS age, CASE WHEN q THEN rn - 1 - coalesce(prev, 0) END AS gap FROM (
  SELECT *, max(CASE WHEN q THEN rn END) OVER (PARTITION BY entity, t ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM (
    SELECT c.entity, c.date, t, coalesce(n_wells >= t, false) AS q, row_number() OVER (PARTITION BY c.entity, t ORDER BY c.date) AS rn
    FROM c_cal c LEFT JOIN c_wagg w ON w.entity = c.entity AND w.obs_date = c.date, unnest({list(SPEC.well_thresholds)}) u(t)))
""")
_COVERAGE = f"""count(*) AS total_months, count(*) FILTER (WHERE q) AS qualifying_count, count(*) FILTER (WHERE NOT q) AS low_sample_or_missing_count,
  {r('100.0 * count(*) FILTER (WHERE NOT q) / count(*)')} AS pct_non_qualifying, CAST(coalesce(max(gap), 0) AS INTEGER) AS max_gap_months, {r('avg(age)')} AS mean_age_months"""


@query("d19_well_coverage", f"""
SELECT entity, {_COVERAGE}, CAST({SPEC.min_wells} AS INTEGER) AS min_wells_threshold FROM c_cov WHERE t = {SPEC.min_wells}
GROUP BY GROUPING SETS ((entity), ())
""")
def d19(spark, sf_dir):
    return wells.well_coverage(grid(spark, sf_dir), base.well_aggregates(spark, sf_dir), SPEC)


@query("d20_well_sensitivity", f"SELECT CAST(t AS INTEGER) AS min_wells_threshold, {_COVERAGE} FROM c_cov GROUP BY t")
def d20(spark, sf_dir):
    return wells.well_sensitivity(grid(spark, sf_dir), base.well_aggregates(spark, sf_dir), SPEC)


# Columns of the master panel.
_MASTER = [
    "rainfall_mm", "rainfall_3m_mm", "spi_3", "spi_stress", *COMPONENTS, *proxy.SOIL_LAYERS, "soil_water_storage_mm",
    "soil_water_climatology_mm", "soil_water_anomaly_mm", "ndvi_raw", "ndvi", "ndvi_climatology", "ndvi_anomaly",
    "lst_raw", "lst_celsius", "lst_climatology_celsius", "lst_anomaly_celsius", "groundwater_depth_m_bgl_raw",
    "groundwater_as_of_depth_m_bgl", "groundwater_climatology_m_bgl", "groundwater_anomaly_m_bgl",
    "surface_water_frequency_raw", "surface_water_frequency", "surface_water_climatology", "surface_water_anomaly",
]
_MASTER_PLAIN = [
    "entity", "date", "year", "month", "split", "ndvi_artifact_masked", "ndvi_imputed", "lst_imputed", "groundwater_n_wells",
    "groundwater_is_qualifying", "groundwater_low_sample_flag", "months_since_last_gw_obs", "last_gw_obs_date",
    "groundwater_stale_flag", "valid_pixels",
]


@query("d21_master_panel", f"SELECT {', '.join(_MASTER_PLAIN)}, {rs(*_MASTER)}, {rs('wsi')}, wsi_category FROM c_panel")
def d21(spark, sf_dir):
    """The whole panel from the raw tables: two written stages that several fits read, then one plan."""
    h = materialize(
        panel_plan.prepare_history(proxy.history(spark, sf_dir), SPEC, proxy.artifact_rules(spark, sf_dir)), "history"
    )
    agg = materialize(proxy.well_aggregates(spark, sf_dir), "wells")
    clim = wells.fit_well_climatology(agg, SPEC)
    return panel_plan.build_panel(h, agg, clim, SPEC).select(*_MASTER_PLAIN, *_MASTER, "wsi", "wsi_category")


@query("d22_index", f"SELECT entity, date, {rs('wsi')}, wsi_category FROM c_panel")
def d22(spark, sf_dir):
    p = base.panel(spark, sf_dir).select("entity", "date", *COMPONENTS)
    return index.add_index(p, SPEC).select("entity", "date", "wsi", "wsi_category")


@query("d23_classes", f"SELECT {classify('c_acctbal / 1000.0')} AS class, count(*) AS n FROM customer GROUP BY ALL")
def d23(spark, sf_dir):
    rows = proxy.table(spark, sf_dir, "customer").select((F.col("c_acctbal") / 1000.0).alias("v"))
    return rows.groupBy(classify_column("v").alias("class")).agg(F.count(F.lit(1)).alias("n"))


# ---- audits ----------------------------------------------------------------------------------

cte("c_audit_calendar", f"""
SELECT count(*) AS total_rows, count(DISTINCT p.date) AS unique_dates, count(*) - count(DISTINCT (p.entity, p.date)) AS duplicate_keys,
  (SELECT count(*) FROM c_cal c ANTI JOIN c_panel q ON q.entity = c.entity AND q.date = c.date) AS missing_keys,
  (SELECT count(*) FROM c_panel q ANTI JOIN c_cal c ON q.entity = c.entity AND q.date = c.date) AS unexpected_keys,
  min(p.date) AS min_date, max(p.date) AS max_date FROM c_panel p
""")
cte("c_audit_origins", f"""
SELECT count(*) FILTER (WHERE date <= {TRAIN_END}) AS train_rows, count(*) FILTER (WHERE date > {TRAIN_END} AND date <= {VAL_END}) AS validation_rows,
  count(*) FILTER (WHERE date > {VAL_END}) AS test_rows,
  count(*) FILTER (WHERE (o = 'train' AND date + INTERVAL 3 MONTH > {TRAIN_END}) OR (o = 'val' AND date + INTERVAL 3 MONTH > {VAL_END})
    OR (o = 'test' AND date + INTERVAL 3 MONTH > {END})) AS leaking_origins,
  max(date) FILTER (WHERE o = 'train') AS last_train_origin, min(date) FILTER (WHERE o = 'val') AS first_val_origin,
  min(date) FILTER (WHERE o = 'test') AS first_test_origin
FROM (SELECT date, {ORIGIN_CASE.replace('forecast_origin', 'date')} AS o FROM c_panel)
""")
cte("c_audit_wells", f"""
SELECT count(*) FILTER (WHERE last_gw_obs_date > date) AS future_observations, count(*) FILTER (WHERE months_since_last_gw_obs < 0) AS negative_ages,
  count(*) FILTER (WHERE (months_since_last_gw_obs > {SPEC.stale_months}) <> (groundwater_stale_flag = 1)) AS stale_mismatches
FROM c_panel WHERE last_gw_obs_date IS NOT NULL
""")


def unpivoted(check: str, passed: str, measures: list[str], source: str) -> str:
    names = ", ".join(f"'{m}'" for m in measures)
    values = ", ".join(f"CAST({m} AS VARCHAR)" for m in measures)
    return f"""SELECT '{check}' AS "check", {passed} AS passed, unnest([{names}]) AS measure, unnest([{values}]) AS value FROM {source}"""


@query("e1_calendar_and_shape", unpivoted(
    "calendar_and_shape", "missing_keys = 0 AND unexpected_keys = 0 AND duplicate_keys = 0",
    ["total_rows", "unique_dates", "duplicate_keys", "missing_keys", "unexpected_keys", "min_date", "max_date"], "c_audit_calendar"))
def e1(spark, sf_dir):
    return audit.measures_long(audit.calendar_and_shape(base.panel(spark, sf_dir), grid(spark, sf_dir), SPEC))


_REQUIRED = ["ndvi_raw", "lst_raw", *COMPONENTS, "groundwater_stale_flag", "months_since_last_gw_obs", "wsi"]


@query("e2_zero_nulls", unpivoted(
    "zero_nulls_in_required_cols", "total_nulls = 0", [*_REQUIRED, "total_nulls"],
    f"(SELECT *, {' + '.join(_REQUIRED)} AS total_nulls FROM (SELECT {', '.join(f'count(*) - count({c}) AS {c}' for c in _REQUIRED)} FROM c_panel))"))
def e2(spark, sf_dir):
    return audit.measures_long(audit.zero_nulls(base.panel(spark, sf_dir), _REQUIRED))


@query("e3_index_exactness", f"""
SELECT 'wsi_mathematical_exactness' AS "check", max(abs(wsi - ({' + '.join(COMPONENTS)}) / 6.0)) <= 1e-12 AS passed FROM c_panel
""")
def e3(spark, sf_dir):
    return audit.index_exactness(base.panel(spark, sf_dir), SPEC).select("check", "passed")


@query("e4_origin_splits", unpivoted(
    "forecast_origin_splits", "leaking_origins = 0",
    ["train_rows", "validation_rows", "test_rows", "leaking_origins", "last_train_origin", "first_val_origin", "first_test_origin"],
    "c_audit_origins"))
def e4(spark, sf_dir):
    return audit.measures_long(audit.origin_splits(base.panel(spark, sf_dir), SPEC))


@query("e5_well_causality", unpivoted(
    "groundwater_causality_and_staleness", "future_observations = 0 AND negative_ages = 0 AND stale_mismatches = 0",
    ["future_observations", "negative_ages", "stale_mismatches"], "c_audit_wells"))
def e5(spark, sf_dir):
    return audit.measures_long(audit.groundwater_causality(base.panel(spark, sf_dir), SPEC))


@query("e6_expected_events", unpivoted(
    "historical_events", "missing_events = 0 AND below_threshold = 0", ["expected_events", "missing_events", "below_threshold"],
    f"""(SELECT count(*) AS expected_events, count(*) - count(p.wsi) AS missing_events, count(*) FILTER (WHERE p.wsi <= 0.5) AS below_threshold
    FROM (SELECT DISTINCT entity, CAST(date_trunc('month', l_shipdate) AS DATE) AS date FROM lineitem JOIN c_sup ON l_suppkey = s_suppkey
      WHERE l_quantity >= 50 AND l_returnflag = 'A') e LEFT JOIN c_panel p ON p.entity = e.entity AND p.date = e.date)"""))
def e6(spark, sf_dir):
    li = proxy.table(spark, sf_dir, "lineitem").where("l_quantity >= 50 AND l_returnflag = 'A'").select(
        "l_suppkey", F.trunc(F.col("l_shipdate").cast("date"), "MM").alias("date")
    ).distinct()
    events = li.join(proxy.suppliers(spark, sf_dir), F.col("l_suppkey") == F.col("s_suppkey")).select("entity", "date")
    return audit.measures_long(audit.historical_events(base.panel(spark, sf_dir), events, SPEC))


@query("e7_export_parity", unpivoted(
    "model_audit_parity", "mismatching_columns = 0 AND unmatched_keys = 0", ["shared_columns", "mismatching_columns", "mismatches", "unmatched_keys"],
    """(SELECT 15 AS shared_columns, count(*) FILTER (WHERE a.entity IS NULL OR m.entity IS NULL) AS unmatched_keys, CAST(max(abs(a.wsi - m.wsi)) > 1e-9 AS INTEGER) + CAST(count(*) FILTER (WHERE a.split <> m.split) > 0 AS INTEGER) AS mismatching_columns,
    CASE WHEN max(abs(a.wsi - m.wsi)) > 1e-9 THEN 'wsi' ELSE '' END AS mismatches FROM c_panel a
    FULL JOIN (SELECT entity, date, split, wsi + CASE WHEN wsi >= 1.5 THEN 1e-6 ELSE 0 END AS wsi FROM c_panel) m ON a.entity = m.entity AND a.date = m.date)"""))
def e7(spark, sf_dir):
    """The model export is altered in its most severe rows, which the check has to notice."""
    p = base.panel(spark, sf_dir)
    model = panel_plan.model_view(p, SPEC)
    altered = model.withColumn("wsi", F.col("wsi") + F.when(F.col("wsi") >= 1.5, 1e-6).otherwise(0.0))
    return audit.measures_long(audit.export_parity(p, altered, SPEC))


@query("e8_panel_contract", unpivoted(
    "panel_contract", "duplicate_keys = 0 AND non_finite_rows = 0 AND continuity_breaks = 0 AND wrong_start = 0 AND wrong_end = 0",
    ["total_rows", "entities", "duplicate_keys", "non_finite_rows", "continuity_breaks", "wrong_start", "wrong_end"],
    f"""(SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS entities, CAST(sum(n - d) AS BIGINT) AS duplicate_keys,
    CAST(sum(bad) AS BIGINT) AS non_finite_rows, CAST(sum(brk) AS BIGINT) AS continuity_breaks,
    count(*) FILTER (WHERE lo <> {START}) AS wrong_start, count(*) FILTER (WHERE hi <> {END}) AS wrong_end FROM (
      SELECT entity, count(*) AS n, count(DISTINCT date) AS d, count(*) FILTER (WHERE wsi IS NULL) AS bad,
        count(*) FILTER (WHERE dd NOT BETWEEN 28 AND 31) AS brk, min(date) AS lo, max(date) AS hi FROM (
        SELECT *, date_diff('day', lag(date) OVER (PARTITION BY entity ORDER BY date), date) AS dd FROM c_panel) GROUP BY entity))"""))
def e8(spark, sf_dir):
    return audit.measures_long(audit.panel_contract(base.panel(spark, sf_dir), [*COMPONENTS, "wsi"], SPEC))


cte("c_checks", f"""
SELECT 'calendar_and_shape' AS "check", missing_keys = 0 AND unexpected_keys = 0 AND duplicate_keys = 0 AS passed FROM c_audit_calendar
UNION ALL SELECT 'zero_nulls_in_required_cols', count(*) = count(wsi) FROM c_panel
UNION ALL SELECT 'wsi_mathematical_exactness', max(abs(wsi - ({' + '.join(COMPONENTS)}) / 6.0)) <= 1e-12 FROM c_panel
UNION ALL SELECT 'forecast_origin_splits', leaking_origins = 0 FROM c_audit_origins
UNION ALL SELECT 'groundwater_causality_and_staleness', future_observations = 0 AND negative_ages = 0 AND stale_mismatches = 0 FROM c_audit_wells
UNION ALL SELECT 'model_audit_parity', count(*) = count(DISTINCT (entity, date)) FROM c_panel
""")


@query("e9_full_suite", """SELECT "check", passed FROM c_checks UNION ALL SELECT 'overall', bool_and(passed) FROM c_checks""")
def e9(spark, sf_dir):
    p = base.panel(spark, sf_dir)
    return audit.full_suite(p, p, panel_plan.model_view(p, SPEC), SPEC, entities=proxy.suppliers(spark, sf_dir)).select(
        "check", "passed"
    )


def _canonical(column: str, kind: str) -> str:
    text = {"float": f"CAST(CAST(floor({column} * 1e6 + 0.5) AS BIGINT) AS VARCHAR)", "time": f"CAST(epoch_us({column}) AS VARCHAR)"}.get(kind, f"CAST({column} AS VARCHAR)")
    return f"coalesce(length({text}) || '=' || {text}, '~')"


_ROW = " || '|' || ".join(_canonical(c, k) for c, k in [
    *[(c, "int") for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")],
    *[(c, "float") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")], ("l_returnflag", "text"), ("l_linestatus", "text"), ("l_shipdate", "time"),
])
_BITS64 = 1 << 64


@query("e10_fingerprint", f"""
WITH d AS (
  SELECT CAST(floor(l_orderkey / {float(audit.LEAF_KEYS)}) AS BIGINT) AS node, md5({_ROW}) AS m FROM lineitem
), leaves AS (
  SELECT node, count(*) AS n, sum(CAST(CAST('0x' || substr(m, 1, 16) AS UBIGINT) AS HUGEINT)) % {_BITS64} AS a, sum(CAST(CAST('0x' || substr(m, 17, 16) AS UBIGINT) AS HUGEINT)) % {_BITS64} AS b FROM d GROUP BY node
), ends AS (
  SELECT min(node) AS lo, max(node) AS hi FROM leaves
), height AS (
  SELECT min(i) AS h FROM ends, range(1, 14) t(i) WHERE lo // (CAST({audit.FAN_OUT} AS HUGEINT) ** i)::BIGINT = hi // (CAST({audit.FAN_OUT} AS HUGEINT) ** i)::BIGINT
), up AS (
  SELECT CAST(level AS INTEGER) AS level, CASE WHEN level = h THEN 0 ELSE node // ({audit.FAN_OUT} ** level)::BIGINT END AS node, n, a, b FROM leaves, (SELECT h, unnest(range(0, h + 1)) AS level FROM height)
)
SELECT level, node, CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(a) % {_BITS64} AS VARCHAR) || ':' || CAST(sum(b) % {_BITS64} AS VARCHAR) AS content_hash FROM up GROUP BY level, node
""")
def e10(spark, sf_dir):
    """Tree of digests of the line items by ranges of the order key."""
    return audit.fingerprint(proxy.table(spark, sf_dir, "lineitem"), "l_orderkey")
