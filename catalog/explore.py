"""Exploratory tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import base, features  # noqa: F401 - defines CTEs
from catalog.base import SPEC, cte, query, r, rs
from catalog.ctes import END, START, normal_cdf
from panelstress.operators import explore
from panelstress.plans import proxy

# name: (raw column, (lower, upper))
STREAMS = {
    "rainfall": ("rainfall_mm", (0.0, None)),
    "soil": ("soil_water_storage_mm", (0.0, None)),
    "ndvi": ("ndvi_raw", (-1.0, 0.5)),
    "lst": ("lst_raw", (0.0, 40.0)),
    "water": ("surface_water_frequency_raw", (0.0, 1.0)),
}
_SQL_RAW = {"ndvi_raw": "ndvi", "lst_raw": "lst_celsius", "surface_water_frequency_raw": "surface_water_frequency"}


def _sql(column: str) -> str:
    return _SQL_RAW.get(column, column)


def _audit_sql(name: str, column: str, bounds: tuple) -> str:
    c = _sql(column)
    bad = " OR ".join(f"{c} {op} {b}" for op, b in (("<", bounds[0]), (">", bounds[1])) if b is not None)
    return f"""SELECT '{name}' AS dataset, count(*) AS row_count, count(DISTINCT entity) AS entity_count, min(date) AS start_date, max(date) AS end_date,
  CAST(0 AS BIGINT) AS duplicate_keys, '{column}' AS target_col, count(*) - count({c}) AS missing_count, {r(f'100.0 * (count(*) - count({c})) / count(*)')} AS missing_pct,
  CAST(0 AS BIGINT) AS infinite_count, '' AS constant_columns, count(*) FILTER (WHERE {bad}) AS domain_violations FROM c_hist"""


@query("i1_quality_audit", " UNION ALL ".join(_audit_sql(n, c, b) for n, (c, b) in STREAMS.items()) + f"""
UNION ALL SELECT 'wells', CAST(sum(c) AS BIGINT), (SELECT count(DISTINCT l_suppkey) FROM lineitem), (SELECT CAST(min(l_shipdate) AS DATE) FROM lineitem), (SELECT CAST(max(l_shipdate) AS DATE) FROM lineitem),
  CAST(sum(c - 1) AS BIGINT), 'water_level_m_bgl', CAST(0 AS BIGINT), {r('0.0')}, CAST(0 AS BIGINT), 'agency', CAST(sum(bad) AS BIGINT)
FROM (SELECT count(*) AS c, count(*) FILTER (WHERE l_quantity > 49) AS bad FROM lineitem GROUP BY l_partkey, CAST(l_shipdate AS DATE))
""")
def i1(spark, sf_dir):
    h = base.history(spark, sf_dir)
    parts = [explore.quality_audit(h, n, c, "entity", "date", b) for n, (c, b) in STREAMS.items()]
    wells = proxy.well_readings(spark, sf_dir).withColumn("date", F.col("date").cast("date")).withColumn("agency", F.lit("survey"))
    parts.append(explore.quality_audit(
        wells, "wells", "water_level_m_bgl", "entity", "date", (0.0, 49.0), ["well_id", "date"], ["agency", "entity"]
    ))
    return explore.union_all(parts)


@query("i2_temporal_coverage", """
SELECT 'line items' AS dataset, min(m) AS earliest, max(m) AS latest, CAST(date_diff('month', min(m), max(m)) + 1 AS INTEGER) AS span_months,
  (date_diff('month', min(m), max(m)) + 1) * count(DISTINCT e) - count(*) AS missing_entity_months
FROM (SELECT DISTINCT l_suppkey AS e, CAST(date_trunc('month', l_shipdate) AS DATE) AS m FROM lineitem)
UNION ALL SELECT 'orders', min(m), max(m), CAST(date_diff('month', min(m), max(m)) + 1 AS INTEGER), (date_diff('month', min(m), max(m)) + 1) * count(DISTINCT e) - count(*)
FROM (SELECT DISTINCT o_custkey AS e, CAST(date_trunc('month', o_orderdate) AS DATE) AS m FROM orders)
""")
def i2(spark, sf_dir):
    li, orders = proxy.table(spark, sf_dir, "lineitem"), proxy.table(spark, sf_dir, "orders")
    return explore.union_all([
        explore.temporal_coverage(li, "line items", "l_suppkey", "l_shipdate"),
        explore.temporal_coverage(orders, "orders", "o_custkey", "o_orderdate"),
    ])


_COVERED = {"ndvi": "ndvi", "lst": "lst_celsius", "soil": "soil_water_layer_1", "surface_water": "surface_water_frequency"}


@query("i3_entity_coverage", f"""
SELECT h.entity, rainfall_total, rainfall_cp, ndvi_total, ndvi_cp, lst_total, lst_cp, soil_total, soil_cp, surface_water_total, surface_water_cp, gw_total_records, gw_unique_wells, gw_monitored_months, gw_cp_monitored_months, gw_blocks FROM (
  SELECT entity, count(*) AS rainfall_total, count(*) FILTER (WHERE date BETWEEN {START} AND {END}) AS rainfall_cp,
    {', '.join(f"count({c}) AS {n}_total, count({c}) FILTER (WHERE date BETWEEN {START} AND {END}) AS {n}_cp" for n, c in _COVERED.items())} FROM c_hist GROUP BY entity) h
JOIN (SELECT entity, count(*) AS gw_total_records, count(DISTINCT p_brand) AS gw_blocks, count(DISTINCT l_partkey) AS gw_unique_wells, count(DISTINCT date_trunc('month', l_shipdate)) AS gw_monitored_months,
  count(DISTINCT date_trunc('month', l_shipdate)) FILTER (WHERE CAST(date_trunc('month', l_shipdate) AS DATE) BETWEEN {START} AND {END}) AS gw_cp_monitored_months
  FROM lineitem JOIN c_sup ON l_suppkey = s_suppkey JOIN part ON p_partkey = l_partkey GROUP BY entity) w ON w.entity = h.entity
""")
def i3(spark, sf_dir):
    h = base.history(spark, sf_dir)
    present = {"ndvi": "ndvi_raw", "lst": "lst_raw", "soil": "soil_water_layer_1", "surface_water": "surface_water_frequency_raw"}
    streams = {"rainfall": h, **{name: h.where(F.col(c).isNotNull()) for name, c in present.items()}}
    blocks = proxy.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("well_id"), F.col("p_brand").alias("block"))
    readings = proxy.well_readings(spark, sf_dir).join(blocks, "well_id")
    return explore.entity_coverage(streams, readings, "well_id", SPEC, block="block")


@query("i4_missingness", """
SELECT entity, month, count(*) - count(rainfall_mm) AS rainfall_missing, count(*) - count(ndvi) AS ndvi_missing, count(*) - count(lst_celsius) AS lst_missing,
  count(*) - count(soil_water_layer_1) AS soil_missing, count(*) - count(surface_water_frequency) AS surface_water_missing,
  5 * count(*) - count(rainfall_mm) - count(ndvi) - count(lst_celsius) - count(soil_water_layer_1) - count(surface_water_frequency) AS total_missing FROM c_hist GROUP BY entity, month
""")
def i4(spark, sf_dir):
    return explore.missingness(base.history(spark, sf_dir), {
        "rainfall": "rainfall_mm", "ndvi": "ndvi_raw", "lst": "lst_raw", "soil": "soil_water_layer_1", "surface_water": "surface_water_frequency_raw"
    }, SPEC)


_STAT_COLUMNS = ["rainfall_mm", "soil_water_storage_mm", "ndvi_raw", "lst_raw", "surface_water_frequency"]
cte("c_long", " UNION ALL ".join(f"SELECT entity, date, month, '{c}' AS variable, {_sql(c)} AS value FROM c_hist" for c in _STAT_COLUMNS) + """
UNION ALL SELECT entity, CAST(l_shipdate AS DATE), CAST(month(l_shipdate) AS INTEGER), 'water_level_m_bgl', l_quantity FROM lineitem JOIN c_sup ON l_suppkey = s_suppkey
""")


def long_history(spark, sf_dir):
    """The monthly streams and every raw reading: the one variable that grows with the observations."""
    monthly = explore.to_long(base.history(spark, sf_dir), _STAT_COLUMNS, ["entity", "date", "month"])
    readings = proxy.well_readings(spark, sf_dir).select("entity", F.col("date").cast("date").alias("date"), F.month("date").alias("month"), "water_level_m_bgl")
    return monthly.unionByName(explore.to_long(readings, ["water_level_m_bgl"], ["entity", "date", "month"]))


@query("i5_summary_statistics", f"""
SELECT variable, count(value) AS count, count(*) - count(value) AS missing_count, {r('100.0 * (count(*) - count(value)) / count(*)', 5)} AS missing_pct, {r('avg(value)', 5)} AS mean,
  {r('stddev_samp(value)', 5)} AS std, {r('min(value)', 5)} AS min, {r('max(value)', 5)} AS max, {r('100.0 * count(*) FILTER (WHERE value = 0) / count(value)', 5)} AS zero_frequency,
  {', '.join(f"{r(f'quantile_cont(value, {p})', 5)} AS {n}" for n, p in explore.SUMMARY_QUANTILES.items())} FROM c_long GROUP BY variable
""", digits=5)
def i5(spark, sf_dir):
    return explore.summary_statistics(long_history(spark, sf_dir))


@query("i6_monthly_climatology", f"SELECT entity, month, variable, {r('avg(value)', 5)} AS mean, {r('median(value)', 5)} AS median FROM c_long GROUP BY GROUPING SETS ((entity, month, variable), (month, variable))", digits=5)
def i6(spark, sf_dir):
    return explore.monthly_climatology(long_history(spark, sf_dir), SPEC)


@query("i7_outliers", f"""
SELECT entity, date, variable, {rs('value')}, abs(value - m) > 3.0 * sd AS beyond_sigma, value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1) AS outside_fences
FROM c_long JOIN (SELECT variable, avg(value) AS m, stddev_samp(value) AS sd, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM c_long GROUP BY variable) USING (variable)
WHERE abs(value - m) > 3.0 * sd OR value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)
""")
def i7(spark, sf_dir):
    return explore.outliers(long_history(spark, sf_dir), ["entity", "date"])


_CORR = {"Rainfall": "rainfall_mm", "SPI": "spi_3", "Soil": "soil_water_storage_mm", "NDVI": "ndvi", "LST": "lst_celsius",
         "Water": "surface_water_frequency", "Depth": "groundwater_depth_m_bgl_raw"}


@query("i8_correlation_matrix", " UNION ALL ".join(
    f"SELECT '{a}' AS variable, {', '.join((r('1.0', 5) if a == b else r(f'corr({x}, {y})', 5)) + f' AS {b}' for b, y in _CORR.items())} FROM c_panel"
    for a, x in _CORR.items()), digits=5)
def i8(spark, sf_dir):
    return explore.correlation_matrix(base.panel(spark, sf_dir), _CORR)


_LAGS = list(range(-3, 7))
_RESPONSES = ["soil_water_storage_mm", "ndvi", "lst_celsius", "surface_water_frequency", "groundwater_as_of_depth_m_bgl"]
_LAG_COLUMNS = ", ".join(f"lead({v}, {k}) OVER w AS r{i}_{j}" for i, v in enumerate(_RESPONSES) for j, k in enumerate(_LAGS))
_LAG_CORR = ", ".join(f"corr(spi_3, r{i}_{j})" for i in range(len(_RESPONSES)) for j in range(len(_LAGS)))


@query("i9_lag_correlations", f"""
SELECT entity, response_variable, CAST(lag_k AS INTEGER) AS lag_k, {r('c', 5)} AS correlation FROM (
  SELECT entity, unnest([{', '.join(f"'{v}'" for v in _RESPONSES for _ in _LAGS)}]) AS response_variable, unnest([{', '.join(str(k) for _ in _RESPONSES for k in _LAGS)}]) AS lag_k,
    unnest([{_LAG_CORR}]) AS c FROM (SELECT entity, spi_3, {_LAG_COLUMNS} FROM c_panel WINDOW w AS (PARTITION BY entity ORDER BY date)) GROUP BY GROUPING SETS ((entity), ()))
""", digits=5)
def i9(spark, sf_dir):
    return explore.lag_correlations(base.panel(spark, sf_dir), "spi_3", _RESPONSES, _LAGS, SPEC)


_TREND = list(_STAT_COLUMNS)
cte("c_year", f"""
SELECT variable, entity, CAST(year(date) AS INTEGER) AS y, avg(value) AS v FROM c_long WHERE variable IN ({', '.join(f"'{c}'" for c in _TREND)}) GROUP BY ALL HAVING count(value) > 0
""")
cte("c_slopes", """
SELECT a.variable, a.entity, median((b.v - a.v) / (b.y - a.y)) AS slope, sum(sign((b.v - a.v) / (b.y - a.y))) AS s
FROM c_year a JOIN c_year b ON b.variable = a.variable AND b.entity = a.entity AND b.y > a.y GROUP BY ALL
""")
cte("c_ties", """
SELECT variable, entity, sum(t * (t - 1.0) * (2.0 * t + 5.0)) AS ties FROM (SELECT variable, entity, v, count(*) AS t FROM c_year GROUP BY ALL) GROUP BY ALL
""")
cte("c_trend", """
SELECT *, CASE WHEN var > 0 THEN (s - sign(s)) / sqrt(CASE WHEN var > 0 THEN var END) ELSE 0.0 END AS z FROM (
  SELECT *, (n * (n - 1.0) * (2.0 * n + 5.0) - ties) / 18.0 AS var FROM (
    SELECT variable, entity, min(y) AS start_year, max(y) AS end_year, CAST(count(*) AS DOUBLE) AS n FROM c_year GROUP BY ALL)
  JOIN c_slopes USING (variable, entity) JOIN c_ties USING (variable, entity))
""")


@query("i10_trends", f"""
SELECT variable, entity, start_year, end_year, CAST(n AS INTEGER) AS years_count, {r('slope', 5)} AS theil_sen_slope, {r('s / (n * (n - 1.0) / 2.0)', 5)} AS kendall_tau, {r('z', 5)} AS mann_kendall_z,
  {r('p', 5)} AS p_value, CASE WHEN p < 0.05 AND z > 0 THEN 'Significant Increase' WHEN p < 0.05 AND z < 0 THEN 'Significant Decrease' ELSE 'No Significant Trend' END AS trend_direction
FROM (SELECT *, 2.0 * (1.0 - ({normal_cdf('abs(z)')})) AS p FROM c_trend)
""", digits=5)
def i10(spark, sf_dir):
    long = explore.to_long(base.history(spark, sf_dir), _TREND, ["entity", "date"])
    return explore.trend_table(long, SPEC)
