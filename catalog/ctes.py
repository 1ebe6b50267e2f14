"""Oracle CTEs: the proxy panel in SQL."""

from __future__ import annotations

from catalog.base import SPEC, cte
from panelstress.functions import special
from panelstress.plans import proxy
from panelstress.spec import COMPONENTS

D = "DATE '{}'".format
START, END, TRAIN_END, VAL_END = map(D, (SPEC.start, SPEC.end, SPEC.train_end, SPEC.val_end))
CAL_START = D(SPEC.calibration_start)


def poly(coefficients, x: str) -> str:
    text = repr(float(coefficients[-1]))
    for c in reversed(coefficients[:-1]):
        text = f"({text} * {x} + {float(c)!r})"
    return text


def guard(std: str) -> str:
    return f"CASE WHEN {std} > 1e-6 THEN {std} ELSE 1.0 END"


def classify(v: str, missing: str = "'Unknown'") -> str:
    return (
        f"CASE WHEN {v} IS NULL THEN {missing} WHEN {v} < -1.5 THEN 'Very Wet' WHEN {v} < -0.5 THEN 'Wet' "
        f"WHEN {v} < 0.5 THEN 'Normal' WHEN {v} < 1.5 THEN 'Moderate Stress' ELSE 'Severe Stress' END"
    )


def normal_quantile(p: str) -> str:
    q = f"({p} - 0.5)"
    r0 = f"(0.180625 - {q} * {q})"
    rt = f"sqrt(-ln(least({p}, 1.0 - {p})))"
    near, far = f"({rt} - 1.6)", f"({rt} - 5.0)"
    central = f"{q} * {poly(special._CENTRAL_NUM, r0)} / {poly(special._CENTRAL_DEN, r0)}"
    t1 = f"{poly(special._TAIL_NUM, near)} / {poly(special._TAIL_DEN, near)}"
    t2 = f"{poly(special._FAR_NUM, far)} / {poly(special._FAR_DEN, far)}"
    return f"CASE WHEN abs({q}) <= 0.425 THEN {central} ELSE sign({q}) * (CASE WHEN {rt} <= 5.0 THEN {t1} ELSE {t2} END) END"


def normal_cdf(z: str) -> str:
    """Phi(z) for a bounded z, from the incomplete gamma series."""
    h = f"({z} * {z} / 2.0)"
    series = f"(SELECT sum(exp((0.5 + t.j) * ln({h}) - {h} - lgamma(t.j + 1.5))) FROM range(0, 200) t(j))"
    return f"CASE WHEN {z} = 0 THEN 0.5 ELSE 0.5 + 0.5 * sign({z}) * least(1.0, {series}) END"


cte("c_sup", "SELECT s_suppkey, s_name AS entity FROM supplier")

cte("c_cells", """
SELECT l_suppkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS date, CAST(count(*) AS DOUBLE) AS n,
  coalesce(CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (WHERE l_returnflag = 'R' AND l_discount >= 0.05) AS DOUBLE), 0.0) AS rain,
  CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) AS disc,
  CAST(sum(CAST(l_tax AS DECIMAL(18,2))) AS DOUBLE) AS tax,
  CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty,
  CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS DOUBLE) AS ret,
  CAST(count(*) FILTER (WHERE l_linestatus = 'F') AS DOUBLE) AS fil
FROM lineitem GROUP BY ALL
""")

cte("c_hist", f"""
SELECT g.entity, g.date, CAST(year(g.date) AS INTEGER) AS year, CAST(month(g.date) AS INTEGER) AS month,
  coalesce(c.rain / 1000.0, 0.0) AS rainfall_mm,
  coalesce(c.disc / c.n, 0.0) AS soil_water_layer_1,
  coalesce(c.tax / c.n, 0.0) AS soil_water_layer_2,
  coalesce((c.disc + c.tax) / c.n, 0.0) AS soil_water_layer_3,
  coalesce(c.qty / c.n / 50.0, 0.0) AS soil_water_layer_4,
  coalesce(c.disc / c.n, 0.0) * 70.0 + coalesce(c.tax / c.n, 0.0) * 210.0
    + coalesce((c.disc + c.tax) / c.n, 0.0) * 720.0 + coalesce(c.qty / c.n / 50.0, 0.0) * 1890.0 AS soil_water_storage_mm,
  CASE WHEN c.n >= 4 THEN 2.0 * c.ret / c.n - 1.0 END AS ndvi,
  CASE WHEN c.n >= 3 THEN c.qty / c.n END AS lst_celsius,
  coalesce(c.fil / c.n, 0.0) AS surface_water_frequency,
  CAST(coalesce(c.n, 1) AS INTEGER) AS valid_pixels
FROM (SELECT s_suppkey, entity, CAST(unnest(generate_series(DATE '{proxy.HISTORY_START}', DATE '{proxy.HISTORY_END}', INTERVAL 1 MONTH)) AS DATE) AS date FROM c_sup) g
LEFT JOIN c_cells c ON c.l_suppkey = g.s_suppkey AND c.date = g.date
""")

cte("c_prep", """
SELECT * EXCLUDE (ndvi), ndvi AS ndvi_raw, lst_celsius AS lst_raw, surface_water_frequency AS surface_water_frequency_raw,
  CASE WHEN year = 2000 AND month = 7 AND ndvi >= 0.2 THEN NULL ELSE ndvi END AS ndvi,
  CASE WHEN year = 2000 AND month = 7 AND ndvi >= 0.2 THEN 1 ELSE 0 END AS ndvi_artifact_masked,
  CASE WHEN count(rainfall_mm) OVER w = 3 THEN sum(rainfall_mm) OVER w END AS rainfall_3m_mm
FROM c_hist WINDOW w AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)
""")

for short, column in (("ndvi", "ndvi"), ("lst", "lst_celsius")):
    cte(f"c_med_{short}", f"""
SELECT CASE WHEN grouping(entity) = 0 AND grouping(month) = 0 THEN 'entity_month' WHEN grouping(entity) = 0 THEN 'entity'
  WHEN grouping(month) = 0 THEN 'month' ELSE 'global' END AS level, entity, month, median({column}) AS med
FROM c_prep WHERE date <= {TRAIN_END} AND {column} IS NOT NULL
GROUP BY GROUPING SETS ((entity, month), (entity), (month), ())
""")

cte("c_imp", """
SELECT p.* EXCLUDE (ndvi, lst_celsius),
  CASE WHEN p.ndvi IS NULL THEN 1 ELSE 0 END AS ndvi_imputed,
  coalesce(p.ndvi, n1.med, n2.med, n3.med, n4.med) AS ndvi,
  CASE WHEN p.lst_celsius IS NULL THEN 1 ELSE 0 END AS lst_imputed,
  coalesce(p.lst_celsius, l1.med, l2.med, l3.med, l4.med) AS lst_celsius
FROM c_prep p
LEFT JOIN c_med_ndvi n1 ON n1.level = 'entity_month' AND n1.entity = p.entity AND n1.month = p.month
LEFT JOIN c_med_ndvi n2 ON n2.level = 'entity' AND n2.entity = p.entity
LEFT JOIN c_med_ndvi n3 ON n3.level = 'month' AND n3.month = p.month
LEFT JOIN c_med_ndvi n4 ON n4.level = 'global'
LEFT JOIN c_med_lst l1 ON l1.level = 'entity_month' AND l1.entity = p.entity AND l1.month = p.month
LEFT JOIN c_med_lst l2 ON l2.level = 'entity' AND l2.entity = p.entity
LEFT JOIN c_med_lst l3 ON l3.level = 'month' AND l3.month = p.month
LEFT JOIN c_med_lst l4 ON l4.level = 'global'
""")

# ---- rainfall index --------------------------------------------------------------------------

cte("c_gstat", f"""
SELECT entity, month, count(rainfall_3m_mm) AS n_samples, count(*) FILTER (WHERE rainfall_3m_mm <= 0.001) AS n_zeros,
  avg(rainfall_3m_mm) AS mean_all, avg(rainfall_3m_mm) FILTER (WHERE rainfall_3m_mm > 0.001) AS mean_pos,
  avg(ln(rainfall_3m_mm)) FILTER (WHERE rainfall_3m_mm > 0.001) AS mean_log
FROM c_prep WHERE date BETWEEN {CAL_START} AND {TRAIN_END} GROUP BY entity, month
""")
cte("c_newton0", """
SELECT *, CASE WHEN n_samples - n_zeros >= 3 AND ln(mean_pos) - mean_log > 1e-12 THEN ln(mean_pos) - mean_log END AS s,
  CASE WHEN n_samples - n_zeros >= 3 AND ln(mean_pos) - mean_log > 1e-12
    THEN (3.0 - (ln(mean_pos) - mean_log) + sqrt(((ln(mean_pos) - mean_log) - 3.0) * ((ln(mean_pos) - mean_log) - 3.0) + 24.0 * (ln(mean_pos) - mean_log)))
      / (12.0 * (ln(mean_pos) - mean_log)) END AS a
FROM c_gstat
""")
_B, _I = "(a + 10.0)", "(1.0 / ((a + 10.0) * (a + 10.0)))"
_PSI = f"(ln({_B}) - 0.5 / {_B} + {poly(special._DIGAMMA_SERIES, _I)} * {_I} - (" + " + ".join(
    f"1.0 / (a + {k}.0)" for k in range(10)) + "))"
_PSI1 = f"(1.0 / {_B} + 0.5 * {_I} + {poly(special._TRIGAMMA_SERIES, _I)} * {_I} / {_B} + " + " + ".join(
    f"1.0 / ((a + {k}.0) * (a + {k}.0))" for k in range(10)) + ")"
for i in range(1, 7):
    cte(f"c_newton{i}", f"""
SELECT * REPLACE (1.0 / (1.0 / a + (ln(a) - {_PSI} - s) / (a * a * (1.0 / a - {_PSI1}))) AS a) FROM c_newton{i - 1}
""")
cte("c_gamma", """
SELECT entity, month, CASE WHEN n_samples > 0 THEN CAST(n_zeros AS DOUBLE) / n_samples ELSE 0.0 END AS q,
  coalesce(a, 1.0) AS alpha,
  CASE WHEN n_samples = 0 THEN 1.0 WHEN a IS NOT NULL THEN mean_pos / a ELSE greatest(mean_all, 1.0) END AS scale,
  n_samples, n_zeros
FROM c_newton6
""")
cte("c_spi_in", f"""
SELECT p.entity, p.date, p.year, p.month, p.rainfall_mm, p.rainfall_3m_mm AS x, coalesce(g.q, 0.0) AS q,
  coalesce(g.alpha, 1.0) AS a, p.rainfall_3m_mm / coalesce(g.scale, 1.0) AS z
FROM c_prep p LEFT JOIN c_gamma g USING (entity, month) WHERE p.date BETWEEN {START} AND {END}
""")
_LOG_TERM = (
    f"CASE WHEN a < 10.0 THEN a * ln(z) - z - lgamma(a + 1.0) ELSE a * ln(z / a) - (z - a) - 0.5 * ln(a) - {special._HALF_LOG_2PI!r}"
    f" - {poly(special._LGAMMA_SERIES, '(1.0 / (a * a))')} / a END"
)
cte("c_spi_series", f"""
SELECT entity, date, exp({_LOG_TERM}) * sum(t) AS p FROM (
  SELECT entity, date, a, z, exp(sum(CASE WHEN j = 0 THEN 0.0 ELSE ln(z / (a + j)) END) OVER (PARTITION BY entity, date ORDER BY j)) AS t
  FROM (SELECT entity, date, a, z, unnest(range(0, CAST(ceil(greatest(z - a, 0.0) + 12.0 * sqrt(greatest(z, a)) + 41.0) AS BIGINT))) AS j
    FROM c_spi_in WHERE x > 0.001 AND z <= a + 40.0 * sqrt(a) + 200.0)) GROUP BY entity, date, a, z
""")
cte("c_spi_h", """
SELECT i.*, CASE WHEN x IS NULL THEN NULL ELSE greatest(1e-7, least(1.0 - 1e-7,
    CASE WHEN x <= 0.001 THEN q ELSE q + (1.0 - q) * coalesce(least(s.p, 1.0), 1.0) END)) END AS h
FROM c_spi_in i LEFT JOIN c_spi_series s USING (entity, date)
""")
cte("c_spi", f"SELECT *, {normal_quantile('h')} AS spi_3 FROM c_spi_h")
cte("c_spi_z", f"""
SELECT entity, date, spi_3, -spi_3 AS spi_stress, (-spi_3 - coalesce(m, 0.0)) / {guard('sd')} AS spi_stress_z FROM (
  SELECT *, avg(-spi_3) FILTER (WHERE date <= {TRAIN_END}) OVER (PARTITION BY entity) AS m,
    stddev_pop(-spi_3) FILTER (WHERE date <= {TRAIN_END}) OVER (PARTITION BY entity) AS sd FROM c_spi)
""")


def anomaly(source: str, value: str, clim: str, anom: str, z: str, sign: int, keep: str = "") -> str:
    s = "-" if sign < 0 else ""
    return f"""
SELECT entity, date, {keep} {value}, {clim}, {anom}, {s}{anom} / {guard('sd')} AS {z} FROM (
  SELECT *, stddev_pop({anom}) FILTER (WHERE date <= {TRAIN_END}) OVER (PARTITION BY entity) AS sd FROM (
    SELECT *, {value} - {clim} AS {anom} FROM (
      SELECT *, avg({value}) FILTER (WHERE date <= {TRAIN_END}) OVER (PARTITION BY entity, month) AS {clim}
      FROM {source} WHERE date BETWEEN {START} AND {END})))
"""


cte("c_soil_z", anomaly("c_prep", "soil_water_storage_mm", "soil_water_climatology_mm", "soil_water_anomaly_mm",
                        "soil_stress_z", -1, ", ".join(proxy.SOIL_LAYERS) + ","))
cte("c_ndvi_z", anomaly("c_imp", "ndvi", "ndvi_climatology", "ndvi_anomaly", "ndvi_stress_z", -1,
                        "ndvi_raw, ndvi_artifact_masked, ndvi_imputed,"))
cte("c_lst_z", anomaly("c_imp", "lst_celsius", "lst_climatology_celsius", "lst_anomaly_celsius", "lst_stress_z", 1,
                       "lst_raw, lst_imputed,"))
cte("c_water_z", anomaly("c_prep", "surface_water_frequency", "surface_water_climatology", "surface_water_anomaly",
                         "surface_water_stress_z", -1, "surface_water_frequency_raw, valid_pixels,"))
cte("c_water_lag", """
SELECT * REPLACE (coalesce(lag(surface_water_frequency) OVER (PARTITION BY entity ORDER BY date), surface_water_frequency) AS surface_water_frequency)
FROM c_prep
""")
cte("c_waterlag_z", anomaly("c_water_lag", "surface_water_frequency", "surface_water_climatology", "surface_water_anomaly",
                            "surface_water_stress_z", -1, "surface_water_frequency_raw, valid_pixels,"))

# ---- wells -----------------------------------------------------------------------------------

cte("c_obs", """
SELECT l_partkey AS well_id, min(entity) AS entity, CAST(l_shipdate AS DATE) AS raw_date, min(l_quantity) AS water_level_m_bgl
FROM lineitem JOIN c_sup ON l_suppkey = s_suppkey WHERE l_quantity >= 0
GROUP BY l_partkey, CAST(l_shipdate AS DATE) HAVING min(l_quantity) = max(l_quantity)
""")
cte("c_obs_month", """
SELECT well_id, min(entity) AS entity, CAST(date_trunc('month', raw_date) AS DATE) AS obs_date, min(water_level_m_bgl) AS lvl
FROM c_obs GROUP BY well_id, CAST(date_trunc('month', raw_date) AS DATE) HAVING min(water_level_m_bgl) = max(water_level_m_bgl)
""")
cte("c_wagg", f"""
SELECT entity, obs_date, count(*) AS n_wells, median(lvl) AS median_depth_m_bgl, avg(lvl) AS mean_depth_m_bgl,
  stddev_pop(lvl) AS std_depth_m_bgl, quantile_cont(lvl, 0.75) - quantile_cont(lvl, 0.25) AS iqr_depth_m_bgl,
  CAST(year(obs_date) AS INTEGER) AS year, CAST(month(obs_date) AS INTEGER) AS month, count(*) >= {SPEC.min_wells} AS is_qualifying
FROM c_obs_month GROUP BY entity, obs_date
""")
cte("c_wclim", f"""
SELECT entity, month, avg(median_depth_m_bgl) AS mean_depth FROM c_wagg
WHERE is_qualifying AND obs_date BETWEEN {START} AND {TRAIN_END} GROUP BY GROUPING SETS ((entity, month), (entity))
""")
cte("c_wanom", """
SELECT a.*, CASE WHEN is_qualifying THEN coalesce(m.mean_depth, o.mean_depth, median_depth_m_bgl) END AS obs_climatology,
  CASE WHEN is_qualifying THEN median_depth_m_bgl - coalesce(m.mean_depth, o.mean_depth, median_depth_m_bgl) END AS obs_anomaly
FROM c_wagg a LEFT JOIN c_wclim m ON m.entity = a.entity AND m.month = a.month
LEFT JOIN c_wclim o ON o.entity = a.entity AND o.month IS NULL
""")
cte("c_cal", f"""
SELECT entity, date, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month FROM (
  SELECT entity, CAST(unnest(generate_series({START}, {END}, INTERVAL 1 MONTH)) AS DATE) AS date FROM c_sup)
""")
cte("c_wcarry", f"""
SELECT c.*, o.obs_date AS last_gw_obs_date,
  w.median_depth_m_bgl AS groundwater_depth_m_bgl_raw, CAST(coalesce(w.n_wells, 0) AS INTEGER) AS groundwater_n_wells,
  CAST(coalesce(w.is_qualifying, false) AS INTEGER) AS groundwater_is_qualifying,
  CAST(coalesce(NOT w.is_qualifying AND w.n_wells > 0, false) AS INTEGER) AS groundwater_low_sample_flag,
  CASE WHEN o.obs_date IS NOT NULL THEN o.median_depth_m_bgl ELSE coalesce(f.mean_depth, 10.0) END AS groundwater_as_of_depth_m_bgl,
  CASE WHEN o.obs_date IS NOT NULL THEN o.obs_climatology ELSE coalesce(f.mean_depth, 10.0) END AS groundwater_climatology_m_bgl,
  coalesce(o.obs_anomaly, 0.0) AS groundwater_anomaly_m_bgl,
  CAST(CASE WHEN o.obs_date IS NULL THEN 999 ELSE (year(c.date) * 12 + month(c.date)) - (year(o.obs_date) * 12 + month(o.obs_date)) END AS INTEGER) AS months_since_last_gw_obs
FROM c_cal c
ASOF LEFT JOIN (SELECT * FROM c_wanom WHERE is_qualifying) o ON o.entity = c.entity AND o.obs_date <= c.date
LEFT JOIN c_wagg w ON w.entity = c.entity AND w.obs_date = c.date
LEFT JOIN c_wclim f ON f.entity = c.entity AND f.month IS NULL
""")
cte("c_gw_z", f"""
SELECT * EXCLUDE (m, sd), CAST(months_since_last_gw_obs > {SPEC.stale_months} AS INTEGER) AS groundwater_stale_flag,
  (groundwater_anomaly_m_bgl - coalesce(m, 0.0)) / {guard('sd')} AS groundwater_stress_z FROM (
  SELECT *, avg(groundwater_anomaly_m_bgl) FILTER (WHERE date <= {TRAIN_END}) OVER (PARTITION BY entity) AS m,
    stddev_pop(groundwater_anomaly_m_bgl) FILTER (WHERE date <= {TRAIN_END}) OVER (PARTITION BY entity) AS sd FROM c_wcarry)
""")
cte("c_panel", f"""
SELECT *, {classify('wsi')} AS wsi_category FROM (
SELECT c.*, CASE WHEN c.date <= {TRAIN_END} THEN 'train' WHEN c.date <= {VAL_END} THEN 'validation' ELSE 'test' END AS split,
  i.rainfall_mm, i.x AS rainfall_3m_mm, s.spi_3, s.spi_stress, s.spi_stress_z,
  so.* EXCLUDE (entity, date), nd.* EXCLUDE (entity, date), ls.* EXCLUDE (entity, date),
  g.* EXCLUDE (entity, date, year, month), wa.* EXCLUDE (entity, date),
  (s.spi_stress_z + so.soil_stress_z + nd.ndvi_stress_z + ls.lst_stress_z + g.groundwater_stress_z + wa.surface_water_stress_z) / 6.0 AS wsi
FROM c_cal c JOIN c_spi_in i USING (entity, date) JOIN c_spi_z s USING (entity, date) JOIN c_soil_z so USING (entity, date)
JOIN c_ndvi_z nd USING (entity, date) JOIN c_lst_z ls USING (entity, date) JOIN c_gw_z g USING (entity, date)
JOIN c_water_z wa USING (entity, date))
""")

COMPONENT_LIST = ", ".join(COMPONENTS)
