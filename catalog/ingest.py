"""Sources, sinks, cleaning, imputation, calendar and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import base, features  # noqa: F401 - defines CTEs
from catalog.base import SPEC, query, r, rs
from catalog.ctes import COMPONENT_LIST, START, TRAIN_END, VAL_END, D
from panelstress.functions.numeric import calendar_date, month_start
from panelstress.operators import anomaly, calendar, clean, impute, residual, spi, wells
from panelstress.plans import panel as panel_plan
from panelstress.plans import proxy
from panelstress.session import stage_path
from panelstress.sources import readers, sinks


def raw_names(spark, sf_dir):
    """Supplier names as a raw source would spell them: aliases and stray blanks."""
    name, key = F.col("entity"), F.col("s_suppkey")
    raw = (
        F.when(key % 7 == 0, F.concat(F.lit("S-"), key.cast("string")))
        .when(key % 5 == 0, F.concat(F.lit("  "), name, F.lit(" ")))
        .otherwise(name)
    )
    return proxy.suppliers(spark, sf_dir).select("s_suppkey", "entity", raw.alias("raw"))


def aliases(spark, sf_dir):
    names = raw_names(spark, sf_dir)
    return names.where(F.col("raw").startswith("S-")).select(F.col("raw").alias("alias"), F.col("entity").alias("canonical"))


def write_csv(df, path):
    df.write.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(path)
    return path


def raw_csv(spark, sf_dir, source, rename=None):
    """Write a monthly stream as CSV under its raw names."""
    rename = rename or {}
    df = base.history(spark, sf_dir).join(raw_names(spark, sf_dir).select("entity", "raw"), "entity")
    columns = [F.col(rename.get(c, c)).alias(c) for c in source.values]
    rows = df.select(F.col("raw").alias("entity"), "year", "month", *columns)
    return write_csv(rows, stage_path(spark, source.name.replace(" ", "-")))


def _reader(source, rename=None):
    def run(spark, sf_dir):
        path = raw_csv(spark, sf_dir, source, rename)
        return readers.load_stream(
            spark, path, source, aliases=aliases(spark, sf_dir),
            members=proxy.suppliers(spark, sf_dir).select("entity"),
        )

    return run


query("a1_rainfall_reader", f"SELECT entity, date, year, month, {rs('rainfall_mm')} FROM c_hist")(_reader(readers.RAINFALL))
query("a2_soil_reader", f"""SELECT entity, date, year, month, {rs('soil_water_layer_1', 'soil_water_layer_2', 'soil_water_layer_3', 'soil_water_layer_4')},
  {r('soil_water_storage_mm')} AS soil_water_storage_mm_0_289cm FROM c_hist""")(
    _reader(readers.SOIL, {"soil_water_storage_mm_0_289cm": "soil_water_storage_mm"})
)
query("a3_vegetation_reader", f"SELECT entity, date, year, month, {rs('ndvi')} FROM c_hist")(
    _reader(readers.VEGETATION, {"ndvi": "ndvi_raw"})
)
query("a4_temperature_reader", f"SELECT entity, date, year, month, {rs('lst_celsius')} FROM c_hist")(
    _reader(readers.TEMPERATURE, {"lst_celsius": "lst_raw"})
)
query("a5_surface_water_reader", f"""SELECT entity, date, year, month, {rs('surface_water_frequency')},
  {r('valid_pixels')} AS valid_pixels FROM c_hist""")(_reader(readers.SURFACE_WATER))


@query("a6_well_reader", """
SELECT well_id, entity, raw_date, CAST(date_trunc('month', raw_date) AS DATE) AS obs_date, CAST(year(raw_date) AS INTEGER) AS year,
  CAST(month(raw_date) AS INTEGER) AS month, """ + r("water_level_m_bgl") + """ AS water_level_m_bgl
FROM (SELECT CAST(well_id AS VARCHAR) AS well_id, entity, raw_date, water_level_m_bgl FROM c_obs)
""")
def a6(spark, sf_dir):
    rows = proxy.well_readings(spark, sf_dir).join(raw_names(spark, sf_dir).select("entity", "raw"), "entity").select(
        "well_id", F.col("raw").alias("entity"), F.col("date").cast("date").alias("date"), "water_level_m_bgl"
    )
    broken = spark.sql(
        "SELECT * FROM VALUES (-1L, 'S-0', 'no date', '3.5'), (-2L, 'S-0', '1999-05-04', '-2.0'), (-3L, 'S-0', '1999-05-04', 'bad'), "
        "(-4L, 'S-0', '1999-05-04', '4.0'), (-4L, 'S-0', '1999-05-04', '8.0'), (-5L, 'Nobody', '1999-05-04', '4.0') "
        "AS t(well_id, entity, date, water_level_m_bgl)"
    )
    text = rows.select([F.col(c).cast("string").alias(c) for c in rows.columns]).unionByName(
        broken.select([F.col(c).cast("string").alias(c) for c in rows.columns])
    )
    path = write_csv(text, stage_path(spark, "well-readings"))
    return readers.load_wells(
        spark, path, aliases=aliases(spark, sf_dir), members=proxy.suppliers(spark, sf_dir).select("entity")
    )


@query("a7_model_dataset_reader", f"SELECT entity, date, {rs('wsi', *COMPONENT_LIST.split(', '))}, split, wsi_category FROM c_panel")
def a7(spark, sf_dir):
    path = stage_path(spark, "model-dataset")
    rows = panel_plan.model_view(base.panel(spark, sf_dir), SPEC)
    rows.withColumnRenamed("wsi", "WSI").write.option("header", True).csv(path)
    df = readers.load_model_dataset(spark, path, SPEC)
    return df.select("entity", "date", "wsi", *SPEC.components, "split", "wsi_category")


@query("a8_sequence_reader", "SELECT sequence_id, entity, forecast_origin, split FROM c_seq WHERE split IN ('val', 'test')")
def a8(spark, sf_dir):
    path = stage_path(spark, "sequence-sink")
    sinks.write_sequences(base.sequences(spark, sf_dir), path)
    return readers.load_sequences(spark, path, "val", "test").select("sequence_id", "entity", "forecast_origin", "split")


@query("a9_residual_input_reader", f"""
SELECT s.sequence_id, s.entity, s.forecast_origin, s.split, {r('p.wsi')} AS wsi FROM c_seq s
JOIN c_panel p ON p.entity = s.entity AND p.date = s.forecast_origin
""")
def a9(spark, sf_dir):
    model, meta = readers.load_residual_inputs(base.panel(spark, sf_dir), base.sequences(spark, sf_dir), SPEC)
    joined = meta.join(model.withColumnRenamed("date", "forecast_origin"), ["entity", "forecast_origin"])
    return joined.select("sequence_id", "entity", "forecast_origin", "split", "wsi")


@query("a10_prediction_reader", """
SELECT model, horizon, count(*) AS n FROM c_test WHERE model IN ('Persistence', 'Seasonal_Persistence') GROUP BY model, horizon
""")
def a10(spark, sf_dir):
    single, full = stage_path(spark, "single-model"), stage_path(spark, "all-models")
    rows = base.test_predictions(spark, sf_dir)
    sinks.write_predictions(rows.where("model = 'Seasonal_Persistence'"), single)
    sinks.write_predictions(rows, full)
    return readers.load_predictions(spark, single, full).groupBy("model", "horizon").agg(F.count(F.lit(1)).alias("n"))


@query("a11_panel_sink", f"SELECT split, count(*) AS n, {r('avg(wsi)')} AS mean_wsi FROM c_panel GROUP BY split")
def a11(spark, sf_dir):
    path = stage_path(spark, "panel-sink")
    sinks.write_panel(base.panel(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.avg("wsi").alias("mean_wsi"))


@query("a12_exports", """
SELECT 'audit' AS export, wsi_category, count(*) AS n FROM c_panel GROUP BY wsi_category
UNION ALL SELECT 'model', wsi_category, count(*) FROM c_panel GROUP BY wsi_category
""")
def a12(spark, sf_dir):
    audit, model = stage_path(spark, "audit-export"), stage_path(spark, "model-export")
    sinks.write_exports(base.panel(spark, sf_dir), audit, model, SPEC)
    parts = [
        readers.read_text_table(spark, path).groupBy("wsi_category").agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(name).alias("export"), "wsi_category", "n"
        )
        for name, path in (("audit", audit), ("model", model))
    ]
    return parts[0].unionByName(parts[1])


@query("a13_train_statistics", f"""
SELECT 'spi_gamma_' || k AS statistic, entity, month, {r('v', 5)} AS value FROM (
  SELECT entity, month, unnest(['q', 'alpha', 'scale', 'n_samples', 'n_zeros']) AS k,
    unnest([q, alpha, scale, CAST(n_samples AS DOUBLE), CAST(n_zeros AS DOUBLE)]) AS v FROM c_gamma)
UNION ALL SELECT 'soil_climatology', entity, month, {r('avg(soil_water_storage_mm)', 5)} FROM c_prep
  WHERE date BETWEEN {START} AND {TRAIN_END} GROUP BY entity, month
UNION ALL SELECT 'ndvi_median_' || level, entity, month, {r('med', 5)} FROM c_med_ndvi
UNION ALL SELECT 'lst_celsius_median_' || level, entity, month, {r('med', 5)} FROM c_med_lst
UNION ALL SELECT CASE WHEN month IS NULL THEN 'groundwater_entity_mean' ELSE 'groundwater_climatology' END, entity, month, {r('mean_depth', 5)} FROM c_wclim
UNION ALL SELECT 'spi_stress_' || k, entity, CAST(NULL AS INTEGER), {r('v', 5)} FROM (
  SELECT entity, unnest(['mean', 'std']) AS k, unnest([avg(spi_stress), stddev_pop(spi_stress)]) AS v FROM c_spi_z
  WHERE date <= {TRAIN_END} GROUP BY entity)
""", digits=5)
def a13(spark, sf_dir):
    h, p = base.history(spark, sf_dir), base.panel(spark, sf_dir)
    stats = sinks.statistics_long(
        SPEC,
        gamma=spi.fit_gamma(h, "rainfall_3m_mm", SPEC),
        climatologies={"soil": anomaly.fit_climatology(p, "soil_water_storage_mm", SPEC)},
        z_parameters={"spi_stress": anomaly.fit_z_parameters(p, "spi_stress", SPEC)},
        medians=impute.fit_medians(h, ["ndvi", "lst_celsius"], SPEC),
        wells=wells.fit_well_climatology(base.well_aggregates(spark, sf_dir), SPEC),
    )
    path = stage_path(spark, "statistics")
    sinks.write_statistics(stats, path)
    return spark.read.schema(stats.schema).json(path)


@query("a14_report_sink", """SELECT "check", passed FROM c_checks UNION ALL SELECT 'overall', bool_and(passed) FROM c_checks""")
def a14(spark, sf_dir):
    from panelstress.operators import audit

    p = base.panel(spark, sf_dir)
    report = audit.full_suite(p, p, panel_plan.model_view(p, SPEC), SPEC)
    path = stage_path(spark, "report")
    sinks.write_report(report, path)
    return spark.read.schema(report.schema).json(path).select("check", "passed")


@query("a15_sequence_sink", "SELECT split, count(*) AS n FROM c_seq GROUP BY split")
def a15(spark, sf_dir):
    path = stage_path(spark, "sequences-out")
    sinks.write_sequences(base.sequences(spark, sf_dir), path)
    return readers.load_sequences(spark, path).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("a16_residual_sink", f"""
SELECT split, count(*) AS n, {r('sum(CAST(y1 AS DOUBLE) - wsi)', 4)} AS sum_t1, {r('sum(CAST(y3 AS DOUBLE) - wsi)', 4)} AS sum_t3
FROM c_seq GROUP BY split
""", digits=4)
def a16(spark, sf_dir):
    path = stage_path(spark, "residuals-out")
    sinks.write_residuals(residual.add_residual_targets(base.sequences(spark, sf_dir), SPEC), path, SPEC)
    return spark.read.parquet(path).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), F.sum("residual_t1").alias("sum_t1"), F.sum("residual_t3").alias("sum_t3")
    )


@query("a17_prediction_sink", "SELECT model, count(*) AS n FROM c_test GROUP BY model")
def a17(spark, sf_dir):
    path = stage_path(spark, "predictions-out")
    sinks.write_predictions(base.test_predictions(spark, sf_dir), path)
    return spark.read.parquet(path).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


# ---- cleaning --------------------------------------------------------------------------------

@query("b1_normalize_entity", "SELECT entity, count(*) AS n FROM c_sup JOIN lineitem ON l_suppkey = s_suppkey GROUP BY entity")
def b1(spark, sf_dir):
    rows = proxy.table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"))
    raw = rows.join(raw_names(spark, sf_dir), F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("raw").alias("entity"), "n")
    return clean.normalize_entity(raw, "entity", aliases(spark, sf_dir)).groupBy("entity").agg(F.sum("n").alias("n"))


@query("b2_keep_members", """
SELECT CAST(l_suppkey AS BIGINT) AS entity, count(*) AS n FROM lineitem
WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY l_suppkey
""")
def b2(spark, sf_dir):
    rows = proxy.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("entity"))
    members = proxy.table(spark, sf_dir, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("entity"))
    return clean.keep_members(rows, members, "entity").groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


@query("b3_coerce_numeric", f"""
SELECT event_type, count(*) AS n_rows, count(v) AS n_numeric, {r('min(v)')} AS lo, {r('max(v)')} AS hi
FROM (SELECT event_type, CASE event_type WHEN 'error' THEN NULL WHEN 'view' THEN NULL ELSE value END AS v FROM events) GROUP BY event_type
""")
def b3(spark, sf_dir):
    text = F.when(F.col("event_type") == "error", "n/a").when(F.col("event_type") == "view", "NaN").otherwise(
        F.col("value").cast("string")
    )
    rows = proxy.table(spark, sf_dir, "events").select("event_type", text.alias("v"))
    return clean.coerce_numeric(rows, ["v"]).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("v").alias("n_numeric"), F.min("v").alias("lo"), F.max("v").alias("hi")
    )


@query("b4_coerce_dates", "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY CAST(ts AS DATE)")
def b4(spark, sf_dir):
    text = F.when(F.col("event_type") == "error", "unknown").otherwise(F.col("ts").cast("string"))
    rows = proxy.table(spark, sf_dir, "events").select(calendar_date(text).alias("day"))
    return rows.where(F.col("day").isNotNull()).groupBy("day").agg(F.count(F.lit(1)).alias("n"))


@query("b5_month_anchor", "SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, count(*) AS n FROM orders GROUP BY ALL")
def b5(spark, sf_dir):
    d = F.col("o_orderdate").cast("date")
    rows = proxy.table(spark, sf_dir, "orders").select(F.year(d).alias("y"), F.month(d).alias("m"))
    return rows.groupBy(month_start("y", "m").alias("month_start")).agg(F.count(F.lit(1)).alias("n"))


@query("b6_range_report", """
SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS duplicate_keys, count(*) FILTER (WHERE lst_celsius < 20 OR lst_celsius > 30) AS lst_celsius_outside,
  count(*) FILTER (WHERE surface_water_frequency <= 0) AS surface_water_frequency_outside,
  count(*) FILTER (WHERE ndvi < -1 OR ndvi > 1) AS ndvi_outside FROM c_hist
""")
def b6(spark, sf_dir):
    rows = base.history(spark, sf_dir).withColumn("ndvi", F.col("ndvi_raw"))
    bounds = {"lst_celsius": (20.0, 30.0), "surface_water_frequency": (0.0, None, True), "ndvi": (-1.0, 1.0)}
    return clean.contract_report(rows, SPEC.keys, bounds)


@query("b7_duplicate_keys", """
SELECT CAST(sum(c) AS BIGINT) AS n_rows, count(*) FILTER (WHERE c > 1) AS duplicate_keys
FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_partkey, CAST(l_shipdate AS DATE))
""")
def b7(spark, sf_dir):
    rows = proxy.table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_shipdate").cast("date").alias("date"))
    return clean.contract_report(rows, ["l_partkey", "date"], {})


@query("b8_drop_invalid", f"SELECT c_mktsegment, count(*) AS n, {r('min(c_acctbal)')} AS lo FROM customer WHERE c_acctbal >= 0 GROUP BY c_mktsegment")
def b8(spark, sf_dir):
    rows = clean.drop_invalid(proxy.table(spark, sf_dir, "customer"), "c_acctbal")
    return rows.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.min("c_acctbal").alias("lo"))


@query("b9_drop_copies", """
SELECT CAST(date_trunc('month', d) AS DATE) AS month_start, count(*) AS n
FROM (SELECT DISTINCT l_partkey, CAST(date_trunc('month', l_shipdate) AS DATE) AS d, l_quantity FROM lineitem) GROUP BY ALL
""")
def b9(spark, sf_dir):
    rows = proxy.table(spark, sf_dir, "lineitem").select(
        "l_partkey", F.trunc(F.col("l_shipdate").cast("date"), "MM").alias("month_start"), "l_quantity"
    )
    return clean.drop_copies(rows, ["l_partkey", "month_start", "l_quantity"]).groupBy("month_start").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("b10_drop_conflicts", f"SELECT well_id, entity, obs_date, {r('lvl')} AS water_level_m_bgl FROM c_obs_month")
def b10(spark, sf_dir):
    rows = clean.clean_observations(proxy.well_readings(spark, sf_dir), "well_id", "date", "water_level_m_bgl", "entity")
    return clean.monthly_observations(rows, "well_id", "water_level_m_bgl", "entity").select(
        "well_id", "entity", "obs_date", "water_level_m_bgl"
    )


@query("b11_mask_artifacts", f"""
SELECT entity, date, {rs('ndvi_raw', 'ndvi')}, ndvi_artifact_masked FROM c_prep
""")
def b11(spark, sf_dir):
    rows = proxy.history(spark, sf_dir)
    out = clean.mask_artifacts(rows, "ndvi", proxy.artifact_rules(spark, sf_dir), "entity")
    return out.select("entity", "date", "ndvi_raw", "ndvi", "ndvi_artifact_masked")


@query("b12_keep_raw", f"SELECT entity, date, {r('lst_celsius')} AS lst_celsius, {r('lst_celsius')} AS lst_raw FROM c_hist")
def b12(spark, sf_dir):
    return clean.keep_raw(proxy.history(spark, sf_dir), "lst_celsius", "lst_raw").select(
        "entity", "date", "lst_celsius", "lst_raw"
    )


@query("b13_fit_medians", f"SELECT level, entity, month, {r('med')} AS median FROM c_med_ndvi")
def b13(spark, sf_dir):
    return impute.fit_medians(base.history(spark, sf_dir), "ndvi", SPEC).long()


@query("b14_impute", f"SELECT entity, date, {rs('ndvi', 'lst_celsius')}, ndvi_imputed, lst_imputed FROM c_imp")
def b14(spark, sf_dir):
    return panel_plan.impute_streams(base.history(spark, sf_dir), SPEC).select(
        "entity", "date", "ndvi", "lst_celsius", "ndvi_imputed", "lst_imputed"
    )


@query("b15_soil_storage", f"SELECT entity, date, {rs('soil_water_storage_mm')} FROM c_hist")
def b15(spark, sf_dir):
    return base.history(spark, sf_dir).select(
        "entity", "date", clean.soil_storage(proxy.SOIL_LAYERS).alias("soil_water_storage_mm")
    )


# ---- calendar --------------------------------------------------------------------------------

@query("c1_calendar", "SELECT entity, date, year, month FROM c_cal")
def c1(spark, sf_dir):
    return calendar.build_calendar(proxy.suppliers(spark, sf_dir), SPEC)


@query("c2_splits", f"""
SELECT split, count(*) AS n, CAST(sum(CAST(split = 'train' AS INTEGER)) AS BIGINT) AS is_train,
  CAST(sum(CAST(split = 'validation' AS INTEGER)) AS BIGINT) AS is_val, CAST(sum(CAST(split = 'test' AS INTEGER)) AS BIGINT) AS is_test
FROM (SELECT CASE WHEN d <= {TRAIN_END} THEN 'train' WHEN d <= {VAL_END} THEN 'validation' ELSE 'test' END AS split
  FROM (SELECT CAST(o_orderdate AS DATE) AS d FROM orders)) GROUP BY split
""")
def c2(spark, sf_dir):
    rows = proxy.table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date"))
    return calendar.add_splits(rows, SPEC).groupBy("split").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("is_train", "is_val", "is_test")]
    )


@query("c3_origin_flags", f"""
SELECT date, count(*) AS n, CAST(sum(CAST(date BETWEEN {START} AND DATE '1999-03-01' AS INTEGER)) AS BIGINT) AS is_forecast_origin_train,
  CAST(sum(CAST(date BETWEEN DATE '1999-07-01' AND DATE '2000-03-01' AS INTEGER)) AS BIGINT) AS is_forecast_origin_val,
  CAST(sum(CAST(date BETWEEN DATE '2000-07-01' AND DATE '2001-04-01' AS INTEGER)) AS BIGINT) AS is_forecast_origin_test
FROM c_cal GROUP BY date
""")
def c3(spark, sf_dir):
    ranges = calendar.default_origin_ranges(SPEC)
    rows = calendar.add_origin_flags(calendar.build_calendar(proxy.suppliers(spark, sf_dir), SPEC), ranges, SPEC)
    return rows.groupBy("date").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ranges])


def origin_case(column: str) -> str:
    return "CASE " + " ".join(
        f"WHEN {column} BETWEEN {D(a)} AND {D(b)} THEN '{s}'" for s, a, b in SPEC.origins.ranges()
    ) + " END"


@query("c4_origin_split", f"SELECT date, {origin_case('date')} AS split, count(*) AS n FROM c_cal GROUP BY date")
def c4(spark, sf_dir):
    rows = calendar.build_calendar(proxy.suppliers(spark, sf_dir), SPEC)
    return rows.groupBy("date", calendar.origin_split("date", SPEC).alias("split")).agg(F.count(F.lit(1)).alias("n"))


