"""Panel inputs derived from order and line-item tables.

Entity = supplier, time = month of shipment. One scan and one aggregation of the line items give all
monthly streams; single line items serve as well readings. The panel grows with the suppliers.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelstress.operators.calendar import build_calendar
from panelstress.operators.clean import soil_storage
from panelstress.plans.panel import well_tables
from panelstress.spec import PanelSpec, SplitPolicy

SPEC = PanelSpec(
    start="1996-01-01",
    end="2001-07-01",
    train_end="1999-06-01",
    val_end="2000-06-01",
    origins=SplitPolicy(
        train=("1996-12-01", "1999-03-01"), val=("1999-06-01", "2000-03-01"), test=("2000-06-01", "2001-04-01")
    ),
    calibration_start="1995-01-01",
    min_wells=5,
    well_thresholds=(3, 5, 7),
)
HISTORY_START, HISTORY_END = "1995-01-01", "2001-10-01"
SOIL_LAYERS = ["soil_water_layer_1", "soil_water_layer_2", "soil_water_layer_3", "soil_water_layer_4"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_name").alias("entity"))


def _exact_sum(column, condition=None):
    """Hundredths add up exactly as integers, so the result does not depend on the order of summation."""
    value = F.floor(column * 100.0 + 0.5)
    total = F.sum(F.when(condition, value) if condition is not None else value)
    return F.coalesce(total, F.lit(0)) / 100.0


def monthly_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All monthly measurements per supplier and month that has line items."""
    li = table(spark, sf_dir, "lineitem")
    returned = F.col("l_returnflag") == "R"
    sums = li.groupBy("l_suppkey", F.trunc(F.col("l_shipdate").cast("date"), "MM").alias("date")).agg(
        F.count(F.lit(1)).cast("double").alias("_n"),
        _exact_sum(F.col("l_extendedprice"), returned & (F.col("l_discount") >= 0.05)).alias("_rain"),
        _exact_sum(F.col("l_discount")).alias("_disc"),
        _exact_sum(F.col("l_tax")).alias("_tax"),
        _exact_sum(F.col("l_quantity")).alias("_qty"),
        F.sum(returned.cast("double")).alias("_returned"),
        F.sum((F.col("l_linestatus") == "F").cast("double")).alias("_filled"),
    )
    n = F.col("_n")
    return sums.select(
        "l_suppkey",
        "date",
        (F.col("_rain") / 1000.0).alias("rainfall_mm"),
        (F.col("_disc") / n).alias(SOIL_LAYERS[0]),
        (F.col("_tax") / n).alias(SOIL_LAYERS[1]),
        ((F.col("_disc") + F.col("_tax")) / n).alias(SOIL_LAYERS[2]),
        (F.col("_qty") / n / 50.0).alias(SOIL_LAYERS[3]),
        F.when(n >= 4, 2.0 * F.col("_returned") / n - 1.0).alias("ndvi"),
        F.when(n >= 3, F.col("_qty") / n).alias("lst_celsius"),
        (F.col("_filled") / n).alias("surface_water_frequency"),
        n.cast("int").alias("valid_pixels"),
    )


def history(spark: SparkSession, sf_dir: str, spec: PanelSpec = SPEC) -> DataFrame:
    """Complete monthly streams in one wide frame; only vegetation and temperature have gaps."""
    names = suppliers(spark, sf_dir)
    grid = build_calendar(names, spec, HISTORY_START, HISTORY_END)
    cells = monthly_cells(spark, sf_dir).join(names, F.col("l_suppkey") == F.col("s_suppkey")).drop(
        "l_suppkey", "s_suppkey"
    )
    defaults = {c: 0.0 for c in ["rainfall_mm", *SOIL_LAYERS, "surface_water_frequency"]} | {"valid_pixels": 1}
    return (
        grid.join(cells, ["entity", "date"], "left")
        .fillna(defaults)
        .withColumn("soil_water_storage_mm", soil_storage(SOIL_LAYERS))
    )


def keyed_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Irregular readings by supplier key: part = well, shipment day = date, quantity = level."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("well_id"),
        F.col("l_suppkey").alias("s_suppkey"),
        F.col("l_shipdate").alias("date"),
        F.col("l_quantity").alias("water_level_m_bgl"),
    )


def well_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same readings under supplier names."""
    return keyed_readings(spark, sf_dir).join(suppliers(spark, sf_dir), "s_suppkey").drop("s_suppkey")


def well_aggregates(spark: SparkSession, sf_dir: str, spec: PanelSpec = SPEC) -> DataFrame:
    """Monthly well aggregates: cleaned and aggregated by key, names joined to the far smaller result."""
    aggregates, _ = well_tables(keyed_readings(spark, sf_dir), replace(spec, entity="s_suppkey"))
    return aggregates.join(suppliers(spark, sf_dir), "s_suppkey").drop("s_suppkey")


def artifact_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vegetation readings of one month taken for artifacts: a full-month spike in July 2000."""
    return (
        history(spark, sf_dir)
        .where((F.col("month") == 7) & (F.col("year") == 2000) & (F.col("ndvi") >= 0.2))
        .select("entity", "year", "month", F.col("ndvi").alias("artifact_value"))
    )
