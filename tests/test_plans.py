"""What travels through the shuffles of the panel, the sequences and the seasonal forecast."""

from panelstress.operators import forecast, spi
from panelstress.operators import sequences as seq
from panelstress.plans import panel as panel_plan

from tests.conftest import monthly_frame


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def children(plan: str, node: str) -> list[str]:
    """The line below each line that names the node."""
    lines = plan.split("\n")
    return [lines[i + 1] for i, line in enumerate(lines) if node in line]


def prepared_streams(spark, spec):
    pdf = monthly_frame(
        ["A", "B"], "2002-01-01", 96,
        rainfall_mm=lambda i, j: float((7 * i + 5 * j) % 11), ndvi=lambda i, j: None if j % 9 == 4 else (i + j % 12) / 20,
        lst_celsius=lambda i, j: 20.0 + i + j % 7, soil_water_storage_mm=lambda i, j: 100.0 + (j * j) % 13,
        surface_water_frequency=lambda i, j: (j % 5) / 5,
    )
    return panel_plan.prepare_history(spark.createDataFrame(pdf), spec).cache()


def small_panel(spark, spec):
    prepared = prepared_streams(spark, spec)
    readings = spark.createDataFrame(
        [(w, e, f"2003-{m:02d}-10", float(5 + w % 4 + m)) for e in "AB" for w in range(12) for m in range(1, 13)],
        "well_id long, entity string, date string, water_level_m_bgl double",
    ).selectExpr("well_id + if(entity = 'B', 100, 0) AS well_id", "entity", "date", "water_level_m_bgl")
    return prepared, panel_plan.build_panel(prepared, *panel_plan.well_tables(readings, spec), spec)


def test_the_precipitation_index_is_computed_on_its_own_columns(spark, spec):
    """A Python function ends a partitioning: wide rows under it would be shuffled a second time."""
    prepared, panel = small_panel(spark, spec)
    below = children(optimized(panel), "gamma_cdf(")
    assert below and all("ndvi" not in line and "soil" not in line for line in below)
    # The values are those of the index on the calendar's own rows, outside months left out.
    wide = prepared.where(f"date BETWEEN '{spec.start}' AND '{spec.end}'")
    direct = spi.add_spi(wide, "rainfall_3m_mm", spi.fit_gamma(prepared, "rainfall_3m_mm", spec), spec)
    expected = {(r["entity"], r["date"]): r["spi_3"] for r in direct.collect()}
    got = {(r["entity"], r["date"]): r["spi_3"] for r in panel.collect()}
    assert got == expected and len(got) == 2 * 72


def test_the_likelihood_equation_is_solved_in_batches(spark, spec):
    fitted = spi.fit_gamma(prepared_streams(spark, spec), "rainfall_3m_mm", spec)
    assert "ArrowEvalPython" in optimized(fitted)


def test_windows_are_counted_without_their_values(spark, panel, spec):
    counts = seq.build_sequences(panel, spec).groupBy("entity").count()
    assert "collect_list" not in optimized(counts)
    assert {r["entity"]: r["count"] for r in counts.collect()} == {e: 54 for e in "ABC"}


def test_no_lookback_travels_through_the_seasonal_join(spark, panel, spec):
    rows = seq.build_sequences(panel, spec).localCheckpoint()
    plan = optimized(forecast.seasonal_persistence(rows, panel, spec).select("forecast_origin", "pred"))
    left = children(plan, "Join LeftOuter")
    assert len(left) == 1 and "_other1" in left[0]
    kept = left[0].split("Project")[1]
    assert "wsi_history" not in kept and ", x#" not in kept
