import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelstress.operators import anomaly, audit, calendar, index, spi, wells
from panelstress.spec import COMPONENTS
from tests.conftest import monthly_frame, months


def _rain(spark, shift=0.0):
    rng = np.random.default_rng(5)
    pdf = monthly_frame(["A", "B"], "2003-01-01", 72, rainfall_mm=lambda i, j: float(rng.gamma(2.0, 30.0)) if rng.random() > 0.2 else 0.0)
    pdf.loc[pdf["year"] > 2005, "rainfall_mm"] += shift
    return spark.createDataFrame(pdf)


def test_rolling_sum(spark, spec):
    df = spark.createDataFrame(monthly_frame(["A"], "2003-01-01", 5, v=lambda i, j: 10.0 * (j + 1)))
    assert [r["s"] for r in spi.rolling_sum(df, "v", "s", spec).orderBy("date").collect()] == [None, None, 60.0, 90.0, 120.0]


def test_spi_stress_is_standardised_on_training_rows(spark, spec):
    df = spi.rolling_sum(_rain(spark), "rainfall_mm", "r3", spec)
    out = spi.add_spi_stress(spi.add_spi(df, "r3", spi.fit_gamma(df, "r3", spec), spec), spec)
    assert spi.spi_round_trip(out).first()["passed"]
    for r in out.where(F.col("date") <= spec.train_end).groupBy("entity").agg(F.avg("spi_stress_z").alias("m"), F.stddev_pop("spi_stress_z").alias("s")).collect():
        assert abs(r["m"]) < 1e-10 and abs(r["s"] - 1) < 1e-10
    dry, wet = (out.where("r3 is not null").orderBy(F.col("r3").asc() if a else F.col("r3").desc()).first()["spi_stress_z"] for a in (True, False))
    assert dry > wet


def test_gamma_parameters_ignore_later_data(spark, spec):
    def fit(shift):
        df = spi.rolling_sum(_rain(spark, shift), "rainfall_mm", "r3", spec)
        return sorted(map(tuple, spi.fit_gamma(df, "r3", spec).collect()))

    assert fit(0.0) == fit(500.0)


def test_gamma_fallbacks(spark, spec):
    pdf = pd.DataFrame({"entity": ["A"] * 3 + ["B"] * 3, "date": months("2003-01-01", 3) * 2, "month": 1, "v": [0.0, 0.0, 6.0, 2.0, 2.0, 2.0]})
    got = {r["entity"]: r for r in spi.fit_gamma(spark.createDataFrame(pdf), "v", spec).collect()}
    assert (got["A"]["q"], got["A"]["alpha"], got["A"]["scale"], got["A"]["n_zeros"]) == (pytest.approx(2 / 3), 1.0, 2.0, 2)
    assert (got["B"]["alpha"], got["B"]["scale"]) == (1.0, 2.0)


def test_anomaly_polarity_and_scale(spark, spec):
    rng = np.random.default_rng(2)
    pdf = monthly_frame(["A", "B"], "2003-01-01", 72, soil_water_storage_mm=lambda i, j: 500 + rng.normal(0, 20), lst_celsius=lambda i, j: 30 + rng.normal())
    out = anomaly.temperature_features(anomaly.soil_features(spark.createDataFrame(pdf), spec), spec).toPandas()
    assert (np.sign(out["soil_stress_z"]) == -np.sign(out["soil_water_anomaly_mm"])).all()
    assert (np.sign(out["lst_stress_z"]) == np.sign(out["lst_anomaly_celsius"])).all()
    train = out[out["year"] <= 2005]
    assert np.allclose(train.groupby("entity")["soil_stress_z"].std(ddof=0), 1.0)


def test_lagged_water_falls_back_in_the_first_month(spark, spec):
    df = spark.createDataFrame(monthly_frame(["A"], "2003-01-01", 3, surface_water_frequency=lambda i, j: 0.1 * (j + 1)))
    out = anomaly.fall_back_to_raw(anomaly.lag_surface_water(df, spec, use_lag=True)).orderBy("date").collect()
    assert [r["surface_water_frequency"] for r in out] == pytest.approx([0.1, 0.1, 0.2])


def _wells(spark, counts):
    rows = [("A", pd.Timestamp(d).date(), f"w{i}", 5.0 + i * 0.1 + k) for k, (d, n) in enumerate(counts) for i in range(n)]
    return spark.createDataFrame(rows, "entity string, obs_date date, well_id string, lvl double")


def test_qualifying_thresholds(spark, spec):
    obs = _wells(spark, [("2003-05-01", 12), ("2003-10-01", 7)])
    for n, expected in ((5, 2), (10, 1), (15, 0)):
        assert wells.aggregate_wells(obs, "lvl", spec, n).where("is_qualifying").count() == expected
    row = wells.aggregate_wells(obs, "lvl", spec).where("n_wells = 12").first()
    v = np.array([5.0 + i * 0.1 for i in range(12)])
    assert (row["median_depth_m_bgl"], row["iqr_depth_m_bgl"]) == (pytest.approx(np.median(v)), pytest.approx(np.percentile(v, 75) - np.percentile(v, 25)))


def test_carry_staleness_and_pre_calendar_seed(spark, spec):
    grid = calendar.build_calendar(spark.createDataFrame([("A",), ("Z",)], "entity string"), spec)
    agg = wells.aggregate_wells(_wells(spark, [("2002-11-01", 12), ("2003-05-01", 12), ("2003-08-01", 3)]), "lvl", spec)
    out = wells.well_features(grid, agg, wells.fit_well_climatology(agg, spec), spec).toPandas().set_index(["entity", "date"])
    get = lambda e, d: out.loc[(e, pd.Timestamp(d).date())]
    assert str(get("A", "2003-01-01")["last_gw_obs_date"]) == "2002-11-01"
    assert (get("A", "2003-01-01")["months_since_last_gw_obs"], get("A", "2003-04-01")["groundwater_stale_flag"]) == (2, 1)
    assert (get("A", "2003-06-01")["months_since_last_gw_obs"], get("A", "2003-06-01")["groundwater_stale_flag"]) == (1, 0)
    assert (get("A", "2003-09-01")["months_since_last_gw_obs"], get("A", "2003-09-01")["groundwater_stale_flag"]) == (4, 1)
    assert (get("A", "2003-08-01")["groundwater_low_sample_flag"], get("A", "2003-08-01")["groundwater_n_wells"]) == (1, 3)
    never = get("Z", "2003-01-01")
    assert (never["months_since_last_gw_obs"], never["groundwater_as_of_depth_m_bgl"], never["groundwater_anomaly_m_bgl"]) == (999, 10.0, 0.0)


def test_carry_is_causal(spark, spec):
    grid = calendar.build_calendar(spark.createDataFrame([("A",)], "entity string"), spec)
    agg = wells.aggregate_wells(_wells(spark, [("2003-10-01", 12)]), "lvl", spec)
    out = wells.carry_observations(grid, agg, wells.fit_well_climatology(agg, spec), spec)
    assert out.where("date < '2003-10-01' and last_gw_obs_date is not null").count() == 0
    assert out.where("date >= '2003-10-01' and last_gw_obs_date is null").count() == 0


def test_coverage_against_a_plain_loop(spark, spec):
    rng = np.random.default_rng(9)
    grid = calendar.build_calendar(spark.createDataFrame([("A",), ("B",), ("Z",)], "entity string"), spec)
    rows = [(e, d, int(rng.integers(0, 16))) for e in "AB" for d in months("2003-01-01", 72)]
    agg = spark.createDataFrame([x for x in rows if x[2]], "entity string, obs_date date, n_wells long")
    got = {r["entity"]: r for r in wells.well_coverage(grid, agg, spec).collect()}
    n = {(e, d): k for e, d, k in rows}
    ages_all = []
    for e in "ABZ":
        seen, age, gap, top, ages = False, 0, 0, 0, []
        for d in months("2003-01-01", 72):
            if n.get((e, d), 0) >= 10:
                seen, age, top, gap = True, 0, max(top, gap), 0
            else:
                gap, age = gap + 1, age + 1 if seen else 1
            ages.append(age)
        ages_all += ages
        assert (got[e]["max_gap_months"], got[e]["mean_age_months"]) == (top, pytest.approx(np.mean(ages)))
    assert got[None]["mean_age_months"] == pytest.approx(np.mean(ages_all))
    sens = {r["min_wells_threshold"]: r["qualifying_count"] for r in wells.well_sensitivity(grid, agg, spec).collect()}
    assert sens == {t: sum(k >= t for k in n.values()) for t in (5, 10, 15)}


def test_index_and_classes(spark, spec):
    values = (1.2, 1.5, 0.9, 1.8, 2.1, 0.9)
    row = index.add_index(spark.createDataFrame([values], list(COMPONENTS)), spec).first()
    assert (row["wsi"], row["wsi_category"]) == (pytest.approx(1.4), "Moderate Stress")
    edges = [(-1.51, "Very Wet"), (-1.5, "Wet"), (-0.5, "Normal"), (0.49, "Normal"), (0.5, "Moderate Stress"), (1.49, "Moderate Stress"), (1.5, "Severe Stress"), (None, "Unknown")]
    df = spark.createDataFrame([(v,) for v, _ in edges], "v double")
    assert [r[0] for r in df.select(index.classify("v")).collect()] == [c for _, c in edges]
    with pytest.raises(KeyError):
        index.add_index(spark.createDataFrame([(1.0,)], ["spi_stress_z"]), spec)
    holey = spark.createDataFrame([(None, *values[1:])], ", ".join(f"{c} double" for c in COMPONENTS))
    with pytest.raises(Exception, match="index component is missing"):
        index.add_index(holey, spec).collect()
    assert index.add_index(holey, spec, strict=False).first()["wsi_category"] == "Unknown"


def test_audits_pass_and_fail(spark, spec, panel):
    full = calendar.add_splits(panel, spec).withColumns(
        {"last_gw_obs_date": F.col("date"), "months_since_last_gw_obs": F.lit(0), "groundwater_stale_flag": F.lit(0)}
    )
    events = panel.orderBy(F.desc("wsi")).limit(1).select("entity", "date")
    good = audit.full_suite(full, full, full, spec, events)
    assert good.where("not passed").count() == 0
    audit.require_passed(good)
    broken = full.where("date <> '2004-02-01'").withColumn("wsi", F.col("wsi") + 1e-9).withColumn(
        "groundwater_stale_flag", F.when(F.col("date") == "2005-05-01", 1).otherwise(0)
    )
    report = audit.full_suite(broken, broken, full, spec, entities=full)
    failed = {r["check"] for r in report.where("not passed").collect()}
    assert failed == {"calendar_and_shape", "wsi_mathematical_exactness", "groundwater_causality_and_staleness", "overall", "model_audit_parity"} or failed >= {
        "calendar_and_shape", "wsi_mathematical_exactness", "groundwater_causality_and_staleness", "overall"}
    with pytest.raises(ValueError):
        audit.require_passed(report)
    contract = audit.panel_contract(broken, ["wsi"], spec).first()
    assert not contract["passed"] and contract["measures"]["continuity_breaks"] == "3"


def test_digest_tree_tells_a_change_and_its_place(spark):
    """Order and partitioning do not matter; a changed, added or repeated row shows in its leaf and all above."""
    import hashlib

    rows = [(i, f"a|{i}", i / 8, None if i % 5 else True) for i in range(0, 40_000, 7)]
    schema = "k bigint, s string, v double, b boolean"
    full = spark.createDataFrame(rows, schema)

    def tree(df):
        return audit.fingerprint(df, "k", leaf=100)

    first = tree(full)
    got = {(r["level"], r["node"]): (r["n_rows"], r["content_hash"]) for r in first.collect()}
    assert got == {(r["level"], r["node"]): (r["n_rows"], r["content_hash"]) for r in tree(full.repartition(7)).collect()}
    top = max(level for level, _ in got)
    assert [k for k in got if k[0] == top] == [(top, 0)] and got[top, 0][0] == len(rows) and top == 3

    def text(v):
        return "~" if v is None else f"{len(v)}={v}"

    halves = [hashlib.md5("|".join([text(str(k)), text(s), text(str(int(v * 1e6 + 0.5))), text(None if b is None else "1")]).encode()).hexdigest() for k, s, v, b in rows]
    sums = [sum(int(h[i : i + 16], 16) for h in halves) % 2**64 for i in (0, 16)]
    assert got[top, 0][1] == f"{sums[0]}:{sums[1]}"
    assert audit.changed_ranges(first, tree(full.repartition(3))).count() == 0
    changed = full.withColumn("v", F.when(F.col("k") == 707, 1e6).otherwise(F.col("v"))).unionByName(full.where("k = 21000")).unionByName(
        spark.createDataFrame([(None, "no key", 1.0, False), (90_000, "new", 1.0, False)], schema)
    )
    found = {(r["first_key"], r["last_key"], r["before_rows"], r["after_rows"]) for r in audit.changed_ranges(first, tree(changed), leaf=100).collect()}
    assert found == {(700, 799, 15, 15), (21000, 21099, 15, 16), (90000, 90099, 0, 1), (None, None, 0, 1)}
    assert audit.fingerprint(full.limit(0), "k").count() == 0
