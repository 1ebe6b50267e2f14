import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelstress.operators import backtest, boosting, forecast, metrics, residual, significance
from panelstress.operators import sequences as seq
from panelstress.plans.baselines import run_baselines
from panelstress.spec import COMPONENTS


@pytest.fixture(scope="module")
def sequences(panel, spec):
    return seq.add_sequence_ids(seq.build_sequences(panel, spec), spec).cache()


def wide(pdf):
    return np.stack([np.vstack(x) for x in pdf["x"]]).reshape(len(pdf), -1), np.stack(pdf["y"].to_numpy())


def closed_form(x, y, alpha):
    mu, sd = x.mean(0), x.std(0)
    z = (x - mu) / sd
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean(0)))
    return lambda q: (q - mu) / sd @ w + y.mean(0)


def test_sequence_contract(sequences, panel, spec):
    counts = {r["split"]: r for r in seq.sequence_report(sequences, spec).collect()}
    assert {k: v["sequences"] for k, v in counts.items()} == {"train": 3 * 22, "val": 3 * 16, "test": 3 * 16}
    assert all(v["broken_months"] == v["bad_shapes"] == v["non_finite"] == 0 for v in counts.values())
    assert str(counts["train"]["last_target"]) == "2005-12-01" and str(counts["val"]["first_target"]) == "2006-01-01"
    check = seq.verify_values(sequences, panel, spec).first()
    assert check["unmatched"] == 0 and check["max_input_diff"] < 1e-6 and check["input_steps"] == 162 * 12


def test_sequence_ids_are_dense_and_ordered(sequences):
    rows = sequences.orderBy("entity", "forecast_origin").select("sequence_id").collect()
    assert [r[0] for r in rows] == [f"{i:06d}" for i in range(1, 163)]


def test_histories_and_missing_months(spark, sequences, panel, spec):
    meta = sequences.select("sequence_id", "entity", "input_start", "input_end")
    stored = {r["sequence_id"]: r["wsi_history"] for r in sequences.select("sequence_id", "wsi_history").collect()}
    assert {r["sequence_id"]: r["wsi_history"] for r in seq.index_histories(panel, meta, spec).collect()} == stored
    with pytest.raises(Exception, match="incomplete index history"):
        seq.index_histories(panel.where("date <> '2004-05-01'"), meta, spec).collect()


def test_residual_identity(sequences, panel, spec):
    res = residual.add_residual_targets(sequences, spec)
    assert all(r["passed"] and r["duplicate_ids"] == 0 for r in residual.residual_report(res, spec).collect())
    joined = residual.origin_index(panel, sequences, spec).join(sequences.select("sequence_id", F.col("wsi_at_origin").alias("w")), "sequence_id")
    assert joined.where("w <> wsi_at_origin").count() == 0
    with pytest.raises(Exception, match="no single index value"):
        residual.origin_index(panel.unionByName(panel), sequences, spec).collect()


@pytest.mark.parametrize("kind", ["history", "step_means", "features", "features_state"])
def test_ridge_equals_the_closed_form(sequences, spec, kind):
    x, width = forecast.ridge_inputs(kind, spec)
    fit = forecast.fit_ridge(sequences, x, F.col("y"), width, 3)
    pdf = sequences.select("split", x.cast("array<double>").alias("v"), "y").toPandas()
    part = {s: (np.stack(g["v"]), np.stack(g["y"]).astype(float)) for s, g in pdf.groupby("split")}
    scores = {a: np.abs(closed_form(*part["train"], a)(part["val"][0]) - part["val"][1]).mean() for a in fit.scores}
    assert fit.scores == pytest.approx(scores, abs=1e-8)
    assert fit.alpha == min(scores, key=scores.get)
    both = [np.concatenate([part["train"][i], part["val"][i]]) for i in (0, 1)]
    expected = closed_form(*both, fit.alpha)(part["test"][0])
    got = forecast.ridge_predict(seq.of_splits(sequences, "test"), kind, fit.final_model, spec).select("pred").toPandas()
    assert np.allclose(np.sort(np.stack(got["pred"]).ravel()), np.sort(expected.ravel()), atol=1e-5)


def test_persistence_and_seasonal(sequences, panel, spec):
    rows = forecast.persistence(sequences, spec).select("pred", "wsi_at_origin").collect()
    assert all(r["pred"] == [pytest.approx(r["wsi_at_origin"], abs=1e-6)] * 3 for r in rows)
    lookup = {(r["entity"], str(r["date"])): r["wsi"] for r in panel.collect()}
    holes = panel.where("date <> '2006-04-01'")
    out = forecast.seasonal_persistence(sequences, holes, spec).where("forecast_origin = '2007-03-01'").collect()
    for r in out:
        assert r["pred"][0] == pytest.approx(np.mean(r["x"][0]), abs=1e-6)  # April 2006 is missing
        assert r["pred"][1] == pytest.approx(lookup[(r["entity"], "2006-05-01")], abs=1e-6)
    for r in forecast.seasonal_persistence(sequences.limit(3), None, spec).collect():
        assert r["pred"] == pytest.approx([np.mean(r["x"][h]) for h in range(3)], abs=1e-6)


def test_boosted_trees_choose_by_validation(sequences, spec):
    candidates = forecast.TREE_CANDIDATES
    fit = forecast.fit_trees(sequences, spec, rounds=4)
    assert [m.booster.target for m in fit.models] == [0, 1, 2] and len(fit.candidates) == 9
    for h, model in enumerate(fit.models):
        maes = [m.absolute[len(m.trees) - 1] for m in fit.candidates if m.booster.target == h]
        assert model.booster.setting == candidates[int(np.argmin(maes))]
        assert len(model.trees) == 1 + int(np.argmin(model.errors))
    val = seq.of_splits(sequences, "val")
    rows = forecast.tree_predict(val, fit.models).select("pred", "y").collect()
    assert len(rows) == val.count()
    for h, model in enumerate(fit.models):
        mae = np.mean([abs(r["pred"][h] - r["y"][h]) for r in rows])
        assert mae == pytest.approx(model.absolute[len(model.trees) - 1], abs=1e-5)
    refitted = forecast.refit_trees(sequences, spec, fit)
    assert [len(m.trees) for m in refitted] == fit.rounds
    unvalidated = forecast.fit_trees(seq.of_splits(sequences, "train"), spec, rounds=2)
    assert all(m.booster.setting == candidates[0] and len(m.trees) == 2 for m in unvalidated.models)


def test_baseline_suite(sequences, panel, spec):
    val, test, chosen = run_baselines(sequences, panel, spec, trees=True, rounds=2)
    assert val.count() == 5 * 48 * 3 and test.count() == 5 * 48 * 3
    assert set(chosen) == {"WSI_Autoregression", "Ridge_Regression"}
    champion = forecast.choose_champion(val).first()
    means = val.groupBy("model").agg(F.avg("absolute_error").alias("m")).orderBy("m").first()
    assert champion["champion"] == means["model"]


def _brute_backtest(pdf, origin, spec):
    """Plain numpy: standardise, window and fit at one origin."""
    t = pd.Timestamp(origin)
    xs, ys, lags, now = [], [], [], {}
    for e, g in pdf[pd.to_datetime(pdf["date"]) <= t].groupby("entity"):
        f = g[list(COMPONENTS)].to_numpy()
        f = (f - f.mean(0)) / f.std(0)
        w = g["wsi"].to_numpy(np.float32).astype(float)
        for i in range(11, len(g) - 3):
            xs.append(f[i - 11 : i + 1].ravel())
            ys.append(w[i + 1 : i + 4])
            lags.append(w[i - 11 : i + 1])
        now[e] = (f[-12:].ravel(), w[-12:])
    models = {"Ridge_Regression": closed_form(np.array(xs), np.array(ys), 1.0), "WSI_Autoregression": closed_form(np.array(lags), np.array(ys), 1.0)}
    return {(m, e): models[m](v[i][None])[0] for e, v in now.items() for i, m in enumerate(("Ridge_Regression", "WSI_Autoregression"))}


def test_backtest_against_brute_force(panel, panel_pdf, spec):
    origins = ["2006-02-01", "2007-09-01", "2008-11-01"]
    out = backtest.rolling_backtest(panel, origins, spec).toPandas()
    assert len(out) == 4 * 3 * (3 + 3 + 1)  # only one horizon has a known target at the last origin
    for origin in origins:
        expected = _brute_backtest(panel_pdf, origin, spec)
        for r in out[out["forecast_origin"].astype(str) == origin].itertuples():
            if (r.model, r.entity) in expected:
                assert r.predicted_wsi == pytest.approx(expected[(r.model, r.entity)][int(r.horizon[1]) - 1], abs=5e-6)


def test_origins_without_training_windows_are_left_out(panel, spec):
    out = backtest.rolling_backtest(panel, ["2003-12-01", "2004-06-01"], spec)
    assert [str(r[0]) for r in out.select("forecast_origin").distinct().collect()] == ["2004-06-01"]


def test_moments_survive_empty_partitions(sequences, spec):
    x, width = forecast.ridge_inputs("history", spec)
    few = sequences.orderBy("position").limit(60).repartition(64)
    assert forecast.fit_moments(few, x, F.col("y"), width, 3)["train"].gram[0, 0] == few.where("split = 'train'").count()


def test_backtest_is_causal(panel, spec):
    changed = panel.withColumns({c: F.when(F.col("date") > "2006-02-01", F.col(c) + 100).otherwise(F.col(c)) for c in (*COMPONENTS, "wsi")})
    key = ["model", "entity", "horizon"]
    a, b = (backtest.rolling_backtest(p, ["2006-02-01"], spec).select(*key, "predicted_wsi").toPandas().sort_values(key, ignore_index=True) for p in (panel, changed))
    pd.testing.assert_frame_equal(a, b)


def test_causal_sequences_bounds(panel, spec):
    rows = seq.causal_sequences(panel, ["2006-02-01"], spec)
    assert str(rows.where("role = 'train'").agg(F.max("forecast_origin")).first()[0]) == "2005-11-01"
    assert rows.where("role = 'current'").count() == 3 and rows.where("forecast_origin > '2006-02-01'").count() == 0


def _windows_at(pdf, origin):
    """Plain numpy: standardised training windows, their targets, and the current windows at one origin."""
    xs, ys, now = [], [], {}
    for e, g in pdf[pd.to_datetime(pdf["date"]) <= pd.Timestamp(origin)].groupby("entity"):
        f = g[list(COMPONENTS)].to_numpy()
        f = ((f - f.mean(0)) / f.std(0)).astype(np.float32)
        w = g["wsi"].to_numpy(np.float32)
        for i in range(11, len(g) - 3):
            xs.append(f[i - 11 : i + 1].ravel())
            ys.append(w[i + 1 : i + 4])
        now[e] = f[-12:].ravel()
    return np.array(xs), np.array(ys), now


def test_causal_sequences_equal_numpy(panel, panel_pdf, spec):
    origins = ["2004-01-01", "2006-02-01", "2007-09-01", "2003-05-01"]  # the last one is too early for a window
    rows = seq.causal_sequences(panel, origins, spec).toPandas()
    assert set(rows["origin"].astype(str)) == set(origins[:3])
    for origin in origins[:3]:
        x, y, now = _windows_at(panel_pdf, origin)
        mine = rows[rows["origin"].astype(str) == origin].sort_values(["entity", "forecast_origin"])
        train, current = mine[mine["role"] == "train"], mine[mine["role"] == "current"]
        assert len(train) == len(x)
        if len(x):
            assert np.allclose(np.stack([np.concatenate(v) for v in train["x"]]), x, atol=1e-5)
            assert np.array_equal(np.stack(train["y"]).astype(np.float32), y)
        assert np.allclose(np.stack([np.concatenate(v) for v in current["x"]]), np.stack([now[e] for e in current["entity"]]), atol=1e-5)
        assert current["y"].isna().all()


def test_expanding_z_holds_the_last_moments_between_months(panel, panel_pdf, spec):
    holes = panel.where("date <> '2006-02-01'")
    z = seq.expanding_z(holes, ["2006-02-01"], spec).where("entity = 'A'").toPandas().sort_values("date")
    g = panel_pdf[(panel_pdf["entity"] == "A") & (pd.to_datetime(panel_pdf["date"]) < "2006-02-01")]
    c = COMPONENTS[0]
    assert np.allclose(z[c], (g[c] - g[c].mean()) / g[c].std(ddof=0)) and len(z) == len(g)
    rows = seq.causal_sequences(holes, ["2006-02-01"], spec).where("entity = 'A'")
    assert rows.where("role = 'current'").count() == 0 and str(rows.agg(F.max("forecast_origin")).first()[0]) == "2005-11-01"
    assert rows.where("forecast_origin = '2005-11-01'").first()["y"][2] is None  # its third month ahead is not known at the origin


def test_backtest_trees_of_all_origins(panel, panel_pdf, spec):
    origins = ["2003-12-01", "2006-02-01", "2007-09-01"]  # no training window is known at the first
    out = backtest.backtest_trees(panel, origins, spec, rounds=3).toPandas()
    assert len(out) == 2 * 9 and set(out["model"]) == {"Boosted_Trees"}
    from panelstress.operators import boosting as bo

    for origin in origins[1:]:  # alone, from the same windows made by numpy, an origin gives the same forecasts
        x, y, now = _windows_at(panel_pdf, origin)
        rows = [(0, False, i, a.astype(float).tolist(), b.astype(float).tolist()) for i, (a, b) in enumerate(zip(x, y))]
        df = panel.sparkSession.createDataFrame(rows, "group int, is_val boolean, id bigint, x array<double>, y array<double>")
        models = bo.fit_boosters(df, [bo.Booster(0, h, backtest.BACKTEST_TREES) for h in range(3)], rounds=3)
        for r in out[out["forecast_origin"].astype(str) == origin].itertuples():
            model = models[int(r.horizon[1]) - 1]
            assert r.predicted_wsi == pytest.approx(model.predict(bo.binned(now[r.entity][None].astype(float), model.edges))[0], abs=2e-3)
    both = backtest.rolling_backtest(panel, origins[1:2], spec, models=("ridge", "trees"), rounds=2)
    assert both.select("model").distinct().count() == 5


def test_backtest_trees_of_packed_windows(panel, spec, monkeypatch):
    """All windows of all origins were written and every level was a job; months are now sent once per origin, and growing is one job."""
    origins = ["2003-12-01", "2006-02-01", "2007-09-01", "2008-11-01"]
    odd = panel.where("entity <> 'A' OR date <> '2006-01-01'").withColumn(COMPONENTS[1], F.when(F.col("date") != "2004-05-01", F.col(COMPONENTS[1])))
    sc, found, jobs = panel.sparkSession.sparkContext, {}, {}
    for name, rounds, most in (("packed", 4, boosting.ALONE_BYTES), ("short", 1, boosting.ALONE_BYTES), ("rows", 4, 0), ("mixed", 4, 120 * 72)):
        for input_name, rows in (("whole", panel), ("odd", odd)):
            monkeypatch.setattr(boosting, "ALONE_BYTES", most)
            sc.setJobGroup(name + input_name, name)
            out = backtest.backtest_trees(rows, origins, spec, rounds).orderBy("entity", "forecast_origin", "horizon").collect()
            found[name, input_name], jobs[name, input_name] = out, len(sc.statusTracker().getJobIdsForGroup(name + input_name))
    sc.setJobGroup("", "")
    for input_name in ("whole", "odd"):
        assert jobs["packed", input_name] == jobs["short", input_name] < jobs["rows", input_name]
        assert str(found["packed", input_name]) == str(found["rows", input_name]) == str(found["mixed", input_name])
    assert len(found["packed", "whole"]) == 3 * (3 + 3 + 1)
    series = seq.causal_series(odd, origins, spec)
    counts = seq.cut_windows(series, spec, "train").groupBy(F.col("origin").cast("string")).count().collect()
    assert seq.count_windows(series, origins, spec) == {r[0]: r[1] for r in counts}


# ---- metrics ---------------------------------------------------------------------------------

def long(spark, rows):
    """rows: (model, entity, origin, horizon, actual, predicted)"""
    df = spark.createDataFrame(rows, "model string, entity string, forecast_origin string, horizon string, a double, p double")
    return df.withColumn("forecast_origin", F.col("forecast_origin").cast("date")).withColumns(forecast.error_columns(F.col("a"), F.col("p"))).drop("a", "p")


def test_scores_by_hand(spark, spec):
    df = long(spark, [("m", "A", "2020-01-01", f"h{i % 3 + 1}", float(i), float(i + 1)) for i in range(1, 5)])
    row = metrics.metrics_table(df, spec).first()
    assert (row["overall_mae"], row["overall_r2"], row["overall_nrmse"]) == (1.0, 0.2, round(1 / np.sqrt(1.25), 4))
    assert row["skill_mae_vs_persistence"] == 0.0  # no reference model: its error counts as 1
    flat = metrics.metrics_table(long(spark, [("m", "A", "2020-01-01", "h1", 2.0, 1.0)] * 2), spec).first()
    assert flat["overall_r2"] == 0.0 and flat["overall_nrmse"] == 0.0


def test_skill_against_the_reference(spark, spec):
    rows = [("Persistence", "A", "2020-01-01", "h1", 0.0, 0.4), ("m", "A", "2020-01-01", "h1", 0.0, 0.1)]
    table = {r["model"]: r for r in metrics.metrics_table(long(spark, rows), spec).collect()}
    assert (table["m"]["skill_mae_vs_persistence"], table["Persistence"]["skill_mae_vs_persistence"]) == (0.75, 0.0)


def test_events(spark):
    values = [(0.6, 0.7), (0.8, 0.9), (1.0, 0.2), (0.1, 0.0)]
    df = long(spark, [("m", "A", "2020-01-01", "h1", a, p) for a, p in values])
    row = metrics.event_metrics(df).where("horizon = 'overall'").first()
    assert (row["stress_precision"], row["stress_recall"], row["stress_f1"]) == (1.0, 0.6667, 0.8)
    assert (row["severe_precision"], row["severe_status"], row["actual_severe_count"]) == (None, "not_estimable", 0)
    assert metrics.confusion_counts(df, "m").first()[1:] == (2, 0, 1, 1)


def test_all_regimes_appear(spark):
    got = {r["regime"]: r["sample_count"] for r in metrics.regime_metrics(long(spark, [("m", "A", "2020-01-01", "h1", 0.6, 0.7)])).collect()}
    assert got == {"Very Wet": 0, "Wet": 0, "Normal": 0, "Moderate Stress": 1, "Severe Stress": 0}


def test_earliest_best_epoch(spark):
    df = spark.createDataFrame([("r", i + 1, v) for i, v in enumerate([0.5, 0.45, 0.4 + 1e-9, 0.4, 0.41])], "run string, epoch int, val_mae double")
    assert metrics.earliest_best_epoch(df).first()["best_epoch"] == 3


@pytest.mark.parametrize("challenger, expected", [([0.40, 0.41], "challenger improves"), ([0.40, 0.70], "gain fails stability check"),
                                                  ([0.5005, 0.5], "approximately equal"), ([0.6, 0.6], "challenger is worse")])
def test_decisions(spark, challenger, expected):
    rows = [("b", "1", 0.50), ("b", "2", 0.52), *[("c", str(i + 1), v) for i, v in enumerate(challenger)]]
    out = metrics.experiment_decision(spark.createDataFrame(rows, "experiment string, run string, val_mae double"), "b", "c", "1").first()
    assert out["decision"] == expected


def test_bootstrap_of_constant_errors(spark):
    origins = [d.date().isoformat() for d in pd.date_range("2020-01-01", periods=12, freq="MS")]
    rows = [(m, e, o, "h1", 0.0, v) for m, v in (("bad", 0.3), ("good", 0.1)) for e in "AB" for o in origins]
    row = significance.block_bootstrap(long(spark, rows), "good", replicates=50).first()
    assert (row["observed_mae_diff"], row["ci_95_lower"], row["bootstrap_p_value"], row["significantly_different"]) == (0.2, 0.2, 0.0, True)
    short = significance.block_bootstrap(long(spark, [r for r in rows if r[2] <= "2020-03-01"]), "good", replicates=5).first()
    assert short["error"] and short["ci_95_lower"] is None
    single = significance.significance_table(long(spark, [r for r in rows if r[0] == "bad"]), long(spark, rows), ("good",), replicates=5).first()
    assert (single["candidate_model"], single["champion_model"]) == ("bad", "good")


@pytest.mark.parametrize("size, blocks, seed", [(10, 4, 42), (1, 2, 42), (34, 12, 7)])
def test_stream_draws_equal_numpy(spark, size, blocks, seed, monkeypatch):
    monkeypatch.setattr(significance, "_CHUNK", 64)
    replicates, length = 50, 3
    origins = size + length - 1
    rng = np.random.default_rng(seed)
    blocks = -(-origins // length)
    expected = [rng.integers(0, size, size=blocks).tolist() for _ in range(replicates)]
    observed = spark.createDataFrame([("m", origins)], "candidate_model string, origins bigint")
    got = [[] for _ in range(replicates)]
    for r in significance.stream_draws(observed, seed, replicates, length).collect():
        got[r["replicate"]].append(r["start"])
    assert [sorted(g) for g in got] == [sorted(e) for e in expected]


def test_values_passed_over_shift_the_rest():
    size = 3 * 2**30  # a quarter of the outputs is passed over
    values, drawn = significance._lemire(5, 0, 400, size)
    rng = np.random.default_rng(5)
    assert values[drawn][:200].tolist() == rng.integers(0, size, size=200).tolist() and 40 < (~drawn).sum() < 160
    tail, kept = significance._lemire(5, 101, 99, size)
    assert tail.tolist() == values[101:200].tolist() and kept.tolist() == drawn[101:200].tolist()


def test_bootstrap_with_numpy_draws(spark):
    origins = [d.date().isoformat() for d in pd.date_range("2020-01-01", periods=20, freq="MS")]
    rng = np.random.default_rng(0)
    errors = {m: rng.normal(size=(20, 2)) for m in ("good", "bad")}
    rows = [(m, e, o, "h1", 0.0, float(errors[m][i, j])) for m in errors for i, o in enumerate(origins) for j, e in enumerate("AB")]
    row = significance.block_bootstrap(long(spark, rows), "good", replicates=200, generator="pcg64").first()
    gen, diffs = np.random.default_rng(42), []
    loss = {m: np.round(np.abs(v), 6) for m, v in errors.items()}
    for _ in range(200):
        at = [s + b for s in gen.integers(0, 18, size=7) for b in range(3)]
        diffs.append(loss["bad"][at].mean() - loss["good"][at].mean())
    assert row["ci_95_lower"] == pytest.approx(np.percentile(diffs, 2.5), abs=1.1e-5)
    assert row["ci_95_upper"] == pytest.approx(np.percentile(diffs, 97.5), abs=1.1e-5)


def test_density_is_close_to_the_exact_one(spark):
    rng = np.random.default_rng(3)
    samples = {"a": rng.normal(size=700), "b": np.concatenate([rng.normal(size=300), [40.0, -25.0]]), "one": np.array([1.0]), "flat": np.full(9, 2.0)}
    rows = [(k, float(v)) for k, values in samples.items() for v in values] + [("a", None), ("a", float("nan")), (None, 1.0), (None, 3.0)]
    got = metrics.density(spark.createDataFrame(rows, "model string, error double").repartition(5), ["model"], "error").toPandas()
    assert {None if not isinstance(k, str) else k for k in got["model"].unique()} == {"a", "b", None}
    for key in ("a", "b"):
        v, curve = samples[key], got[got["model"] == key].sort_values("point")
        h = v.std(ddof=1) * len(v) ** -0.2
        x = np.linspace(v.min() - 3 * h, v.max() + 3 * h, 200)
        exact = np.exp(-0.5 * ((x[:, None] - v) / h) ** 2).sum(axis=1) / (len(v) * h * np.sqrt(2 * np.pi))
        found = np.zeros(200)
        found[curve["point"]] = curve["density"]
        assert np.allclose(curve["x"], x[curve["point"]]) and np.abs(found - exact).max() < 1e-3 * exact.max()


@pytest.mark.parametrize("h, loss", [(1, "absolute"), (3, "absolute"), (2, "squared")])
def test_diebold_mariano_against_numpy(spark, h, loss):
    rng = np.random.default_rng(h)
    e1, e2 = rng.normal(0, 1.3, 200), rng.normal(size=200)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(e1, e2))], "pos long, e1 double, e2 double")
    got = significance.diebold_mariano(df, "e1", "e2", "pos", h, loss=loss).first()
    d = e1**2 - e2**2 if loss == "squared" else np.abs(e1) - np.abs(e2)
    var = d.var() + sum(2 * (1 - k / h) * np.mean((d[k:] - d.mean()) * (d[:-k] - d.mean())) for k in range(1, h))
    from statistics import NormalDist

    stat = d.mean() / np.sqrt(var / len(d))
    assert got["dm_stat"] == pytest.approx(stat, abs=1e-4)
    assert got["p_value"] == pytest.approx(2 * (1 - NormalDist().cdf(abs(stat))), abs=1e-4)
    same = significance.diebold_mariano(df, "e1", "e1", "pos", h).first()
    assert (same["dm_stat"], same["p_value"]) == (0.0, 1.0)


def test_patience_keeps_the_best_round_met_in_time():
    from panelstress.operators import boosting as bo

    def kept(errors):
        state = bo._Growing(bo.BoostedModel(bo.Booster(0, 0, bo.TreeSetting()), 0.0, np.zeros((1, 1))), 0, 1, 1000, forecast.TREE_PATIENCE)
        for error in errors:
            if state.done:
                break
            state.model.trees.append(bo.Tree.empty(1))
            state.judge(np.array([2 * error, 0.0, 2.0]))
        return len(state.kept().trees)

    assert kept([3.0, 2.0, 2.5, 1.0]) == 4
    assert kept([3.0, 2.0] + [2.5] * 14 + [1.0]) == 17
    assert kept([3.0, 2.0] + [2.5] * 15 + [1.0]) == 2
    assert kept([]) == 0


@pytest.mark.parametrize("constant, mean", [(0.1, 0.0), (0.3, 1e7), (7.7, 1e7)])
def test_ridge_with_constant_and_large_columns(spark, constant, mean):
    rng = np.random.default_rng(5)
    x = np.stack([np.full(400, constant), mean + rng.normal(size=400), rng.normal(size=400)], axis=1)
    y = (3.0 * (x[:, 1:2] - mean) - 2.0 * x[:, 2:3]) + 0.01 * rng.normal(size=(400, 1))
    df = spark.createDataFrame([("train", a.tolist(), b.tolist()) for a, b in zip(x, y, strict=True)], "split string, x array<double>, y array<double>").repartition(5)
    model = forecast.solve_ridge(forecast.fit_moments(df, F.col("x"), F.col("y"), 3, 1)["train"], 1.0)
    z = (x - x.mean(axis=0)) / np.array([1.0, x[:, 1].std(), x[:, 2].std()])
    z[:, 0] = 0.0
    w = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y - y.mean()))[:, 0] / np.array([1.0, x[:, 1].std(), x[:, 2].std()])
    assert abs(model.coefficients[0, 0]) < 1e-9
    assert model.coefficients[1:, 0] == pytest.approx(w[1:], rel=1e-6)


def test_causal_sequences_cut_windows_without_exploding_them(panel, spec):
    """Windows were copied and standardised element by element for every origin; nulls keep their place."""
    holes = panel.withColumns({
        "wsi": F.when((F.col("entity") == "B") & (F.col("date") == "2004-06-01"), None).otherwise(F.col("wsi")),
        "spi_stress_z": F.when((F.col("entity") == "B") & (F.col("date") == "2004-03-01"), None).otherwise(F.col("spi_stress_z")),
    })
    rows = seq.causal_sequences(holes, ["2004-06-01", "2005-01-01"], spec)
    assert "MapInArrow" in rows._jdf.queryExecution().executedPlan().toString()
    got = {(r["entity"], str(r["origin"]), str(r["forecast_origin"])): r for r in rows.collect()}
    last = got["B", "2004-06-01", "2004-06-01"]
    assert last["role"] == "current" and last["y"] is None and len(last["wsi_history"]) == 11
    assert [step[0] is None for step in last["x"]].index(True) == 8 and None not in last["x"][7]
    train = got["B", "2005-01-01", "2004-04-01"]
    assert train["role"] == "train" and train["y"][1] is None and None not in (train["y"][0], train["y"][2])
    assert len(got["A", "2005-01-01", "2004-04-01"]["wsi_history"]) == 12


def test_value_check_compares_inside_the_row(sequences, panel, spec):
    """Every step and target was a row of its own in the join with the panel."""
    from datetime import date

    missing = panel.where(~((F.col("entity") == "A") & (F.col("date") == F.lit(date(2004, 3, 1)))))
    out = seq.verify_values(sequences, missing, spec)
    assert "Generate" not in out._jdf.queryExecution().optimizedPlan().toString()
    n = sequences.count()
    a = sequences.where("entity = 'A'")
    hit = a.where("DATE '2004-03-01' BETWEEN input_start AND target_t3").count()
    row = out.first()
    assert (row["input_steps"], row["targets"], row["unmatched"]) == (n * spec.lookback, n * spec.horizon, hit)


def test_linear_forecasts_are_one_product_per_batch(spark):
    """Values equal numpy, missing inputs give null, and no lambda runs per input and target."""
    model = forecast.RidgeModel(1.0, np.array([[1.0, -2.0], [0.5, 3.0]]), np.array([0.25, 1.0]))
    rows = [(0, [1.5, 2.0]), (1, None), (2, [1.0, None]), (3, [1.0]), (4, [float("nan"), 1.0]), (5, [-4.0, 0.5])]
    out = spark.createDataFrame(rows, "id int, x array<float>").withColumn("p", forecast.linear_predict(F.col("x"), model))
    found = {r["id"]: r["p"] for r in out.collect()}
    assert found[0] == [2.75, 4.0] and found[5] == [-3.5, 10.5]
    assert found[1] is None and found[2] is None and found[3] is None and np.isnan(found[4]).all()
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
