"""Metrics, skill, events, significance, runs and figure tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import base, forecasts
from catalog.base import SPEC, cte, query, r, rs
from catalog.ctes import classify, normal_cdf
from panelstress.operators import forecast, metrics, significance
from panelstress.operators import sequences as seq

_HS = ("h1", "h2", "h3")
_MODELS = ["Persistence", "Seasonal_Persistence", "WSI_Autoregression", "Ridge_Regression"]


@query("h1_long_predictions", f"""
SELECT evaluation_type, model, sequence_id, entity, forecast_origin, horizon, {rs('actual_wsi', 'predicted_wsi', 'error', 'absolute_error', 'squared_error', digits=4)} FROM c_test
""", digits=4)
def h1(spark, sf_dir):
    """The models that SQL can fit; those of the boosted trees are in g5_boosted_trees."""
    return base.test_predictions(spark, sf_dir)


def at(h: str | None, value: str) -> str:
    return value if h is None else f"{value} FILTER (WHERE horizon = '{h}')"


def mae(h=None):
    return at(h, "avg(absolute_error)")


def rmse(h=None):
    return f"sqrt({at(h, 'avg(squared_error)')})"


def r2(h=None):
    total = f"({at(h, 'var_pop(actual_wsi)')} * {at(h, 'count(actual_wsi)')})"
    return f"CASE WHEN {total} = 0 THEN 0.0 ELSE 1.0 - {at(h, 'sum((actual_wsi - predicted_wsi) * (actual_wsi - predicted_wsi))')} / nullif({total}, 0) END"


def nrmse(h=None):
    std = at(h, "stddev_pop(actual_wsi)")
    return f"CASE WHEN {std} = 0 THEN 0.0 ELSE sqrt({at(h, 'avg((actual_wsi - predicted_wsi) * (actual_wsi - predicted_wsi))')}) / nullif({std}, 0) END"


_OVERALL = f"{mae()} AS overall_mae, {rmse()} AS overall_rmse, {r2()} AS overall_r2, {nrmse()} AS overall_nrmse"
_BY_H = ", ".join(f"{mae(h)} AS mae_{h}, {rmse(h)} AS rmse_{h}, {r2(h)} AS r2_{h}" for h in _HS)
cte("c_metrics0", f"SELECT model, {_OVERALL}, {_BY_H} FROM c_test GROUP BY model")
_SKILLS = ", ".join(
    f"CASE WHEN p.{c} > 0 THEN 1.0 - m.{c} / p.{c} ELSE 0.0 END AS {n}" for c, n in [
        ("overall_mae", "skill_mae_vs_persistence"), ("overall_rmse", "skill_rmse_vs_persistence"),
        *[(f"mae_{h}", f"skill_mae_{h}") for h in _HS]]
)
cte("c_metrics1", f"SELECT m.*, {_SKILLS} FROM c_metrics0 m JOIN c_metrics0 p ON p.model = 'Persistence'")
_METRIC_COLUMNS = ["overall_mae", "overall_rmse", "overall_r2", "overall_nrmse", "skill_mae_vs_persistence", "skill_rmse_vs_persistence",
                   *[f"{c}_{h}" for h in _HS for c in ("mae", "rmse", "r2", "skill_mae")]]
cte("c_metrics", f"SELECT model, {', '.join(f'round({c}, 4) + 0.0 AS {c}' for c in _METRIC_COLUMNS)} FROM c_metrics1")


@query("h2_mae_rmse", f"SELECT model, horizon, {r('avg(absolute_error)', 5)} AS mae, {r('sqrt(avg(squared_error))', 5)} AS rmse FROM c_test GROUP BY model, horizon", digits=5)
def h2(spark, sf_dir):
    return base.test_predictions(spark, sf_dir).groupBy("model", "horizon").agg(
        metrics.mae().alias("mae"), metrics.rmse().alias("rmse")
    )


@query("h3_r2", f"SELECT model, {r(r2(), 5)} AS r2 FROM c_test GROUP BY model", digits=5)
def h3(spark, sf_dir):
    return base.test_predictions(spark, sf_dir).groupBy("model").agg(metrics.r2().alias("r2"))


@query("h4_nrmse", f"SELECT model, {r(nrmse(), 5)} AS nrmse FROM c_test GROUP BY model", digits=5)
def h4(spark, sf_dir):
    return base.test_predictions(spark, sf_dir).groupBy("model").agg(metrics.nrmse().alias("nrmse"))


@query("h5_skill", f"SELECT model, {rs('skill_mae_vs_persistence', 'skill_rmse_vs_persistence', 'skill_mae_h1', 'skill_mae_h2', 'skill_mae_h3', digits=5)} FROM c_metrics1", digits=5)
def h5(spark, sf_dir):
    table = metrics.metrics_table(base.test_predictions(spark, sf_dir), SPEC, digits=None)
    return table.select("model", "skill_mae_vs_persistence", "skill_rmse_vs_persistence", *[f"skill_mae_{h}" for h in _HS])


@query("h6_metrics", f"SELECT model, {rs(*_METRIC_COLUMNS)} FROM c_metrics")
def h6(spark, sf_dir):
    return metrics.metrics_table(base.test_predictions(spark, sf_dir), SPEC)


@query("h7_entity_metrics", f"""
SELECT model, entity, {r(mae(), 4)} AS mae, {r(rmse(), 4)} AS rmse, {r(r2(), 4)} AS r2, {', '.join(f'{r(mae(h), 4)} AS mae_{h}' for h in _HS)}
FROM c_test GROUP BY model, entity
""", digits=4)
def h7(spark, sf_dir):
    return metrics.entity_metrics(base.test_predictions(spark, sf_dir), SPEC, digits=None)


_CLASSES = "['Very Wet', 'Wet', 'Normal', 'Moderate Stress', 'Severe Stress']"


@query("h8_regime_metrics", f"""
SELECT g.model, g.regime, coalesce(n, 0) AS sample_count, {r('coalesce(round(mae, 4), 0.0)')} AS mae, {r('coalesce(round(rmse, 4), 0.0)')} AS rmse
FROM (SELECT model, unnest({_CLASSES}) AS regime FROM (SELECT DISTINCT model FROM c_test)) g LEFT JOIN (
  SELECT model, {classify('actual_wsi', 'NULL')} AS regime, count(*) AS n, {mae()} AS mae, {rmse()} AS rmse FROM c_test GROUP BY ALL) t
  ON t.model = g.model AND t.regime = g.regime
""")
def h8(spark, sf_dir):
    return metrics.regime_metrics(base.test_predictions(spark, sf_dir))


def _counts(t: float, prefix: str) -> str:
    a, p = f"actual_wsi >= {t}", f"predicted_wsi >= {t}"
    return (f"count(*) FILTER (WHERE {a} AND {p}) AS {prefix}tp, count(*) FILTER (WHERE NOT ({a}) AND {p}) AS {prefix}fp, "
            f"count(*) FILTER (WHERE {a} AND NOT ({p})) AS {prefix}fn, count(*) FILTER (WHERE NOT ({a}) AND NOT ({p})) AS {prefix}tn")


def _scores(prefix: str) -> str:
    tp, fp, fn = (f"{prefix}_{c}" for c in ("tp", "fp", "fn"))
    pr = f"(CASE WHEN {tp} + {fp} > 0 THEN {tp} / nullif({tp} + {fp}, 0) ELSE 0.0 END)"
    re = f"(CASE WHEN {tp} + {fn} > 0 THEN {tp} / nullif({tp} + {fn}, 0) ELSE 0.0 END)"
    f1 = f"(CASE WHEN {pr} + {re} > 0 THEN 2.0 * {pr} * {re} / nullif({pr} + {re}, 0) ELSE 0.0 END)"
    seen = f"{tp} + {fn} > 0"
    return ", ".join([
        f"CAST({tp} + {fn} AS BIGINT) AS actual_{prefix}_count",
        *[f"CASE WHEN {seen} THEN {r(f'round({e}, 4)')} END AS {prefix}_{n}" for e, n in ((pr, "precision"), (re, "recall"), (f1, "f1"))],
        f"CASE WHEN {seen} THEN 'estimable' ELSE 'not_estimable' END AS {prefix}_status",
    ])


@query("h9_event_metrics", f"""
SELECT model, coalesce(horizon, 'overall') AS horizon, {_scores('stress')}, {_scores('severe')} FROM (
  SELECT model, horizon, {_counts(0.5, 'stress_')}, {_counts(1.5, 'severe_')} FROM c_test GROUP BY GROUPING SETS ((model, horizon), (model)))
""")
def h9(spark, sf_dir):
    return metrics.event_metrics(base.test_predictions(spark, sf_dir))


@query("h10_confusion", f"SELECT model, {_counts(0.5, '')} FROM c_test WHERE model = 'WSI_Autoregression' GROUP BY model")
def h10(spark, sf_dir):
    return metrics.confusion_counts(base.test_predictions(spark, sf_dir), "WSI_Autoregression")


# ---- significance ----------------------------------------------------------------------------

_L, _B = 3, 1000
cte("c_osum", "SELECT model, forecast_origin, sum(absolute_error) AS s, CAST(count(*) AS DOUBLE) AS n FROM c_test GROUP BY ALL")
cte("c_best_model", "SELECT model FROM (SELECT model, round(avg(absolute_error), 4) AS mae FROM c_test GROUP BY model) ORDER BY mae, model LIMIT 1")


def bootstrap_ctes(tag: str, champion: str) -> str:
    cte(f"c_{tag}_pairs", f"""
SELECT a.model, b.model AS champion, a.forecast_origin, a.s, a.n, b.s AS s2, b.n AS n2,
  row_number() OVER (PARTITION BY a.model ORDER BY a.forecast_origin) - 1 AS idx, count(*) OVER (PARTITION BY a.model) AS origins
FROM c_osum a JOIN c_osum b ON b.forecast_origin = a.forecast_origin AND b.model = {champion} WHERE a.model <> {champion}
""")
    cte(f"c_{tag}_blocks", f"""
SELECT model, idx, {', '.join(f'sum({c}) OVER w AS {c}' for c in ('s', 'n', 's2', 'n2'))} FROM c_{tag}_pairs
WINDOW w AS (PARTITION BY model ORDER BY forecast_origin ROWS BETWEEN CURRENT ROW AND {_L - 1} FOLLOWING)
""")
    cte(f"c_{tag}_obs", f"""
SELECT model, max(champion) AS champion, count(*) AS origins, sum(s) / sum(n) - sum(s2) / sum(n2) AS observed FROM c_{tag}_pairs GROUP BY model
""")
    m, a0 = significance._MODULUS, "(rep * 7919 + blk * 104729 + 42 + 1)"
    cte(f"c_{tag}_draws", f"""
SELECT model, rep, ((((a * (a % 65536 + 1)) % {m}) * {significance._MULTIPLIER}) % {m}) % (origins - {_L} + 1) AS idx FROM (
  SELECT model, origins, rep, (({a0} % {m}) * {significance._MULTIPLIER}) % {m} AS a FROM (
    SELECT model, origins, rep, unnest(range(0, CAST(ceil(origins / {_L}.0) AS BIGINT))) AS blk FROM (
      SELECT model, origins, unnest(range(0, {_B})) AS rep FROM c_{tag}_obs WHERE origins > {_L})))
""")
    cte(f"c_{tag}_boot", f"""
SELECT model, rep, sum(s) / sum(n) - sum(s2) / sum(n2) AS diff FROM c_{tag}_draws JOIN c_{tag}_blocks USING (model, idx) GROUP BY model, rep
""")
    return f"""
SELECT o.model AS candidate_model, o.champion AS champion_model, {r('round(observed, 5)')} AS observed_mae_diff, {r('round(lo, 5)')} AS ci_95_lower,
  {r('round(hi, 5)')} AS ci_95_upper, {r('round(least(1.0, 2.0 * CASE WHEN observed > 0 THEN sl ELSE sh END), 4)')} AS bootstrap_p_value,
  lo > 0 OR hi < 0 AS significantly_different, observed < 0 AND hi < 0 AS candidate_is_better, CAST(NULL AS VARCHAR) AS error
FROM c_{tag}_obs o JOIN (SELECT model, quantile_cont(diff, 0.025) AS lo, quantile_cont(diff, 0.975) AS hi,
  avg(CASE WHEN diff <= 0 THEN 1.0 ELSE 0.0 END) AS sl, avg(CASE WHEN diff >= 0 THEN 1.0 ELSE 0.0 END) AS sh FROM c_{tag}_boot GROUP BY model) b USING (model)
"""


@query("h11_block_bootstrap", bootstrap_ctes("mb", "'Persistence'"))
def h11(spark, sf_dir):
    return significance.block_bootstrap(base.test_predictions(spark, sf_dir), "Persistence")


_DM_ORDER = "OVER (PARTITION BY horizon ORDER BY entity, forecast_origin)"
cte("c_dm", f"""
SELECT *, row_number() {_DM_ORDER} AS pos FROM (
  SELECT a.entity, a.forecast_origin, a.horizon, CAST(substr(a.horizon, 2) AS INTEGER) AS h, abs(a.error) - abs(b.error) AS d FROM c_test a
  JOIN c_test b ON b.sequence_id = a.sequence_id AND b.horizon = a.horizon AND b.model = 'Persistence' WHERE a.model = 'Seasonal_Persistence')
""")
cte("c_dm_lag", """
SELECT *, lag(d, 1) OVER w AS d1, lag(d, 2) OVER w AS d2, avg(d) OVER (PARTITION BY horizon) AS m FROM c_dm WINDOW w AS (PARTITION BY horizon ORDER BY pos)
""")
cte("c_dm_stat", """
SELECT horizon, count(*) AS n, avg(d) / sqrt((var_pop(d) + coalesce(CASE max(h) WHEN 2 THEN 2.0 * (1.0 - 1.0 / 2.0) * avg((d - m) * (d1 - m))
  WHEN 3 THEN 2.0 * (1.0 - 1.0 / 3.0) * avg((d - m) * (d1 - m)) + 2.0 * (1.0 - 2.0 / 3.0) * avg((d - m) * (d2 - m)) END, 0.0)) / count(*)) AS stat FROM c_dm_lag GROUP BY horizon
""")


@query("h12_diebold_mariano", f"""
SELECT horizon, n, {r('round(stat, 4)')} AS dm_stat, {r(f'round(2.0 * (1.0 - ({normal_cdf("z")})), 4)')} AS p_value
FROM (SELECT *, least(abs(stat), 10.0) AS z FROM c_dm_stat)
""")
def h12(spark, sf_dir):
    """Positions count the test sequences in (entity, origin) order."""
    test = seq.of_splits(base.sequences(spark, sf_dir), "test").drop("sequence_id", "position")
    order = seq.add_sequence_ids(test, SPEC).select("entity", "forecast_origin", "position")
    rows = base.test_predictions(spark, sf_dir)
    a = rows.where("model = 'Seasonal_Persistence'").select("entity", "forecast_origin", "horizon", F.col("error").alias("e1"))
    b = rows.where("model = 'Persistence'").select("entity", "forecast_origin", "horizon", F.col("error").alias("e2"))
    pairs = a.join(b, ["entity", "forecast_origin", "horizon"]).join(order, ["entity", "forecast_origin"])
    out = None
    for h in (1, 2, 3):
        part = significance.diebold_mariano(pairs.where(F.col("horizon") == f"h{h}"), "e1", "e2", "position", h, ["horizon"])
        out = part if out is None else out.unionByName(part)
    return out


@query("h13_significance_table", bootstrap_ctes("sg", "(SELECT model FROM c_best_model)"))
def h13(spark, sf_dir):
    return significance.significance_table(base.test_predictions(spark, sf_dir))


# ---- comparison ------------------------------------------------------------------------------

_SECOND = "WSI_Autoregression"
_COMPARE = ["overall_mae", *[f"mae_{h}" for h in _HS], "overall_rmse", *[f"rmse_{h}" for h in _HS], "overall_r2", *[f"r2_{h}" for h in _HS]]


def _second(c: str, n: str) -> str:
    return f"{r(f'round(CASE WHEN s.{c} > 0 THEN 1.0 - m.{c} / s.{c} ELSE 0.0 END, 4)')} AS {n}"


@query("h14_model_comparison", f"""
SELECT m.model, {', '.join(f'{r(f"m.{c}")} AS {c}' for c in _COMPARE)}, {r('m.skill_mae_vs_persistence')} AS skill_vs_persistence,
  {', '.join(f'{r(f"m.skill_mae_{h}")} AS skill_vs_persistence_{h}' for h in _HS)}, {_second('overall_mae', 'skill_vs_second')},
  {', '.join(_second(f'mae_{h}', f'skill_vs_second_{h}') for h in _HS)} FROM c_metrics m JOIN c_metrics s ON s.model = '{_SECOND}'
""")
def h14(spark, sf_dir):
    table = metrics.metrics_table(base.test_predictions(spark, sf_dir), SPEC)
    return metrics.comparison_table(table, SPEC, _SECOND)


def _improve(name: str, c: str) -> str:
    return (f"{r(f'round(f.{c} - c.{c}, 4)')} AS {name}_delta_mae, "
            f"{r(f'round((f.{c} - c.{c}) / nullif(f.{c}, 0) * 100.0, 2)')} AS {name}_skill_pct")


@query("h15_winner_report", f"""
SELECT (SELECT model FROM c_metrics ORDER BY overall_mae, model LIMIT 1) AS winner, {r('(SELECT min(overall_mae) FROM c_metrics)')} AS winner_mae,
  c.model AS candidate, f.model AS reference, {_improve('overall', 'overall_mae')}, {', '.join(_improve(h, f'mae_{h}') for h in _HS)}, c.overall_mae < f.overall_mae AS beats
FROM c_metrics c JOIN c_metrics f ON f.model IN ('Persistence', '{_SECOND}') WHERE c.model = 'Ridge_Regression'
""")
def h15(spark, sf_dir):
    table = metrics.metrics_table(base.test_predictions(spark, sf_dir), SPEC)
    return metrics.winner_report(table, SPEC, "Ridge_Regression", ["Persistence", _SECOND])


_PERIOD = ("2000-01-01", "2000-12-31")
_IN = f"forecast_origin BETWEEN DATE '{_PERIOD[0]}' AND DATE '{_PERIOD[1]}'"


@query("h16_backtest_summary", f"""
SELECT model, count(*) AS total_evaluations, {r(f'round({mae()}, 4)')} AS overall_mae, {r(f'round({rmse()}, 4)')} AS overall_rmse,
  {r(f'coalesce(round(avg(absolute_error) FILTER (WHERE {_IN}), 4), 0.0)')} AS drought_mae, {r(f'coalesce(round(sqrt(avg(squared_error) FILTER (WHERE {_IN})), 4), 0.0)')} AS drought_rmse,
  {', '.join(f'{r(f"round({mae(h)}, 4)")} AS mae_{h}, {r(f"round({rmse(h)}, 4)")} AS rmse_{h}' for h in _HS)} FROM c_bt GROUP BY model
""")
def h16(spark, sf_dir):
    """The models that SQL can fit."""
    rows = forecasts.backtest_rows(spark, sf_dir).where("model <> 'Ridge_Regression'")
    return metrics.backtest_summary(rows, SPEC, _PERIOD)


@query("h16_five_models")
def h16_all(spark, sf_dir):
    rows = forecasts.backtest_rows(spark, sf_dir).unionByName(forecasts.backtest_tree_rows(spark, sf_dir))
    return metrics.backtest_summary(rows, SPEC, _PERIOD)


# ---- runs: every forecast origin of a model counts as one run --------------------------------

cte("c_runs", "SELECT model AS experiment, CAST(forecast_origin AS VARCHAR) AS run, avg(absolute_error) AS val_mae FROM c_test GROUP BY ALL")


def runs(spark, sf_dir):
    return base.test_predictions(spark, sf_dir).groupBy(
        F.col("model").alias("experiment"), F.col("forecast_origin").cast("string").alias("run")
    ).agg(F.avg("absolute_error").alias("val_mae"))


@query("h17_run_stability", f"""
SELECT experiment, count(*) AS runs, {r('avg(val_mae)', 5)} AS mean_val_mae, {r('stddev_pop(val_mae)', 5)} AS std_val_mae, {r('min(val_mae)', 5)} AS min_val_mae,
  {r('max(val_mae)', 5)} AS max_val_mae, {r('max(val_mae) - min(val_mae)', 5)} AS range_val_mae FROM c_runs GROUP BY experiment
""", digits=5)
def h17(spark, sf_dir):
    return metrics.run_stability(runs(spark, sf_dir), digits=9)


_MAIN = "2000-06-01"


@query("h18_experiment_decision", f"""
SELECT {rs('baseline_main', 'baseline_mean', 'baseline_std', 'challenger_main', 'challenger_mean', 'challenger_std', 'delta', digits=5)},
  CASE WHEN delta < -0.001 AND challenger_mean < baseline_mean AND challenger_std <= baseline_std * 1.5 THEN 'challenger improves'
    WHEN delta < -0.001 THEN 'gain fails stability check' WHEN abs(delta) <= 0.001 THEN 'approximately equal' ELSE 'challenger is worse' END AS decision
FROM (SELECT *, challenger_main - baseline_main AS delta FROM (SELECT {', '.join(
    f"max(val_mae) FILTER (WHERE experiment = '{e}' AND run = '{_MAIN}') AS {s}_main, avg(val_mae) FILTER (WHERE experiment = '{e}') AS {s}_mean, stddev_pop(val_mae) FILTER (WHERE experiment = '{e}') AS {s}_std"
    for s, e in (("baseline", "Persistence"), ("challenger", "WSI_Autoregression")))} FROM c_runs))
""", digits=5)
def h18(spark, sf_dir):
    return metrics.experiment_decision(runs(spark, sf_dir), "Persistence", "WSI_Autoregression", _MAIN)


_TABLE_METRICS = ["overall_mae", "mae_h1", "mae_h2", "mae_h3", "overall_rmse", "rmse_h1", "rmse_h2", "rmse_h3"]


@query("h19_experiment_table", f"""
SELECT metric, {', '.join(f"{r(f'max(value) FILTER (WHERE model = {chr(39)}{m}{chr(39)})')} AS {m}" for m in _MODELS)},
  {r("max(value) FILTER (WHERE model = 'Ridge_Regression') - max(value) FILTER (WHERE model = 'Persistence')")} AS delta
FROM (SELECT model, unnest([{', '.join(f"'{m}'" for m in _TABLE_METRICS)}]) AS metric, unnest([{', '.join(_TABLE_METRICS)}]) AS value FROM c_metrics) GROUP BY metric
""")
def h19(spark, sf_dir):
    table = metrics.metrics_table(base.test_predictions(spark, sf_dir), SPEC)
    long = table.unpivot(["model"], _TABLE_METRICS, "metric", "value").withColumnRenamed("model", "experiment")
    return metrics.experiment_table(long, _MODELS, "Persistence", "Ridge_Regression")


@query("h20_earliest_best_epoch", f"""
SELECT run, min(epoch) AS best_epoch, {r('max(low)')} AS best_val_mae FROM (
  SELECT *, min(val_mae) OVER (PARTITION BY run) AS low FROM (
    SELECT model AS run, CAST(date_diff('month', DATE '{_MAIN}', forecast_origin) + 1 AS INTEGER) AS epoch, round(avg(absolute_error), 3) AS val_mae FROM c_test GROUP BY ALL))
WHERE val_mae <= low + 1e-8 GROUP BY run
""")
def h20(spark, sf_dir):
    from panelstress.operators.audit import month_gap

    rows = base.test_predictions(spark, sf_dir).withColumn("_start", F.lit(_MAIN).cast("date"))
    history = rows.groupBy(F.col("model").alias("run"), (month_gap("_start", "forecast_origin") + 1).alias("epoch")).agg(
        F.round(F.avg("absolute_error"), 3).alias("val_mae")
    )
    return metrics.earliest_best_epoch(history)


@query("h21_mean_forecast_by_origin", f"""
SELECT horizon, forecast_origin, {r('avg(actual_wsi)', 5)} AS actual_mean, {', '.join(f"{r(f'avg(predicted_wsi) FILTER (WHERE model = {chr(39)}{m}{chr(39)})', 5)} AS {m}" for m in _MODELS)}
FROM c_test GROUP BY horizon, forecast_origin
""", digits=5)
def h21(spark, sf_dir):
    return metrics.mean_forecast_by_origin(base.test_predictions(spark, sf_dir), _MODELS)


@query("h22_error_by_horizon", f"SELECT model, h AS horizon, {r('v')} AS mae FROM (SELECT model, unnest(['h1', 'h2', 'h3']) AS h, unnest([mae_h1, mae_h2, mae_h3]) AS v FROM c_metrics)")
def h22(spark, sf_dir):
    return metrics.error_by_horizon(metrics.metrics_table(base.test_predictions(spark, sf_dir), SPEC), SPEC)


@query("h23_residual_histogram", "SELECT model, CAST(floor(error / 0.1) AS BIGINT) AS bin, count(*) AS n FROM c_test GROUP BY ALL")
def h23(spark, sf_dir):
    return metrics.residual_histogram(base.test_predictions(spark, sf_dir))


_DENSE = metrics.DENSITY_POINTS
cte("c_dens", f"""
SELECT model, n, lo, hi, h, h / {metrics.BINS_PER_BANDWIDTH} AS bin FROM (
  SELECT model, count(*) AS n, min(error) AS lo, max(error) AS hi, stddev_samp(error) * pow(count(*), -0.2) AS h FROM c_test GROUP BY model) WHERE n > 1 AND h > 0
""")
cte("c_dens_bins", """
SELECT model, b, sum(w) AS w FROM (
  SELECT model, unnest([floor(place), floor(place) + 1]) AS b, unnest([1 - (place - floor(place)), place - floor(place)]) AS w
  FROM (SELECT t.model, (error - lo) / bin AS place FROM c_test t JOIN c_dens d ON d.model = t.model)) GROUP BY model, b
""")


@query("h23_residual_density", f"""
SELECT model, point, {r('x', 4)} AS x, {r('sum(CASE WHEN abs(x - c) <= reach THEN w * exp(-0.5 * ((x - c) / h) * ((x - c) / h)) ELSE 0.0 END) / (n * h * sqrt(2 * pi()))', 4)} AS density FROM (
  SELECT d.model, n, h, w, lo + b * bin AS c, {metrics.KERNEL_REACH} * h AS reach, CAST(i AS INTEGER) AS point,
    lo - {metrics.DENSITY_CUT} * h + i * ((hi - lo + {2 * metrics.DENSITY_CUT} * h) / {_DENSE - 1}.0) AS x
  FROM c_dens d JOIN c_dens_bins b ON b.model = d.model, range({_DENSE}) p(i)) GROUP BY model, point, x, n, h
""", digits=4)
def h23b(spark, sf_dir):
    return metrics.residual_density(base.test_predictions(spark, sf_dir))


@query("h11_bootstrap_numpy_draws")
def h11b(spark, sf_dir):
    """The bootstrap with the draws of numpy's generator."""
    return significance.block_bootstrap(base.test_predictions(spark, sf_dir), "Persistence", generator="pcg64")
