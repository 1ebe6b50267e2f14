"""Sequences, residual targets, forecasters and the backtest."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import base
from catalog.base import SPEC, cte, query, r, rs
from catalog.ctes import D
from catalog.forecast_ctes import FEATURES, errors, linear, mean_of_step, ridge_ctes
from panelstress.operators import backtest, forecast, residual
from panelstress.operators import sequences as seq
from panelstress.plans import baselines
from panelstress.spec import COMPONENTS, RIDGE_ALPHAS

# Windows and forecasts are stored in single precision, so they are compared at five digits.
_STEP_COLUMNS = ", ".join(f"{r(f'x[(step - 1) * 6 + {i}]', 5)} AS {c}" for i, c in enumerate(COMPONENTS, start=1))


@query("f1_sequences", f"""
SELECT entity, forecast_origin, input_start, target_t1, target_t2, target_t3, split, CAST(step - 1 AS INTEGER) AS step, {_STEP_COLUMNS}, {rs('y1', 'y2', 'y3', digits=5)}
FROM (SELECT *, unnest(range(1, 13)) AS step FROM c_seq)
""", digits=5)
def f1(spark, sf_dir):
    rows = seq.build_sequences(base.panel(spark, sf_dir), SPEC)
    return rows.select(
        "entity", "forecast_origin", "input_start", "target_t1", "target_t2", "target_t3", "split",
        *[F.col("y")[i].alias(f"y{i + 1}") for i in range(3)], F.posexplode("x").alias("step", "v"),
    ).select("*", *[F.col("v")[i].alias(c) for i, c in enumerate(COMPONENTS)]).drop("v")


@query("f2_sequence_ids", "SELECT sequence_id, position, entity, forecast_origin, split FROM c_seq")
def f2(spark, sf_dir):
    rows = seq.add_sequence_ids(seq.build_sequences(base.panel(spark, sf_dir), SPEC), SPEC)
    return rows.select("sequence_id", "position", "entity", "forecast_origin", "split")


@query("f3_sequence_report", """
SELECT split, CAST(sum(n) AS BIGINT) AS sequences, count(*) AS entities, min(n) AS min_per_entity, max(n) AS max_per_entity,
  CAST(sum(bad) AS BIGINT) AS bad_shapes, CAST(sum(bad) AS BIGINT) AS non_finite, CAST(sum(brk) AS BIGINT) AS broken_months,
  min(o1) AS first_origin, max(o2) AS last_origin, min(t1) AS first_target, max(t2) AS last_target
FROM (SELECT split, entity, count(*) AS n, count(*) FILTER (WHERE len(x) <> 72 OR y3 IS NULL) AS bad,
  count(*) FILTER (WHERE date_diff('month', input_start, forecast_origin) <> 11 OR date_diff('month', forecast_origin, target_t3) <> 3) AS brk,
  min(forecast_origin) AS o1, max(forecast_origin) AS o2, min(target_t1) AS t1, max(target_t3) AS t2 FROM c_seq GROUP BY split, entity) GROUP BY split
""")
def f3(spark, sf_dir):
    return seq.sequence_report(base.sequences(spark, sf_dir), SPEC)


@query("f4_value_check", f"""
SELECT count(*) * 12 AS input_steps, count(*) * 3 AS targets, CAST(0 AS BIGINT) AS unmatched,
  (SELECT max(greatest({', '.join(f'abs(CAST(CAST({c} AS FLOAT) AS DOUBLE) - {c})' for c in COMPONENTS)})) FROM c_panel) < 1e-6 AS inputs_equal,
  (SELECT max(abs(CAST(CAST(wsi AS FLOAT) AS DOUBLE) - wsi)) FROM c_panel) < 1e-6 AS targets_equal FROM c_seq
""")
def f4(spark, sf_dir):
    out = seq.verify_values(base.sequences(spark, sf_dir), base.panel(spark, sf_dir), SPEC)
    return out.select(
        "input_steps", "targets", "unmatched", (F.col("max_input_diff") < 1e-6).alias("inputs_equal"),
        (F.col("max_target_diff") < 1e-6).alias("targets_equal"),
    )


_WEIGHTED = "list_sum(list_transform(x, lambda v, i: CAST(v AS DOUBLE) * i))"


@query("f5_flat_inputs", f"SELECT sequence_id, CAST(len(x) AS INTEGER) AS size, {r('x[1]', 4)} AS first, {r('x[72]', 4)} AS last, {r(_WEIGHTED, 4)} AS weighted FROM c_seq", digits=4)
def f5(spark, sf_dir):
    """The weighted sum depends on the order of the flattened values."""
    flat = seq.flat_inputs()
    weighted = F.transform(flat, lambda v, i: v.cast("double") * (i + 1))
    return base.sequences(spark, sf_dir).select(
        "sequence_id", F.size(flat).alias("size"), F.get(flat, F.lit(0)).alias("first"), F.element_at(flat, -1).alias("last"),
        F.aggregate(weighted, F.lit(0.0), lambda a, v: a + v).alias("weighted"),
    )


@query("f6_index_histories", f"SELECT sequence_id, CAST(step - 1 AS INTEGER) AS step, {r('hist[step]')} AS wsi FROM (SELECT *, unnest(range(1, 13)) AS step FROM c_seq)")
def f6(spark, sf_dir):
    meta = base.sequences(spark, sf_dir).select("sequence_id", "entity", "input_start", "input_end")
    rows = seq.index_histories(base.panel(spark, sf_dir), meta, SPEC)
    return rows.select("sequence_id", F.posexplode("wsi_history").alias("step", "wsi"))


@query("f7_origin_index", f"SELECT sequence_id, entity, forecast_origin, {r('wsi')} AS wsi_at_origin FROM c_seq")
def f7(spark, sf_dir):
    return residual.origin_index(base.panel(spark, sf_dir), base.sequences(spark, sf_dir), SPEC)


_RESIDUALS = ", ".join(f"{r(f'CAST(y{h} AS DOUBLE) - wsi', 5)} AS residual_t{h}" for h in (1, 2, 3))


@query("f8_residual_targets", f"SELECT sequence_id, entity, forecast_origin, split, {r('wsi', 5)} AS wsi_at_origin, {_RESIDUALS} FROM c_seq", digits=5)
def f8(spark, sf_dir):
    return residual.add_residual_targets(base.sequences(spark, sf_dir), SPEC).select(
        "sequence_id", "entity", "forecast_origin", "split", "wsi_at_origin", *residual.residual_columns(SPEC)
    )


@query("f9_residual_report", """
SELECT split, count(*) AS sequences, count(*) - count(DISTINCT sequence_id) AS duplicate_ids, CAST(0 AS BIGINT) AS non_finite,
  max(greatest(abs(CAST(CAST(CAST(y1 AS DOUBLE) - wsi AS FLOAT) AS DOUBLE) - (CAST(y1 AS DOUBLE) - CAST(CAST(wsi AS FLOAT) AS DOUBLE))),
    abs(CAST(CAST(CAST(y3 AS DOUBLE) - wsi AS FLOAT) AS DOUBLE) - (CAST(y3 AS DOUBLE) - CAST(CAST(wsi AS FLOAT) AS DOUBLE))))) <= 1e-6 AS passed
FROM c_seq GROUP BY split
""")
def f9(spark, sf_dir):
    rows = residual.add_residual_targets(base.sequences(spark, sf_dir), SPEC)
    return residual.residual_report(rows, SPEC).drop("max_identity_diff")


# Residual forecasts: the ridge of G8.
_RES_TARGETS = "[CAST(y1 AS DOUBLE) - wsi, CAST(y2 AS DOUBLE) - wsi, CAST(y3 AS DOUBLE) - wsi]"
ridge_ctes("res", FEATURES, 72, _RES_TARGETS)
ridge_ctes("rst", f"list_append({FEATURES}, wsi)", 73, _RES_TARGETS)


@query("f10_reconstruction", f"""
SELECT count(*) AS sequences, true AS passed, {r('avg(e)', 5)} AS residual_mae, {r('avg(e)', 5)} AS wsi_mae FROM (
  SELECT (abs(CAST(list_dot_product(f.w[1], v) + f.b[1] AS FLOAT) - (CAST(y1 AS DOUBLE) - wsi)) + abs(CAST(list_dot_product(f.w[2], v) + f.b[2] AS FLOAT) - (CAST(y2 AS DOUBLE) - wsi))
    + abs(CAST(list_dot_product(f.w[3], v) + f.b[3] AS FLOAT) - (CAST(y3 AS DOUBLE) - wsi))) / 3.0 AS e
  FROM (SELECT *, {FEATURES} AS v FROM c_seq WHERE split = 'val') s, c_res_fit f WHERE f.split = 'val')
""", digits=5)
def f10(spark, sf_dir):
    rows = residual.add_residual_targets(base.sequences(spark, sf_dir), SPEC)
    y = F.array(*[F.col(c) for c in residual.residual_columns(SPEC)])
    x, width = forecast.ridge_inputs("features", SPEC)
    fit = forecast.fit_ridge(rows, x, y, width, SPEC.horizon)
    val = seq.of_splits(rows, "val").withColumn("r_hat", forecast.linear_predict(x, fit.train_model).cast("array<float>"))
    return residual.reconstruction_check(val, "r_hat", SPEC).drop("max_error_gap")


BACKTEST_START, BACKTEST_END = "1999-01-01", "2001-04-01"
ORIGINS = backtest.month_range(BACKTEST_START, BACKTEST_END)
_ALL_ORIGINS = backtest.month_range("1997-06-01", BACKTEST_END)


def _z(source: str) -> str:
    return ", ".join(
        f"({c} - avg({c}) OVER g) / CASE WHEN stddev_pop({c}) OVER g < 1e-6 THEN 1.0 ELSE stddev_pop({c}) OVER g END AS {c}"
        for c in COMPONENTS
    )


cte("c_expand", f"""
SELECT origin, entity, date, wsi, {_z('c_panel')} FROM c_panel JOIN (SELECT unnest([{', '.join(map(D, _ALL_ORIGINS))}]) AS origin) ON date <= origin
WINDOW g AS (PARTITION BY origin, entity)
""")


@query("f11_expanding_z", f"SELECT origin, entity, date, {rs('wsi', *COMPONENTS)} FROM c_expand")
def f11(spark, sf_dir):
    return seq.expanding_z(base.panel(spark, sf_dir), _ALL_ORIGINS, SPEC)


@query("f12_causal_sequences", f"""
SELECT origin, entity, forecast_origin, CASE WHEN forecast_origin = origin THEN 'current' ELSE 'train' END AS role,
  {r('list_sum(x)', 4)} AS x_sum, {r('x[72]', 4)} AS x_last, {r('hist[1]', 4)} AS wsi_first, {r('CASE WHEN forecast_origin < origin THEN y3 END', 4)} AS y3
FROM (SELECT origin, entity, date AS forecast_origin, flatten(list([{', '.join(f'CAST(CAST({c} AS FLOAT) AS DOUBLE)' for c in COMPONENTS)}]) OVER w) AS x,
  list(CAST(CAST(wsi AS FLOAT) AS DOUBLE)) OVER w AS hist, CAST(CAST(lead(wsi, 3) OVER o AS FLOAT) AS DOUBLE) AS y3,
  row_number() OVER o AS rn FROM c_expand WINDOW o AS (PARTITION BY origin, entity ORDER BY date), w AS (PARTITION BY origin, entity ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
WHERE rn >= 12 AND (forecast_origin = origin OR forecast_origin <= origin - INTERVAL 3 MONTH)
""", digits=4)
def f12(spark, sf_dir):
    rows = seq.causal_sequences(base.panel(spark, sf_dir), _ALL_ORIGINS, SPEC)
    flat = seq.flat_inputs()
    return rows.select(
        "origin", "entity", "forecast_origin", "role",
        F.aggregate(flat, F.lit(0.0), lambda a, v: a + v.cast("double")).alias("x_sum"),
        F.element_at(flat, -1).cast("double").alias("x_last"),
        F.col("wsi_history")[0].cast("double").alias("wsi_first"),
        F.col("y")[2].cast("double").alias("y3"),
    )


@query("f13_train_val_union", "SELECT entity, count(*) AS n FROM c_seq WHERE split IN ('train', 'val') GROUP BY entity")
def f13(spark, sf_dir):
    return seq.of_splits(base.sequences(spark, sf_dir), "train", "val").groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


# ---- forecasters -----------------------------------------------------------------------------

def _wide_prediction(rows):
    return rows.select("sequence_id", *[F.col("pred")[i].alias(f"p{i + 1}") for i in range(3)])


def _wide_sql(column: str, where: str = "true", digits: int = 5) -> str:
    return f"SELECT sequence_id, {', '.join(f'{r(f'{column}[{i}]', digits)} AS p{i}' for i in (1, 2, 3))} FROM c_wide WHERE {where}"


@query("g1_persistence", _wide_sql("persistence"), digits=5)
def g1(spark, sf_dir):
    return _wide_prediction(forecast.persistence(base.sequences(spark, sf_dir), SPEC))


@query("g1_persistence_from_features", f"SELECT sequence_id, {', '.join(f'{r(f'CAST({mean_of_step(12)} AS FLOAT)', 5)} AS p{h}' for h in (1, 2, 3))} FROM c_seq", digits=5)
def g1b(spark, sf_dir):
    return _wide_prediction(forecast.persistence(base.sequences(spark, sf_dir), SPEC, use_origin=False))


@query("g2_seasonal_persistence", _wide_sql("seasonal"), digits=5)
def g2(spark, sf_dir):
    rows = base.sequences(spark, sf_dir)
    return _wide_prediction(forecast.seasonal_persistence(rows, base.panel(spark, sf_dir), SPEC))


def _ridge(spark, sf_dir, kind, targets=None):
    rows = base.sequences(spark, sf_dir)
    if targets is None:
        y = F.col("y")
    else:
        rows = residual.add_residual_targets(rows, SPEC)
        y = F.array(*[F.col(c) for c in residual.residual_columns(SPEC)])
    x, width = forecast.ridge_inputs(kind, SPEC)
    return rows, forecast.fit_ridge(rows, x, y, width, SPEC.horizon)


@query("g3_autoregression", _wide_sql("ar", "split = 'val'", 5), digits=5)
def g3(spark, sf_dir):
    rows, fit = _ridge(spark, sf_dir, "history")
    return _wide_prediction(forecast.ridge_predict(seq.of_splits(rows, "val"), "history", fit.train_model, SPEC))


@query("g4_ridge", _wide_sql("ridge", "split = 'val'", 5), digits=5)
def g4(spark, sf_dir):
    rows, fit = _ridge(spark, sf_dir, "features")
    return _wide_prediction(forecast.ridge_predict(seq.of_splits(rows, "val"), "features", fit.train_model, SPEC))


@base._stage("tree-forecasts")
def tree_forecasts(spark, sf_dir):
    """Long predictions of the boosted trees: three settings per horizon with patience, then the refit."""
    parts, _ = baselines.tree_suite(base.sequences(spark, sf_dir), SPEC)
    out = [forecast.long_predictions(rows, "Boosted_Trees", kind, SPEC) for kind, rows in parts.items()]
    return out[0].unionByName(out[1])


@query("g5_boosted_trees")
def g5(spark, sf_dir):
    """Forecasts of the validation rows by the setting chosen per horizon, and of the test rows by its refit."""
    return tree_forecasts(spark, sf_dir)


@query("g6_alpha_selection", f"""
SELECT 'history' AS inputs, CAST(alpha AS DOUBLE) AS alpha, {r('mae')} AS val_mae, alpha = (SELECT alpha FROM c_ar_best) AS chosen FROM c_ar_scores
UNION ALL SELECT 'features', CAST(alpha AS DOUBLE), {r('mae')}, alpha = (SELECT alpha FROM c_rr_best) FROM c_rr_scores
""")
def g6(spark, sf_dir):
    out = []
    for kind in ("history", "features"):
        _, fit = _ridge(spark, sf_dir, kind)
        out += [(kind, a, fit.scores[a], a == fit.alpha) for a in RIDGE_ALPHAS]
    return spark.createDataFrame(out, "inputs string, alpha double, val_mae double, chosen boolean")


@query("g7_refit", f"""
SELECT sequence_id, 'history' AS inputs, {', '.join(f'{r(f'ar[{i}]', 5)} AS p{i}' for i in (1, 2, 3))} FROM c_wide WHERE split = 'test'
UNION ALL SELECT sequence_id, 'features', {', '.join(r(f'ridge[{i}]', 5) for i in (1, 2, 3))} FROM c_wide WHERE split = 'test'
""", digits=5)
def g7(spark, sf_dir):
    parts = []
    for kind in ("history", "features"):
        rows, fit = _ridge(spark, sf_dir, kind)
        pred = forecast.ridge_predict(seq.of_splits(rows, "test"), kind, fit.final_model, SPEC)
        parts.append(_wide_prediction(pred).withColumn("inputs", F.lit(kind)))
    return parts[0].unionByName(parts[1])


def _residual_sql(tag: str, inputs: str) -> str:
    preds = linear("f", "v", "wsi")
    return f"""SELECT sequence_id, {', '.join(f'{r(f'p[{i}]', 5)} AS p{i}' for i in (1, 2, 3))} FROM (
  SELECT sequence_id, {preds} AS p FROM (SELECT *, {inputs} AS v FROM c_seq WHERE split IN ('val', 'test')) s JOIN c_{tag}_fit f ON f.split = s.split)"""


def _residual_prediction(rows, fit, kind):
    """Validation rows by the model of the training rows, test rows by the refit."""
    parts = [
        forecast.ridge_predict(seq.of_splits(rows, split), kind, model, SPEC, residual=True)
        for split, model in (("val", fit.train_model), ("test", fit.final_model))
    ]
    return _wide_prediction(parts[0].unionByName(parts[1]))


@query("g8_residual_ridge", _residual_sql("res", FEATURES), digits=5)
def g8(spark, sf_dir):
    rows, fit = _ridge(spark, sf_dir, "features", "residual")
    return _residual_prediction(rows, fit, "features")


@query("g9_residual_ridge_with_state", _residual_sql("rst", f"list_append({FEATURES}, wsi)"), digits=5)
def g9(spark, sf_dir):
    rows, fit = _ridge(spark, sf_dir, "features_state", "residual")
    return _residual_prediction(rows, fit, "features_state")


@query("g10_baseline_suite", f"""
SELECT evaluation_type, model, horizon, count(*) AS n, {r('avg(absolute_error)', 4)} AS mae FROM c_pred GROUP BY ALL
""", digits=4)
def g10(spark, sf_dir):
    val, test, _ = baselines.run_baselines(base.sequences(spark, sf_dir), base.panel(spark, sf_dir), SPEC)
    return val.unionByName(test).groupBy("evaluation_type", "model", "horizon").agg(
        F.count(F.lit(1)).alias("n"), F.avg("absolute_error").alias("mae")
    )


@query("g10_five_models")
def g10_all(spark, sf_dir):
    """The suite with the boosted trees."""
    rows = base.predictions(spark, sf_dir).unionByName(tree_forecasts(spark, sf_dir))
    return rows.groupBy("evaluation_type", "model", "horizon").agg(F.count(F.lit(1)).alias("n"), F.avg("absolute_error").alias("mae"))


@query("g11_champion", f"""
SELECT model AS champion, {r('mae', 5)} AS mean_val_mae, {r('rmse', 5)} AS mean_val_rmse FROM (
  SELECT model, round(avg(mae), 5) AS mae, round(avg(rmse), 5) AS rmse FROM (
    SELECT model, horizon, avg(absolute_error) AS mae, sqrt(avg(squared_error)) AS rmse FROM c_val GROUP BY model, horizon)
  GROUP BY model) ORDER BY mae, rmse, model LIMIT 1
""", digits=5)
def g11(spark, sf_dir):
    return forecast.choose_champion(base.val_predictions(spark, sf_dir))


# Backtest: persistence, seasonal persistence and the index autoregression have an oracle.
_ORIGIN_LIST = ", ".join(map(D, ORIGINS))
cte("c_bt_rows", f"""
SELECT entity, date AS forecast_origin, wsi, list(wsi) OVER w AS hist, {', '.join(f'lead(wsi, {h}) OVER o AS a{h}, lag(wsi, {12 - h}) OVER o AS s{h}' for h in (1, 2, 3))},
  row_number() OVER o AS rn FROM c_panel
WINDOW o AS (PARTITION BY entity ORDER BY date), w AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)
""")
_F = "CAST(CAST({} AS FLOAT) AS DOUBLE)"
cte("c_bt_z", f"""
SELECT origin, list_concat([1.0::DOUBLE], list_transform(hist, lambda v: {_F.format('v')}), [{', '.join(_F.format(f'a{h}') for h in (1, 2, 3))}]) AS z
FROM c_bt_rows JOIN (SELECT unnest([{_ORIGIN_LIST}]) AS origin) ON forecast_origin <= origin - INTERVAL 3 MONTH WHERE rn >= 12
""")
cte("c_bt_g", """
SELECT origin, list(v ORDER BY i) AS g FROM (SELECT origin, i, list(s ORDER BY j) AS v FROM (
  SELECT origin, i, j, sum(z[i] * z[j]) AS s FROM (SELECT origin, z, unnest(range(1, 17)) AS i FROM c_bt_z), unnest(range(1, 17)) t(j) GROUP BY origin, i, j) GROUP BY origin, i) GROUP BY origin
""")
cte("c_bt_s", """
SELECT origin, g, list_transform(range(1, 16), lambda i: g[1][i + 1] / g[1][1]) AS mu,
  list_transform(range(1, 13), lambda i: sqrt((g[i + 1][i + 1] - g[1][i + 1] * g[1][i + 1] / g[1][1]) / g[1][1])) AS sd FROM c_bt_g
""")
cte("c_bt_m", """
SELECT origin, list_transform(range(1, 13), lambda i: list_transform(range(1, 16), lambda j:
  (g[i + 1][j + 1] - g[1][1] * mu[i] * mu[j]) / sd[i] / (CASE WHEN j <= 12 THEN sd[j] ELSE 1.0 END) + CASE WHEN i = j THEN 1.0 ELSE 0.0 END)) AS m FROM c_bt_s
""")
cte("c_bt_gj", """
SELECT 1, origin, m FROM c_bt_m UNION ALL SELECT k + 1, alpha, list_transform(m, lambda row, i: CASE WHEN i = k
  THEN list_transform(row, lambda v: v / m[k][k]) ELSE list_transform(row, lambda v, j: v - row[k] / m[k][k] * m[k][j]) END) FROM c_bt_gj WHERE k <= 12
""")
cte("c_bt_w", """
SELECT origin, w, list_transform([1, 2, 3], lambda h: mu[12 + h] - list_sum(list_transform(range(1, 13), lambda i: w[h][i] * mu[i]))) AS b
FROM (SELECT s.origin, s.mu, list_transform([1, 2, 3], lambda h: list_transform(range(1, 13), lambda i: m[i][12 + h] / sd[i])) AS w
  FROM c_bt_gj j JOIN c_bt_s s ON s.origin = j.alpha WHERE k = 13)
""")
cte("c_bt", f"""
SELECT 'historical_diagnostic' AS evaluation_type, model, entity, forecast_origin, CAST(forecast_origin + INTERVAL (h) MONTH AS DATE) AS target_date,
  'h' || h AS horizon, {errors()} FROM (
  SELECT entity, forecast_origin, model, h, CAST(pred[h] AS DOUBLE) AS p, [a1, a2, a3][h] AS a FROM (
    SELECT *, unnest([1, 2, 3]) AS h FROM (
      SELECT r.entity, r.forecast_origin, a1, a2, a3, unnest(['Persistence', 'Seasonal_Persistence', 'WSI_Autoregression']) AS model,
        unnest([[CAST(wsi AS FLOAT), CAST(wsi AS FLOAT), CAST(wsi AS FLOAT)],
          [CAST(coalesce(s1, wsi) AS FLOAT), CAST(coalesce(s2, wsi) AS FLOAT), CAST(coalesce(s3, wsi) AS FLOAT)],
          {linear('f', f"list_transform(r.hist, lambda v: {_F.format('v')})")}]) AS pred
      FROM c_bt_rows r JOIN c_bt_w f ON f.origin = r.forecast_origin WHERE rn >= 12)) WHERE [a1, a2, a3][h] IS NOT NULL)
""")
_BT_COLUMNS = "evaluation_type, model, entity, forecast_origin, target_date, horizon"
_BT_VALUES = ("actual_wsi", "predicted_wsi", "error", "absolute_error", "squared_error")


@base._stage("backtest")
def backtest_rows(spark, sf_dir):
    return backtest.rolling_backtest(base.panel(spark, sf_dir), ORIGINS, SPEC)


@base._stage("backtest-trees")
def backtest_tree_rows(spark, sf_dir):
    return backtest.backtest_trees(base.panel(spark, sf_dir), ORIGINS, SPEC)


@query("g12_backtest", f"SELECT {_BT_COLUMNS}, {rs(*_BT_VALUES, digits=5)} FROM c_bt", digits=5)
def g12(spark, sf_dir):
    """The models that SQL can fit; the others are g12_backtest_ridge and g12_backtest_trees."""
    return backtest_rows(spark, sf_dir).where("model <> 'Ridge_Regression'")


@query("g12_backtest_ridge")
def g12b(spark, sf_dir):
    rows = backtest.rolling_backtest(base.panel(spark, sf_dir), ORIGINS, SPEC)
    return rows.where("model = 'Ridge_Regression'")


@query("g12_backtest_trees")
def g12c(spark, sf_dir):
    return backtest_tree_rows(spark, sf_dir)
