"""Forecasters and the long prediction table."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelstress.functions.numeric import rounded
from panelstress.operators.boosting import BoostedModel, Booster, TreeSetting, fit_boosters, predict_boosted
from panelstress.operators.sequences import flat_inputs, of_splits
from panelstress.spec import INDEX, RIDGE_ALPHAS, PanelSpec


# ---- persistence ---------------------------------------------------------------------------

def _step_mean(x: Column, step: int) -> Column:
    """Mean of the features of one lookback step; the index when no stored value is at hand."""
    values = F.element_at(x, step)
    total = F.aggregate(values, F.lit(0.0), lambda a, v: a + v.cast("double"))
    return total / F.size(values)


def persistence(sequences: DataFrame, spec: PanelSpec, use_origin: bool = True) -> DataFrame:
    """The index at the origin repeated over the horizon."""
    value = F.col("wsi_at_origin") if use_origin else _step_mean(F.col("x"), -1)
    return sequences.withColumn("pred", F.array_repeat(value.cast("float"), spec.horizon))


def seasonal_persistence(
    sequences: DataFrame, panel: DataFrame | None, spec: PanelSpec, fallback: str = "lookback", period: int = 12
) -> DataFrame:
    """Index one season before each target; without a panel, the matching lookback steps alone.

    All targets of a sequence lie in consecutive months of one entity, so the panel is packed into
    one map per entity (bounded by the calendar) and joined once. A missing month falls back to the
    matching lookback step, or to the index at the origin with ``fallback='origin'``. Fallbacks are taken
    before the join, so that no lookback travels through it unless the caller keeps it.
    """
    e = spec.entity
    if panel is None:
        steps = [_step_mean(F.col("x"), h).cast("float") for h in range(1, spec.horizon + 1)]
        return sequences.withColumn("pred", F.array(*steps))
    series = panel.groupBy(e).agg(
        F.map_from_entries(F.collect_list(F.struct(spec.date, INDEX))).alias("_series")
    )
    others, preds = {}, []
    for h in range(1, spec.horizon + 1):
        others[f"_other{h}"] = F.col("wsi_at_origin") if fallback == "origin" else _step_mean(F.col("x"), h)
        stored = F.try_element_at("_series", F.add_months(f"target_t{h}", -period))
        preds.append(F.coalesce(stored, f"_other{h}").cast("float"))
    rows = sequences.withColumns(others).join(series, e, "left")
    return rows.withColumn("pred", F.array(*preds)).drop("_series", *others)


# ---- ridge -----------------------------------------------------------------------------------

@dataclass(frozen=True)
class Moments:
    """Sum of outer products of [1, inputs, targets], the latter two less ``shift``, which keeps them small."""

    gram: np.ndarray
    inputs: int
    shift: np.ndarray | None = None

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.gram + other.gram, self.inputs, self.shift)


@dataclass(frozen=True)
class RidgeModel:
    alpha: float
    coefficients: np.ndarray  # (inputs, targets), for unscaled inputs
    intercept: np.ndarray  # (targets,)


def partial_moments(inputs: int, targets: int, shift: np.ndarray):
    """Task-side reduction: one matrix product per split and Arrow batch, one row per split and partition."""

    def reduce_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for pdf in batches:
            for split, rows in pdf.groupby("split"):
                x = np.stack(rows["x"].to_numpy()).astype(float)
                y = np.stack(rows["y"].to_numpy()).astype(float)
                z = np.hstack([np.ones((len(rows), 1)), np.hstack([x, y]) - shift])
                totals[split] = totals.get(split, 0.0) + z.T @ z
        if totals:  # a task without rows has nothing to add
            yield pd.DataFrame({"split": list(totals), "g": [g.ravel() for g in totals.values()]})

    return reduce_batches


#: Rows whose medians the moments are taken about.
SHIFT_ROWS = 64


def fit_moments(df: DataFrame, x: Column, y: Column, inputs: int, targets: int) -> dict[str, Moments]:
    """Gram matrix of the rows of each split: matrix products in the tasks, sums in one small aggregation.

    Only (1 + inputs + targets)^2 numbers per split reach the driver, whatever the number of rows. Values are shifted by
    the medians of a few rows, so that products do not cancel when a mean is large; a shift does not change a fit, so any
    rows will do, and the data are read once.
    """
    rows = df.select("split", x.cast("array<double>").alias("x"), y.cast("array<double>").alias("y"))
    few = [[*r["x"], *r["y"]] for r in rows.select("x", "y").limit(SHIFT_ROWS).collect()]
    shift = np.nan_to_num(np.median(np.array(few, dtype=float), axis=0)) if few else np.zeros(inputs + targets)
    partial = rows.mapInPandas(partial_moments(inputs, targets, shift), "split string, g array<double>")
    cells = partial.select("split", F.posexplode("g").alias("i", "v")).groupBy("split", "i").agg(F.sum("v").alias("v"))
    size = 1 + inputs + targets
    grams: dict[str, np.ndarray] = {}
    for split, part in cells.toPandas().groupby("split"):
        gram = np.zeros(size * size)
        gram[part["i"].to_numpy()] = part["v"].to_numpy()
        grams[split] = gram.reshape(size, size)
    return {split: Moments(g, inputs, shift) for split, g in grams.items()}


def solve_ridge(moments: Moments, alpha: float) -> RidgeModel:
    """Ridge on inputs standardised with population deviations, intercept unpenalised."""
    p = moments.inputs
    n = moments.gram[0, 0]
    mean = moments.gram[0, 1:] / n
    centred = moments.gram[1:, 1:] - n * np.outer(mean, mean)
    variance = np.maximum(np.diag(centred)[:p], 0.0) / n
    full = mean if moments.shift is None else mean + moments.shift
    # A variance within rounding of zero, for a mean of that size, is a constant column: it divides by one.
    eps = np.finfo(float).eps
    constant = variance <= n * eps * variance + (n * eps * full[:p]) ** 2
    scale = np.where(constant, 1.0, np.sqrt(variance))
    centred[:p][constant] = 0.0
    centred[:, :p][:, constant] = 0.0
    a = centred[:p, :p] / np.outer(scale, scale)
    b = centred[:p, p:] / scale[:, None]
    w = np.linalg.solve(a + alpha * np.eye(p), b) / scale[:, None]
    return RidgeModel(alpha, w, full[p:] - full[:p] @ w)


def linear_predict(x: Column, model: RidgeModel) -> Column:
    """One array of forecasts per row, by one matrix product per Arrow batch; null where an input is missing."""
    weights, intercept = model.coefficients, model.intercept
    inputs, targets = weights.shape

    def predict(rows: pa.Array) -> pa.Array:
        full = pc.fill_null(pc.equal(pc.list_value_length(rows), inputs), False)
        values = rows.filter(full).flatten()
        good = full.to_numpy(zero_copy_only=False).copy()
        known = values.is_valid().to_numpy(zero_copy_only=False).reshape(-1, inputs).all(axis=1)
        z = values.to_numpy(zero_copy_only=False).astype(float).reshape(-1, inputs)[known] @ weights + intercept
        good[good] = known
        ends = np.concatenate([[0], np.cumsum(good * targets)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(z.ravel()), mask=pa.array(~good))

    return F.arrow_udf(predict, "array<double>")(x)


def select_alpha(val: DataFrame, x: Column, y: Column, models: list[RidgeModel]) -> tuple[float, dict[float, float]]:
    """Smallest validation MAE over all horizons; the first alpha wins ties. One pass for all alphas."""
    targets = models[0].coefficients.shape[1]
    every = RidgeModel(0.0, np.hstack([m.coefficients for m in models]), np.concatenate([m.intercept for m in models]))
    scored = val.select(y.alias("y"), linear_predict(x, every).alias("p"))
    errors = []
    for i in range(len(models)):
        gaps = [F.abs(F.col("p")[i * targets + h] - F.col("y")[h].cast("double")) for h in range(targets)]
        errors.append(F.avg(sum(gaps[1:], gaps[0]) / float(targets)).alias(f"m{i}"))
    row = scored.agg(*errors).first()
    scores = {m.alpha: row[f"m{i}"] for i, m in enumerate(models)}
    return min(models, key=lambda m: scores[m.alpha]).alpha, scores


@dataclass(frozen=True)
class RidgeFit:
    """Chosen setting, the model fitted on training data, and the refit on training plus validation."""

    alpha: float
    scores: dict[float, float]
    train_model: RidgeModel
    final_model: RidgeModel


def fit_ridge(
    sequences: DataFrame, x: Column, y: Column, inputs: int, targets: int, alphas: tuple[float, ...] = RIDGE_ALPHAS
) -> RidgeFit:
    """Fit on 'train', choose alpha on 'val', refit on both.

    Moments add up, so one pass gives the fit and the refit.
    """
    moments = fit_moments(of_splits(sequences, "train", "val"), x, y, inputs, targets)
    train, val_rows = moments["train"], of_splits(sequences, "val")
    models = [solve_ridge(train, a) for a in alphas]
    alpha, scores = select_alpha(val_rows, x, y, models)
    return RidgeFit(alpha, scores, solve_ridge(train, alpha), solve_ridge(train + moments["val"], alpha))


def ridge_inputs(kind: str, spec: PanelSpec) -> tuple[Column, int]:
    """Inputs by name: 'history' (index lags), 'step_means' (feature means in place of stored lags),
    'features' (flattened window), 'features_state' (plus the index at the origin)."""
    width = spec.lookback * len(spec.components)
    if kind == "history":
        return F.col("wsi_history"), spec.lookback
    if kind == "step_means":
        return F.transform("x", lambda step: F.aggregate(step, F.lit(0.0), lambda a, v: a + v.cast("double")) / F.size(step)), spec.lookback
    if kind == "features":
        return flat_inputs(), width
    if kind == "features_state":
        return F.concat(flat_inputs().cast("array<double>"), F.array(F.col("wsi_at_origin"))), width + 1
    raise ValueError(f"unknown inputs: {kind}")


def ridge_predict(sequences: DataFrame, kind: str, model: RidgeModel, spec: PanelSpec, residual: bool = False) -> DataFrame:
    """Forecast column; residual models are put back on the index scale."""
    x, _ = ridge_inputs(kind, spec)
    pred = linear_predict(x, model)
    if residual:
        pred = F.transform(pred, lambda r: r + F.col("wsi_at_origin"))
    return sequences.withColumn("pred", pred.cast("array<float>"))


# ---- boosted trees ---------------------------------------------------------------------------

# Candidate settings of the boosted-tree forecaster, rounds at most, rounds without a smaller validation
# error after which boosting stops, and rounds where there is nothing to validate on.
TREE_CANDIDATES = (
    TreeSetting(max_depth=3, step=0.05, rows=0.8, columns=0.8, l1=0.1, l2=1.0),
    TreeSetting(max_depth=4, step=0.05, rows=0.8, columns=0.8, l1=0.5, l2=1.0),
    TreeSetting(max_depth=3, step=0.10, rows=0.9, columns=0.9, l1=0.1, l2=1.0),
)
TREE_ROUNDS = 300
TREE_PATIENCE = 15
TREE_ROUNDS_UNVALIDATED = 100


def tree_rows(sequences: DataFrame, spec: PanelSpec, is_val: Column, group: Column | None = None) -> DataFrame:
    """Windows in the form that the booster takes; the key of a row is a hash of its entity and origin."""
    return sequences.select(
        (F.lit(0) if group is None else group).cast("int").alias("group"),
        is_val.alias("is_val"),
        F.xxhash64(spec.entity, "forecast_origin").alias("id"),
        flat_inputs().cast("array<double>").alias("x"),
        F.col("y").cast("array<double>").alias("y"),
    )


@dataclass(frozen=True)
class TreeFit:
    """One model per horizon with the setting of the smallest validation MAE, and all models that were grown for it."""

    models: list[BoostedModel]
    candidates: list[BoostedModel]

    @property
    def rounds(self) -> list[int]:
        return [len(m.trees) for m in self.models]


def fit_trees(
    sequences: DataFrame, spec: PanelSpec, candidates: tuple[TreeSetting, ...] = TREE_CANDIDATES, rounds: int = TREE_ROUNDS, seed: int = 42
) -> TreeFit:
    """All settings for all horizons grown together on the training rows, each stopped by the validation rows."""
    validated = not of_splits(sequences, "val").isEmpty()
    if not validated:
        candidates, rounds = candidates[:1], min(rounds, TREE_ROUNDS_UNVALIDATED)
    boosters = [Booster(0, h, c) for h in range(spec.horizon) for c in candidates]
    rows = tree_rows(of_splits(sequences, "train", "val"), spec, F.col("split") == "val")
    grown = fit_boosters(rows, boosters, rounds, TREE_PATIENCE if validated else None, seed)
    chosen = []
    for h in range(spec.horizon):
        mine = [m for m in grown if m.booster.target == h]
        chosen.append(min(mine, key=lambda m: m.absolute[len(m.trees) - 1]) if validated else mine[0])
    return TreeFit(chosen, grown)


def refit_trees(sequences: DataFrame, spec: PanelSpec, fit: TreeFit, seed: int = 42) -> list[BoostedModel]:
    """The chosen settings with as many rounds as were kept, on training and validation rows."""
    rows = tree_rows(of_splits(sequences, "train", "val"), spec, F.lit(False))
    return fit_boosters(rows, [m.booster for m in fit.models], fit.rounds, None, seed)


def tree_predict(sequences: DataFrame, models: list[BoostedModel]) -> DataFrame:
    return predict_boosted(sequences, models, flat_inputs())


# ---- long predictions ------------------------------------------------------------------------

def error_columns(actual: Column, predicted: Column, digits: int = 6) -> dict[str, Column]:
    """Rounded value, prediction and errors, computed from unrounded inputs."""
    error = predicted - actual
    return {
        "actual_wsi": rounded(actual, digits),
        "predicted_wsi": rounded(predicted, digits),
        "error": rounded(error, digits),
        "absolute_error": rounded(F.abs(error), digits),
        "squared_error": rounded(error * error, digits),
    }


def long_predictions(df: DataFrame, model: str, evaluation_type: str, spec: PanelSpec) -> DataFrame:
    """Wide forecasts to one row per sequence and horizon."""
    pairs = F.posexplode(F.arrays_zip(F.col("pred").alias("p"), F.col("y").alias("a")))
    rows = df.select("sequence_id", spec.entity, "forecast_origin", pairs.alias("i", "pair"))
    columns = error_columns(F.col("pair.a").cast("double"), F.col("pair.p").cast("double"))
    return rows.select(
        F.lit(evaluation_type).alias("evaluation_type"),
        F.lit(model).alias("model"),
        "sequence_id",
        spec.entity,
        "forecast_origin",
        F.concat(F.lit("h"), F.col("i") + 1).alias("horizon"),
        *[c.alias(n) for n, c in columns.items()],
    )


def choose_champion(predictions: DataFrame) -> DataFrame:
    """One row: the model with the smallest mean of per-horizon MAE, then of per-horizon RMSE."""
    by_horizon = predictions.groupBy("model", "horizon").agg(
        F.avg("absolute_error").alias("_mae"), F.sqrt(F.avg("squared_error")).alias("_rmse")
    )
    by_model = by_horizon.groupBy("model").agg(
        F.round(F.avg("_mae"), 5).alias("mean_val_mae"), F.round(F.avg("_rmse"), 5).alias("mean_val_rmse")
    )
    best = F.min(F.struct("mean_val_mae", "mean_val_rmse", "model")).alias("_b")
    return by_model.agg(best).select(
        F.col("_b.model").alias("champion"), F.col("_b.mean_val_mae").alias("mean_val_mae"),
        F.col("_b.mean_val_rmse").alias("mean_val_rmse"),
    )
