"""The baseline suite: fit on training data, validate, choose, refit, test."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstress.operators import forecast
from panelstress.operators.sequences import of_splits
from panelstress.spec import PanelSpec

RIDGE_MODELS = {"WSI_Autoregression": "history", "Ridge_Regression": "features"}


def tree_suite(sequences: DataFrame, spec: PanelSpec, rounds: int = forecast.TREE_ROUNDS) -> tuple[dict[str, DataFrame], forecast.TreeFit]:
    """Validation forecasts of the boosted trees, test forecasts of their refit, and the fit."""
    fit = forecast.fit_trees(sequences, spec, rounds=rounds)
    refitted = forecast.refit_trees(sequences, spec, fit)
    parts = {
        "official_validation": forecast.tree_predict(of_splits(sequences, "val"), fit.models),
        "official_test": forecast.tree_predict(of_splits(sequences, "test"), refitted),
    }
    return parts, fit


def run_baselines(
    sequences: DataFrame, panel: DataFrame, spec: PanelSpec, trees: bool = False, rounds: int = forecast.TREE_ROUNDS
) -> tuple[DataFrame, DataFrame, dict]:
    """Validation predictions, test predictions and the chosen settings.

    The models are small (coefficients, trees); the rows they are fitted on and applied to stay
    distributed. Boosted trees are optional because every level of a round is a distributed pass.
    """
    val, test = of_splits(sequences, "val"), of_splits(sequences, "test")
    parts: dict[str, list[DataFrame]] = {"official_validation": [], "official_test": []}
    chosen: dict[str, object] = {}

    def add(kind: str, name: str, rows: DataFrame) -> None:
        parts[kind].append(forecast.long_predictions(rows, name, kind, spec))

    for kind, rows in (("official_validation", val), ("official_test", test)):
        add(kind, "Persistence", forecast.persistence(rows, spec))
        add(kind, "Seasonal_Persistence", forecast.seasonal_persistence(rows, panel, spec))
    for name, inputs in RIDGE_MODELS.items():
        x, width = forecast.ridge_inputs(inputs, spec)
        fit = forecast.fit_ridge(sequences, x, F.col("y"), width, spec.horizon)
        chosen[name] = fit.alpha
        add("official_validation", name, forecast.ridge_predict(val, inputs, fit.train_model, spec))
        add("official_test", name, forecast.ridge_predict(test, inputs, fit.final_model, spec))
    if trees:
        for kind, predicted in tree_suite(sequences, spec, rounds)[0].items():
            add(kind, "Boosted_Trees", predicted)
    union = {k: reduce(DataFrame.unionByName, v) for k, v in parts.items()}
    return union["official_validation"], union["official_test"], chosen
