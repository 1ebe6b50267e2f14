"""Rolling-origin backtest: the loop over origins is a column, not a loop."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelstress.operators import boosting
from panelstress.operators.boosting import (
    BINS, BoostedModel, Booster, Columns, TreeSetting, cell_bins, cell_numbers, deal_models, fit_boosters, grow_alone, grow_in_tasks, predict_boosted,
)
from panelstress.operators.forecast import Moments, error_columns, solve_ridge, tree_rows
from panelstress.operators.sequences import causal_series, count_windows, cut_windows, flat_inputs, pack_windows, unpack_windows
from panelstress.session import materialize
from panelstress.spec import INDEX, PanelSpec


def month_range(start: str, end: str, stride: int = 1) -> list[str]:
    return [d.date().isoformat() for d in pd.date_range(start, end, freq="MS")[::stride]]


def entity_series(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    """One row per entity with its ordered months; a row is bounded by the calendar."""
    row = F.struct(
        F.col(spec.date).alias("d"), F.array(*[F.col(c) for c in spec.components]).alias("f"), F.col(INDEX).alias("w")
    )
    ordered = panel.groupBy(spec.entity).agg(F.sort_array(F.collect_list(row)).alias("s"))
    return ordered.select(
        F.transform("s", lambda r: r["d"]).alias("dates"),
        F.transform("s", lambda r: r["f"]).alias("features"),
        F.transform("s", lambda r: r["w"]).alias("index"),
    )


def _windows(values: np.ndarray, length: int) -> np.ndarray:
    """Rolling row-major windows of a (months, features) matrix."""
    view = np.lib.stride_tricks.sliding_window_view(values, length, axis=0)
    return view.transpose(0, 2, 1).reshape(len(view), -1)


def causal_moments(origins: list[str], spec: PanelSpec):
    """Task-side reduction: Gram matrices per origin, summed over the partition's entities.

    Standardising by the statistics known at the origin is an affine map of the window, so it is applied
    to the running sum of raw products instead of to every window at every origin.
    """
    when = np.array(origins, dtype="datetime64[M]")
    back, ahead = spec.lookback, spec.horizon
    width = len(spec.components)
    sizes = {"features": 1 + back * width + ahead, "history": 1 + back + ahead}

    def reduce_series(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = {k: np.zeros((len(when), s, s)) for k, s in sizes.items()}
        for pdf in batches:
            for dates, features, index in zip(pdf["dates"], pdf["features"], pdf["index"]):
                _add_entity(
                    totals, np.array(dates, dtype="datetime64[M]"), np.vstack(features).astype(float),
                    np.asarray(index, dtype=np.float32).astype(float), when, spec,
                )
        rows = [(o, k, totals[k][i].ravel()) for i, o in enumerate(origins) for k in sizes]
        yield pd.DataFrame(rows, columns=["origin", "kind", "g"])

    return reduce_series


def _add_entity(totals, months, features, index, when, spec: PanelSpec) -> None:
    back, ahead = spec.lookback, spec.horizon
    count = len(months) - back - ahead + 1  # windows with full lookback and horizon
    if count <= 0:
        return
    # Standardising does not see a shift, and centred features lose no digits in the sums of squares and products.
    features = features - features.mean(axis=0)
    ones = np.ones((count, 1))
    y = np.lib.stride_tricks.sliding_window_view(index[back:], ahead)[:count]
    x = _windows(features, back)[:count]
    lags = np.lib.stride_tricks.sliding_window_view(index, back)[:count]
    window_origin = months[back - 1 : back - 1 + count]
    known = np.searchsorted(window_origin, when - ahead, side="right")  # windows usable at each origin
    rows_seen = np.searchsorted(months, when, side="right")
    sums, squares = np.cumsum(features, axis=0), np.cumsum(features**2, axis=0)
    running = {k: np.zeros(totals[k].shape[1:]) for k in totals}
    blocks = {"features": np.hstack([ones, x, y]), "history": np.hstack([ones, lags, y])}
    used = 0
    p = x.shape[1]
    for i in np.argsort(when):
        if known[i] > used:
            for k, z in blocks.items():
                part = z[used : known[i]]
                running[k] += part.T @ part
            used = known[i]
        if used == 0:
            continue
        totals["history"][i] += running["history"]
        n = rows_seen[i]
        mean = sums[n - 1] / n
        std = np.sqrt(np.maximum(squares[n - 1] / n - mean**2, 0.0))
        std[std < 1e-6] = 1.0
        m, s = np.tile(mean, back), np.tile(std, back)
        g = running["features"].copy()
        first = g[0].copy()
        g[1 : p + 1] -= np.outer(m, first)
        g[:, 1 : p + 1] -= np.outer(g[:, 0], m)
        g[1 : p + 1] /= s[:, None]
        g[:, 1 : p + 1] /= s
        totals["features"][i] += g


def fit_origin_models(panel: DataFrame, origins: list[str], spec: PanelSpec, alpha: float = 1.0) -> DataFrame:
    """Ridge coefficients per origin and input kind: (origin, kind, weights[h][input], intercept[h])."""
    inputs = {"features": spec.lookback * len(spec.components), "history": spec.lookback}
    partial = entity_series(panel, spec).mapInPandas(
        causal_moments(origins, spec), "origin string, kind string, g array<double>"
    )
    cells = (
        partial.select("origin", "kind", F.posexplode("g").alias("i", "v"))
        .groupBy("origin", "kind", "i")
        .agg(F.sum("v").alias("v"))
    )

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        origin, kind = key
        size = int(round(len(pdf) ** 0.5))
        gram = pdf.sort_values("i")["v"].to_numpy().reshape(size, size)
        if gram[0, 0] == 0:
            return pd.DataFrame(columns=["origin", "kind", "weights", "intercept"])
        model = solve_ridge(Moments(gram, inputs[kind]), alpha)
        return pd.DataFrame(
            {"origin": [origin], "kind": [kind], "weights": [list(model.coefficients.T)], "intercept": [model.intercept]}
        )

    fitted = cells.groupBy("origin", "kind").applyInPandas(
        solve, "origin string, kind string, weights array<array<double>>, intercept array<double>"
    )
    return fitted.withColumn("origin", F.col("origin").cast("date"))


def current_windows(panel: DataFrame, origins: list[str], spec: PanelSpec) -> DataFrame:
    """The forecast input at each origin, standardised by the months up to it, with the true targets."""
    series = Window.partitionBy(spec.entity).orderBy(spec.date)
    past = series.rowsBetween(Window.unboundedPreceding, 0)
    back = series.rowsBetween(-(spec.lookback - 1), 0)
    means = F.array(*[F.avg(c).over(past) for c in spec.components])
    stds = F.array(*[F.stddev_pop(c).over(past) for c in spec.components])
    step = F.array(*[F.col(c) for c in spec.components])
    leads = range(1, spec.horizon + 1)
    season = 12
    rows = panel.select(
        spec.entity,
        F.col(spec.date).alias("forecast_origin"),
        F.collect_list(step).over(back).alias("_raw"),
        F.collect_list(INDEX).over(back).alias("wsi_history"),
        means.alias("_mean"),
        F.transform(stds, lambda s: F.when(s < 1e-6, F.lit(1.0)).otherwise(s)).alias("_std"),
        F.col(INDEX).alias("wsi_at_origin"),
        F.array(*[F.lead(INDEX, h).over(series) for h in leads]).alias("actual"),
        F.array(*[F.lag(INDEX, season - h).over(series) for h in leads]).alias("_season"),
    ).where((F.size("_raw") == spec.lookback) & F.col("forecast_origin").isin([F.lit(o).cast("date") for o in origins]))
    scaled = F.transform(
        "_raw", lambda v: F.zip_with(F.zip_with(v, F.col("_mean"), lambda a, b: a - b), F.col("_std"), lambda a, b: a / b)
    )
    seasonal = F.transform("_season", lambda v: F.coalesce(v, F.col("wsi_at_origin")))
    return rows.withColumn("x", scaled).withColumn("seasonal", seasonal).drop("_raw", "_mean", "_std", "_season")


def _apply(x, model):
    """Affine forecasts from coefficient arrays stored in columns."""

    def one(weights, i):
        start = F.get(F.col(f"{model}_b"), i)
        return F.aggregate(F.zip_with(x, weights, lambda a, b: a * b), start, lambda s, v: s + v)

    return F.transform(F.col(f"{model}_w"), one)


def backtest_long(rows: DataFrame, forecasts: dict, spec: PanelSpec) -> DataFrame:
    """Stack forecasts to one row per (model, entity, origin, horizon); rows without truth are left out."""
    stacked = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), f.cast("array<float>").alias("pred")) for m, f in forecasts.items()]))
    wide = rows.select(spec.entity, "forecast_origin", "actual", stacked.alias("f"))
    long = wide.select(
        F.col("f.model").alias("model"), spec.entity, "forecast_origin",
        F.posexplode(F.arrays_zip(F.col("f.pred").alias("p"), F.col("actual").alias("a"))).alias("i", "pair"),
    ).where(F.col("pair.a").isNotNull())
    columns = error_columns(F.col("pair.a"), F.col("pair.p").cast("double"))
    return long.select(
        F.lit("historical_diagnostic").alias("evaluation_type"), "model", spec.entity, "forecast_origin",
        F.add_months("forecast_origin", F.col("i") + 1).alias("target_date"),
        F.concat(F.lit("h"), F.col("i") + 1).alias("horizon"),
        *[c.alias(n) for n, c in columns.items()],
    )


# Setting and rounds of the backtest's tree model; the other values are the booster's defaults.
BACKTEST_TREES = TreeSetting(max_depth=3, step=0.08)
BACKTEST_ROUNDS = 50


def rolling_backtest(
    panel: DataFrame, origins: list[str], spec: PanelSpec, alpha: float = 1.0, models: tuple[str, ...] = ("ridge",), rounds: int = BACKTEST_ROUNDS
) -> DataFrame:
    """Persistence, seasonal persistence and, as named, both ridge models and boosted trees at every origin.

    The model table has one row per origin (at most one per calendar month), so it is broadcast.
    """
    rows = current_windows(panel, origins, spec)
    forecasts = {
        "Persistence": F.array_repeat(F.col("wsi_at_origin"), spec.horizon),
        "Seasonal_Persistence": F.col("seasonal"),
    }
    if "ridge" in models:
        fitted = fit_origin_models(panel, origins, spec, alpha)
        wide = fitted.groupBy(F.col("origin").alias("forecast_origin")).agg(
            *[F.max(F.when(F.col("kind") == k, F.col(c))).alias(f"{k}_{short}")
              for k in ("history", "features") for c, short in (("weights", "w"), ("intercept", "b"))]
        )
        rows = rows.join(F.broadcast(wide), "forecast_origin")
        lags = F.transform("wsi_history", lambda v: v.cast("float").cast("double"))
        forecasts["WSI_Autoregression"] = _apply(lags, "history")
        forecasts["Ridge_Regression"] = _apply(flat_inputs(), "features")
    out = backtest_long(rows, forecasts, spec)
    return out.unionByName(backtest_trees(panel, origins, spec, rounds)) if "trees" in models else out


def _grow_windows(boosters: list[Booster], rounds: int, seed: int, spec: PanelSpec):
    """Task-side growing from packed windows; the bins' edges are those of :func:`fit_edges`, as the task holds all rows of its group."""
    back, ahead, width = spec.lookback, spec.horizon, len(spec.components)

    def grow(work: tuple[int, list[int]], packs: Iterator[bytes]) -> Iterator[tuple[int, BoostedModel]]:
        cells, first, y, first_target = unpack_windows(packs, back, ahead)
        columns, edges = Columns(back * width, BINS, len(first)), np.full((back * width, BINS - 1), np.inf)
        for f in range(back * width):
            step, component = divmod(f, width)
            mine = cells[component].take(first + step)
            edges[f], of_cell = cell_bins(np.bincount(mine, minlength=1 << 16), BINS)
            columns.put(f, of_cell.take(mine))
        for number in work[1]:
            target = y.take(first_target + boosters[number].target)
            base = round(float(np.nanmean(target, dtype=np.float64)), 6)
            yield number, grow_alone(boosters[number], edges, columns, target, None, base, rounds, None, seed)

    return grow


def fit_origin_trees(series: DataFrame, origins: list[str], spec: PanelSpec, rounds: int, seed: int, parallelism: int) -> list[BoostedModel | None]:
    """One model per origin and horizon on the windows whose targets the origin knows; the origin's number is the group.

    The windows of an origin go to one task as long as their bins take no more than ``ALONE_BYTES``; those of larger ones are written as rows.
    """
    boosters = [Booster(g, h, BACKTEST_TREES) for g in range(len(origins)) for h in range(spec.horizon)]
    width = spec.lookback * len(spec.components)
    sizes = {origins.index(o): n for o, n in count_windows(series, origins, spec).items()}
    alone = {g: n for g, n in sizes.items() if n * width <= boosting.ALONE_BYTES and BACKTEST_TREES.rows >= 1.0}
    done: dict[int, BoostedModel] = {}
    if work := deal_models(boosters, alone, parallelism):
        packs = pack_windows(series, {origins[g]: g for g in alone}, cell_numbers, spec)
        done = grow_in_tasks(packs.rdd, work, _grow_windows(boosters, rounds, seed, spec))
    large = [n for n, b in enumerate(boosters) if b.group in sizes and n not in done]
    if large:
        some = [origins[g] for g in sizes if g not in alone]
        wanted = F.filter("moments", lambda m: m.origin.isin([F.lit(o).cast("date") for o in some]))
        dates = F.array(*[F.lit(o).cast("date") for o in origins])
        group = (F.array_position(dates, F.col("origin")) - 1).cast("int")
        windows = materialize(cut_windows(series.withColumn("moments", wanted), spec, "train").withColumn("group", group), "backtest-windows")
        rows = tree_rows(windows, spec, F.lit(False), F.col("group"))
        done |= dict(zip(large, fit_boosters(rows, [boosters[n] for n in large], rounds, seed=seed)))
    return [done.get(n) for n in range(len(boosters))]


def backtest_trees(panel: DataFrame, origins: list[str], spec: PanelSpec, rounds: int = BACKTEST_ROUNDS, seed: int = 42) -> DataFrame:
    """Boosted trees at every origin, on the windows whose targets it knows.

    An entity's months and moments are written once; training windows are cut where models grow, current ones where they are forecast.
    Origins without training windows have no forecasts.
    """
    series = materialize(causal_series(panel, origins, spec), "backtest-series")
    models = fit_origin_trees(series, origins, spec, rounds, seed, panel.sparkSession.sparkContext.defaultParallelism)
    dates = F.array(*[F.lit(o).cast("date") for o in origins])
    current = cut_windows(series, spec, "current").withColumn("group", (F.array_position(dates, F.col("origin")) - 1).cast("int"))
    current = current.select("group", spec.entity, "forecast_origin", "x")
    pred = predict_boosted(current, models, flat_inputs(), F.col("group")).select(spec.entity, "forecast_origin", "pred")
    truth = current_windows(panel, origins, spec).select(spec.entity, "forecast_origin", "actual")
    return backtest_long(pred.join(truth, [spec.entity, "forecast_origin"]), {"Boosted_Trees": F.col("pred")}, spec)
