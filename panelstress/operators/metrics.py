"""Accuracy, skill, regime and event tables over long predictions.

All tables come from map-side combining aggregations keyed by model (and horizon, entity or class), so
a model with most of the rows costs no more than any other. Tables of one row per model are finished
with a constant-key window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelstress.functions.numeric import classify, rounded
from panelstress.spec import CLASS_UPPER_BOUNDS, EVENT_THRESHOLDS, PanelSpec


def _when(condition: Column | None, value: Column) -> Column:
    return value if condition is None else F.when(condition, value)


def mae(condition: Column | None = None) -> Column:
    return F.avg(_when(condition, F.col("absolute_error")))


def rmse(condition: Column | None = None) -> Column:
    return F.sqrt(F.avg(_when(condition, F.col("squared_error"))))


def r2(condition: Column | None = None) -> Column:
    """1 - residual over total sum of squares; 0 when the actual values do not vary."""
    actual = _when(condition, F.col("actual_wsi"))
    residual = F.sum((actual - F.col("predicted_wsi")) * (actual - F.col("predicted_wsi")))
    total = F.var_pop(actual) * F.count(actual)
    return F.when(total == 0.0, 0.0).otherwise(1.0 - residual / F.nullif(total, F.lit(0.0)))


def nrmse(condition: Column | None = None) -> Column:
    """Root mean squared error over the population deviation of the actual values."""
    actual = _when(condition, F.col("actual_wsi"))
    gap = actual - F.col("predicted_wsi")
    std = F.stddev_pop(actual)
    return F.when(std == 0.0, 0.0).otherwise(F.sqrt(F.avg(gap * gap)) / F.nullif(std, F.lit(0.0)))


def _horizons(spec: PanelSpec) -> list[str]:
    return [f"h{h}" for h in range(1, spec.horizon + 1)]


def _skill(value: Column, reference: Column) -> Column:
    return F.when(reference > 0.0, 1.0 - value / F.nullif(reference, F.lit(0.0))).otherwise(0.0)


def metrics_table(predictions: DataFrame, spec: PanelSpec, reference: str = "Persistence", digits: int | None = 4) -> DataFrame:
    """One wide row per model: overall and per-horizon accuracy, and skill against a reference model.

    A reference model that is absent counts with error 1.
    """
    aggs = [
        mae().alias("overall_mae"), rmse().alias("overall_rmse"),
        r2().alias("overall_r2"), nrmse().alias("overall_nrmse"),
    ]
    for h in _horizons(spec):
        at = F.col("horizon") == h
        aggs += [mae(at).alias(f"mae_{h}"), rmse(at).alias(f"rmse_{h}"), r2(at).alias(f"r2_{h}")]
    table = predictions.groupBy("model").agg(*aggs)
    everything = Window.partitionBy(F.lit(0))

    def of_reference(name: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("model") == reference, F.col(name))).over(everything), F.lit(1.0))

    skills = {
        "skill_mae_vs_persistence": _skill(F.col("overall_mae"), of_reference("overall_mae")),
        "skill_rmse_vs_persistence": _skill(F.col("overall_rmse"), of_reference("overall_rmse")),
        **{f"skill_mae_{h}": _skill(F.col(f"mae_{h}"), of_reference(f"mae_{h}")) for h in _horizons(spec)},
    }
    table = table.withColumns(skills)
    order = ["overall_mae", "overall_rmse", "overall_r2", "overall_nrmse",
             "skill_mae_vs_persistence", "skill_rmse_vs_persistence"]
    for h in _horizons(spec):
        order += [f"mae_{h}", f"rmse_{h}", f"r2_{h}", f"skill_mae_{h}"]
    return table.select("model", *[(F.col(c) if digits is None else rounded(F.col(c), digits)).alias(c) for c in order])


def entity_metrics(predictions: DataFrame, spec: PanelSpec, digits: int | None = 4) -> DataFrame:
    columns = {"mae": mae(), "rmse": rmse(), "r2": r2()}
    columns |= {f"mae_{h}": mae(F.col("horizon") == h) for h in _horizons(spec)}
    return predictions.groupBy("model", spec.entity).agg(
        *[(c if digits is None else rounded(c, digits)).alias(n) for n, c in columns.items()]
    )


def regime_metrics(predictions: DataFrame, digits: int = 4) -> DataFrame:
    """Errors by class of the actual value; every class appears for every model."""
    classes = [name for name, _ in CLASS_UPPER_BOUNDS]
    found = predictions.groupBy("model", classify("actual_wsi", None).alias("regime")).agg(
        F.count(F.lit(1)).alias("sample_count"), mae().alias("mae"), rmse().alias("rmse")
    )
    grid = found.select("model").distinct().select("model", F.explode(F.array(*map(F.lit, classes))).alias("regime"))
    return grid.join(found, ["model", "regime"], "left").select(
        "model",
        "regime",
        F.coalesce("sample_count", F.lit(0)).alias("sample_count"),
        rounded(F.coalesce("mae", F.lit(0.0)), digits).alias("mae"),
        rounded(F.coalesce("rmse", F.lit(0.0)), digits).alias("rmse"),
    )


def confusion(threshold: float) -> dict[str, Column]:
    actual, predicted = F.col("actual_wsi") >= threshold, F.col("predicted_wsi") >= threshold
    return {
        "tp": F.count(F.when(actual & predicted, 1)),
        "fp": F.count(F.when(~actual & predicted, 1)),
        "fn": F.count(F.when(actual & ~predicted, 1)),
        "tn": F.count(F.when(~actual & ~predicted, 1)),
    }


def confusion_counts(predictions: DataFrame, model: str, threshold: float = 0.5) -> DataFrame:
    rows = predictions.where(F.col("model") == model)
    return rows.groupBy("model").agg(*[c.alias(n) for n, c in confusion(threshold).items()])


def event_scores(prefix: str, digits: int = 4) -> dict[str, Column]:
    """Precision, recall, F1 and status from count columns named ``<prefix>_tp`` and so on."""
    tp, fp, fn = (F.col(f"{prefix}_{c}").cast("double") for c in ("tp", "fp", "fn"))
    precision = F.when(tp + fp > 0, tp / F.nullif(tp + fp, F.lit(0.0))).otherwise(0.0)
    recall = F.when(tp + fn > 0, tp / F.nullif(tp + fn, F.lit(0.0))).otherwise(0.0)
    total = precision + recall
    f1 = F.when(total > 0, 2.0 * precision * recall / F.nullif(total, F.lit(0.0))).otherwise(0.0)
    present = tp + fn > 0
    return {
        f"actual_{prefix}_count": (tp + fn).cast("long"),
        f"{prefix}_precision": F.when(present, rounded(precision, digits)),
        f"{prefix}_recall": F.when(present, rounded(recall, digits)),
        f"{prefix}_f1": F.when(present, rounded(f1, digits)),
        f"{prefix}_status": F.when(present, "estimable").otherwise("not_estimable"),
    }


def event_metrics(predictions: DataFrame, thresholds=EVENT_THRESHOLDS) -> DataFrame:
    """Event scores per model for 'overall' and each horizon; without actual events scores are NULL."""
    counts = {f"{name}_{c}": col for name, t in thresholds for c, col in confusion(t).items()}
    per_horizon = predictions.groupBy("model", "horizon").agg(*[c.alias(n) for n, c in counts.items()])
    rolled = per_horizon.groupingSets(
        [[F.col("model"), F.col("horizon")], [F.col("model")]], "model", "horizon"
    ).agg(*[F.sum(n).alias(n) for n in counts])
    scores: dict[str, Column] = {}
    for name, _ in thresholds:
        scores |= event_scores(name)
    return rolled.select(
        "model", F.coalesce("horizon", F.lit("overall")).alias("horizon"), *[c.alias(n) for n, c in scores.items()]
    )


def comparison_table(metrics: DataFrame, spec: PanelSpec, second: str, digits: int = 4) -> DataFrame:
    """Metrics with skill against persistence and against a second reference, overall and per horizon."""
    everything = Window.partitionBy(F.lit(0))

    def of_second(name: str) -> Column:
        return F.max(F.when(F.col("model") == second, F.col(name))).over(everything)

    hs = _horizons(spec)
    columns = ["overall_mae", *[f"mae_{h}" for h in hs], "overall_rmse", *[f"rmse_{h}" for h in hs],
               "overall_r2", *[f"r2_{h}" for h in hs]]
    out = {c: F.col(c) for c in columns}
    out["skill_vs_persistence"] = F.col("skill_mae_vs_persistence")
    out |= {f"skill_vs_persistence_{h}": F.col(f"skill_mae_{h}") for h in hs}
    out["skill_vs_second"] = _skill(F.col("overall_mae"), of_second("overall_mae"))
    out |= {f"skill_vs_second_{h}": _skill(F.col(f"mae_{h}"), of_second(f"mae_{h}")) for h in hs}
    return metrics.select("model", *[rounded(c, digits).alias(n) for n, c in out.items()])


def winner_report(metrics: DataFrame, spec: PanelSpec, candidate: str, references: list[str]) -> DataFrame:
    """The model with the lowest MAE, and the candidate's improvement over each reference."""
    names = ["overall", *_horizons(spec)]
    column = {"overall": "overall_mae", **{h: f"mae_{h}" for h in _horizons(spec)}}

    def of(model: str, name: str) -> Column:
        return F.max(F.when(F.col("model") == model, F.col(column[name])))

    best = F.min(F.struct("overall_mae", "model"))
    row = metrics.agg(
        best.alias("_best"),
        *[of(m, n).alias(f"_{i}_{n}") for i, m in enumerate([candidate, *references]) for n in names],
    )
    parts = []
    for i, ref in enumerate(references, start=1):
        cells = []
        for n in names:
            mine, theirs = F.col(f"_0_{n}"), F.col(f"_{i}_{n}")
            cells += [
                rounded(theirs - mine, 4).alias(f"{n}_delta_mae"),
                rounded((theirs - mine) / F.nullif(theirs, F.lit(0.0)) * 100.0, 2).alias(f"{n}_skill_pct"),
            ]
        parts.append(F.struct(F.lit(ref).alias("reference"), *cells, (F.col("_0_overall") < F.col(f"_{i}_overall")).alias("beats")))
    return row.select(
        F.col("_best.model").alias("winner"), F.col("_best.overall_mae").alias("winner_mae"),
        F.lit(candidate).alias("candidate"), F.explode(F.array(*parts)).alias("r"),
    ).select("winner", "winner_mae", "candidate", "r.*")


def backtest_summary(predictions: DataFrame, spec: PanelSpec, period: tuple[str, str], name: str = "drought", digits: int = 4) -> DataFrame:
    """Overall, per horizon and inside an origin period; an empty period gives 0."""
    inside = F.col("forecast_origin").between(F.lit(period[0]).cast("date"), F.lit(period[1]).cast("date"))
    columns = {
        "overall_mae": mae(), "overall_rmse": rmse(),
        f"{name}_mae": F.coalesce(mae(inside), F.lit(0.0)), f"{name}_rmse": F.coalesce(rmse(inside), F.lit(0.0)),
    }
    for h in _horizons(spec):
        at = F.col("horizon") == h
        columns |= {f"mae_{h}": mae(at), f"rmse_{h}": rmse(at)}
    return predictions.groupBy("model").agg(
        F.count(F.lit(1)).alias("total_evaluations"), *[rounded(c, digits).alias(n) for n, c in columns.items()]
    )


# ---- runs and experiments --------------------------------------------------------------------

def run_stability(runs: DataFrame, metric: str = "val_mae", group: str = "experiment", digits: int = 6) -> DataFrame:
    """Spread of a metric over repeated runs."""
    c = F.col(metric)
    return runs.groupBy(group).agg(
        F.count(c).alias("runs"),
        *[rounded(v, digits).alias(f"{n}_{metric}") for n, v in {
            "mean": F.avg(c), "std": F.stddev_pop(c), "min": F.min(c), "max": F.max(c), "range": F.max(c) - F.min(c),
        }.items()],
    )


def experiment_decision(
    runs: DataFrame, baseline: str, challenger: str, main_run: str, metric: str = "val_mae",
    group: str = "experiment", run: str = "run", margin: float = 0.001, spread: float = 1.5,
) -> DataFrame:
    """One row: improves, unstable gain, equal within the margin, or worse."""

    def of(name: str, value: Column) -> Column:
        return F.when(F.col(group) == name, value)

    at_main = F.when(F.col(run) == main_run, F.col(metric))
    c = F.col(metric)
    row = runs.agg(
        *[f.alias(f"{side}_{n}") for side, name in (("baseline", baseline), ("challenger", challenger)) for n, f in {
            "main": F.max(of(name, at_main)), "mean": F.avg(of(name, c)), "std": F.stddev_pop(of(name, c)),
        }.items()]
    ).withColumn("delta", F.col("challenger_main") - F.col("baseline_main"))
    stable = (F.col("challenger_mean") < F.col("baseline_mean")) & (
        F.col("challenger_std") <= F.col("baseline_std") * spread
    )
    decision = (
        F.when((F.col("delta") < -margin) & stable, "challenger improves")
        .when(F.col("delta") < -margin, "gain fails stability check")
        .when(F.abs("delta") <= margin, "approximately equal")
        .otherwise("challenger is worse")
    )
    return row.withColumn("decision", decision)


def experiment_table(long_metrics: DataFrame, experiments: list[str], baseline: str, challenger: str) -> DataFrame:
    """(metric, experiment, value) side by side, with the challenger's difference to the baseline."""
    wide = long_metrics.groupBy("metric").agg(
        *[F.max(F.when(F.col("experiment") == e, F.col("value"))).alias(e) for e in experiments]
    )
    return wide.withColumn("delta", F.col(challenger) - F.col(baseline))


def earliest_best_epoch(history: DataFrame, run: str = "run", epoch: str = "epoch", metric: str = "val_mae", tolerance: float = 1e-8) -> DataFrame:
    """First epoch within the tolerance of the run's minimum."""
    low = F.min(metric).over(Window.partitionBy(run))
    return (
        history.withColumn("_low", low)
        .where(F.col(metric) <= F.col("_low") + tolerance)
        .groupBy(run)
        .agg(F.min(epoch).alias("best_epoch"), F.max("_low").alias(f"best_{metric}"))
    )


# ---- tables behind the figures ---------------------------------------------------------------

def mean_forecast_by_origin(predictions: DataFrame, models: list[str]) -> DataFrame:
    """Mean actual and, per model, mean forecast for each (horizon, origin)."""
    return predictions.groupBy("horizon", "forecast_origin").agg(
        F.avg("actual_wsi").alias("actual_mean"),
        *[F.avg(F.when(F.col("model") == m, F.col("predicted_wsi"))).alias(m) for m in models],
    )


def error_by_horizon(metrics: DataFrame, spec: PanelSpec) -> DataFrame:
    """(model, horizon, MAE) from the wide metrics."""
    columns = [f"mae_{h}" for h in _horizons(spec)]
    return metrics.unpivot(["model"], columns, "horizon", "mae").withColumn(
        "horizon", F.regexp_replace("horizon", "^mae_", "")
    )


def residual_histogram(predictions: DataFrame, width: float = 0.1) -> DataFrame:
    """Counts of errors per model in fixed-width bins; ``bin`` is the integer bin number."""
    return predictions.groupBy("model", F.floor(F.col("error") / width).alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )


# Points of the curve, bandwidths beyond the data at its ends. Bins per bandwidth and reach of the kernel
# keep the binned density within a few parts in ten thousand of the exact one.
DENSITY_POINTS = 200
DENSITY_CUT = 3.0
BINS_PER_BANDWIDTH = 32
KERNEL_REACH = 9.0


def density(df: DataFrame, keys: list[str], value: str, points: int = DENSITY_POINTS) -> DataFrame:
    """Gaussian kernel density of a column per key group: keys, point, x, density.

    The bandwidth is std * n^(-1/5). Every value is shared linearly between its two neighbouring bins, which is one aggregation
    with map-side combine; the kernel then runs over the bins, whose number grows with n^(1/5) and the range in deviations, not
    with the rows. Values that are null or not finite take no part; a group of fewer than two different values has no curve.
    """
    v = F.col(value).cast("double")
    rows = df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))).select(*keys, v.alias("_v"))
    moments = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.stddev_samp("_v").alias("_std"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    ).where("_n > 1 AND _std > 0")
    width = moments.withColumn("_h", F.col("_std") * F.pow(F.col("_n").cast("double"), F.lit(-0.2))).withColumn("_bin", F.col("_h") / BINS_PER_BANDWIDTH)
    names = {k: f"_key_{k}" for k in keys}
    same = [F.col(k).eqNullSafe(F.col(names[k])) for k in keys]
    place = (F.col("_v") - F.col("_lo")) / F.col("_bin")
    low = F.floor(place)
    shared = rows.join(width.withColumnsRenamed(names), same).select(
        *keys, "_n", "_lo", "_hi", "_h", "_bin",
        F.explode(F.array(
            F.struct(low.alias("b"), (1.0 - (place - low)).alias("w")), F.struct((low + 1).alias("b"), (place - low).alias("w"))
        )).alias("_s"),
    )
    bins = shared.groupBy(*keys, "_n", "_lo", "_hi", "_h", "_bin", F.col("_s.b").alias("_b")).agg(F.sum("_s.w").alias("_w"))
    start = F.col("_lo") - DENSITY_CUT * F.col("_h")
    step = (F.col("_hi") - F.col("_lo") + 2.0 * DENSITY_CUT * F.col("_h")) / float(points - 1)
    centre = F.col("_lo") + F.col("_b") * F.col("_bin")
    # Points that the kernel of a bin reaches.
    first = F.greatest(F.lit(0), F.ceil((centre - KERNEL_REACH * F.col("_h") - start) / step).cast("int"))
    last = F.least(F.lit(points - 1), F.floor((centre + KERNEL_REACH * F.col("_h") - start) / step).cast("int"))
    reached = bins.select(*keys, "_n", "_h", "_w", start.alias("_start"), step.alias("_step"), centre.alias("_c"), F.explode(F.sequence(first, last)).alias("point"))
    x = F.col("_start") + F.col("point") * F.col("_step")
    u = (x - F.col("_c")) / F.col("_h")
    kernel = F.exp(-0.5 * u * u) / (F.col("_n") * F.col("_h") * F.lit(math.sqrt(2.0 * math.pi)))
    return reached.groupBy(*keys, "point", x.alias("x")).agg(F.sum(F.col("_w") * kernel).alias("density"))


def residual_density(predictions: DataFrame) -> DataFrame:
    """Curve of the errors per model."""
    return density(predictions, ["model"], "error")
