"""Lookback windows, targets, ids, histories and their checks."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelstress.functions.numeric import month_number
from panelstress.operators.calendar import origin_split
from panelstress.session import materialize
from panelstress.spec import INDEX, STD_FLOOR, PanelSpec


def _series(spec: PanelSpec, *extra: str) -> Window:
    return Window.partitionBy(*extra, spec.entity).orderBy(spec.date)


def slide(panel: DataFrame, spec: PanelSpec, *partition: str) -> DataFrame:
    """Every row with a full lookback and horizon: inputs, index history, targets and their dates.

    Whether a lookback is full follows from the row number, so that counting windows collects no values.
    """
    w = _series(spec, *partition)
    back = w.rowsBetween(-(spec.lookback - 1), 0)
    step = F.array(*[F.col(c).cast("float") for c in spec.components])
    leads = range(1, spec.horizon + 1)
    return (
        panel.select(
            *partition,
            spec.entity,
            F.col(spec.date).alias("forecast_origin"),
            F.lag(spec.date, spec.lookback - 1).over(w).alias("input_start"),
            F.col(spec.date).alias("input_end"),
            *[F.lead(spec.date, h).over(w).alias(f"target_t{h}") for h in leads],
            F.collect_list(step).over(back).alias("x"),
            F.collect_list(INDEX).over(back).alias("wsi_history"),
            F.array(*[F.lead(INDEX, h).over(w).cast("float") for h in leads]).alias("y"),
            F.col(INDEX).alias("wsi_at_origin"),
            F.row_number().over(w).alias("_months"),
        )
        .where((F.col("_months") >= spec.lookback) & F.col(f"target_t{spec.horizon}").isNotNull())
        .drop("_months")
    )


def build_sequences(panel: DataFrame, spec: PanelSpec) -> DataFrame:
    """Windows whose origin belongs to a split."""
    return (
        slide(panel, spec)
        .withColumn("split", origin_split("forecast_origin", spec))
        .where(F.col("split").isNotNull())
    )


def entity_offsets(counts: DataFrame, spec: PanelSpec) -> DataFrame:
    """Rows of all earlier entities, for a table ``(entity, n)``, without a global window.

    The counts are range-partitioned by entity and written, which freezes the partition of each row;
    partition totals (one row per partition) are accumulated and added to the running sum inside
    the partition.
    """
    e = spec.entity
    ranged = materialize(
        counts.repartitionByRange(e).withColumn("_part", F.spark_partition_id()), "entity-counts"
    )
    parts = ranged.groupBy("_part").agg(F.sum("n").alias("_total"))
    one = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", F.coalesce(F.sum("_total").over(one), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_part").orderBy(e).rowsBetween(Window.unboundedPreceding, -1)
    return (
        ranged.withColumn("_before", F.coalesce(F.sum("n").over(inside), F.lit(0)))
        .join(parts, "_part")
        .select(e, (F.col("_base") + F.col("_before")).alias("offset"))
    )


def add_sequence_ids(sequences: DataFrame, spec: PanelSpec) -> DataFrame:
    """Dense position and zero-padded id in (entity, origin) order."""
    e = spec.entity
    counts = sequences.groupBy(e).agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy(e).orderBy("forecast_origin"))
    return (
        sequences.withColumn("_rank", rank)
        .join(entity_offsets(counts, spec), e)
        .withColumn("position", F.col("offset") + F.col("_rank"))
        .withColumn("sequence_id", F.format_string("%06d", F.col("position")))
        .drop("_rank", "offset")
    )


def flat_inputs(x: str | Column = "x") -> Column:
    """Row-major (step, feature) vector."""
    return F.flatten(F.col(x) if isinstance(x, str) else x)


def sequence_report(sequences: DataFrame, spec: PanelSpec) -> DataFrame:
    """Counts, shapes, finiteness, entity balance, boundaries and month continuity per split."""
    width = len(spec.components)
    values = F.flatten("x")
    shape_bad = (
        (F.size("x") != spec.lookback)
        | F.exists("x", lambda s: F.size(s) != width)
        | (F.size("y") != spec.horizon)
    )
    bad_value = F.exists(
        F.concat(values, F.col("y")),
        lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")),
    )
    origin = month_number("forecast_origin")
    broken = (
        (F.col("input_end") != F.col("forecast_origin"))
        | (origin - month_number("input_start") != spec.lookback - 1)
    )
    for h in range(1, spec.horizon + 1):
        broken = broken | (month_number(f"target_t{h}") - origin != h)
    per_entity = sequences.groupBy("split", spec.entity).agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum(shape_bad.cast("int")).alias("_shape"),
        F.sum(bad_value.cast("int")).alias("_value"),
        F.sum(F.coalesce(broken, F.lit(True)).cast("int")).alias("_break"),
        F.min("forecast_origin").alias("_o1"),
        F.max("forecast_origin").alias("_o2"),
        F.min("target_t1").alias("_t1"),
        F.max(f"target_t{spec.horizon}").alias("_t2"),
    )
    return per_entity.groupBy("split").agg(
        F.sum("_n").alias("sequences"),
        F.count(F.lit(1)).alias("entities"),
        F.min("_n").alias("min_per_entity"),
        F.max("_n").alias("max_per_entity"),
        F.sum("_shape").alias("bad_shapes"),
        F.sum("_value").alias("non_finite"),
        F.sum("_break").alias("broken_months"),
        F.min("_o1").alias("first_origin"),
        F.max("_o2").alias("last_origin"),
        F.min("_t1").alias("first_target"),
        F.max("_t2").alias("last_target"),
    )


def verify_values(sequences: DataFrame, panel: DataFrame, spec: PanelSpec) -> DataFrame:
    """Largest difference between every stored window value and its source row, over all sequences.

    The panel is packed into one map per entity (bounded by the calendar) and joined once; values are compared inside
    the row of their sequence. Source rows of one key are all compared.
    """
    e = spec.entity
    month = F.struct(F.array(*[F.col(c) for c in spec.components]).alias("f"), F.col(INDEX).alias("w"))
    source = panel.groupBy(*spec.keys).agg(F.collect_list(month).alias("_rows")).groupBy(e).agg(
        F.map_from_entries(F.collect_list(F.struct(spec.date, "_rows"))).alias("_source")
    )

    def found(first: Column) -> Column:
        """The source rows of a month; one without values when there are none."""
        none = F.array(F.struct(F.lit(None).cast("array<double>").alias("f"), F.lit(None).cast("double").alias("w")))
        return F.coalesce(F.try_element_at("_source", first), none)

    def pairs(column: str, start: str, shift: int) -> Column:
        return F.flatten(F.transform(column, lambda v, i: F.transform(found(F.add_months(start, i + shift)), lambda s: F.struct(v.alias("v"), s.alias("s")))))

    def count(values: Column) -> Column:
        return F.coalesce(F.sum(F.array_size(values).cast("long")), F.lit(0))

    gap = F.array_max(F.transform("_inputs", lambda p: F.array_max(F.zip_with(p["v"], p["s"]["f"], lambda a, b: F.abs(a.cast("double") - b)))))
    rows = sequences.select(e, "input_start", "forecast_origin", "x", "y").join(source, e, "left").select(
        pairs("x", "input_start", 0).alias("_inputs"), pairs("y", "forecast_origin", 1).alias("_targets")
    )
    return rows.agg(
        count(F.filter("_inputs", lambda p: p["v"].isNotNull())).alias("input_steps"),
        count(F.filter("_targets", lambda p: p["v"].isNotNull())).alias("targets"),
        (count(F.filter("_inputs", lambda p: p["s"]["w"].isNull())) + count(F.filter("_targets", lambda p: p["s"]["w"].isNull()))).alias("unmatched"),
        F.max(gap).alias("max_input_diff"),
        F.max(F.array_max(F.transform("_targets", lambda p: F.abs(p["v"].cast("double") - p["s"]["w"])))).alias("max_target_diff"),
    )


def index_histories(panel: DataFrame, meta: DataFrame, spec: PanelSpec) -> DataFrame:
    """Stored index values of each sequence's input months, for metadata without histories.

    Months are generated per sequence and joined by key; a missing, repeated or non-finite month
    raises while rows are computed.
    """
    months = F.sequence("input_start", "input_end", F.expr("interval 1 month"))
    wanted = meta.select("sequence_id", spec.entity, F.explode(months).alias(spec.date))
    found = wanted.join(panel.select(*spec.keys, INDEX), spec.keys, "left")
    grouped = found.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct(spec.date, INDEX))).alias("_h")
    )
    history = F.transform("_h", lambda s: s[INDEX])
    good = (F.size("_h") == spec.lookback) & ~F.exists(
        history, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    )
    failed = F.raise_error(F.concat(F.lit("incomplete index history of sequence "), F.col("sequence_id")))
    return grouped.select(
        "sequence_id", F.when(good, history).otherwise(failed.cast("array<double>")).alias("wsi_history")
    )


def of_splits(sequences: DataFrame, *splits: str) -> DataFrame:
    """Rows of the named splits, e.g. training plus validation for a refit."""
    return sequences.where(F.col("split").isin(*splits))


def origin_moments(panel: DataFrame, origins: list[str], spec: PanelSpec) -> DataFrame:
    """One row per entity: ``moments``, an array of (origin, mean, std) over its rows up to each origin.

    Running moments come from one pass over an entity's months; a row's moments hold for the origins from its date
    until the next row's. The array is bounded by the number of origins, whatever the number of rows.
    """
    w = _series(spec)
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    dates = F.array(*[F.lit(o).cast("date") for o in sorted(origins)])
    stds = [F.stddev_pop(c).over(past) for c in spec.components]
    rows = panel.select(
        spec.entity,
        F.col(spec.date).alias("_from"),
        F.lead(spec.date).over(w).alias("_until"),
        F.array(*[F.avg(c).over(past) for c in spec.components]).alias("mean"),
        F.array(*[F.when(s < STD_FLOOR, F.lit(1.0)).otherwise(s) for s in stds]).alias("std"),
    )
    until = F.col("_until")
    held = F.filter(dates, lambda o: (o >= F.col("_from")) & (until.isNull() | (o < until)))
    return rows.select(spec.entity, F.explode(held).alias("origin"), "mean", "std").groupBy(spec.entity).agg(
        F.sort_array(F.collect_list(F.struct("origin", "mean", "std"))).alias("moments")
    )


def expanding_z(panel: DataFrame, origins: list[str], spec: PanelSpec) -> DataFrame:
    """For each origin, rows up to it with features standardised by those rows only.

    A row meets its entity's moments once and is standardised by them per origin; no window is keyed by the origin.
    """
    rows = panel.join(origin_moments(panel, origins, spec), spec.entity)
    later = F.explode(F.filter("moments", lambda m: m.origin >= F.col(spec.date)))
    return rows.select(*spec.keys, *spec.components, INDEX, later.alias("_m")).select(
        F.col("_m.origin").alias("origin"), *spec.keys,
        *[((F.col(c) - F.col("_m.mean")[i]) / F.col("_m.std")[i]).alias(c) for i, c in enumerate(spec.components)], INDEX,
    )


#: Rows of a batch that a task hands back, and entities whose packed windows share a value.
_BATCH = 8_192
_PACKED = 256


def _lists(values: pa.Array, *sizes: int) -> pa.Array:
    """Values as (nested) lists of fixed sizes, from the innermost on."""
    for size in sizes:
        values = pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) + 1, size, dtype=np.int32)), values)
    return values


def _numbers(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of numbers and where they are null, from lists of a fixed size."""
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(-1, width), flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, width)


def _cut_windows(batches: Iterator[pa.RecordBatch], back: int, ahead: int, width: int, role: str | None) -> Iterator[pa.RecordBatch]:
    """Per entity of a batch (entity, series, moments) the windows of all origins, or those of one role, standardised by what an origin knows."""

    def gather(entity: pa.Array, parts: list[tuple]) -> pa.RecordBatch:
        owner, origin, at, x, x_null, index, index_null, y, y_null, train = (np.concatenate(c) for c in zip(*parts))
        held = ~index_null
        history = pa.ListArray.from_arrays(
            pa.array(np.append(0, np.cumsum(held.sum(axis=1))).astype(np.int32)), pa.array(index[held].astype(np.float32))
        )
        targets = pa.array(y[train].ravel().astype(np.float32), mask=y_null[train].ravel())
        ends = pa.array(np.append(0, np.cumsum(train) * ahead).astype(np.int32), mask=np.append(~train, False))
        return pa.RecordBatch.from_arrays(
            [pa.array(origin), entity.take(pa.array(owner)), pa.array(at), _lists(pa.array(x.ravel(), mask=x_null.ravel()), width, back),
             history, pa.ListArray.from_arrays(ends, targets), pa.array(np.where(train, "train", "current"))],
            names=["origin", "entity", "forecast_origin", "x", "wsi_history", "y", "role"],
        )

    for batch in batches:
        parts, rows = [], 0
        series, moments = batch.column("s"), batch.column("moments")
        for i in range(batch.num_rows):
            s, m = series[i].values, moments[i].values
            dates = s.field("d").to_numpy(zero_copy_only=False).astype("datetime64[D]")
            count = len(dates) - back + 1
            if count <= 0:
                continue
            features, nulls = _numbers(s.field("f"), width)
            index = s.field("w").to_numpy(zero_copy_only=False).astype(float)
            index_null = s.field("w").is_null().to_numpy(zero_copy_only=False)
            origins, known = (m.field(c).to_numpy(zero_copy_only=False).astype("datetime64[D]") for c in ("origin", "known"))
            (mean, mean_null), (std, std_null) = _numbers(m.field("mean"), width), _numbers(m.field("std"), width)
            at = dates[back - 1 :]
            train = (at[:, None] <= known) & (at[:, None] != origins)
            current = at[:, None] == origins
            w, o = np.nonzero({"train": train, "current": current}.get(role, train | current))
            step = w[:, None] + np.arange(back)
            with np.errstate(all="ignore"):
                x = ((features[step] - mean[o][:, None]) / std[o][:, None]).astype(np.float32)
            x_null = nulls[step] | (mean_null | std_null)[o][:, None]
            target = w[:, None] + back - 1 + np.arange(1, ahead + 1)
            beyond = target >= len(dates)
            target[beyond] = 0
            unknown = beyond | (dates[target] > origins[o][:, None]) | index_null[target]
            parts.append((np.full(len(w), i), origins[o], at[w], x, x_null, index[step], index_null[step], index[target], unknown, train[w, o]))
            rows += len(w)
            if rows >= _BATCH:
                yield gather(batch.column(0), parts)
                parts, rows = [], 0
        if rows:
            yield gather(batch.column(0), parts)


def _packed_windows(
    batches: Iterator[pa.RecordBatch], groups: dict[np.datetime64, int], code: Callable[[np.ndarray], np.ndarray], back: int, ahead: int, width: int
) -> Iterator[pa.RecordBatch]:
    """Per group (origin) and some entities one value that holds their training windows, see :func:`unpack_windows`."""
    for batch in batches:
        for start in range(0, batch.num_rows, _PACKED):
            found: dict[int, list[tuple[int, np.ndarray, np.ndarray]]] = {}
            series, moments = (batch.slice(start, _PACKED).column(c) for c in ("s", "moments"))
            for s, m in zip(series, moments):
                s, m = s.values, m.values
                dates = s.field("d").to_numpy(zero_copy_only=False).astype("datetime64[D]")
                if len(dates) < back:
                    continue
                origins, known = (m.field(c).to_numpy(zero_copy_only=False).astype("datetime64[D]") for c in ("origin", "known"))
                features, mean, std = (_numbers(c, width)[0] for c in (s.field("f"), m.field("mean"), m.field("std")))
                with np.errstate(all="ignore"):
                    x = code(((features[None] - mean[:, None]) / std[:, None]).astype(np.float32))
                index = np.append(s.field("w").to_numpy(zero_copy_only=False).astype(np.float32), np.full(ahead, np.nan, np.float32))
                later = np.append(dates, np.full(ahead, dates[-1]))
                for i, n in enumerate(np.searchsorted(dates[back - 1 :], known, "right")):
                    group = groups.get(origins[i])
                    if n and group is not None:
                        target = slice(back, back + n + ahead - 1)
                        y = np.where(later[target] > origins[i], np.float32(np.nan), index[target])
                        found.setdefault(group, []).append((n, x[i, : n + back - 1], y))
            for group, parts in found.items():
                n, x, y = zip(*parts)
                value = pickle.dumps((np.array(n), np.concatenate(x), np.concatenate(y)))
                yield pa.RecordBatch.from_arrays([pa.array([group], pa.int32()), pa.array([value], pa.binary())], names=["group", "pack"])


def pack_windows(series: DataFrame, groups: dict[str, int], code: Callable[[np.ndarray], np.ndarray], spec: PanelSpec) -> DataFrame:
    """Values (group, pack) that hold the training windows of the origins in ``groups``, from :func:`causal_series`.

    The windows of an entity at an origin overlap, so its standardised months are sent once instead of once per window. ``code`` gives the
    form, of the same shape, in which they are sent.
    """
    of_day = {np.datetime64(o, "D"): g for o, g in groups.items()}
    back, ahead, width = spec.lookback, spec.horizon, len(spec.components)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _packed_windows(batches, of_day, code, back, ahead, width)

    return series.mapInArrow(pack, "group int, pack binary")


def unpack_windows(packs: Iterator[bytes], back: int, ahead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Coded values by component and month of all entities, the first month of every window, targets, and the first target of every window."""
    n, x, y = (np.concatenate(c) for c in zip(*map(pickle.loads, packs)))
    number, entity = np.arange(n.sum()), np.repeat(np.arange(len(n)), n)
    return np.ascontiguousarray(x.T), number + entity * (back - 1), y, number + entity * (ahead - 1)


def count_windows(series: DataFrame, origins: list[str], spec: PanelSpec) -> dict[str, int]:
    """Training windows per origin that has any."""
    last = F.array(*[F.struct(F.lit(o).alias("origin"), F.add_months(F.lit(o).cast("date"), -spec.horizon).alias("known")) for o in origins])
    at = F.explode(F.expr(f"slice(s.d, {spec.lookback}, size(s))")).alias("d")
    known = F.explode(F.filter(last, lambda k: k.known >= F.col("d"))).alias("k")
    dates = series.select(at).groupBy("d").agg(F.count(F.lit(1)).alias("n"))
    return {r["origin"]: r["n"] for r in dates.select("n", known).groupBy("k.origin").agg(F.sum("n").alias("n")).collect()}


def causal_series(panel: DataFrame, origins: list[str], spec: PanelSpec) -> DataFrame:
    """One row per entity: its months in order (date, features, index), bounded by the calendar, and its moments at every origin."""
    e, ahead = spec.entity, spec.horizon
    month = F.struct(F.col(spec.date).alias("d"), F.array(*[F.col(c).cast("double") for c in spec.components]).alias("f"), F.col(INDEX).cast("double").alias("w"))
    series = panel.groupBy(e).agg(F.sort_array(F.collect_list(month)).alias("s"))
    moments = origin_moments(panel, origins, spec).select(
        e, F.transform("moments", lambda m: F.struct(m.origin.alias("origin"), F.add_months(m.origin, -ahead).alias("known"), m.mean.alias("mean"), m.std.alias("std"))).alias("moments")
    )
    return series.join(moments, e).select(e, "s", "moments")


def cut_windows(series: DataFrame, spec: PanelSpec, role: str | None = None) -> DataFrame:
    """The windows of :func:`causal_series`, all or those of one role, cut and standardised by array arithmetic inside the task."""
    e, back, ahead, width = spec.entity, spec.lookback, spec.horizon, len(spec.components)
    entity = series.schema[e].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _cut_windows(batches, back, ahead, width, role)

    return series.mapInArrow(
        cut, f"origin date, entity {entity}, forecast_origin date, x array<array<float>>, wsi_history array<float>, y array<float>, role string"
    ).withColumnRenamed("entity", e)


def causal_sequences(panel: DataFrame, origins: list[str], spec: PanelSpec) -> DataFrame:
    """Training windows (targets known at the origin) and the current window, per backtest origin.

    ``role`` is 'train' or 'current'; current windows carry no targets. An entity's months meet its moments in one row.
    """
    return cut_windows(causal_series(panel, origins, spec), spec)
