"""Exact grouped quantiles that never hold an unbounded group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelstress.functions.numeric import linear_quantile
from panelstress.session import materialize

_RESOLUTION = 512.0
_UNIT = 1e6
_BINS = 4096
_TOP = 1 << 40
#: Distinct values that one task orders; bins that hold more are narrowed again.
BIN_LIMIT = 100_000
#: Buckets in which groups are counted before single groups are.
_HASHES = 1 << 16


def exact_quantiles(
    df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float],
    extra: dict[str, Column] | None = None, limit: int = BIN_LIMIT,
) -> DataFrame:
    """Linear-interpolation quantiles per key group, and further aggregates in ``extra``.

    With further aggregates the rows are written first, so that what they come from runs once; pass the columns in need
    only. Result: keys, n, extra columns, quantiles.
    """
    extra = extra or {}
    if not extra:
        return split_quantiles(df, keys, value, quantiles, limit)
    rows = materialize(df.where(F.col(value).isNotNull()), "quantile-rows")
    split = split_quantiles(rows, keys, value, quantiles, limit)
    others = rows.groupBy(*keys).agg(*[c.alias(name) for name, c in extra.items()])
    names = {k: f"_key_{k}" for k in keys}
    others = others.withColumnsRenamed(names)
    same = [F.col(k).eqNullSafe(F.col(names[k])) for k in keys]
    joined = split.join(others, same) if keys else split.crossJoin(others)
    return joined.select(*keys, "n", *extra, *quantiles)


def _coarse_bucket() -> Column:
    """Monotone logarithmic bucket of a value, about 0.2 % wide; infinities and NaN have their own, NaN last."""
    v = F.col("_v")
    finite = (F.signum(v) * F.floor(F.log1p(F.abs(v) * _UNIT) * _RESOLUTION)).cast("long")
    infinite = F.when(v > 0, F.lit(_TOP)).otherwise(F.lit(-_TOP))
    return F.when(F.isnan(v), F.lit(2 * _TOP)).when(F.abs(v) == float("inf"), infinite).otherwise(finite)


def _fine_bucket() -> Column:
    """Equal bins between the smallest and largest value found in the bin before."""
    share = (F.col("_v") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    return F.when(F.col("_lo") == F.col("_hi"), F.lit(0)).otherwise(F.coalesce(F.floor(share * _BINS), F.lit(0))).cast("long")


def _wanted(probabilities: list[float], first: Column, last: Column) -> Column:
    """True where one of the ranks lies in [first, last)."""
    hit = F.lit(False)
    for p in probabilities:
        for side in (F.floor, F.ceil):
            rank = _rank(p, side)
            hit = hit | ((rank >= first) & (rank < last))
    return hit


def _rank(p: float, side) -> Column:
    return side((F.col("n") - 1).cast("double") * F.lit(p)).cast("long")


def _narrow(values: DataFrame, group: list[str], bucket: str, probabilities: list[float]) -> DataFrame:
    """Keep the values of those buckets that hold a wanted rank.

    The histogram has one row per bucket, which bounds the window over it whatever the group holds.
    ``_before`` counts the values in front of the bucket.
    """
    in_group = Window.partitionBy(*group)
    running = in_group.orderBy(bucket).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = "_before" in values.columns
    histogram = values.groupBy(*group, bucket).agg(
        F.sum("_c").alias("_bc"),
        F.min("_v").alias("_lo"),
        F.max("_v").alias("_hi"),
        *([F.max("_before").alias("_base"), F.max("n").alias("n")] if known else []),
    )
    if not known:
        histogram = histogram.withColumn("_base", F.lit(0)).withColumn("n", F.sum("_bc").over(in_group))
    histogram = histogram.withColumn("_before", F.col("_base") + F.sum("_bc").over(running) - F.col("_bc"))
    targets = histogram.where(_wanted(probabilities, F.col("_before"), F.col("_before") + F.col("_bc")))
    rows = values.select(*group, bucket, "_v", "_c")
    targets = targets.select(*group, bucket, "_before", "n", "_lo", "_hi").withColumnsRenamed({c: f"_t{c}" for c in (*group, bucket)})
    same = [F.col(c).eqNullSafe(F.col(f"_t{c}")) for c in (*group, bucket)]
    return rows.join(targets, same).drop(*[f"_t{c}" for c in (*group, bucket)])


def _whole(values: DataFrame, names: list[str]) -> DataFrame:
    """Groups that are ordered as they are; one sort serves these sums and the ranks."""
    group = Window.partitionBy(*names).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return values.withColumn("_before", F.lit(0).cast("long")).withColumns(
        {"n": F.sum("_c").over(group), "_total": F.sum(F.col("_v") * F.col("_c")).over(group)}
    )


def _large_groups(values: DataFrame, names: list[str], limit: int) -> DataFrame | None:
    """Groups of more than ``limit`` distinct values; None when there are none.

    Rows are first counted by a hash of their group, which shuffles at most ``_HASHES`` numbers per task. A bucket holds at least
    as many rows as any of its groups, so only groups in buckets above the limit are counted themselves.
    """
    hashed = values.withColumn("_hash", F.pmod(F.xxhash64(*names), F.lit(_HASHES)))
    full = hashed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select("_hash")
    if full.isEmpty():
        return None
    counts = hashed.join(full, "_hash", "left_semi").groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    large = materialize(counts.where(F.col("_n") > limit).drop("_n"), "quantile-groups")
    return None if large.isEmpty() else large


def _narrowed(values: DataFrame, names: list[str], probabilities: list[float], limit: int) -> tuple[DataFrame, list[str], list[str]]:
    """The values of the bins that hold the wanted ranks, the names of the groups and of the bins."""
    bins = ["_b0"]
    fine = materialize(_narrow(values.withColumn("_b0", _coarse_bucket()), names, "_b0", probabilities), "quantile-bins")
    while True:
        wide = fine.where(F.col("_lo") != F.col("_hi")).groupBy(*names, *bins).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit)
        if wide.isEmpty():
            return fine, names, bins
        bins.append(f"_b{len(bins)}")
        binned = fine.withColumn(bins[-1], _fine_bucket())
        fine = materialize(_narrow(binned, [*names, *bins[:-1]], bins[-1], probabilities), "quantile-bins")


def _squares(mean: Column) -> Column:
    return F.sum(F.col("_c") * (F.col("_v") - mean) * (F.col("_v") - mean))


def _ranked(fine: DataFrame, names: list[str], bins: list[str], probabilities: list[float], moments: bool = False) -> DataFrame:
    """Per group the size and, for every probability, the values at the ranks below and above; of whole groups the moments too."""
    inside = (
        Window.partitionBy(*names, *bins).orderBy("_v")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ordered = fine.withColumn("_last", F.col("_before") + F.sum("_c").over(inside)).withColumn(
        "_first", F.col("_last") - F.col("_c")
    )

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_first")) & (rank < F.col("_last")), F.col("_v")))

    picks = [F.max("n").alias("n")]
    for i, p in enumerate(probabilities):
        picks += [at(_rank(p, F.floor)).alias(f"_lo{i}"), at(_rank(p, F.ceil)).alias(f"_hi{i}")]
    if moments:
        size = F.nullif(F.col("n"), F.lit(0))
        picks += [
            F.max(F.col("_total") / size).alias("mean"), F.sqrt(_squares(F.col("_total") / size) / F.nullif(F.max("n"), F.lit(0))).alias("std")
        ]
    return ordered.groupBy(*names).agg(*picks)


def counted_values(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Distinct values of each group with counts, spread by (keys, value) and written. Nulls are kept with a count of 0."""
    v = F.col(value).cast("double")
    return materialize(df.groupBy(*[F.col(k) for k in keys], v.alias("_v")).agg(F.count(v).alias("_c")), "quantile-values")


def counted_quantiles(
    values: DataFrame, names: list[str], quantiles: dict[str, float], limit: int = BIN_LIMIT, moments: bool = False
) -> DataFrame:
    """Quantiles, and on request ``mean`` and population deviation ``std``, of the groups of a table of :func:`counted_values`.

    A group without any value has the size 0 and nulls. Result: names, n, moments, quantiles.
    """
    probabilities = sorted(set(quantiles.values()))
    found = _large_groups(values, names, limit)
    if found is None:
        summary = _ranked(_whole(values, names), names, [], probabilities, moments)
    else:
        large = found.withColumnsRenamed({k: f"_t{k}" for k in names})
        same = [F.col(k).eqNullSafe(F.col(f"_t{k}")) for k in names]
        wide = values.join(large, same, "left_semi")
        ranked = _ranked(*_narrowed(wide, names, probabilities, limit), probabilities)
        if moments:
            totals = wide.groupBy(*names).agg((F.sum(F.col("_v") * F.col("_c")) / F.nullif(F.sum("_c"), F.lit(0))).alias("mean"))
            totals = totals.withColumnsRenamed({k: f"_t{k}" for k in names})
            centred = wide.join(totals, same).groupBy(*names).agg(
                F.max("mean").alias("mean"), F.sqrt(_squares(F.col("mean")) / F.nullif(F.sum("_c"), F.lit(0))).alias("std")
            )
            ranked = ranked.join(centred.withColumnsRenamed({k: f"_t{k}" for k in names}), same).drop(*[f"_t{k}" for k in names])
        small = _whole(values.join(large, same, "left_anti"), names)
        summary = _ranked(small, names, [], probabilities, moments).unionByName(ranked)

    columns = []
    for name, p in quantiles.items():
        i = probabilities.index(p)
        position = (F.col("n") - 1).cast("double") * F.lit(p)
        fraction = position - F.floor(position).cast("double")
        columns.append(linear_quantile(F.col(f"_lo{i}"), F.col(f"_hi{i}"), fraction).alias(name))
    return summary.select(*names, "n", *(["mean", "std"] if moments else []), *columns)


def split_quantiles(
    df: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], limit: int = BIN_LIMIT
) -> DataFrame:
    """Quantiles of groups of any size.

    A group is first reduced to distinct values with counts, spread by (keys, value) and written. Groups of at most ``limit``
    distinct values are ordered as they are. For larger ones a logarithmic histogram, and then linear ones inside the bins
    that matter, narrow the search until no bin that holds a wanted rank has more than ``limit`` distinct values; only those
    are ordered. Exact for any data: infinities keep their place, NaN counts as the largest value, null keys form a group.
    Result: keys, n, quantiles.
    """
    names = keys or ["_all"]
    rows = df.where(F.col(value).isNotNull())
    values = counted_values(rows if keys else rows.withColumn("_all", F.lit(0)), names, value)
    return counted_quantiles(values, names, quantiles, limit).select(*keys, "n", *quantiles)
