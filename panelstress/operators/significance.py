"""Moving-block bootstrap and Diebold-Mariano test."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelstress.functions.numeric import rounded
from panelstress.functions.special import normal_two_sided_p

_MODULUS = 2147483647
_MULTIPLIER = 48271


def draw(replicate: Column, block: Column, seed: int, size: Column) -> Column:
    """Seeded pseudo-random integer in 0 .. size-1 as an integer formula, the same in any SQL engine."""
    r, b = replicate.cast("long"), block.cast("long")
    a = (r * 7919 + b * 104729 + seed + 1) % _MODULUS
    a = (a * _MULTIPLIER) % _MODULUS
    c = (a * (a % 65536 + 1)) % _MODULUS
    return ((c * _MULTIPLIER) % _MODULUS) % size


#: 32-bit outputs of the generator per row of the table from which draws are made.
_CHUNK = 4096


def _lemire(seed: int, first: int, count: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Outputs ``first`` .. of a PCG64 stream as 32-bit halves, reduced to 0 .. size-1: values, and which of them are drawn.

    The generator jumps to its place, so any part of the stream costs the same. A half whose low product lies below
    2^32 mod size is passed over, which makes all values equally likely.
    """
    stream = np.random.PCG64(seed)
    stream.advance(first // 2)
    words = stream.random_raw((first % 2 + count + 1) // 2)
    halves = np.stack([words & 0xFFFFFFFF, words >> np.uint64(32)], axis=1).ravel()[first % 2 :][:count]
    product = halves * np.uint64(size)
    return (product >> np.uint64(32)).astype(np.int64), (product & np.uint64(0xFFFFFFFF)) >= np.uint64(2**32 % size)


def stream_draws(observed: DataFrame, seed: int, replicates: int, block_length: int) -> DataFrame:
    """(candidate_model, replicate, start): the integers that a seeded numpy generator gives, one vector per replicate.

    Every task makes its part of the stream; the number of values passed over before a part shifts the places of the rest.
    """
    starts, blocks = F.col("origins") - block_length + 1, F.ceil(F.col("origins") / block_length).cast("int")
    wanted = F.lit(replicates) * blocks
    # A value is passed over with a probability below 2^-16 for up to 2^16 starts; the spare part is far beyond that.
    parts = F.explode(F.sequence(F.lit(0), F.ceil(wanted * 1.01 / _CHUNK).cast("int")))
    rows = observed.select("candidate_model", starts.cast("bigint").alias("size"), blocks.alias("blocks"), parts.alias("part"))

    def draw_parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for model, size, blocks, part in pdf.itertuples(index=False):
                if size == 1:  # nothing is drawn where there is one start
                    values, drawn = np.zeros(_CHUNK, np.int64), np.ones(_CHUNK, bool)
                else:
                    values, drawn = _lemire(seed, part * _CHUNK, _CHUNK, size)
                yield pd.DataFrame({"candidate_model": model, "blocks": blocks, "part": part, "values": [values[drawn]]})

    made = rows.repartition("candidate_model", "part").mapInPandas(draw_parts, "candidate_model string, blocks int, part int, values array<bigint>")
    before = Window.partitionBy("candidate_model").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = made.withColumn("_before", F.coalesce(F.sum(F.size("values")).over(before), F.lit(0)))
    flat = placed.select("candidate_model", "blocks", "_before", F.posexplode("values").alias("_i", "start")).withColumn("_at", F.col("_before") + F.col("_i"))
    replicate = F.floor(F.col("_at") / F.col("blocks")).cast("int")
    return flat.select("candidate_model", replicate.alias("replicate"), F.col("start").cast("int").alias("start")).where(F.col("replicate") < replicates)


def formula_draws(observed: DataFrame, seed: int, replicates: int, block_length: int) -> DataFrame:
    """(candidate_model, replicate, start) from an integer formula that any SQL engine can repeat."""
    starts = F.col("origins") - block_length + 1
    return (
        observed.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.ceil(F.col("origins") / block_length).cast("int") - 1)))
        .select("candidate_model", "replicate", draw(F.col("replicate"), F.col("block"), seed, starts).cast("int").alias("start"))
    )


DRAWS = {"formula": formula_draws, "pcg64": stream_draws}


def origin_sums(predictions: DataFrame) -> DataFrame:
    """Absolute errors per (model, origin): all entities and horizons of an origin stay together."""
    return predictions.groupBy("model", "forecast_origin").agg(
        F.sum("absolute_error").alias("s"), F.count("absolute_error").cast("double").alias("n")
    )


def block_bootstrap(
    predictions: DataFrame, champion: str | Column, candidates: list[str] | None = None,
    block_length: int = 3, replicates: int = 1000, seed: int = 42, generator: str = "formula",
) -> DataFrame:
    """Every candidate against the champion, all candidates and replicates in one job.

    Predictions shrink to one row per model and origin first. The origin count is bounded by the
    calendar, so the block table and the draws do not grow with the data. Blocks are not trimmed.
    ``generator`` is "formula", which SQL can repeat, or "pcg64", whose starts are those of numpy's default generator.
    A candidate with too few origins gets an ``error``.
    """
    sums = origin_sums(predictions)
    champion = F.lit(champion) if isinstance(champion, str) else champion
    best = sums.where(F.col("model") == champion).select(
        F.col("model").alias("champion_model"), "forecast_origin", F.col("s").alias("s2"), F.col("n").alias("n2")
    )
    others = sums.where(F.col("model") != champion)
    if candidates is not None:
        others = others.where(F.col("model").isin(candidates))
    pairs = others.join(best, "forecast_origin", "left").withColumnRenamed("model", "candidate_model")

    w = Window.partitionBy("candidate_model").orderBy("forecast_origin")
    ahead = w.rowsBetween(0, block_length - 1)
    whole = Window.partitionBy("candidate_model")
    blocks = (
        pairs.withColumn("start", F.row_number().over(w) - 1)
        .withColumn("origins", F.count(F.lit(1)).over(whole))
        .withColumns({f"b_{c}": F.sum(c).over(ahead) for c in ("s", "n", "s2", "n2")})
    )
    observed = pairs.groupBy("candidate_model").agg(
        F.max("champion_model").alias("champion_model"),
        F.count(F.lit(1)).alias("origins"),
        (F.sum("s") / F.sum("n") - F.sum("s2") / F.sum("n2")).alias("observed"),
    )
    usable = F.col("origins") > block_length
    draws = DRAWS[generator](observed.where(usable), seed, replicates, block_length)
    boot = (
        draws.join(blocks.select("candidate_model", "start", "b_s", "b_n", "b_s2", "b_n2"), ["candidate_model", "start"])
        .groupBy("candidate_model", "replicate")
        .agg((F.sum("b_s") / F.sum("b_n") - F.sum("b_s2") / F.sum("b_n2")).alias("diff"))
    )
    summary = boot.groupBy("candidate_model").agg(
        F.percentile("diff", 0.025).alias("lower"),
        F.percentile("diff", 0.975).alias("upper"),
        F.avg((F.col("diff") <= 0).cast("double")).alias("share_low"),
        F.avg((F.col("diff") >= 0).cast("double")).alias("share_high"),
    )
    p = F.least(F.lit(1.0), 2.0 * F.when(F.col("observed") > 0, F.col("share_low")).otherwise(F.col("share_high")))
    return observed.join(summary, "candidate_model", "left").select(
        "candidate_model",
        "champion_model",
        rounded(F.col("observed"), 5).alias("observed_mae_diff"),
        rounded(F.col("lower"), 5).alias("ci_95_lower"),
        rounded(F.col("upper"), 5).alias("ci_95_upper"),
        F.when(usable, rounded(p, 4)).alias("bootstrap_p_value"),
        ((F.col("lower") > 0) | (F.col("upper") < 0)).alias("significantly_different"),
        ((F.col("observed") < 0) & (F.col("upper") < 0)).alias("candidate_is_better"),
        F.when(~usable, "not enough origins for block bootstrap").alias("error"),
    )


def significance_table(predictions: DataFrame, extra: DataFrame | None = None, references: tuple[str, ...] = (), **options) -> DataFrame:
    """All models against the one with the lowest MAE.

    With a single model pass ``extra`` predictions and ``references``: the model is then compared
    with each of them.
    """
    scores = predictions.groupBy("model").agg(rounded(F.avg("absolute_error"), 4).alias("mae"))
    best = scores.agg(F.min_by("model", F.struct("mae", "model")).alias("m")).scalar()
    if extra is None:
        return block_bootstrap(predictions, best, **options)
    single = predictions.unionByName(extra.where(F.col("model").isin(list(references))))
    name = scores.agg(F.max("model").alias("m")).scalar()
    out = None
    for ref in references:
        part = block_bootstrap(
            single.where((F.col("model") == name) | (F.col("model") == ref)), ref, **options
        )
        out = part if out is None else out.unionByName(part)
    return out


def diebold_mariano(
    pairs: DataFrame, first: str, second: str, position: str, horizon: int, group: list[str] | None = None,
    loss: str = "absolute",
) -> DataFrame:
    """Loss-difference test with Bartlett weights up to lag ``horizon - 1``.

    ``position`` is the dense order of the series inside each group. Lagged products come from an equi-join
    on the shifted position, not from an ordered window, so one long series is spread over all tasks.
    """
    keys = group or []
    a, b = F.col(first), F.col(second)
    d = a * a - b * b if loss == "squared" else F.abs(a) - F.abs(b)
    series = pairs.select(*keys, F.col(position).cast("long").alias("_pos"), d.alias("_d"))
    group_by = keys or [F.lit(0).alias("_all")]
    names = keys or ["_all"]
    base = series.groupBy(*group_by).agg(
        F.count("_d").alias("n"), F.avg("_d").alias("_m"), F.var_pop("_d").alias("_g0")
    )
    lag = max(0, horizon - 1)
    if lag:
        offsets = F.array(*[F.lit(k) for k in range(1, lag + 1)])
        shifted = series.select(*keys, F.explode(offsets).alias("_k"), "_pos", F.col("_d").alias("_old")).withColumn(
            "_pos", F.col("_pos") + F.col("_k")
        )
        products = series.join(shifted, [*keys, "_pos"]).groupBy(*group_by, "_k").agg(
            F.count(F.lit(1)).alias("_c"), F.sum(F.col("_d") * F.col("_old")).alias("_p"),
            F.sum(F.col("_d") + F.col("_old")).alias("_s"),
        )
        weight = 2.0 * (1.0 - F.col("_k") / float(lag + 1))
        cov = (F.col("_p") - F.col("_m") * F.col("_s") + F.col("_c") * F.col("_m") * F.col("_m")) / F.col("_c")
        extra = products.join(base.select(*names, "_m"), names).groupBy(*names).agg(F.sum(weight * cov).alias("_g"))
        base = base.join(extra, names, "left")
    else:
        base = base.withColumn("_g", F.lit(0.0))
    variance = (F.col("_g0") + F.coalesce("_g", F.lit(0.0))) / F.col("n")
    flat = variance <= 1e-12
    stat = F.col("_m") / F.sqrt(F.when(~flat, variance))
    return base.withColumn("_stat", stat).select(
        *keys,
        "n",
        F.when(flat, 0.0).otherwise(rounded(F.col("_stat"), 4)).alias("dm_stat"),
        F.when(flat, 1.0).otherwise(rounded(normal_two_sided_p(F.col("_stat")), 4)).alias("p_value"),
    )
