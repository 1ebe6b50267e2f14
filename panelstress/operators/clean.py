"""Row-level cleaning and structural contracts of raw streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelstress.functions.numeric import calendar_date, month_start, numeric
from panelstress.spec import SOIL_LAYER_DEPTHS_MM


def normalize_entity(df: DataFrame, entity: str, aliases: DataFrame | dict[str, str] | None = None) -> DataFrame:
    """Trim names and replace known aliases; unknown names stay.

    A dictionary becomes a map literal. An alias table ``(alias, canonical)`` may grow with the data
    and is joined without a hint, so the optimizer broadcasts it only when it measures it small.
    """
    clean = F.trim(F.col(entity).cast("string"))
    if aliases is None:
        return df.withColumn(entity, clean)
    if isinstance(aliases, dict):
        lookup = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
        return df.withColumn(entity, F.coalesce(F.try_element_at(lookup, clean), clean))
    # One row per alias, so that readings are not multiplied; an alias with two names is an error, not a choice.
    clash = F.raise_error(F.concat(F.lit("alias with several canonical names: "), F.first("alias")))
    table = aliases.groupBy(F.col("alias").alias("_alias")).agg(
        F.when(F.min("canonical") == F.max("canonical"), F.min("canonical")).otherwise(clash.cast("string")).alias("_canonical")
    )
    return (
        df.withColumn(entity, clean)
        .join(table, F.col(entity) == F.col("_alias"), "left")
        .withColumn(entity, F.coalesce("_canonical", entity))
        .drop("_alias", "_canonical")
    )


def keep_members(df: DataFrame, members: DataFrame | list[str], entity: str) -> DataFrame:
    """Rows of known entities only."""
    if isinstance(members, list):
        return df.where(F.col(entity).isin(members))
    return df.join(members.select(entity).distinct(), entity, "left_semi")


def coerce_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: numeric(c) for c in columns})


def anchor_months(df: DataFrame, date: str) -> DataFrame:
    """First-of-month date from integer ``year`` and ``month`` columns."""
    return (
        df.withColumn("year", F.col("year").cast("int"))
        .withColumn("month", F.col("month").cast("int"))
        .withColumn(date, month_start("year", "month"))
    )


def outside(value: Column, lower: float | None, upper: float | None, strict_lower: bool = False) -> Column:
    """True where a present value breaks its bounds; missing values pass."""
    bad = F.lit(False)
    if lower is not None:
        bad = bad | ((value <= lower) if strict_lower else (value < lower))
    if upper is not None:
        bad = bad | (value > upper)
    return F.coalesce(bad, F.lit(False))


def contract_report(df: DataFrame, keys: list[str], bounds: dict[str, tuple]) -> DataFrame:
    """One row: row count, surplus rows per key, and values out of bounds per column, in one shuffle."""
    names = {c: f"{c}_outside" for c in bounds}
    partial = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(outside(F.col(c), *b).cast("int")).alias(names[c]) for c, b in bounds.items()],
    )
    return partial.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("n_rows"),
        F.coalesce(F.sum((F.col("_n") > 1).cast("int")), F.lit(0)).cast("long").alias("duplicate_keys"),
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names.values()],
    )


def require_contract(report: DataFrame, name: str) -> None:
    """Raise when a contract report (a single row) shows a violation."""
    row = report.first().asDict()
    broken = {k: v for k, v in row.items() if k != "n_rows" and v}
    if broken:
        raise ValueError(f"{name}: contract violated: {broken}")


def drop_invalid(df: DataFrame, level: str, date: str | None = None) -> DataFrame:
    """Rows with a level of at least zero and, when named, a date."""
    keep = F.col(level).isNotNull() & (F.col(level) >= 0.0)
    return df.where(keep if date is None else keep & F.col(date).isNotNull())


def drop_copies(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per distinct combination."""
    return df.dropDuplicates(columns)


def clean_observations(
    df: DataFrame, well: str, date: str, level: str, entity: str, carry: list[str] | None = None
) -> DataFrame:
    """Well readings with bad dates, missing or negative levels and conflicting readings removed.

    Exact copies collapse and a (well, date) with more than one distinct level is dropped whole:
    both follow from the smallest and largest level of the key, so one aggregation with map-side
    combine does it and a hot well is never collected.
    """
    carry = [c for c in (carry or []) if c in df.columns]
    attributes = [entity, *carry]
    rows = drop_invalid(
        df.withColumn("raw_date", calendar_date(date)).withColumn(level, numeric(level)), level, "raw_date"
    )
    return (
        drop_conflicts(rows, [well, "raw_date"], level, attributes)
        .withColumn("obs_date", F.trunc("raw_date", "MM").cast("date"))
        .withColumn("year", F.year("obs_date"))
        .withColumn("month", F.month("obs_date"))
        .select(well, entity, *carry, "raw_date", "obs_date", "year", "month", level)
    )


def drop_conflicts(df: DataFrame, keys: list[str], level: str, attributes: list[str]) -> DataFrame:
    """One row per key whose readings all agree; keys with differing levels vanish."""
    # A single fixed-width attribute keeps the aggregation hash-based.
    attribute = F.min(attributes[0]) if len(attributes) == 1 else F.min(F.struct(*attributes))
    grouped = df.groupBy(*keys).agg(F.min(level).alias(level), F.max(level).alias("_hi"), attribute.alias("_attr"))
    picked = [F.col("_attr").alias(attributes[0])] if len(attributes) == 1 else [F.col(f"_attr.{a}").alias(a) for a in attributes]
    return grouped.where(F.col("_hi") == F.col(level)).select(*keys, level, *picked)


def monthly_observations(df: DataFrame, well: str, level: str, entity: str) -> DataFrame:
    """The same cleaning repeated at (well, month) grain."""
    return drop_conflicts(drop_invalid(df, level, "obs_date"), [well, "obs_date"], level, [entity])


def mask_artifacts(
    df: DataFrame, value: str, rules: DataFrame, entity: str, tolerance: float = 1e-4
) -> DataFrame:
    """Null out known source artifacts given as rows ``(entity, year, month, artifact_value)``.

    Adds ``<value>_raw`` (the value before masking) and ``<value>_artifact_masked`` (0/1).
    """
    if f"{value}_raw" not in df.columns:
        df = df.withColumn(f"{value}_raw", F.col(value))
    per_cell = rules.groupBy(entity, "year", "month").agg(F.collect_set("artifact_value").alias("_artifacts"))
    hit = F.coalesce(
        F.exists("_artifacts", lambda a: F.abs(F.col(f"{value}_raw") - a) < tolerance), F.lit(False)
    )
    return (
        df.join(per_cell, [entity, "year", "month"], "left")
        .withColumn(f"{value}_artifact_masked", hit.cast("int"))
        .withColumn(value, F.when(F.col(f"{value}_artifact_masked") == 0, F.col(value)))
        .drop("_artifacts")
    )


def keep_raw(df: DataFrame, value: str, raw: str | None = None) -> DataFrame:
    """Copy a value before QC or imputation touches it."""
    return df.withColumn(raw or f"{value}_raw", F.col(value))


def soil_storage(layers: list[str]) -> Column:
    """Water column in mm from four volumetric layers."""
    weighted = [F.col(c) * d for c, d in zip(layers, SOIL_LAYER_DEPTHS_MM, strict=True)]
    return weighted[0] + weighted[1] + weighted[2] + weighted[3]
