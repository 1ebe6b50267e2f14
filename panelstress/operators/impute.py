"""Train-only medians at four levels, and imputation with them."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelstress.operators.quantiles import split_quantiles
from panelstress.spec import PanelSpec


@dataclass(frozen=True)
class MedianStats:
    """Training medians of several columns.

    ``by_entity``: one row per entity with, per column, a struct (monthly map, overall).
    ``pooled``: a single row with the same structs over all entities.
    """

    by_entity: DataFrame
    pooled: DataFrame
    columns: tuple[str, ...]
    spec: PanelSpec

    def long(self, column: str | None = None) -> DataFrame:
        """(level, entity, month, median) of one column, with NULL for a dimension the level does not use."""
        e, c = self.spec.entity, column or self.columns[0]
        parts = []
        for frame, names in ((self.by_entity, ("entity_month", "entity")), (self.pooled, ("month", "global"))):
            key = F.col(e) if e in frame.columns else F.lit(None).cast("string").alias(e)
            parts.append(
                frame.select(F.lit(names[0]).alias("level"), key, F.explode(f"{c}.monthly").alias("month", "median"))
            )
            parts.append(
                frame.select(F.lit(names[1]).alias("level"), key, F.lit(None).cast("int").alias("month"),
                             F.col(f"{c}.overall").alias("median"))
            )
        return reduce(DataFrame.unionByName, parts).where(F.col("median").isNotNull())


def _packed(level_is_month: Column, month: Column, median: Column) -> Column:
    """Struct (monthly map, overall) from rows of monthly and overall medians of one group."""
    entry = F.when(level_is_month & median.isNotNull(), F.struct(month.alias("k"), median.alias("v")))
    return F.struct(
        F.map_from_entries(F.collect_list(entry)).alias("monthly"),
        F.max(F.when(~level_is_month, median)).alias("overall"),
    )


def fit_medians(df: DataFrame, columns: str | list[str], spec: PanelSpec, train_end: str | None = None) -> MedianStats:
    """Medians by (entity, month), entity, month and over all rows up to the end of training.

    Entity levels hold at most one row per calendar month and use the built-in median, for all columns in
    one grouping-sets pass; the pooled levels grow with the number of entities and use split quantiles, again
    for all columns and both levels at once.
    """
    names = (columns,) if isinstance(columns, str) else tuple(columns)
    e, m = spec.entity, "month"
    train = df.where(F.col(spec.date) <= F.lit(train_end or spec.train_end).cast("date")).select(e, m, *names)
    levels = train.groupingSets([[F.col(e), F.col(m)], [F.col(e)]], e, m).agg(
        F.grouping_id().alias("_g"), *[F.median(c).alias(c) for c in names]
    )
    monthly = F.col("_g") == 0
    by_entity = levels.groupBy(e).agg(*[_packed(monthly, F.col(m), F.col(c)).alias(c) for c in names])

    everywhere = F.lit(0)  # month 0 stands for the pooled level
    long = train.select(
        F.explode(F.array(F.col(m), everywhere)).alias(m), *[F.col(c).cast("double").alias(c) for c in names]
    ).unpivot([m], list(names), "_column", "_value")
    medians = split_quantiles(long, ["_column", m], "_value", {"_median": 0.5})
    pooled = medians.agg(
        *[
            _packed(F.col(m) != 0, F.col(m), F.when(F.col("_column") == c, F.col("_median"))).alias(c)
            for c in names
        ]
    )
    return MedianStats(by_entity, pooled, names, spec)


def impute(df: DataFrame, stats: MedianStats, flags: dict[str, str]) -> DataFrame:
    """Fill missing values of the columns in ``flags`` with the first available level.

    The flag column is 1 where a value was missing. The pooled row enters as a scalar subquery.
    """
    e, month = stats.spec.entity, F.col("month")
    own = stats.by_entity.select(e, F.struct(*stats.columns).alias("_own"))
    pooled = stats.pooled.select(F.struct(*stats.columns).alias("p")).scalar()
    out = df.join(own, e, "left")
    for column, flag in flags.items():
        mine, all_entities = F.col(f"_own.{column}"), pooled[column]
        out = out.withColumn(flag, F.col(column).isNull().cast("int")).withColumn(
            column,
            F.coalesce(
                F.col(column),
                F.try_element_at(mine["monthly"], month),
                mine["overall"],
                F.try_element_at(all_entities["monthly"], month),
                all_entities["overall"],
            ),
        )
    return out.drop("_own")


def count_imputed(df: DataFrame, flags: list[str]) -> DataFrame:
    """One row with the number of imputed cells per flag."""
    return df.agg(*[F.sum(F.col(f).cast("long")).alias(f"{f}_cells") for f in flags])
