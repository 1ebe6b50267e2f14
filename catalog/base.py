"""Registry, shared stages and shared oracle CTEs."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from panelstress.operators import sequences as seq
from panelstress.operators import wells
from panelstress.plans import panel as panel_plan
from panelstress.plans import proxy
from panelstress.plans.baselines import run_baselines
from panelstress.session import configure, materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CTES: dict[str, str] = {}

SPEC = proxy.SPEC
_STAGES: dict[tuple[str, str, str], DataFrame] = {}

# Added before flooring: moves the rounding boundary off decimal ties, where two engines may disagree.
_HALF = 0.5000137


def report(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round floating-point columns at the edge, in the way the oracle does."""
    scale = float(10**digits)
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.select(
        *[
            (F.floor(F.col(c).cast("double") * scale + _HALF) / scale).alias(c)
            if isinstance(t, (DoubleType, FloatType)) else F.col(c)
            for c, t in types.items()
        ]
    )


def r(expression: str, digits: int = 6) -> str:
    scale = f"1e{digits}"
    return f"(floor(CAST({expression} AS DOUBLE) * {scale} + {_HALF}) / {scale})"


def rs(*names: str, digits: int = 6) -> str:
    """Rounded columns under their own names."""
    return ", ".join(f"{r(n, digits)} AS {n}" for n in names)


def cte(name: str, sql: str) -> None:
    CTES[name] = sql.strip()


def with_ctes(sql: str) -> str:
    """Prefix a statement with the CTEs it mentions, in definition order."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                visit(CTES[name])

    visit(sql)
    recursive = {n for n in needed if "UNION ALL SELECT k + 1" in CTES[n]}
    parts = [
        f"{n} (k, alpha, m) AS ({CTES[n]})" if n in recursive else f"{n} AS MATERIALIZED ({CTES[n]})"
        for n in CTES if n in needed
    ]
    if not parts:
        return sql.strip()
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + sql.strip()


def query(name: str, sql: str | None = None, digits: int | None = 6):
    """Register a Spark query and, when given, its oracle."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            df = fn(spark, sf_dir)
            return df if digits is None else report(df, digits)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = with_ctes(sql)
        return fn

    return register


# ---- stages ----------------------------------------------------------------------------------

def _stage(name: str):
    """A stage is written once per application and input folder and shared by the queries that read it."""

    def wrap(fn):
        def get(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            key = (spark.sparkContext.applicationId, sf_dir, name)
            if key not in _STAGES:
                _STAGES[key] = materialize(fn(spark, sf_dir), name)
            return _STAGES[key]

        return get

    return wrap


def forget_stages() -> None:
    _STAGES.clear()


@_stage("history")
def history(spark, sf_dir):
    return panel_plan.prepare_history(proxy.history(spark, sf_dir), SPEC, proxy.artifact_rules(spark, sf_dir))


@_stage("wells")
def well_aggregates(spark, sf_dir):
    return proxy.well_aggregates(spark, sf_dir)


@_stage("panel")
def panel(spark, sf_dir):
    agg = well_aggregates(spark, sf_dir)
    return panel_plan.build_panel(history(spark, sf_dir), agg, wells.fit_well_climatology(agg, SPEC), SPEC)


@_stage("sequences")
def sequences(spark, sf_dir):
    return seq.add_sequence_ids(seq.build_sequences(panel(spark, sf_dir), SPEC), SPEC)


@_stage("predictions")
def predictions(spark, sf_dir):
    val, test, _ = run_baselines(sequences(spark, sf_dir), panel(spark, sf_dir), SPEC)
    return val.unionByName(test)


def test_predictions(spark, sf_dir):
    return predictions(spark, sf_dir).where("evaluation_type = 'official_test'")


def val_predictions(spark, sf_dir):
    return predictions(spark, sf_dir).where("evaluation_type = 'official_validation'")
