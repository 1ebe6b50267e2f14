from __future__ import annotations

import os
import sys
from datetime import date

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from panelstress import PanelSpec, SplitPolicy  # noqa: E402
from panelstress.session import configure  # noqa: E402
from panelstress.spec import COMPONENTS  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return configure(session)


SPEC = PanelSpec(
    start="2003-01-01",
    end="2008-12-01",
    train_end="2005-12-01",
    val_end="2007-06-01",
    origins=SplitPolicy(
        train=("2003-12-01", "2005-09-01"), val=("2005-12-01", "2007-03-01"), test=("2007-06-01", "2008-09-01")
    ),
    calibration_start="2003-01-01",
)


@pytest.fixture(scope="session")
def spec():
    return SPEC


def months(start: str, n: int) -> list[date]:
    return [d.date() for d in pd.date_range(start, periods=n, freq="MS")]


def monthly_frame(entities: list[str], start: str, n: int, **columns) -> pd.DataFrame:
    """Balanced frame; each column is a function (entity number, month number) -> value."""
    rows = []
    for i, e in enumerate(entities):
        for j, d in enumerate(months(start, n)):
            rows.append({"entity": e, "date": d, "year": d.year, "month": d.month, **{k: f(i, j) for k, f in columns.items()}})
    return pd.DataFrame(rows)


@pytest.fixture(scope="session")
def panel_pdf():
    rng = np.random.default_rng(7)
    pdf = monthly_frame(["A", "B", "C"], "2003-01-01", 72)
    for c in COMPONENTS:
        pdf[c] = rng.normal(size=len(pdf))
    pdf["wsi"] = pdf[list(COMPONENTS)].mean(axis=1)
    return pdf


@pytest.fixture(scope="session")
def panel(spark, panel_pdf):
    return spark.createDataFrame(panel_pdf).cache()
