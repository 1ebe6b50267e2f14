"""A cross-section of the registered queries against their oracles on the smallest tables."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ["b10_drop_conflicts", "d21_master_panel", "d19_well_coverage", "g7_refit", "h9_event_metrics", "h11_block_bootstrap", "i5_summary_statistics"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")


def test_every_inventory_line_is_registered():
    inventory = {name: m.group() for name in entry.queries() if (m := re.match(r"[a-i]\d+", name))}
    ids = set(inventory.values())
    sizes = {"a": 17, "b": 15, "c": 4, "d": 23, "e": 10, "f": 13, "g": 12, "h": 23, "i": 10}
    assert ids == {f"{k}{i}" for k, n in sizes.items() for i in range(1, n + 1)}
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(inventory) - set(entry.oracle_sql()) == {
        "g5_boosted_trees", "g10_five_models", "g12_backtest_ridge", "g12_backtest_trees", "h11_bootstrap_numpy_draws", "h16_five_models",
    }


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_its_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = entry.queries()[name](spark, SF).toArrow().to_pandas()
    expected = con.sql(entry.oracle_sql()[name]).to_arrow_table().to_pandas()
    columns = sorted(expected.columns)
    assert sorted(got.columns) == columns

    def rows(df):
        return sorted(tuple("" if v is None or v != v else str(v) for v in r) for r in df[columns].astype(object).itertuples(index=False))

    assert rows(got) == rows(expected)


FIVE = {"Persistence", "Seasonal_Persistence", "WSI_Autoregression", "Ridge_Regression", "Boosted_Trees"}


def of_five_models(spark, name):
    """Rows of a query over five models; its trees took a job per level, hundreds of them, for ten entities."""
    context = spark.sparkContext
    context.setJobGroup(name, name)
    rows = entry.queries()[name](spark, SF).collect()
    context.setJobGroup("", "")
    assert {r["model"] for r in rows} == FIVE and len(context.statusTracker().getJobIdsForGroup(name)) < 120
    return rows


def test_suite_of_five_models(spark):
    rows = of_five_models(spark, "g10_five_models")
    assert len(rows) == 2 * 3 * 5 and len({(r["evaluation_type"], r["horizon"], r["n"]) for r in rows}) == 2 * 3  # the same rows for every model


def test_backtest_summary_of_five_models(spark):
    rows = of_five_models(spark, "h16_five_models")
    assert len(rows) == 5
