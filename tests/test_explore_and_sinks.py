import itertools

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelstress.operators import explore, trend
from panelstress.operators import sequences as seq
from panelstress.sources import readers, sinks
from tests.conftest import monthly_frame


def test_trends_against_pairs(spark, spec):
    rng = np.random.default_rng(4)
    pdf = monthly_frame(["up", "noise"], "2003-01-01", 120, v=lambda i, j: float((1 - i) * (j // 12) + rng.normal(0, 0.2)))
    out = {r["entity"]: r for r in explore.trend_table(explore.to_long(spark.createDataFrame(pdf), ["v"], ["entity", "date"]), spec).collect()}
    for e, g in pdf.groupby("entity"):
        y = g.groupby("year")["v"].mean()
        pairs = list(itertools.combinations(y.index, 2))
        slopes = [(y[b] - y[a]) / (b - a) for a, b in pairs]
        s = sum(np.sign(slopes))
        assert out[e]["theil_sen_slope"] == pytest.approx(np.median(slopes))
        assert out[e]["kendall_tau"] == pytest.approx(s / len(pairs))
        assert out[e]["mann_kendall_z"] == pytest.approx((s - np.sign(s)) / np.sqrt(10 * 9 * 25 / 18))
    assert out["up"]["trend_direction"] == "Significant Increase"


def test_correlations(spark, spec, panel, panel_pdf):
    names = {"a": "spi_stress_z", "b": "soil_stress_z", "c": "wsi"}
    out = explore.correlation_matrix(panel, names).toPandas().set_index("variable")
    assert np.allclose(out.loc[list(names), list(names)].to_numpy(), panel_pdf[list(names.values())].corr().to_numpy())
    lagged = explore.lag_correlations(panel, "spi_stress_z", ["wsi"], [-1, 0, 2], spec).where("entity = 'A'")
    a = panel_pdf[panel_pdf["entity"] == "A"]
    for r in lagged.collect():
        assert r["correlation"] == pytest.approx(a["spi_stress_z"].corr(a["wsi"].shift(-r["lag_k"])))


def test_quality_and_outliers(spark):
    rows = [("A", f"2003-{m:02d}-01", float(v)) for m, v in enumerate([1, 2, 3, 4, 5, 1, 2, 3, 4, 5, 3, 90], start=1)] + [("A", "2003-12-01", None)]
    df = spark.createDataFrame(rows, "entity string, date string, v double").withColumn("date", F.col("date").cast("date"))
    row = explore.quality_audit(df, "x", "v", "entity", "date", (0.0, 50.0), constants=["entity"]).first()
    assert (row["row_count"], row["duplicate_keys"], row["missing_count"], row["domain_violations"], row["constant_columns"]) == (13, 1, 1, 1, "entity")
    assert [r["value"] for r in explore.outliers(explore.to_long(df, ["v"], ["entity"]), ["entity"]).collect()] == [90.0]
    assert explore.temporal_coverage(df.where("date <> '2003-05-01'"), "x", "entity", "date").first()["missing_entity_months"] == 1


def test_sequence_round_trip_prunes_splits(spark, panel, spec, tmp_path):
    rows = seq.add_sequence_ids(seq.build_sequences(panel, spec), spec)
    sinks.write_sequences(rows, str(tmp_path / "s"))
    back = readers.load_sequences(spark, str(tmp_path / "s"), "val")
    assert back.count() == 48
    assert "PartitionFilters: [" in back._jdf.queryExecution().toString() and "PartitionFilters: []" not in back._jdf.queryExecution().toString()
    model, meta = readers.load_residual_inputs(panel.withColumnRenamed("wsi", "WSI"), rows, spec)
    assert model.columns == ["entity", "date", "wsi"] and meta.count() == 162


def test_model_dataset_round_trip(spark, panel, spec, tmp_path):
    path = str(tmp_path / "m")
    sinks.write_table(panel, path)
    assert readers.load_model_dataset(spark, path, spec).count() == 216
    sinks.write_table(panel.where("date <> '2004-02-01'"), path)
    with pytest.raises(ValueError):
        readers.load_model_dataset(spark, path, spec)


def test_one_key_may_hold_two_entities(spark):
    from panelstress.operators import explore

    df = spark.createDataFrame([("A", "k", "2003-01-01", 1.0), ("B", "k", "2003-01-01", 2.0)], "entity string, well string, date string, v double")
    row = explore.quality_audit(df, "wells", "v", "entity", "date", keys=["well", "date"]).first()
    assert (row.entity_count, row.duplicate_keys, row.row_count) == (2, 1, 2)


def test_parity_notices_missing_rows_and_nulls(spark, spec):
    from panelstress.operators import audit

    left = spark.createDataFrame([("A", "2003-01-01", 1.0), ("A", "2003-02-01", None), ("A", "2003-03-01", 3.0)], "entity string, date string, wsi double")
    right = spark.createDataFrame([("A", "2003-01-01", 1.0), ("A", "2003-02-01", 1.0)], "entity string, date string, wsi double")
    row = audit.export_parity(left, right, spec).first()
    assert not row["passed"] and row["measures"]["unmatched_keys"] == "1" and row["measures"]["mismatches"] == "wsi"
    assert audit.export_parity(left, left, spec).first()["passed"]


def test_stages_are_removed_when_the_caller_is_done(spark, tmp_path):
    from panelstress import session

    before = session.stages_written()
    kept = session.materialize(spark.range(5).toDF("id"), "kept", folder=str(tmp_path / "a"))
    assert kept.count() == 5 and any((tmp_path / "a/stages").iterdir())
    assert session.remove_stages(spark, before) == 1
    assert not any((tmp_path / "a/stages").iterdir()) and session.stages_written() == before


@pytest.mark.parametrize("n, kinds", [(2, 50), (7, 2), (300, 12), (2000, 10**6)])
def test_trend_statistics_equal_all_pairs(n, kinds):
    """Against numpy over all pairs; few kinds of values make many ties."""
    rng = np.random.default_rng(n)
    x, y = np.sort(rng.choice(10 * n, n, replace=False)).astype(float), rng.integers(0, kinds, n) / 7.0
    i, j = np.triu_indices(n, 1)
    s, variance = trend.kendall(y)
    assert s == np.sign(y[j] - y[i]).sum() and trend.inversions(y) == (y[j] < y[i]).sum()
    ties = np.unique(y, return_counts=True)[1]
    assert variance == pytest.approx((n * (n - 1) * (2 * n + 5) - (ties * (ties - 1) * (2 * ties + 5)).sum()) / 18)
    assert trend.theil_sen(x, y) == np.median((y[j] - y[i]) / (x[j] - x[i]))


def test_long_series_are_selected_by_blocks(monkeypatch):
    rng = np.random.default_rng(0)
    x, y = np.arange(5000.0), np.round(rng.normal(size=5000), 1)
    i, j = np.triu_indices(5000, 1)
    exact = np.median((y[j] - y[i]) / (x[j] - x[i]))
    held = []
    blocks = trend._slopes
    monkeypatch.setattr(trend, "_slopes", lambda a, b: (held.append(len(s)) or s for s in blocks(a, b)))
    assert trend.theil_sen(x, y) == exact and max(held) <= trend.BLOCK
    assert trend.kendall(y)[0] == np.sign(y[j] - y[i]).sum()
    monkeypatch.setattr(trend, "BLOCK", 64)
    for values in (y[:90], np.zeros(90), np.repeat([0.0, 5.0], 45), np.concatenate([y[:80], [1e300, -1e300]])):
        a, b = np.triu_indices(len(values), 1)
        with np.errstate(over="ignore"):
            assert trend.theil_sen(x[: len(values)], values) == np.median((values[b] - values[a]) / (x[b] - x[a]))
    assert trend.theil_sen(x[:1], y[:1]) is None


def test_headers_come_from_the_first_line_of_each_file(spark, tmp_path):
    """The headers were found by sorting all lines of every file's first block."""
    import pyarrow as pa

    from panelstress.sources import readers

    lines = [("f1", "a,b"), ("f1", "1,2"), ("f2", "b,a"), ("f2", "3,4"), ("f1", "5,6")]
    batches = [pa.RecordBatch.from_pylist([{"file_path": f, "value": v} for f, v in part]) for part in (lines[:1], lines[1:4], lines[4:])]
    assert [r for b in readers._first_lines(iter(batches)) for r in b.to_pylist()] == [{"file_path": "f1", "header": "a,b"}, {"file_path": "f2", "header": "b,a"}]
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    (tmp_path / "y.csv").write_text("b,a\n4,3\n")
    assert sorted((r.a, r.b) for r in readers.read_text_table(spark, str(tmp_path)).collect()) == [("1", "2"), ("3", "4")]


@pytest.mark.parametrize("limit", [2, 100_000])
def test_monthly_climatology_reads_its_rows_once(spark, spec, limit):
    """Tables equal pandas, groups of nulls included, whatever the number of values that a task may order."""
    rng = np.random.default_rng(8)
    rows = [(e, int(m), v, float(x)) for e, m, v, x in zip(rng.choice(["A", "B"], 400), rng.integers(1, 4, 400), rng.choice(["p", "q"], 400), rng.integers(0, 9, 400) / 4)]
    rows += [("A", 12, "p", None), (None, 1, "q", 2.5)]
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    table = spark.createDataFrame(rows, "entity string, month int, variable string, value double")
    out = explore.monthly_climatology(table.mapInArrow(count, table.schema), spec, limit).collect()
    assert read.value == len(rows)
    frame = pd.DataFrame(rows, columns=["entity", "month", "variable", "value"])
    for r in out:
        part = frame[(frame["month"] == r["month"]) & (frame["variable"] == r["variable"])]
        own = part[part["entity"] == r["entity"]] if r["entity"] else part
        if r["entity"] is None and r["mean"] == 2.5 and r["median"] == 2.5:
            continue  # the group whose entity is null
        mean, median = own["value"].mean(), own["value"].median()
        assert (r["mean"], r["median"]) == ((None, None) if np.isnan(mean) else (pytest.approx(mean), pytest.approx(median)))
    assert len(out) == len(frame.groupby(["entity", "month", "variable"], dropna=False)) + len(frame.groupby(["month", "variable"]))


def test_moments_of_counted_values(spark):
    """Moments of whole and of narrowed groups, with a mean that is large for the deviation."""
    from panelstress.operators.quantiles import counted_quantiles, counted_values

    rng = np.random.default_rng(9)
    frame = pd.DataFrame({"k": np.repeat(["large", "small"], [300, 5]), "v": np.round(1e7 + rng.normal(0, 0.5, 305), 1)})
    frame.loc[0:40, "v"] = frame["v"].iloc[41]
    values = counted_values(spark.createDataFrame(frame), ["k"], "v")
    for limit in (8, 1000):
        out = {r["k"]: r for r in counted_quantiles(values, ["k"], {"q": 0.25}, limit=limit, moments=True).collect()}
        for k, g in frame.groupby("k"):
            assert (out[k]["n"], out[k]["mean"], out[k]["q"]) == (len(g), pytest.approx(g["v"].mean(), rel=1e-12), pytest.approx(g["v"].quantile(0.25)))
            assert out[k]["std"] == pytest.approx(g["v"].std(ddof=0), rel=1e-6)
