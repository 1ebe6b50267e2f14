import pytest
from pyspark.sql import functions as F

from panelstress.operators import calendar, clean, impute
from panelstress.sources import readers
from tests.conftest import monthly_frame


def test_names_and_members(spark):
    df = spark.createDataFrame([(" Old ",), ("New",), ("Other",), ("7",)], "entity string")
    by_dict = clean.normalize_entity(df, "entity", {"Old": "New"})
    table = spark.createDataFrame([("Old", "New")], "alias string, canonical string")
    by_table = clean.normalize_entity(df, "entity", table)
    expected = ["7", "New", "New", "Other"]
    assert sorted(r[0] for r in by_dict.collect()) == expected
    assert sorted(r[0] for r in by_table.collect()) == expected
    assert clean.keep_members(by_dict, ["New"], "entity").count() == 2


def test_conflicting_negative_and_broken_readings_vanish(spark):
    rows = [("w1", "A", "2010-05-03", "4.0"), ("w1", "A", "2010-05-03", "8.0"), ("w2", "A", "2010-05-03", "-2.0"),
            ("w3", "A", "2010-05-03", "6.5"), ("w3", "A", "2010-05-03", "6.5"), ("w4", "A", "nonsense", "1.0"), ("w5", "A", "2010-05-03", "x")]
    out = clean.clean_observations(spark.createDataFrame(rows, "well_id string, entity string, date string, lvl string"), "well_id", "date", "lvl", "entity")
    assert [(r["well_id"], r["lvl"], str(r["obs_date"])) for r in out.collect()] == [("w3", 6.5, "2010-05-01")]
    two_dates = spark.createDataFrame([("w", "A", "2010-05-03", "1"), ("w", "A", "2010-05-09", "2"), ("v", "A", "2010-05-09", "2")], "well_id string, entity string, date string, lvl string")
    monthly = clean.monthly_observations(clean.clean_observations(two_dates, "well_id", "date", "lvl", "entity"), "well_id", "lvl", "entity")
    assert [r["well_id"] for r in monthly.collect()] == ["v"]


def test_attributes_of_readings_are_kept(spark):
    df = spark.createDataFrame([("w", "A", "b1", "2010-05-03", 2.0)], "well_id string, entity string, block string, date string, water_level_m_bgl double")
    row = readers.prepare_wells(df).first()
    assert (row["block"], row["month"]) == ("b1", 5)


def test_reader_contract(spark, tmp_path):
    def write(rows):
        path = str(tmp_path / f"s{abs(hash(rows)) % 10**9}")
        spark.createDataFrame(list(rows), "entity string, year int, month int, rainfall_mm string").write.option("header", True).csv(path)
        return path

    good = readers.load_rainfall(spark, write((("A", 2003, 1, "5.5"), ("A", 2003, 2, "oops"))))
    assert [r["rainfall_mm"] for r in good.orderBy("date").collect()] == [5.5, None]
    with pytest.raises(ValueError):
        readers.load_rainfall(spark, write((("A", 2003, 1, "-1"),)))
    with pytest.raises(ValueError):
        readers.load_rainfall(spark, write((("A", 2003, 1, "1"), ("A", 2003, 1, "2"))))


def test_index_column_rules():
    assert readers.index_column(["a", "WSI"]) == "WSI"
    assert readers.index_column(["WSI", "wsi"]) == "wsi"
    with pytest.raises(ValueError):
        readers.index_column(["WSI", "wsi"], strict=True)
    with pytest.raises(KeyError):
        readers.index_column(["a"])


def test_artifacts_are_masked_once(spark):
    df = spark.createDataFrame([("A", 2022, 7, 0.122442), ("A", 2022, 7, 0.5), ("B", 2022, 7, 0.122442), ("A", 2021, 7, None)], "entity string, year int, month int, ndvi double")
    rules = spark.createDataFrame([("A", 2022, 7, 0.12244)], "entity string, year int, month int, artifact_value double")
    out = clean.mask_artifacts(df, "ndvi", rules, "entity")
    assert sorted((r["entity"], r["ndvi_raw"], r["ndvi"], r["ndvi_artifact_masked"]) for r in out.where("year = 2022").collect()) == [
        ("A", 0.122442, None, 1), ("A", 0.5, 0.5, 0), ("B", 0.122442, 0.122442, 0)]
    assert out.where("year = 2021").first()["ndvi_artifact_masked"] == 0


def test_soil_storage(spark):
    df = spark.createDataFrame([(0.1, 0.2, 0.3, 0.4)], "a double, b double, c double, d double")
    assert df.select(clean.soil_storage(["a", "b", "c", "d"])).first()[0] == pytest.approx(7 + 42 + 216 + 756)


def _gappy(spark, future_shift=0.0):
    pdf = monthly_frame(["A", "B", "C"], "2003-01-01", 72, v=lambda i, j: 10.0 * i + j % 12 + 0.1 * (j // 12))
    pdf.loc[pdf["year"] > 2005, "v"] += future_shift
    pdf.loc[(pdf["entity"] == "A") & (pdf["month"] == 3), "v"] = None  # falls to the entity median
    pdf.loc[(pdf["entity"] == "C"), "v"] = None  # falls to the month median
    pdf.loc[(pdf["entity"] == "B") & (pdf["year"] == 2007), "v"] = None  # has an (entity, month) median
    return clean.coerce_numeric(spark.createDataFrame(pdf), ["v"]), pdf


def test_imputation_levels(spark, spec):
    df, pdf = _gappy(spark)
    stats = impute.fit_medians(df, "v", spec)
    out = impute.impute(df, stats, {"v": "flag"}).toPandas().set_index(["entity", "year", "month"])
    train = pdf[pdf["year"] <= 2005]
    assert out.loc[("A", 2004, 3), "v"] == pytest.approx(train[train.entity == "A"]["v"].median())
    assert out.loc[("B", 2007, 5), "v"] == pytest.approx(train[(train.entity == "B") & (train.month == 5)]["v"].median())
    assert out.loc[("C", 2004, 3), "v"] == pytest.approx(train[train.month == 3]["v"].median())
    assert out["flag"].sum() == pdf["v"].isna().sum()
    assert impute.count_imputed(impute.impute(df, stats, {"v": "flag"}), ["flag"]).first()[0] == pdf["v"].isna().sum()
    assert stats.long().where("level = 'global'").first()["median"] == pytest.approx(train["v"].median())


def test_medians_ignore_later_data(spark, spec):
    def key(df):
        return sorted((r["level"], str(r["entity"]), str(r["month"]), r["median"]) for r in impute.fit_medians(df, "v", spec).long().collect())

    assert key(_gappy(spark)[0]) == key(_gappy(spark, 1000.0)[0])


def test_calendar_splits_and_origins(spark, spec):
    entities = spark.createDataFrame([("B",), ("A",), ("A",)], "entity string")
    grid = calendar.add_splits(calendar.build_calendar(entities, spec), spec)
    assert grid.count() == 2 * 72
    counts = {r["split"]: r["count"] for r in grid.groupBy("split").count().collect()}
    assert counts == {"train": 72, "validation": 36, "test": 36}
    one = grid.where("entity = 'A'").withColumn("o", calendar.origin_split("date", spec))
    gaps = [str(r[0]) for r in one.where("o is null and date between '2005-10-01' and '2007-05-01'").select("date").orderBy("date").collect()]
    assert gaps == ["2005-10-01", "2005-11-01", "2007-04-01", "2007-05-01"]
    flagged = calendar.add_origin_flags(grid, calendar.default_origin_ranges(spec), spec)
    assert flagged.agg(F.sum("is_forecast_origin_train"), F.sum("is_forecast_origin_val")).first()[:] == (2 * 33, 2 * 15)


def test_alias_rows_do_not_multiply_readings(spark):
    from pyspark.errors import PySparkException
    from pyspark.sql import functions as F

    from panelstress.operators import clean

    rows = spark.createDataFrame([("Old ",), ("Other",)], "entity string")
    twice = spark.createDataFrame([("Old", "New"), ("Old", "New")], "alias string, canonical string")
    assert sorted(r[0] for r in clean.normalize_entity(rows, "entity", twice).collect()) == ["New", "Other"]
    clash = twice.unionByName(twice.withColumn("canonical", F.lit("Else")))
    with pytest.raises(PySparkException):
        clean.normalize_entity(rows, "entity", clash).collect()


def test_files_with_other_column_orders_are_read_by_name(spark, tmp_path):
    from panelstress.sources import readers

    (tmp_path / "a.csv").write_text("entity,year,month,rainfall_mm\nA,2003,1,5.5\n")
    (tmp_path / "b.csv").write_text("entity,month,year,rainfall_mm\nA,2,2003,6.5\n")
    rows = readers.load_rainfall(spark, str(tmp_path)).orderBy("date").collect()
    assert [(str(r.date), r.rainfall_mm) for r in rows] == [("2003-01-01", 5.5), ("2003-02-01", 6.5)]
    (tmp_path / "c.csv").write_text("entity,month,year,depth\nA,2,2003,6.5\n")
    with pytest.raises(ValueError):
        readers.load_rainfall(spark, str(tmp_path))
