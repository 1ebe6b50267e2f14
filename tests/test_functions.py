import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelstress.functions import numeric, special
from panelstress.operators.quantiles import exact_quantiles, split_quantiles


def test_lower_gamma_against_closed_forms():
    z = np.array([0.01, 0.5, 1.0, 4.0, 9.0, 30.0])
    assert np.allclose(special.lower_gamma(z, np.full(6, 0.5)), [math.erf(math.sqrt(v)) for v in z], atol=1e-14)
    assert np.allclose(special.lower_gamma(z, np.ones(6)), 1 - np.exp(-z), atol=1e-14)
    poisson = 1 - sum(math.exp(-30.0 + k * math.log(30.0) - math.lgamma(k + 1)) for k in range(25))
    assert special.lower_gamma(np.array([30.0]), np.array([25.0]))[0] == pytest.approx(poisson, abs=1e-12)
    assert special.lower_gamma(np.array([0.0, 1e6]), np.array([2.0, 2.0])).tolist() == [0.0, 1.0]
    assert np.isnan(special.lower_gamma(np.array([np.nan]), np.array([2.0])))[0]


def test_large_shapes_agree_across_the_switch():
    a = special.LARGE_SHAPE
    z = a + np.sqrt(a) * np.array([-2.0, 0.0, 2.0])
    below = special.lower_gamma(z, np.full(3, a))
    above = special.lower_gamma(z, np.full(3, a + 1e-3))
    assert np.allclose(below, above, atol=1e-6)


def test_normal_functions(spark):
    ps = [1e-7, 1e-4, 0.02, 0.3, 0.5, 0.7, 0.98, 1 - 1e-7]
    zs = [-6.0, -2.5, -0.1, 0.0, 0.7, 3.0]
    q = [r[0] for r in spark.createDataFrame([(p,) for p in ps], "p double").select(special.normal_quantile(F.col("p"))).collect()]
    c = [r[0] for r in spark.createDataFrame([(z,) for z in zs], "z double").select(special.normal_cdf("z")).collect()]
    assert q == pytest.approx([NormalDist().inv_cdf(p) for p in ps], abs=1e-9)
    assert c == pytest.approx([NormalDist().cdf(z) for z in zs], abs=1e-14)


def test_gamma_shape_solves_the_likelihood_equation(spark):
    gaps = [1e-4, 0.001, 0.05, 0.5, 2.0]
    df = spark.createDataFrame([(s,) for s in gaps], "s double").select("s", special.gamma_shape_mle(F.col("s")).alias("a"))
    left = df.select((F.ln("a") - special.digamma(F.col("a")) - F.col("s")).alias("r")).collect()
    assert max(abs(r["r"]) for r in left) < 1e-11


def test_digamma_and_trigamma(spark):
    row = spark.range(1).select(special.digamma(F.lit(1.0)), special.trigamma(F.lit(1.0)), special.log_gamma(F.lit(5.5))).first()
    assert row[0] == pytest.approx(-0.5772156649015329, abs=1e-13)
    assert row[1] == pytest.approx(math.pi**2 / 6, abs=1e-12)
    assert row[2] == pytest.approx(math.lgamma(5.5), abs=1e-12)


def test_numeric_coercion(spark):
    df = spark.createDataFrame([("1.5",), ("NaN",), ("bad",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(numeric.numeric("t")).collect()] == [1.5, None, None, None, None]
    dates = spark.createDataFrame([("2003-02-28",), ("2003-02-30",), ("soon",)], "t string")
    assert [str(r[0]) for r in dates.select(numeric.calendar_date("t")).collect()] == ["2003-02-28", "None", "None"]


@pytest.mark.parametrize("limit", [1, 50, 10**9])
def test_quantiles_on_skewed_groups(spark, limit):
    """One key holds most rows; both branches and their mixture give the same exact values."""
    rng = np.random.default_rng(3)
    groups = {"hot": rng.normal(0, 100, 3000).round(1), "one": np.array([4.2]), "few": np.array([1.0, 2.0, 4.0, 10.0]),
              "same": np.full(60, -7.5),
              "narrow": 1.0 + rng.random(2000) * 1e-9, "tiny": rng.normal(0, 1e-9, 20)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("few", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    probs = {"p1": 0.01, "p25": 0.25, "p50": 0.5, "p99": 0.99}
    out = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", probs, {"mean": F.avg("v")}, limit=limit).collect()}
    assert set(out) == set(groups)
    for k, vs in groups.items():
        assert out[k]["n"] == len(vs)
        assert out[k]["mean"] == pytest.approx(vs.mean())
        for name, p in probs.items():
            assert out[k][name] == pytest.approx(np.percentile(vs, 100 * p), rel=1e-12, abs=1e-18)


def test_split_quantiles_without_keys(spark):
    values = np.random.default_rng(1).lognormal(0, 3, 5000)
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    row = split_quantiles(df, [], "v", {"m": 0.5, "hi": 0.999}).first()
    assert (row["n"], row["m"], row["hi"]) == (5000, pytest.approx(np.median(values)), pytest.approx(np.quantile(values, 0.999)))


@pytest.mark.parametrize("limit", [1, 10**9])
def test_quantiles_keep_infinities_nan_and_null_keys(spark, limit):
    inf, nan = float("inf"), float("nan")
    groups = {"up": [1.0, 2.0, inf, inf], "down": [-inf, 1.0, 2.0], "nan": [1.0, nan, nan, nan], None: [3.0, 3.0, 5.0], "one": [2.5]}
    df = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs], "k string, v double")
    out = {r["k"]: r for r in exact_quantiles(df, ["k"], "v", {"q": 0.75, "low": 0.25}, {"top": F.max("v")}, limit=limit).collect()}
    assert set(out) == set(groups)
    assert out["up"]["q"] == inf and out["down"]["q"] == 1.5 and out["one"]["q"] == 2.5
    assert out["nan"]["q"] != out["nan"]["q"] and out[None]["q"] == 4.0 and out[None]["low"] == 3.0
    assert out["down"]["low"] == -inf


def test_parts_are_bounded_by_bytes_and_smaller_ones_stay(spark):
    """No part of a scan or shuffle grows with the input; sizes below the bound are the caller's."""
    from panelstress.session import configure

    scan, part = "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    count = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    before = {k: spark.conf.get(k, None) for k in (scan, part, count)}
    try:
        spark.conf.set(scan, "128MB")
        spark.conf.set(part, "8m")
        configure(spark)
        assert (spark.conf.get(scan), spark.conf.get(part)) == (f"{16 << 20}b", "8m")
        assert int(spark.conf.get(count)) >= 400
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
        configure(spark)
