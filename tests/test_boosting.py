"""The distributed booster against a plain numpy one, node by node."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelstress.operators import boosting as bo


def rows_of(spark, groups, features=5, targets=2, n=240, seed=0, parts=5):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        x = rng.normal(size=(n, features)).astype(np.float32).astype(float)
        x[:, 1] = np.round(x[:, 1])  # few distinct values, ties in gain
        x[:, 2] = 1.0  # constant
        y = np.stack([np.where(x[:, 0] > 0.3, 1.0, -1.0) + 0.3 * x[:, 1] + 0.2 * rng.normal(size=n) for _ in range(targets)], axis=1)
        out += [(g, bool(i % 4 == 3), 1000 * g + i, x[i].tolist(), y[i].tolist()) for i in range(n)]
    df = spark.createDataFrame(out, "group int, is_val boolean, id bigint, x array<double>, y array<double>").repartition(parts)
    return df, out


def grow_plain(rows, setting, target, rounds, patience, seed, bins=bo.BINS):
    """One model by recursion over row sets; sums are taken row by row."""
    train, val = [r for r in rows if not r[1]], [r for r in rows if r[1]]
    x, xv = np.array([r[3] for r in train]), np.array([r[3] for r in val])
    y, yv = np.array([r[4][target] for r in train]), np.array([r[4][target] for r in val])
    ids = np.array([r[2] for r in train])
    edges = []
    for f in range(x.shape[1]):
        cells, counts = np.unique(bo._cells(x[:, f]), return_counts=True)
        edges.append(bo.quantile_edges(cells, counts, bins))
    base = round(float(y.mean()), 6)
    margin, vmargin = np.full(len(y), base), np.full(len(yv), base)
    trees, errors = [], []
    for turn in range(rounds):
        use, columns = bo.drawn_rows(ids, setting.rows, seed, turn), bo.drawn_columns(x.shape[1], setting.columns, seed, turn)
        gradient = np.rint((margin - y) * 2**20) / 2**20

        def soft(g):
            return np.sign(g) * max(abs(g) - setting.l1, 0.0)

        def worth(at):
            return -setting.step * soft(gradient[at].sum()) / (len(at) + setting.l2)

        def grow(at, depth):
            best = (bo.MIN_GAIN, None)
            score = lambda k: soft(gradient[k].sum()) ** 2 / (len(k) + setting.l2) if len(k) else 0.0
            if depth < setting.max_depth:
                for f in np.flatnonzero(columns):
                    for cut in edges[f]:
                        go = x[at, f] <= cut
                        left, right = at[go], at[~go]
                        if len(left) and len(right):
                            gain = score(left) + score(right) - score(at)
                            if gain > best[0] + 1e-12:
                                best = (gain, (f, cut, left, right))
            if best[1] is None:
                return worth(at)
            f, cut, left, right = best[1]
            return f, cut, grow(left, depth + 1), grow(right, depth + 1)

        def value(tree, v):
            while isinstance(tree, tuple):
                tree = tree[2] if v[tree[0]] <= tree[1] else tree[3]
            return tree

        trees.append(grow(np.flatnonzero(use), 0))
        margin = margin + [value(trees[-1], v) for v in x]
        vmargin = vmargin + [value(trees[-1], v) for v in xv]
        errors.append(float(np.mean((vmargin - yv) ** 2)))
        if patience is not None and len(errors) - 1 - int(np.argmin(errors)) >= patience:
            break
    kept = int(np.argmin(errors)) + 1 if patience is not None else len(trees)
    return base, trees[:kept], errors, value


SETTINGS = [
    bo.TreeSetting(max_depth=3, step=0.3, rows=0.8, columns=0.6, l1=0.1, l2=1.0),
    bo.TreeSetting(max_depth=2, step=0.5, l1=0.5, l2=2.0),
]


def test_all_models_equal_a_plain_booster(spark, monkeypatch):
    monkeypatch.setattr(bo, "KEEP", 3)  # margins are written in between
    df, rows = rows_of(spark, 2)
    boosters = [bo.Booster(g, t, s) for g in (0, 1) for t in (0, 1) for s in SETTINGS]
    models = bo.fit_boosters(df, boosters, rounds=7, patience=2, seed=3)
    pred = {m: {} for m in range(len(models))}
    for number, (booster, model) in enumerate(zip(boosters, models)):
        mine = [r for r in rows if r[0] == booster.group]
        base, trees, errors, value = grow_plain(mine, booster.setting, booster.target, 7, 2, 3)
        assert model.base == base and len(model.trees) == len(trees) and model.errors == pytest.approx(errors, rel=1e-9)
        x = np.array([r[3] for r in mine])
        expected = base + np.sum([[value(t, v) for v in x] for t in trees], axis=0)
        assert np.allclose(model.predict(bo.binned(x, model.edges)), expected, atol=1e-9)
        pred[number] = {r[2]: p for r, p in zip(mine, expected)}
    chosen = [m for m in models if m.booster.setting == SETTINGS[0]]
    got = bo.predict_boosted(df, chosen, F.col("x"), F.col("group")).select("group", "id", "pred", "is_val").collect()
    assert len(got) == len(rows)
    for r in got:
        numbers = [i for i, b in enumerate(boosters) if b.group == r["group"] and b.setting == SETTINGS[0]]
        assert r["pred"] == pytest.approx([pred[i][r["id"]] for i in numbers], abs=1e-5)


def test_trees_do_not_depend_on_the_partitioning(spark):
    fits = []
    for parts in (1, 7):
        df, _ = rows_of(spark, 1, n=400, parts=parts)
        fits.append(bo.fit_boosters(df, [bo.Booster(0, 0, SETTINGS[0])], rounds=4)[0])
    assert all(np.array_equal(getattr(a, k), getattr(b, k)) for a, b in zip(fits[0].trees, fits[1].trees, strict=True) for k in ("feature", "cut", "value"))


def test_patience_stops_the_rounds(spark):
    df, _ = rows_of(spark, 1, n=160)
    noise = df.withColumn("y", F.transform("y", lambda v: F.rand(5) * 0 + F.pmod(F.xxhash64("id"), F.lit(97)) / 97.0))
    setting = bo.TreeSetting(max_depth=4, step=0.8)
    model = bo.fit_boosters(noise, [bo.Booster(0, 0, setting)], rounds=60, patience=3)[0]
    assert len(model.errors) == len(model.trees) + 3 and len(model.errors) < 60
    whole = bo.fit_boosters(noise, [bo.Booster(0, 0, setting)], rounds=len(model.errors))[0]
    assert len(whole.trees) == len(model.errors)
    assert all(np.array_equal(a.value, b.value) for a, b in zip(model.trees, whole.trees))


def test_rounds_per_model_missing_groups_and_constant_targets(spark):
    df, _ = rows_of(spark, 1, n=80)
    flat = df.withColumn("y", F.array(F.lit(2.0), F.lit(2.0)))
    boosters = [bo.Booster(0, 0, SETTINGS[0]), bo.Booster(0, 1, SETTINGS[1]), bo.Booster(7, 0, SETTINGS[0])]
    a, b, missing = bo.fit_boosters(flat, boosters, rounds=[1, 3, 2])
    assert missing is None and (len(a.trees), len(b.trees)) == (1, 3)
    assert a.base == 2.0 and all((t.feature == -1).all() and not t.value.any() for t in [*a.trees, *b.trees])
    assert bo.fit_boosters(df.limit(0), boosters[:1], rounds=2) == [None]


def test_more_than_the_bins_and_missing_values(spark):
    cells, counts = np.unique(bo._cells(np.random.default_rng(1).normal(size=20_000)), return_counts=True)
    edges = bo.quantile_edges(cells, counts, 64)
    assert len(edges) == 63 and (np.diff(edges) > 0).all()
    share = np.diff(np.concatenate([[0], np.searchsorted(np.sort(np.random.default_rng(1).normal(size=20_000)), edges)])) / 20_000
    assert share.max() < 2.5 / 64
    assert bo.binned(np.array([[np.nan], [-9.0]]), edges[None])[:, 0].tolist() == [63, 0]


def test_few_rows_go_to_every_core(spark, monkeypatch):
    """The written rows had as many parts as their bytes filled: one task grew all trees of a small table."""
    parts = []

    def blocks(state, features, real=bo._blocks):
        parts.append(real(state, features))
        return parts[-1]

    monkeypatch.setattr(bo, "_blocks", blocks)
    df, _ = rows_of(spark, 2)
    bo.fit_boosters(df, [bo.Booster(g, 0, SETTINGS[0]) for g in (0, 1)], rounds=1)
    assert parts[0].getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_sums_of_large_gradients_are_exact():
    rng = np.random.default_rng(3)
    raw = np.asfortranarray(rng.integers(0, 8, (500, 3), dtype=np.uint8))
    place, use = rng.integers(0, 2, 500), rng.random(500) < 0.7
    for unit in (2**20, 2**38):
        gradient = np.rint(rng.normal(size=500) * unit)
        got = bo._node_sums(raw, place, 2, gradient, use, 8)
        for k, f, b in np.ndindex(2, 3, 8):
            at = use & (place == k) & (raw[:, f] == b)
            assert (got[0, k, f, b], got[1, k, f, b]) == (gradient[at].sum(), at.sum())


def test_models_of_one_task_are_those_of_the_passes(spark, monkeypatch):
    """Every level of every round was a job, however small the table; models of a small group are now grown by one job."""
    df, _ = rows_of(spark, 2)
    boosters = [bo.Booster(g, t, s) for g in (0, 1) for t in (0, 1) for s in SETTINGS]
    tracker, fits, jobs = spark.sparkContext.statusTracker(), {}, {}
    for name, rounds, most in (("alone", 6, bo.ALONE_BYTES), ("short", 2, bo.ALONE_BYTES), ("passes", 6, 0), ("mixed", 6, 220 * 5)):
        monkeypatch.setattr(bo, "ALONE_BYTES", most)
        rows = df.where("group = 0 OR id % 7 > 0") if name == "mixed" else df  # group 1 is the smaller one there
        spark.sparkContext.setJobGroup(name, name)
        fits[name] = bo.fit_boosters(rows, boosters, rounds, patience=3, seed=5)
        jobs[name] = len(tracker.getJobIdsForGroup(name))
    spark.sparkContext.setJobGroup("", "")
    assert jobs["alone"] == jobs["short"] < jobs["passes"]
    for a, b in [*zip(fits["alone"], fits["passes"], strict=True), *zip(fits["alone"][:4], fits["mixed"][:4], strict=True)]:
        assert a.booster == b.booster and a.base == b.base and len(a.trees) == len(b.trees) and a.errors == pytest.approx(b.errors, rel=1e-12)
        assert all(np.array_equal(getattr(x, k), getattr(y, k)) for x, y in zip(a.trees, b.trees) for k in ("feature", "cut", "value"))
    assert all(m is not None for m in fits["mixed"])


def test_two_features_share_a_sum(monkeypatch):
    """Columns of one or two features, in slices or as a whole, with whole sums or with sums that do not fit, give the same trees."""
    rng = np.random.default_rng(4)
    raw, ids = rng.integers(0, 64, (5, 700)).astype(np.uint8), np.arange(700)
    for scale in (1.0, 2.0**32):
        y, models = np.rint(rng.normal(size=700) * 1e3) * scale / 1e3 + raw[1] * scale, []
        for paired, part in ((1, 64), (10**6, 10**6)):
            monkeypatch.setattr(bo, "_PAIRED", paired)
            monkeypatch.setattr(bo, "_SLICE", part)
            columns = bo.Columns(5, 64, 700)
            for f in range(5):
                columns.put(f, raw[f, :300], slice(0, 300))
                columns.put(f, raw[f, 300:], slice(300, 700))
            assert columns.per == (2 if paired == 1 else 1)
            sums = columns.sums(None, np.rint(y), None)
            assert all(sums[1, f, b] == (raw[f] == b).sum() for f in range(5) for b in range(64))
            models.append(bo.grow_alone(bo.Booster(0, 0, SETTINGS[0]), np.zeros((5, 63)), columns, y, ids, 0.0, 4, None, 9))
        assert all(np.array_equal(a.feature, b.feature) and np.array_equal(a.cut, b.cut) for a, b in zip(models[0].trees, models[1].trees, strict=True))
        assert all(np.allclose(a.value, b.value, rtol=1e-12) for a, b in zip(models[0].trees, models[1].trees))


def test_work_is_dealt_to_all_cores():
    boosters = [bo.Booster(0, h, s) for h in range(3) for s in SETTINGS]
    assert sorted(len(numbers) for _, numbers in bo.deal_models(boosters, {0: 10}, 6)) == [1] * 6
    many = [bo.Booster(g, h, SETTINGS[0]) for g in range(28) for h in range(3)]
    work = bo.deal_models(many, {g: g + 1 for g in range(28)}, 6)
    assert [g for g, _ in work] == list(range(27, -1, -1)) and all(len(numbers) == 3 for _, numbers in work)
    assert bo.deal_models(many, {}, 6) == []


def test_more_parts_than_tasks(spark, monkeypatch):
    """A cluster may deal the values to more parts than there are tasks; the parts without values failed."""
    df, _ = rows_of(spark, 2)
    boosters = [bo.Booster(g, 0, SETTINGS[0]) for g in (0, 1)]
    few = bo.fit_boosters(df, boosters, 2)
    monkeypatch.setattr(bo.RDD, "partitionBy", lambda self, n, *a, f=bo.RDD.partitionBy, **b: f(self, max(n, 9), *a, **b))
    for a, b in zip(few, bo.fit_boosters(df, boosters, 2), strict=True):
        assert all(np.array_equal(x.value, y.value) for x, y in zip(a.trees, b.trees, strict=True))
