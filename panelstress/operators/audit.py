"""Checks that return report rows; nothing is repaired silently.

Every check yields ``check, passed, measures`` with the measures as a string map, so reports union
into one table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.types import NumericType

from panelstress.functions.numeric import mean_of, month_number
from panelstress.operators.calendar import build_calendar, origin_split
from panelstress.session import materialize
from panelstress.spec import INDEX, PanelSpec


def _report(df: DataFrame, check: str, passed: Column, measures: list[str]) -> DataFrame:
    pairs = [x for m in measures for x in (F.lit(m), F.col(m).cast("string"))]
    return df.select(
        F.lit(check).alias("check"), F.coalesce(passed, F.lit(False)).alias("passed"), F.create_map(*pairs).alias("measures")
    )


def measures_long(report: DataFrame) -> DataFrame:
    """(check, passed, measure, value) rows of a report."""
    return report.select("check", "passed", F.explode("measures").alias("measure", "value"))


def calendar_and_shape(df: DataFrame, expected: DataFrame, spec: PanelSpec) -> DataFrame:
    """Compare keys with the expected calendar: missing, unexpected and duplicate keys, row and date counts."""
    keys = spec.keys
    seen = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    both = seen.join(expected.select(*keys).withColumn("_x", F.lit(1)), keys, "full")
    by_date = both.groupBy(spec.date).agg(
        F.sum("_n").alias("n"),
        F.count("_n").alias("present"),
        F.sum(F.greatest(F.col("_n") - 1, F.lit(0))).alias("dup"),
        F.count(F.when(F.col("_n").isNull(), 1)).alias("missing"),
        F.count(F.when(F.col("_x").isNull(), 1)).alias("extra"),
    )
    out = by_date.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.count(F.when(F.col("present") > 0, 1)).alias("unique_dates"),
        F.coalesce(F.sum("dup"), F.lit(0)).alias("duplicate_keys"),
        F.sum("missing").alias("missing_keys"),
        F.sum("extra").alias("unexpected_keys"),
        F.min(F.when(F.col("present") > 0, F.col(spec.date))).alias("min_date"),
        F.max(F.when(F.col("present") > 0, F.col(spec.date))).alias("max_date"),
    )
    ok = (F.col("missing_keys") == 0) & (F.col("unexpected_keys") == 0) & (F.col("duplicate_keys") == 0)
    return _report(out, "calendar_and_shape", ok,
                   ["total_rows", "unique_dates", "duplicate_keys", "missing_keys", "unexpected_keys", "min_date", "max_date"])


def zero_nulls(df: DataFrame, columns: list[str]) -> DataFrame:
    out = df.agg(*[F.count(F.when(F.col(c).isNull() | F.isnan(c), 1)).alias(c) for c in columns])
    out = out.withColumn("total_nulls", reduce(lambda a, b: a + b, [F.col(c) for c in columns]))
    return _report(out, "zero_nulls_in_required_cols", F.col("total_nulls") == 0, [*columns, "total_nulls"])


def index_exactness(df: DataFrame, spec: PanelSpec, tolerance: float = 1e-12) -> DataFrame:
    out = df.agg(F.max(F.abs(F.col(INDEX) - mean_of(list(spec.components)))).alias("max_discrepancy"))
    return _report(out, "wsi_mathematical_exactness", F.col("max_discrepancy") <= tolerance, ["max_discrepancy"])


def origin_splits(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """Rows per period, and origins whose last target leaves the period of its split."""
    d = F.col(spec.date)
    last_target = F.add_months(d, spec.horizon)
    split = origin_split(d, spec)
    leak = (
        ((split == "train") & (last_target > F.lit(spec.train_end).cast("date")))
        | ((split == "val") & (last_target > F.lit(spec.val_end).cast("date")))
        | ((split == "test") & (last_target > F.lit(spec.end).cast("date")))
    )
    expected = {s: F.col("split") == s for s in ("train", "validation", "test")}
    out = df.agg(
        *[F.count(F.when(c, 1)).alias(f"{s}_rows") for s, c in expected.items()],
        F.count(F.lit(1)).alias("_n"),
        F.count(F.when(leak, 1)).alias("leaking_origins"),
        F.max(F.when(split == "train", d)).alias("last_train_origin"),
        F.min(F.when(split == "val", d)).alias("first_val_origin"),
        F.min(F.when(split == "test", d)).alias("first_test_origin"),
    )
    ok = (F.col("leaking_origins") == 0) & (
        F.col("train_rows") + F.col("validation_rows") + F.col("test_rows") == F.col("_n")
    )
    return _report(out, "forecast_origin_splits", ok,
                   ["train_rows", "validation_rows", "test_rows", "leaking_origins",
                    "last_train_origin", "first_val_origin", "first_test_origin"])


def groundwater_causality(df: DataFrame, spec: PanelSpec) -> DataFrame:
    seen = F.col("last_gw_obs_date").isNotNull()
    age = F.col("months_since_last_gw_obs")
    out = df.agg(
        F.count(F.when(seen & (F.col("last_gw_obs_date").cast("date") > F.col(spec.date)), 1)).alias("future_observations"),
        F.count(F.when(seen & (age < 0), 1)).alias("negative_ages"),
        F.count(
            F.when(seen & ((age > spec.stale_months) != (F.col("groundwater_stale_flag") == 1)), 1)
        ).alias("stale_mismatches"),
    )
    measures = ["future_observations", "negative_ages", "stale_mismatches"]
    return _report(out, "groundwater_causality_and_staleness",
                   reduce(lambda a, b: a & b, [F.col(m) == 0 for m in measures]), measures)


def historical_events(df: DataFrame, expected: DataFrame, spec: PanelSpec, threshold: float = 0.5) -> DataFrame:
    """Every expected (entity, date) exists and its index exceeds the threshold."""
    found = expected.select(*spec.keys).join(df.select(*spec.keys, INDEX), spec.keys, "left")
    out = found.agg(
        F.count(F.lit(1)).alias("expected_events"),
        F.count(F.when(F.col(INDEX).isNull(), 1)).alias("missing_events"),
        F.count(F.when(F.col(INDEX) <= threshold, 1)).alias("below_threshold"),
    )
    ok = (F.col("missing_events") == 0) & (F.col("below_threshold") == 0)
    return _report(out, "historical_events", ok, ["expected_events", "missing_events", "below_threshold"])


def export_parity(audit: DataFrame, model: DataFrame, spec: PanelSpec, tolerance: float = 1e-9) -> DataFrame:
    """Shared columns of two exports agree on shared keys: largest gap, or mismatch count for non-numbers.

    A null against a value is an infinite gap, and a key that only one side has fails the check.
    """
    shared = [c for c in model.columns if c in audit.columns and c not in spec.keys]
    left = audit.select(*spec.keys, *[F.col(c).alias(f"a_{c}") for c in shared])
    right = model.select(*spec.keys, *[F.col(c).alias(f"m_{c}") for c in shared])
    types = {f.name: f.dataType for f in audit.schema.fields}
    measures = []
    for c in shared:
        a, m = F.col(f"a_{c}"), F.col(f"m_{c}")
        if isinstance(types[c], NumericType):
            gap = F.when(a.isNull() != m.isNull(), F.lit(float("inf"))).otherwise(F.abs(a - m).cast("double"))
            measures.append(F.coalesce(F.max(F.when(F.col("_a") & F.col("_m"), gap)), F.lit(0.0)).alias(c))
        else:
            measures.append(F.count(F.when(F.col("_a") & F.col("_m") & ~a.eqNullSafe(m), 1)).cast("double").alias(c))
    both = left.withColumn("_a", F.lit(True)).join(right.withColumn("_m", F.lit(True)), spec.keys, "full")
    both = both.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("_a", "_m")})
    out = both.agg(*measures, F.count(F.when(~(F.col("_a") & F.col("_m")), 1)).alias("unmatched_keys"))
    broken = [F.when(F.col(c) > tolerance, F.lit(c)) for c in shared]
    out = out.select(
        F.lit(len(shared)).alias("shared_columns"),
        F.size(F.array_compact(F.array(*broken))).alias("mismatching_columns"),
        F.array_join(F.array_compact(F.array(*broken)), ",").alias("mismatches"), "unmatched_keys",
    )
    return _report(out, "model_audit_parity", (F.col("mismatching_columns") == 0) & (F.col("unmatched_keys") == 0),
                   ["shared_columns", "mismatching_columns", "mismatches", "unmatched_keys"])


def panel_contract(df: DataFrame, columns: list[str], spec: PanelSpec) -> DataFrame:
    """Required columns, unique keys, finite values and month continuity per entity."""
    absent = [c for c in [*spec.keys, *columns] if c not in df.columns]
    if absent:
        raise KeyError(f"required columns are missing: {absent}")
    bad = reduce(
        lambda a, b: a | b,
        [F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")) for c in columns],
    )
    w = Window.partitionBy(spec.entity).orderBy(spec.date)
    days = F.datediff(F.col(spec.date), F.lag(spec.date).over(w))
    rows = df.select(*spec.keys, bad.alias("_bad")).withColumn("_days", days)
    per_entity = rows.groupBy(spec.entity).agg(
        F.count(F.lit(1)).alias("_n"),
        F.countDistinct(spec.date).alias("_dates"),
        F.sum(F.col("_bad").cast("int")).alias("_bad"),
        F.count(F.when(~F.col("_days").between(28, 31), 1)).alias("_breaks"),
        F.min(spec.date).alias("_lo"),
        F.max(spec.date).alias("_hi"),
    )
    out = per_entity.agg(
        F.sum("_n").alias("total_rows"),
        F.count(F.lit(1)).alias("entities"),
        F.sum(F.col("_n") - F.col("_dates")).alias("duplicate_keys"),
        F.sum("_bad").alias("non_finite_rows"),
        F.sum("_breaks").alias("continuity_breaks"),
        F.count(F.when(F.col("_lo") != F.lit(spec.start).cast("date"), 1)).alias("wrong_start"),
        F.count(F.when(F.col("_hi") != F.lit(spec.end).cast("date"), 1)).alias("wrong_end"),
    )
    zero = ["duplicate_keys", "non_finite_rows", "continuity_breaks", "wrong_start", "wrong_end"]
    return _report(out, "panel_contract", reduce(lambda a, b: a & b, [F.col(m) == 0 for m in zero]),
                   ["total_rows", "entities", *zero])


def full_suite(
    panel: DataFrame, audit: DataFrame, model: DataFrame, spec: PanelSpec,
    events: DataFrame | None = None, entities: DataFrame | None = None,
) -> DataFrame:
    """All checks plus an ``overall`` row that passes only when every check does.

    The expected calendar spans the given entities, or those of the panel.
    """
    grid = build_calendar(panel if entities is None else entities, spec)
    checks = [
        calendar_and_shape(panel, grid, spec),
        zero_nulls(panel, [*spec.components, INDEX]),
        index_exactness(panel, spec),
        origin_splits(panel, spec),
        groundwater_causality(panel, spec),
        export_parity(audit, model, spec),
    ]
    if events is not None:
        checks.append(historical_events(panel, events, spec))
    report = reduce(DataFrame.unionByName, checks)
    overall = report.agg(
        F.count(F.lit(1)).alias("checks"), F.count(F.when(~F.col("passed"), 1)).alias("failed")
    )
    return report.unionByName(_report(overall, "overall", F.col("failed") == 0, ["checks", "failed"]))


def require_passed(report: DataFrame) -> None:
    """Raise when any check failed; a report has one row per check."""
    failed = [r["check"] for r in report.where(~F.col("passed")).select("check").collect()]
    if failed:
        raise ValueError(f"validation failed: {failed}")


#: Key values of one leaf of the tree of digests, and children of a node.
LEAF_KEYS = 1024
FAN_OUT = 16


def canonical(field: T.StructField) -> Column:
    """A value as text that any engine can repeat: floating-point numbers in millionths, times in microseconds."""
    c = F.col(field.name)
    if isinstance(field.dataType, (T.FloatType, T.DoubleType, T.DecimalType)):
        c = F.floor(c.cast("double") * 1e6 + 0.5).cast("bigint")
    elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
        c = F.unix_micros(c.cast("timestamp"))
    elif isinstance(field.dataType, T.BooleanType):
        c = c.cast("int")
    text = c.cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit("="), text), F.lit("~"))


def _half(digest: str, first: int) -> Column:
    return F.conv(F.substring(digest, first, 16), 16, 10).cast("decimal(20,0)")


def fingerprint(df: DataFrame, key: str, columns: list[str] | None = None, leaf: int = LEAF_KEYS, fan_out: int = FAN_OUT) -> DataFrame:
    """Tree of order-insensitive digests over ranges of an integer key: level, node, n_rows, content_hash.

    A row's digest is the MD5 of its canonical values; a node adds up the two halves of the digests below it, each modulo 2^64.
    Level 0 has a node per ``leaf`` keys (null for rows without a key), each further level one per ``fan_out`` nodes, up to
    one node, the level of which is the greatest. Rows are added up once, to leaves; the levels above are made from the leaves.
    """
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    digest = F.md5(F.concat_ws("|", *[canonical(f) for f in fields]))
    rows = df.select(F.floor(F.col(key) / leaf).cast("bigint").alias("node"), digest.alias("_d"))
    leaves = materialize(
        rows.select("node", _half("_d", 1).alias("a"), _half("_d", 17).alias("b")).groupBy("node").agg(
            F.count(F.lit(1)).alias("n"), F.sum("a").alias("a"), F.sum("b").alias("b")
        ),
        "digest-leaves",
    )
    lo, hi = leaves.agg(F.coalesce(F.min("node"), F.lit(0)), F.coalesce(F.max("node"), F.lit(0))).first()
    height = 1
    while lo // fan_out**height != hi // fan_out**height:
        height += 1
    up = leaves.select(
        "n", "a", "b", "node", F.explode(F.array(*[F.struct(F.lit(i).alias("level"), F.lit(fan_out**i).cast("bigint").alias("span")) for i in range(height + 1)])).alias("l")
    ).select(
        F.col("l.level").alias("level"), "n", "a", "b",
        F.when(F.col("l.level") == height, F.lit(0).cast("bigint")).otherwise(F.floor(F.col("node") / F.col("l.span")).cast("bigint")).alias("node"),
    )
    sums = up.groupBy("level", "node").agg(F.sum("n").alias("n_rows"), F.sum("a").alias("a"), F.sum("b").alias("b"))
    modulus = F.lit("18446744073709551616").cast("decimal(20,0)")
    halves = [(F.col(c) % modulus).cast("decimal(20,0)").cast("string") for c in ("a", "b")]
    content = F.concat(halves[0], F.lit(":"), halves[1])
    return sums.select("level", "node", "n_rows", content.alias("content_hash"))


def changed_ranges(before: DataFrame, after: DataFrame, leaf: int = LEAF_KEYS) -> DataFrame:
    """Key ranges (first_key, last_key) whose leaves differ between two trees, with their numbers of rows; null ends for rows without a key."""
    sides = [t.where("level = 0").select("node", F.col("n_rows").alias(f"{n}_rows"), F.col("content_hash").alias(n)) for t, n in ((before, "before"), (after, "after"))]
    old, new = sides[0], sides[1].withColumnRenamed("node", "_node")
    joined = old.join(new, F.col("node").eqNullSafe(F.col("_node")), "full_outer").where(~F.col("before").eqNullSafe(F.col("after")))
    node = F.coalesce("node", "_node")
    return joined.select(
        (node * leaf).alias("first_key"), (node * leaf + leaf - 1).alias("last_key"),
        F.coalesce("before_rows", F.lit(0)).alias("before_rows"), F.coalesce("after_rows", F.lit(0)).alias("after_rows"),
    )


def month_gap(earlier: str, later: str) -> Column:
    return month_number(later) - month_number(earlier)
