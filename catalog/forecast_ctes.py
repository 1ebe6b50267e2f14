"""Oracle CTEs: sequences, ridge by Gauss-Jordan elimination, long predictions."""

from __future__ import annotations

from catalog.base import SPEC, cte
from catalog.ctes import D
from panelstress.spec import COMPONENTS, RIDGE_ALPHAS

ORIGIN_CASE = "CASE " + " ".join(
    f"WHEN forecast_origin BETWEEN {D(a)} AND {D(b)} THEN '{s}'" for s, a, b in SPEC.origins.ranges()
) + " END"
_STEP = ", ".join(f"CAST({c} AS FLOAT)" for c in COMPONENTS)

cte("c_slide", f"""
SELECT * FROM (SELECT entity, date AS forecast_origin, lag(date, 11) OVER o AS input_start,
  lead(date, 1) OVER o AS target_t1, lead(date, 2) OVER o AS target_t2, lead(date, 3) OVER o AS target_t3,
  flatten(list([{_STEP}]) OVER w) AS x, list(wsi) OVER w AS hist,
  CAST(lead(wsi, 1) OVER o AS FLOAT) AS y1, CAST(lead(wsi, 2) OVER o AS FLOAT) AS y2, CAST(lead(wsi, 3) OVER o AS FLOAT) AS y3, wsi
  FROM c_panel WINDOW o AS (PARTITION BY entity ORDER BY date),
    w AS (PARTITION BY entity ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW))
WHERE input_start IS NOT NULL AND target_t3 IS NOT NULL
""")
cte("c_seq", """
SELECT *, printf('%06d', position) AS sequence_id FROM (
  SELECT *, row_number() OVER (ORDER BY entity, forecast_origin) AS position FROM (
    SELECT *, """ + ORIGIN_CASE + """ AS split FROM c_slide) WHERE split IS NOT NULL)
""")


def ridge_ctes(tag: str, inputs: str, p: int, targets: str = "[CAST(y1 AS DOUBLE), CAST(y2 AS DOUBLE), CAST(y3 AS DOUBLE)]") -> None:
    """Moments, all alphas on train, choice on val, refit on train + val; ends in c_<tag>_fit(stage, b, w)."""
    size = 1 + p + 3
    rows = f"SELECT split, list_concat([1.0::DOUBLE], {inputs}, {targets}) AS z FROM c_seq"
    cte(f"c_{tag}_rows", rows)
    for stage, splits in (("fit", "'train'"), ("refit", "'train', 'val'")):
        cte(f"c_{tag}_{stage}_g", f"""
SELECT list(v ORDER BY i) AS g FROM (SELECT i, list(s ORDER BY j) AS v FROM (
  SELECT i, j, sum(z[i] * z[j]) AS s FROM (SELECT z, unnest(range(1, {size + 1})) AS i FROM c_{tag}_rows WHERE split IN ({splits})),
    unnest(range(1, {size + 1})) t(j) GROUP BY i, j) GROUP BY i)
""")
        cte(f"c_{tag}_{stage}_s", f"""
SELECT g, list_transform(range(1, {size}), lambda i: g[1][i + 1] / g[1][1]) AS mu,
  list_transform(range(1, {p + 1}), lambda i: CASE WHEN g[i + 1][i + 1] - g[1][i + 1] * g[1][i + 1] / g[1][1] <= 0 THEN 1.0
    ELSE sqrt((g[i + 1][i + 1] - g[1][i + 1] * g[1][i + 1] / g[1][1]) / g[1][1]) END) AS sd FROM c_{tag}_{stage}_g
""")
        alphas = f"unnest({list(RIDGE_ALPHAS)}::DOUBLE[])" if stage == "fit" else f"(SELECT alpha FROM c_{tag}_best)"
        cte(f"c_{tag}_{stage}_m0", f"""
SELECT {alphas} AS alpha, list_transform(range(1, {p + 1}), lambda i: list_transform(range(1, {p + 4}), lambda j:
  (g[i + 1][j + 1] - g[1][1] * mu[i] * mu[j]) / sd[i] / (CASE WHEN j <= {p} THEN sd[j] ELSE 1.0 END))) AS m FROM c_{tag}_{stage}_s
""")
        cte(f"c_{tag}_{stage}_m1", f"""
SELECT alpha, list_transform(m, lambda row, i: list_transform(row, lambda v, j: CASE WHEN i = j THEN v + alpha ELSE v END)) AS m FROM c_{tag}_{stage}_m0
""")
        cte(f"c_{tag}_{stage}_gj", f"""
SELECT 1, alpha, m FROM c_{tag}_{stage}_m1 UNION ALL SELECT k + 1, alpha, list_transform(m, lambda row, i: CASE WHEN i = k
  THEN list_transform(row, lambda v: v / m[k][k]) ELSE list_transform(row, lambda v, j: v - row[k] / m[k][k] * m[k][j]) END)
FROM c_{tag}_{stage}_gj WHERE k <= {p}
""")
        cte(f"c_{tag}_{stage}_w", f"""
SELECT alpha, w, list_transform([1, 2, 3], lambda h: mu[{p} + h] - list_sum(list_transform(range(1, {p + 1}), lambda i: w[h][i] * mu[i]))) AS b
FROM (SELECT alpha, mu, list_transform([1, 2, 3], lambda h: list_transform(range(1, {p + 1}), lambda i: m[i][{p} + h] / sd[i])) AS w
  FROM c_{tag}_{stage}_gj, c_{tag}_{stage}_s WHERE k = {p + 1})
""")
        if stage == "fit":
            gaps = " + ".join(f"abs(list_dot_product(w[{h}], z[2:{p + 1}]) + b[{h}] - z[{p + 1 + h}])" for h in (1, 2, 3))
            cte(f"c_{tag}_scores", f"""
SELECT alpha, avg(({gaps}) / 3.0) AS mae FROM c_{tag}_rows, c_{tag}_fit_w WHERE split = 'val' GROUP BY alpha
""")
            cte(f"c_{tag}_best", f"SELECT alpha, mae FROM c_{tag}_scores ORDER BY mae, alpha LIMIT 1")
    cte(f"c_{tag}_fit", f"""
SELECT 'val' AS split, b, w FROM c_{tag}_fit_w WHERE alpha = (SELECT alpha FROM c_{tag}_best)
UNION ALL SELECT 'test', b, w FROM c_{tag}_refit_w
""")


HISTORY = "hist"
FEATURES = "list_transform(x, lambda v: CAST(v AS DOUBLE))"
ridge_ctes("ar", HISTORY, 12)
ridge_ctes("rr", FEATURES, 72)


def mean_of_step(step: int) -> str:
    lo = (step - 1) * 6
    return "(" + " + ".join(f"CAST(x[{lo + i}] AS DOUBLE)" for i in range(1, 7)) + ") / 6.0"


def linear(tag: str, inputs: str, offset: str = "0.0") -> str:
    return "[" + ", ".join(
        f"CAST(list_dot_product({tag}.w[{h}], {inputs}) + {tag}.b[{h}] + {offset} AS FLOAT)" for h in (1, 2, 3)
    ) + "]"


_SEASON = ", ".join(
    f"CAST(coalesce(p{h}.wsi, {mean_of_step(h)}) AS FLOAT)" for h in (1, 2, 3)
)
cte("c_wide", f"""
SELECT s.*, [CAST(s.wsi AS FLOAT), CAST(s.wsi AS FLOAT), CAST(s.wsi AS FLOAT)] AS persistence, [{_SEASON}] AS seasonal,
  {linear('ar', 's.hist')} AS ar, {linear('rr', 'list_transform(s.x, lambda v: CAST(v AS DOUBLE))')} AS ridge
FROM c_seq s
LEFT JOIN c_panel p1 ON p1.entity = s.entity AND p1.date = s.target_t1 - INTERVAL 12 MONTH
LEFT JOIN c_panel p2 ON p2.entity = s.entity AND p2.date = s.target_t2 - INTERVAL 12 MONTH
LEFT JOIN c_panel p3 ON p3.entity = s.entity AND p3.date = s.target_t3 - INTERVAL 12 MONTH
LEFT JOIN c_ar_fit ar ON ar.split = s.split LEFT JOIN c_rr_fit rr ON rr.split = s.split
""")


def errors(actual: str = "a", predicted: str = "p") -> str:
    e = f"({predicted} - {actual})"
    return (
        f"round({actual}, 6) + 0.0 AS actual_wsi, round({predicted}, 6) + 0.0 AS predicted_wsi, round({e}, 6) + 0.0 AS error, "
        f"round(abs({e}), 6) + 0.0 AS absolute_error, round({e} * {e}, 6) + 0.0 AS squared_error"
    )


cte("c_pred", f"""
SELECT CASE split WHEN 'val' THEN 'official_validation' ELSE 'official_test' END AS evaluation_type, model, sequence_id, position, entity,
  forecast_origin, 'h' || h AS horizon, {errors()} FROM (
  SELECT split, sequence_id, position, entity, forecast_origin, model, h,
    CAST(pred[h] AS DOUBLE) AS p, CAST([y1, y2, y3][h] AS DOUBLE) AS a FROM (
    SELECT *, unnest([1, 2, 3]) AS h FROM (
      SELECT * EXCLUDE (x, hist), unnest(['Persistence', 'Seasonal_Persistence', 'WSI_Autoregression', 'Ridge_Regression']) AS model,
        unnest([persistence, seasonal, ar, ridge]) AS pred FROM c_wide WHERE split <> 'train')))
""")
cte("c_test", "SELECT * FROM c_pred WHERE evaluation_type = 'official_test'")
cte("c_val", "SELECT * FROM c_pred WHERE evaluation_type = 'official_validation'")
