"""The engine's queries over panels derived from orders, lineitem and part, each with its SQL where SQL can express it.

The asset panel is weekly spend by order priority (log changes), the confounders weekly averages of shipped lines.
L and V are the lookback and the number of validation folds of these queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import backtest, forecast_sql, inference, lags, panel, rolling, windows
from ..sources import sinks, tables

L, V, P_MAX = 52, 2, 3
NAMES = list(tables.SERIES)
BENCHMARK = NAMES[0]
SPEC = windows.WindowSpec(L, V, 1)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def rounded(c, digits: int = 6) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)


def assets(spark, d):
    return tables.spend_panel(spark, d)


def size(p: DataFrame) -> int:
    return p.agg((F.max("t") + 1).alias("n")).first().n


def aligned(spark, d) -> tuple[DataFrame, DataFrame]:
    """The asset panel and the filled confounders on its dates, with the same t."""
    y = assets(spark, d)
    filled = panel.interpolate(tables.ship_confounders(spark, d), "linear")
    return y, panel.on_dates_of(filled, y).join(y.select("t", "date").distinct(), "date").select("t", "date", "series", "value")


CELLS = """cells AS (SELECT CAST(date_trunc('week', o_orderdate) AS DATE) AS date, o_orderpriority AS series, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS level FROM orders GROUP BY 1, 2)"""
PANEL = CELLS + """,
days AS (SELECT DISTINCT date FROM cells),
levels AS (SELECT d.date, k.series, coalesce(c.level, 0.0) AS level FROM days d CROSS JOIN (SELECT DISTINCT series FROM cells) k LEFT JOIN cells c ON c.date = d.date AND c.series = k.series),
num AS (SELECT date, CAST(row_number() OVER (ORDER BY date) - 2 AS INTEGER) AS t FROM days),
change AS (SELECT n.t, l.date, l.series, 0.01 * (ln(1 + level) - ln(1 + lag(level) OVER (PARTITION BY series ORDER BY l.date))) AS value FROM levels l JOIN num n ON n.date = l.date),
panel AS (SELECT * FROM change WHERE t >= 0),
size AS (SELECT max(t) + 1 AS n FROM panel)"""
SPARSE = CELLS + """,
change AS (SELECT date, series, 0.01 * (ln(1 + level) - ln(1 + lag(level) OVER (PARTITION BY series ORDER BY date))) AS value FROM cells),
sparse AS (SELECT * FROM change WHERE date > (SELECT min(date) FROM cells))"""
SHIPPED = """weeks AS (SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(l_discount) AS d, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(l_quantity) AS q, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(l_extendedprice) AS p FROM lineitem GROUP BY 1),
numbered AS (SELECT *, row_number() OVER (ORDER BY date) AS n FROM weeks),
ship AS (
  SELECT date, 'C_DISC' AS series, d AS value FROM numbered
  UNION ALL SELECT date, 'C_QTY', CASE WHEN n % 3 = 0 THEN q END FROM numbered
  UNION ALL SELECT date, 'C_PRICE', CASE WHEN date >= DATE '1996-01-01' AND date < DATE '2001-06-01' THEN p END FROM numbered
)"""
MARKED = SHIPPED + """,
placed AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY date) AS i FROM ship),
known AS (
  SELECT *, max(CASE WHEN value IS NOT NULL THEN i END) OVER (PARTITION BY series ORDER BY i) AS a,
    min(CASE WHEN value IS NOT NULL THEN i END) OVER (PARTITION BY series ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS b FROM placed
),
ends AS (SELECT k.date, k.series, k.value, k.i, k.a, k.b, x.value AS va, y.value AS vb FROM known k LEFT JOIN placed x ON x.series = k.series AND x.i = k.a LEFT JOIN placed y ON y.series = k.series AND y.i = k.b)"""
FILLED = MARKED + """,
filled AS (SELECT date, series, coalesce(CASE WHEN value IS NOT NULL OR b IS NULL THEN va ELSE va + (vb - va) * (i - a) / nullif(b - a, 0) END, 0.0) AS value FROM ends)"""


# Sources, projection and filters


@query("panel_long", f"WITH {PANEL} SELECT t, date, series, round(value, 6) + 0.0 AS value FROM panel")
def panel_long(spark, d):
    return assets(spark, d).withColumn("value", rounded("value"))


@query("panel_wide_pivot", f"WITH {PANEL} SELECT t, " + ", ".join(f"round(max(CASE WHEN series = '{s}' THEN value END), 6) + 0.0 AS \"{s}\"" for s in NAMES) + " FROM panel GROUP BY t")
def panel_wide(spark, d):
    wide = lags.wide(assets(spark, d), NAMES)
    return wide.select("t", *[rounded(F.col(f"`{s}`")).alias(s) for s in NAMES])


@query("panel_unpivot", f"WITH {PANEL} SELECT t, series, round(value, 6) + 0.0 AS value FROM panel")
def panel_unpivot(spark, d):
    wide = lags.wide(assets(spark, d), NAMES)
    return wide.unpivot("t", [f"`{s}`" for s in NAMES], "series", "value").select("t", F.regexp_replace("series", "`", "").alias("series"), rounded("value").alias("value"))


@query("header_date_parse", "WITH h AS (SELECT DISTINCT 'X' || strftime(o_orderdate, '%Y%m%d') AS header FROM orders) SELECT header, CAST(strptime(ltrim(header, 'X'), '%Y%m%d') AS DATE) AS date FROM h")
def header_date_parse(spark, d):
    h = spark.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("X"), F.date_format("o_orderdate", "yyyyMMdd")).alias("header")).distinct()
    return h.select("header", tables.header_date("header").alias("date"))


@query("complete_case_series", f"WITH {SPARSE}, full_ AS (SELECT series FROM sparse GROUP BY series HAVING count(DISTINCT CASE WHEN value IS NOT NULL THEN date END) = (SELECT count(DISTINCT date) FROM sparse)) SELECT date, series, round(value, 6) + 0.0 AS value FROM sparse WHERE series IN (SELECT series FROM full_)")
def complete_case_series(spark, d):
    return panel.complete_series(tables.spend_panel(spark, d, fill=False).select("date", "series", "value")).withColumn("value", rounded("value"))


@query("first_n_series", f"WITH {PANEL}, few AS (SELECT DISTINCT series FROM panel ORDER BY series LIMIT 3) SELECT t, date, series, round(value, 6) + 0.0 AS value FROM panel WHERE series IN (SELECT series FROM few)")
def first_n_series(spark, d):
    return panel.first_series(assets(spark, d), 3).select("t", "date", "series", rounded("value").alias("value"))


@query("named_series", f"WITH {PANEL} SELECT t, date, series, round(value, 6) + 0.0 AS value FROM panel WHERE series IN ('1-URGENT', '5-LOW')")
def named_series(spark, d):
    return panel.named_series(assets(spark, d), ["1-URGENT", "5-LOW"]).withColumn("value", rounded("value"))


@query("tail_subset", f"WITH {PANEL} SELECT t, date, series, round(value, 6) + 0.0 AS value FROM panel WHERE t > (SELECT max(t) FROM panel) - 100")
def tail_subset(spark, d):
    return panel.tail_days(assets(spark, d), 100).withColumn("value", rounded("value"))


@query("date_cap_filter", f"WITH {SHIPPED} SELECT date, series, round(value, 6) + 0.0 AS value FROM ship WHERE series = 'C_DISC' AND date <= DATE '1999-12-31'")
def date_cap_filter(spark, d):
    return panel.until(panel.named_series(tables.ship_confounders(spark, d), ["C_DISC"]), "1999-12-31").withColumn("value", rounded("value"))


@query("trading_day_semi", f"WITH {PANEL}, {SHIPPED} SELECT date, series, round(value, 6) + 0.0 AS value FROM ship WHERE date IN (SELECT date FROM panel)")
def trading_day_semi(spark, d):
    return panel.require_dates(tables.ship_confounders(spark, d), assets(spark, d)).withColumn("value", rounded("value"))


@query("confounder_outer_merge", f"WITH {SHIPPED} SELECT d.date, s.series, round(x.value, 6) + 0.0 AS value FROM (SELECT DISTINCT date FROM weeks) d CROSS JOIN (SELECT DISTINCT series FROM ship) s LEFT JOIN ship x ON x.date = d.date AND x.series = s.series")
def confounder_outer_merge(spark, d):
    ship = tables.ship_confounders(spark, d).filter("value is not null")
    return panel.outer_merge([ship.filter(F.col("series") == s) for s in ("C_DISC", "C_QTY", "C_PRICE")]).select("date", "series", rounded("value").alias("value"))


@query("interpolate_linear", f"WITH {FILLED} SELECT date, series, round(value, 6) + 0.0 AS value FROM filled")
def interpolate_linear(spark, d):
    return panel.interpolate(tables.ship_confounders(spark, d), "linear").select("date", "series", rounded("value").alias("value"))


@query("interpolate_ffill", f"WITH {MARKED} SELECT date, series, round(coalesce(va, 0.0), 6) + 0.0 AS value FROM ends")
def interpolate_ffill(spark, d):
    return panel.interpolate(tables.ship_confounders(spark, d), "ffill").select("date", "series", rounded("value").alias("value"))


@query("fill_zero", f"WITH {SHIPPED} SELECT date, series, round(coalesce(value, 0.0), 6) + 0.0 AS value FROM ship")
def fill_zero(spark, d):
    return tables.ship_confounders(spark, d).na.fill(0.0, ["value"]).withColumn("value", rounded("value"))


LAG_SQL = f"WITH {PANEL}, l AS (SELECT t, series, value, lag(value, 1) OVER w AS l1, lag(value, 2) OVER w AS l2 FROM panel WINDOW w AS (PARTITION BY series ORDER BY t)) SELECT t"


def lag_columns(kinds) -> str:
    return "".join(f", round(max(CASE WHEN series = '{s}' THEN {c} END), 6) + 0.0 AS \"{s}{suffix}\"" for c, suffix in kinds for s in NAMES)


def round_all(frame: DataFrame) -> DataFrame:
    return frame.select("t", *[rounded(F.col(f"`{c}`")).alias(c) for c in frame.columns if c != "t"])


@query("make_lags", LAG_SQL + lag_columns([("l1", "_lag1"), ("l2", "_lag2")]) + " FROM l GROUP BY t")
def make_lags(spark, d):
    return round_all(lags.make_lags(assets(spark, d), NAMES, 2))


@query("make_lags_with_original", LAG_SQL + lag_columns([("value", ""), ("l1", "_lag1"), ("l2", "_lag2")]) + " FROM l GROUP BY t")
def make_lags_with_original(spark, d):
    return round_all(lags.make_lags(assets(spark, d), NAMES, 2, include_original=True))


@query(
    "realign_roles",
    f"WITH {PANEL}, {FILLED}, c AS (SELECT p.t, f.series, f.value FROM filled f JOIN (SELECT DISTINCT t, date FROM panel) p ON p.date = f.date), "
    "y AS (SELECT t, max(CASE WHEN series = '1-URGENT' THEN value END) AS y FROM panel GROUP BY t), tr AS (SELECT t, lag(y) OVER (ORDER BY t) AS y_lag1 FROM y), "
    "w AS (SELECT t, lag(value) OVER (ORDER BY t) AS w_lag1, lag(value, 2) OVER (ORDER BY t) AS w_lag2 FROM c WHERE series = 'C_QTY') "
    "SELECT y.t, round(y, 6) + 0.0 AS y, round(y_lag1, 6) + 0.0 AS y_lag1, round(w_lag1, 6) + 0.0 AS w_lag1, round(w_lag2, 6) + 0.0 AS w_lag2 FROM y JOIN tr ON y.t = tr.t JOIN w ON y.t = w.t WHERE y IS NOT NULL AND y_lag1 IS NOT NULL AND w_lag1 IS NOT NULL AND w_lag2 IS NOT NULL",
)
def realign_roles(spark, d):
    y, c = aligned(spark, d)
    one = y.filter("series = '1-URGENT'").withColumn("series", F.lit("y"))
    w = c.filter("series = 'C_QTY'").withColumn("series", F.lit("w"))
    return round_all(lags.realign(one.select("t", F.col("value").alias("y")), lags.make_lags(one, ["y"], 1), lags.make_lags(w, ["w"], 2)))


# Files


@query("csv_returns_scan", f"WITH {PANEL} SELECT date, series, round(value, 6) + 0.0 AS value FROM panel")
def csv_returns_scan(spark, d):
    """The panel written as a wide CSV with a column a date, and read back."""
    path = f"{sinks.scratch(spark, 'csv')}/returns.csv"
    sinks.save_returns(assets(spark, d), path)
    return tables.read_returns(spark, path).select("date", "series", rounded("value").alias("value"))


@query(
    "csv_confounder_scan",
    f"WITH {SHIPPED} SELECT w.date, s.series, round(x.value, 6) + 0.0 AS value FROM weeks w CROSS JOIN (SELECT DISTINCT series FROM ship) s "
    "LEFT JOIN ship x ON x.date = w.date AND x.series = s.series AND (s.series <> 'C_PRICE' OR x.date <= DATE '1999-12-31')",
)
def csv_confounder_scan(spark, d):
    """Three files of confounders and one that is missing, merged on the date; C_PRICE up to a date only."""
    ship, folder = tables.ship_confounders(spark, d), sinks.scratch(spark, "csv")
    paths = {s: f"{folder}/{s}.csv" for s in ("C_DISC", "C_QTY", "C_PRICE")}
    for s, path in paths.items():
        sinks.save_confounder(ship.filter(F.col("series") == s), path)
    read = tables.read_confounders(spark, [*paths.values(), f"{folder}/absent.csv"], until={paths["C_PRICE"]: "1999-12-31"})
    return read.select("date", "series", rounded("value").alias("value"))


# Windows


ORIGINS_SQL = f"WITH {PANEL}, o AS (SELECT CAST(unnest(range({L}, n - 1)) AS INTEGER) AS origin FROM size)"


@query("fold_windows", ORIGINS_SQL + f" SELECT origin, CAST(s AS INTEGER) AS shift, CAST(origin - {L} + s AS INTEGER) AS lo, CAST(origin - {V} + 1 + s AS INTEGER) AS hi FROM o, range({V}) r(s)")
def fold_windows(spark, d):
    return windows.fold_windows(spark, size(assets(spark, d)), SPEC)


@query("final_windows", ORIGINS_SQL + f" SELECT origin, CAST(origin - {L} AS INTEGER) AS lo, CAST(origin + 1 AS INTEGER) AS hi FROM o")
def final_windows(spark, d):
    return windows.final_windows(spark, size(assets(spark, d)), SPEC)


@query("run_grid", ORIGINS_SQL + f" SELECT origin, CAST(p AS INTEGER) AS p, alpha, CAST(s AS INTEGER) AS shift FROM o, range(1, {P_MAX + 1}) g(p), (VALUES (CAST(0.001 AS DOUBLE)), (0.01), (0.1), (1.0), (10.0)) a(alpha), range({V}) r(s)")
def run_grid(spark, d):
    return windows.run_grid(spark, size(assets(spark, d)), SPEC, P_MAX, list(rolling.ALPHAS))


@query("time_series_split", f"WITH {PANEL}, k AS (SELECT CAST(f AS INTEGER) AS fold, n // 6 AS h, CAST(n - (5 - f) * (n // 6) AS INTEGER) AS lo FROM size, range(5) r(f)) SELECT fold, lo AS train_rows, lo AS test_lo, CAST(lo + h - 1 AS INTEGER) AS test_hi FROM k")
def time_series_split(spark, d):
    return windows.time_series_split(spark, size(assets(spark, d)), 5)


# Forecasts in SQL


AR1 = f"""lagged AS (SELECT t, series, value, lag(value) OVER (PARTITION BY series ORDER BY t) AS l1 FROM panel),
ar1 AS (SELECT t, series, CASE WHEN regr_sxx(value, l1) OVER w > 0 THEN regr_avgy(value, l1) OVER w + regr_slope(value, l1) OVER w * (l1 - regr_avgx(value, l1) OVER w) ELSE regr_avgy(value, l1) OVER w END AS f
  FROM lagged WINDOW w AS (PARTITION BY series ORDER BY t ROWS BETWEEN {L} PRECEDING AND 1 PRECEDING)),
fc AS (SELECT * FROM ar1 WHERE t > {L})"""


@query("rolling_ar1_forecast", f"WITH {PANEL}, {AR1} SELECT t, series, round(f, 6) + 0.0 AS f FROM fc")
def rolling_ar1_forecast(spark, d):
    return forecast_sql.ar1(assets(spark, d), L).withColumn("f", rounded("f"))


def plane(y: str, x: str, z: str, w: str) -> str:
    """SQL of a forecast by two regressors over the window w."""
    c = lambda a, b: f"covar_pop({a}, {b}) OVER {w}"
    det = f"({c(x, x)} * {c(z, z)} - {c(x, z)} * {c(x, z)})"
    m = lambda v: f"avg({v}) OVER {w}"
    return (
        f"CASE WHEN {det} > 0 THEN {m(y)} + ({c(x, y)} * {c(z, z)} - {c(z, y)} * {c(x, z)}) / {det} * ({x} - {m(x)})"
        f" + ({c(z, y)} * {c(x, x)} - {c(x, y)} * {c(x, z)}) / {det} * ({z} - {m(z)}) END"
    )


@query(
    "rolling_arx1_forecast",
    f"WITH {PANEL}, {FILLED}, x AS (SELECT p.t, f.value AS x FROM filled f JOIN (SELECT DISTINCT t, date FROM panel) p ON p.date = f.date WHERE f.series = 'C_DISC'), "
    "rows_ AS (SELECT p.t, p.series, p.value, lag(p.value) OVER v AS l1, lag(x.x) OVER v AS x1 FROM panel p JOIN x ON x.t = p.t WINDOW v AS (PARTITION BY p.series ORDER BY p.t)), "
    f"fit AS (SELECT t, series, {plane('value', 'l1', 'x1', 'w')} AS f FROM rows_ WINDOW w AS (PARTITION BY series ORDER BY t ROWS BETWEEN {L} PRECEDING AND 1 PRECEDING)) SELECT t, series, round(f, 6) + 0.0 AS f FROM fit WHERE t > {L}",
)
def rolling_arx1_forecast(spark, d):
    y, c = aligned(spark, d)
    x = c.filter("series = 'C_DISC'").select("t", F.col("value").alias("x"))
    return forecast_sql.arx1(y, x, L).withColumn("f", rounded("f"))


M = L - V + 1
FOLDS = f"""lagged2 AS (SELECT t, series, value, lag(value) OVER v AS l1, lag(value, 2) OVER v AS l2 FROM panel WINDOW v AS (PARTITION BY series ORDER BY t)),
folds AS (SELECT t, series, value,
    regr_avgy(value, l1) OVER a + regr_slope(value, l1) OVER a * (l1 - regr_avgx(value, l1) OVER a) AS f1, {plane('value', 'l1', 'l2', 'b')} AS f2
  FROM lagged2 WINDOW a AS (PARTITION BY series ORDER BY t ROWS BETWEEN {M - 1} PRECEDING AND 1 PRECEDING), b AS (PARTITION BY series ORDER BY t ROWS BETWEEN {M - 2} PRECEDING AND 1 PRECEDING)),
day AS (SELECT t, 1 AS p, sqrt(avg(pow(value - f1, 2))) AS err, avg(abs(value - f1)) AS mae FROM folds WHERE t >= {M} GROUP BY t UNION ALL SELECT t, 2, sqrt(avg(pow(value - f2, 2))), avg(abs(value - f2)) FROM folds WHERE t >= {M} GROUP BY t),
errors AS (SELECT CAST(t + {V} - 1 - s AS INTEGER) AS origin, p, CAST(s AS INTEGER) AS shift, err FROM day, range({V}) r(s), size WHERE t + {V} - 1 - s BETWEEN {L} AND n - 2),
best AS (SELECT origin, arg_min(p, (err, p)) AS p_opt, min(err) AS valid_err FROM (SELECT origin, p, avg(err) AS err FROM errors GROUP BY 1, 2) GROUP BY 1)"""


def errors_of(spark, d):
    y = assets(spark, d)
    return forecast_sql.fold_errors(forecast_sql.fold_forecasts(y, L, V), L, V, size(y))


@query("fold_error_sum", f"WITH {PANEL}, {FOLDS} SELECT origin, p, round(sum(err), 6) + 0.0 AS err FROM errors GROUP BY 1, 2")
def fold_error_sum(spark, d):
    return errors_of(spark, d).groupBy("origin", "p").agg(rounded(F.sum("err")).alias("err"))


@query("argmin_lag", f"WITH {PANEL}, {FOLDS} SELECT origin, p_opt, round(valid_err, 6) + 0.0 AS valid_err FROM best")
def argmin_lag(spark, d):
    return forecast_sql.best_lag(errors_of(spark, d)).select("origin", "p_opt", rounded("valid_err").alias("valid_err"))


@query("row_rmse", f"WITH {PANEL}, {FOLDS} SELECT t, round(err, 6) + 0.0 AS row_rmse FROM day WHERE p = 1")
def row_rmse(spark, d):
    f = forecast_sql.fold_forecasts(assets(spark, d), L, V)
    return f.groupBy("t").agg(rounded(F.sqrt(F.avg(F.pow(F.col("value") - F.col("f1"), 2)))).alias("row_rmse"))


@query("mean_output_rmse", f"WITH {PANEL}, {FOLDS} SELECT t, round(mae, 6) + 0.0 AS mean_output_rmse FROM day WHERE p = 1")
def mean_output_rmse(spark, d):
    f = forecast_sql.fold_forecasts(assets(spark, d), L, V)
    return f.groupBy("t").agg(rounded(F.avg(F.abs(F.col("value") - F.col("f1")))).alias("mean_output_rmse"))


@query(
    "rolling_ar1_lag_select",
    f"WITH {PANEL}, {FOLDS}, finals AS (SELECT t, series, CAST(t - 1 AS INTEGER) AS origin, regr_avgy(value, l1) OVER a + regr_slope(value, l1) OVER a * (l1 - regr_avgx(value, l1) OVER a) AS f1, {plane('value', 'l1', 'l2', 'b')} AS f2 "
    f"FROM lagged2 WINDOW a AS (PARTITION BY series ORDER BY t ROWS BETWEEN {L} PRECEDING AND 1 PRECEDING), b AS (PARTITION BY series ORDER BY t ROWS BETWEEN {L - 1} PRECEDING AND 1 PRECEDING)) "
    "SELECT f.origin, f.t, f.series, p_opt, round(CASE WHEN p_opt = 1 THEN f1 ELSE f2 END, 6) + 0.0 AS f FROM finals f JOIN best ON best.origin = f.origin",
)
def rolling_ar1_lag_select(spark, d):
    y = assets(spark, d)
    return forecast_sql.lag_selected(y, L, V, size(y)).withColumn("f", rounded("f"))


HISTORY = f"WITH {PANEL}, {AR1}, h AS (SELECT a.t, a.series, abs(b.l1 - a.l1) AS d, b.t AS u, b.value AS y FROM lagged a JOIN lagged b ON a.series = b.series AND b.t BETWEEN a.t - {L} AND a.t - 1 WHERE a.t > {L})"


@query("knn_forecast", HISTORY + ", r AS (SELECT *, row_number() OVER (PARTITION BY t, series ORDER BY d, u) AS n FROM h) SELECT t, series, round(sum(y) / 5, 6) + 0.0 AS f FROM r WHERE n <= 5 GROUP BY 1, 2")
def knn_forecast(spark, d):
    return forecast_sql.nearest(assets(spark, d), L, 5).withColumn("f", rounded("f"))


@query("radius_forecast", HISTORY + " SELECT t, series, round(avg(CASE WHEN d <= 0.005 THEN y END), 6) + 0.0 AS f FROM h GROUP BY 1, 2")
def radius_forecast(spark, d):
    return forecast_sql.within(assets(spark, d), L, 0.005).withColumn("f", rounded("f"))


@query("dummy_forecast", f"WITH {PANEL}, m AS (SELECT t, series, avg(value) OVER (PARTITION BY series ORDER BY t ROWS BETWEEN {L} PRECEDING AND 1 PRECEDING) AS f FROM panel) SELECT t, series, round(f, 6) + 0.0 AS f FROM m WHERE t > {L}")
def dummy_forecast(spark, d):
    return forecast_sql.mean(assets(spark, d), L).withColumn("f", rounded("f"))


# Backtest


def ar1_forecasts(spark, d):
    y = assets(spark, d)
    return forecast_sql.ar1(y, L), y


BACK = f"WITH {PANEL}, {AR1}"


def held_sql(kind: str, sign: int = 1, cutoff: int = 0) -> str:
    if kind == "naive":
        raw = "raw AS (SELECT t, series, sign(f) AS raw FROM fc)"
    elif kind == "weighted":
        raw = "raw AS (SELECT t, series, f AS raw FROM fc)"
    else:
        raw = f"ranked AS (SELECT t, series, f, row_number() OVER (PARTITION BY t ORDER BY abs(f) DESC, series) AS k FROM fc), edge AS (SELECT t, max(CASE WHEN k = {cutoff + 1} THEN abs(f) END) AS e FROM ranked GROUP BY t), raw AS (SELECT r.t, r.series, CASE WHEN abs(f) > e THEN sign(f) ELSE 0.0 END AS raw FROM ranked r JOIN edge ON edge.t = r.t)"
    return raw + f", held AS (SELECT t, series, {sign} * raw / CASE WHEN sum(abs(raw)) OVER (PARTITION BY t) = 0 THEN 1.0 ELSE sum(abs(raw)) OVER (PARTITION BY t) END AS position FROM raw)"


def positions_query(name: str, strategy: backtest.Strategy, sql: str):
    @query(name, f"{BACK}, {sql} SELECT t, series, round(position, 6) + 0.0 AS position FROM held")
    def run(spark, d):
        return backtest.positions(ar1_forecasts(spark, d)[0], strategy, len(NAMES)).withColumn("position", rounded("position"))


for _name, _strategy, _sql in (
    ("positions_naive", backtest.Strategy("naive", "naive"), held_sql("naive")),
    ("positions_weighted", backtest.Strategy("weighted", "weighted"), held_sql("weighted")),
    ("positions_top25", backtest.Strategy("top_25", "top", 0.25), held_sql("top", 1, 3)),
    ("positions_top50", backtest.Strategy("top_50", "top", 0.5), held_sql("top", 1, 2)),
    ("positions_top75", backtest.Strategy("top_75", "top", 0.75), held_sql("top", 1, 1)),
    ("positions_contrarian", backtest.Strategy("contrarian", "weighted", contrarian=True), held_sql("weighted", -1)),
):
    positions_query(_name, _strategy, _sql)

WEIGHTED = backtest.Strategy("weighted", "weighted")
DAILY = f"{BACK}, {held_sql('weighted')}, port AS (SELECT h.t, coalesce(sum(position * (exp(value) - 1)), 0.0) AS daily, sum(position) AS net_position FROM held h LEFT JOIN panel p ON p.t = h.t AND p.series = h.series GROUP BY h.t), bench AS (SELECT t, exp(value) - 1 AS b FROM panel WHERE series = '{BENCHMARK}')"
BETA = "regr_slope(daily, b) OVER w"
HEDGED = f", both_ AS (SELECT p.t, daily, net_position, b FROM port p LEFT JOIN bench ON bench.t = p.t), betas AS (SELECT *, CASE WHEN count(*) OVER w = 63 AND regr_sxx(daily, b) OVER w > 0 THEN {BETA} ELSE 0.0 END AS beta FROM both_ WINDOW w AS (ORDER BY t ROWS BETWEEN 62 PRECEDING AND CURRENT ROW))"


def shown(result: DataFrame, cumulative: int = 4) -> DataFrame:
    return result.select("t", rounded("daily").alias("daily"), rounded("net_position").alias("net_position"), rounded("cumulative", cumulative).alias("cumulative"))


def cumulative_sql(daily: str, source: str) -> str:
    return f" SELECT t, round({daily}, 6) + 0.0 AS daily, round(net_position, 6) + 0.0 AS net_position, round(product(1 + {daily}) OVER (ORDER BY t) - 1, 4) + 0.0 AS cumulative FROM {source}"


@query("simple_returns", f"WITH {PANEL} SELECT t, series, round(exp(value) - 1, 6) + 0.0 AS value FROM panel")
def simple_returns(spark, d):
    return backtest.simple_returns(assets(spark, d)).select("t", "series", rounded("value").alias("value"))


@query("pnl_daily", DAILY + " SELECT t, round(daily, 6) + 0.0 AS daily, round(net_position, 6) + 0.0 AS net_position FROM port")
def pnl_daily(spark, d):
    f, y = ar1_forecasts(spark, d)
    out = backtest.portfolio(backtest.positions(f, WEIGHTED, len(NAMES)), y)
    return out.select("t", rounded("daily").alias("daily"), rounded("net_position").alias("net_position"))


@query("pnl_cumulative", DAILY + cumulative_sql("daily", "port"))
def pnl_cumulative(spark, d):
    f, y = ar1_forecasts(spark, d)
    return shown(backtest.pnl(f, y, WEIGHTED, len(NAMES)))


@query("pnl_market_adjusted", DAILY + HEDGED + cumulative_sql("(daily - net_position * b)", "both_"))
def pnl_market_adjusted(spark, d):
    f, y = ar1_forecasts(spark, d)
    return shown(backtest.pnl(f, y, WEIGHTED, len(NAMES), benchmark=BENCHMARK))


@query("pnl_beta_neutral", DAILY + HEDGED + cumulative_sql("(daily - net_position * coalesce(beta * b, 0.0))", "betas"))
def pnl_beta_neutral(spark, d):
    f, y = ar1_forecasts(spark, d)
    return shown(backtest.pnl(f, y, WEIGHTED, len(NAMES), benchmark=BENCHMARK, beta_neutral=True))


@query("rolling_beta", DAILY + HEDGED + " SELECT t, round(beta, 4) + 0.0 AS beta FROM betas")
def rolling_beta(spark, d):
    f, y = ar1_forecasts(spark, d)
    daily = backtest.portfolio(backtest.positions(f, WEIGHTED, len(NAMES)), y)
    bench = y.filter(F.col("series") == BENCHMARK).select("t", (F.exp("value") - 1).alias("b"))
    return backtest.rolling_beta(daily.join(bench, "t", "left").withColumn("p", F.col("daily")), 63).select("t", rounded("beta", 4).alias("beta"))


@query("buy_and_hold", f"WITH {PANEL} SELECT t, round(exp(value) - 1, 6) + 0.0 AS daily, 1.0::DOUBLE AS net_position, round(exp(sum(value) OVER (ORDER BY t)) - 1, 4) + 0.0 AS cumulative FROM panel WHERE series = '{BENCHMARK}' AND t > {L}")
def buy_and_hold(spark, d):
    y = assets(spark, d)
    return shown(backtest.buy_and_hold(y.filter((F.col("series") == BENCHMARK) & (F.col("t") > L))))


def sweep_sql() -> str:
    parts = [("naive", held_sql("naive")), ("weighted", held_sql("weighted")), ("top_50", held_sql("top", 1, 2)), ("top_25", held_sql("top", 1, 3)), ("top_75", held_sql("top", 1, 1))]
    out = []
    for name, sql in parts:
        for c in ("ranked", "edge", "raw", "held"):
            sql = sql.replace(f"{c} AS (", f"{c}_{name} AS (").replace(f"FROM {c}", f"FROM {c}_{name}").replace(f"JOIN {c} ", f"JOIN {c}_{name} {c} ")
        out.append(sql)
    union = " UNION ALL ".join(f"SELECT '{n}' AS strategy, * FROM held_{n}" for n, _ in parts)
    return f"{BACK}, {', '.join(out)}, held AS ({union}), port AS (SELECT h.strategy, h.t, coalesce(sum(position * (exp(value) - 1)), 0.0) AS daily, sum(position) AS net_position FROM held h LEFT JOIN panel p ON p.t = h.t AND p.series = h.series GROUP BY 1, 2), results AS (SELECT *, product(1 + daily) OVER (PARTITION BY strategy ORDER BY t) - 1 AS cumulative FROM port)"


SWEEP = sweep_sql()
METRICS = SWEEP + ", metrics AS (SELECT strategy, (pow(1 + arg_max(cumulative, t), 252.0 / count(*)) - 1) * 100 AS a, avg(daily) * 252 / nullif(stddev_samp(daily) * sqrt(252.0), 0) AS s, arg_max(cumulative, t) AS r FROM results GROUP BY 1)"
METRIC_COLUMNS = "strategy, round(a, 4) + 0.0 AS annualized_return_pct, round(s, 4) + 0.0 AS sharpe_ratio, round(r, 4) + 0.0 AS total_return"


def swept(spark, d):
    f, y = ar1_forecasts(spark, d)
    return backtest.sweep(f, y, len(NAMES))


def metric_columns(table: DataFrame) -> DataFrame:
    return table.select("strategy", *[rounded(c, 4).alias(c) for c in ("annualized_return_pct", "sharpe_ratio", "total_return")])


@query("strategy_sweep", SWEEP + " SELECT strategy, t, round(daily, 6) + 0.0 AS daily, round(net_position, 6) + 0.0 AS net_position, round(cumulative, 4) + 0.0 AS cumulative FROM results")
def strategy_sweep(spark, d):
    out = swept(spark, d)
    return out.select("strategy", "t", rounded("daily").alias("daily"), rounded("net_position").alias("net_position"), rounded("cumulative", 4).alias("cumulative"))


@query("performance_metrics", METRICS + f" SELECT {METRIC_COLUMNS} FROM metrics")
def performance_metrics(spark, d):
    return metric_columns(backtest.performance(swept(spark, d)))


@query("performance_csv_sink", METRICS + f" SELECT {METRIC_COLUMNS} FROM metrics")
def performance_csv_sink(spark, d):
    """The performance table as it comes back from its CSV."""
    table, folder = backtest.performance(swept(spark, d)), sinks.scratch(spark, "csv")
    sinks.save_performance(table, folder)
    return metric_columns(spark.read.schema(table.schema).csv(f"{folder}/performance", header=True))


@query("best_strategy", METRICS + f" SELECT {METRIC_COLUMNS} FROM metrics WHERE s IS NOT NULL ORDER BY s DESC, strategy LIMIT 1")
def best_strategy(spark, d):
    return metric_columns(backtest.best_strategy(backtest.performance(swept(spark, d))))


@query("lag_summary", f"WITH {PANEL}, {FOLDS} SELECT round(avg(p_opt), 6) + 0.0 AS mean_p, min(p_opt) AS min_p, max(p_opt) AS max_p FROM best")
def lag_summary(spark, d):
    out = backtest.lag_summary(forecast_sql.best_lag(errors_of(spark, d)))
    return out.select(rounded("mean_p").alias("mean_p"), "min_p", "max_p")


# Inference and data quality


@query(
    "coef_mapping",
    "WITH pre(j, name) AS (VALUES (0, 'a_lag1'), (1, 'b_lag1')), post(j, name) AS (VALUES (0, 'a_lag1'), (1, 'b_lag1'), (2, 'a_lag2'), (3, 'b_lag2')) "
    "SELECT CAST(o AS INTEGER) AS outcome, post.name, CAST(o * 2 + pre.j AS INTEGER) AS before_index, CAST(o * 4 + post.j AS INTEGER) AS after_index FROM post LEFT JOIN pre ON pre.name = post.name, range(2) r(o)",
)
def coef_mapping(spark, d):
    pre = spark.createDataFrame([(0, "a_lag1"), (1, "b_lag1")], "j int, name string")
    post = spark.createDataFrame([(0, "a_lag1"), (1, "b_lag1"), (2, "a_lag2"), (3, "b_lag2")], "j int, name string")
    out = inference.match_coefficients(pre, post, 2)
    return out.select("outcome", "name", F.col("before_index").cast("int").alias("before_index"), F.col("after_index").cast("int").alias("after_index"))


@query(
    "bh_adjust_min",
    "WITH p AS (SELECT p_size, p_partkey, ((p_partkey * 7919) % 9973 + 0.5) / 9973 AS p FROM part), r AS (SELECT p_size, CAST(p AS DOUBLE) * count(*) OVER (PARTITION BY p_size) / row_number() OVER (PARTITION BY p_size ORDER BY p, p_partkey) AS a FROM p) "
    "SELECT p_size, round(least(min(a), 1.0), 6) + 0.0 AS p_min FROM r GROUP BY 1",
)
def bh_adjust_min(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet").select("p_size", "p_partkey", (((F.col("p_partkey") * 7919) % 9973 + F.lit(0.5)) / 9973).alias("p"))
    return inference.least_adjusted(p, "p_size", "p", "p_partkey").select("p_size", rounded("p_min").alias("p_min"))


@query(
    "data_quality_report",
    f"WITH {PANEL}, {SHIPPED}, every AS (SELECT 'assets' AS panel_name, date, series, value FROM panel UNION ALL SELECT 'confounders', date, series, value FROM ship) "
    "SELECT panel_name, count(DISTINCT date) AS n_rows, count(DISTINCT series) AS n_series, min(date) AS first_date, max(date) AS last_date, count(*) FILTER (value IS NULL) AS n_missing FROM every GROUP BY 1",
)
def data_quality_report(spark, d):
    a, c = panel.quality(assets(spark, d)), panel.quality(tables.ship_confounders(spark, d))
    return a.select(F.lit("assets").alias("panel_name"), "*").unionByName(c.select(F.lit("confounders").alias("panel_name"), "*"))


# Multi-series models, fitted in Python workers


def models_sql(exogenous: bool = False) -> str:
    """Plain VAR(X) by normal equations: sums over a window are differences of running sums, and Gauss-Jordan steps solve them.

    Regressors are scaled for the sake of the sums alone; one that depends on those before it gets the weight 0. Ends in
    fits (d, p, s: -1 for the final fit, hi, series, value, guess), errors and best.
    """
    units = "SELECT t, 0 AS side, series, value / stddev_pop(value) OVER (PARTITION BY series) AS z FROM panel"
    if exogenous:
        units += " UNION ALL SELECT p.t, 1, f.series, (f.value - avg(f.value) OVER (PARTITION BY f.series)) / stddev_pop(f.value) OVER (PARTITION BY f.series) FROM filled f JOIN (SELECT DISTINCT t, date FROM panel) p ON p.date = f.date"
    return f"""WITH RECURSIVE {PANEL}{', ' + FILLED if exogenous else ''},
units AS ({units}),
target AS (SELECT t, series, value, row_number() OVER (PARTITION BY t ORDER BY series) AS o FROM panel),
orders_ AS (SELECT CAST(unnest(range(1, {P_MAX + 1})) AS INTEGER) AS p),
terms AS (SELECT p, u.t + k AS t, k, side, series, z FROM units u, range(1, {P_MAX + 1}) r(k), orders_ WHERE k <= p UNION ALL SELECT p, t, 0, 0, '', 1.0 FROM (SELECT DISTINCT t FROM panel), orders_),
x AS (SELECT p, t, row_number() OVER (PARTITION BY p, t ORDER BY k, side, series) AS i, z FROM terms, size WHERE t >= p AND t < n),
width AS (SELECT p, max(i) AS k FROM x GROUP BY p),
joint AS (SELECT p, t, i AS j, z FROM x UNION ALL SELECT w.p, y.t, w.k + o, y.value FROM target y, width w WHERE y.t >= w.p),
upto AS (SELECT a.p, a.t, a.i, b.j, sum(a.z * b.z) OVER (PARTITION BY a.p, a.i, b.j ORDER BY a.t) AS s FROM x a JOIN joint b ON a.p = b.p AND a.t = b.t),
origins AS (SELECT CAST(unnest(range({L}, n - 1)) AS INTEGER) AS d FROM size),
job AS (SELECT d, p, CAST(s AS INTEGER) AS s, d - {L} + s AS lo, d - {V} + 1 + s AS hi FROM origins, orders_, range({V}) r(s) UNION ALL SELECT d, p, -1, d - {L}, d + 1 FROM origins, orders_),
cells_of AS (SELECT j.d, j.p, j.s, j.hi, u.i, u.j, u.s - coalesce(v.s, 0.0) AS a FROM job j JOIN upto u ON u.p = j.p AND u.t = j.hi - 1 LEFT JOIN upto v ON v.p = j.p AND v.i = u.i AND v.j = u.j AND v.t = j.lo + j.p - 1),
rows_of AS (SELECT d, p, s, hi, i, list(a ORDER BY j) AS r FROM cells_of GROUP BY ALL),
solve AS (
  SELECT d, p, s, hi, 1 AS step, CAST(count(*) AS INTEGER) AS k, list(r ORDER BY i) AS m FROM rows_of GROUP BY d, p, s, hi
  UNION ALL
  SELECT d, p, s, hi, step + 1, k, CASE WHEN m[step][step] > 1e-9
    THEN list_transform(m, lambda r, i: CASE WHEN i = step THEN list_transform(r, lambda v: v / m[step][step]) ELSE list_transform(r, lambda v, j: v - r[step] * m[step][j] / m[step][step]) END)
    ELSE list_transform(m, lambda r, i: list_transform(r, lambda v, j: CASE WHEN i = step OR j = step THEN 0.0 ELSE v END)) END
  FROM solve WHERE step <= k
),
at_ AS (SELECT p, t, list(z ORDER BY i) AS x FROM x GROUP BY p, t),
fits AS (SELECT f.d, f.p, f.s, f.hi, y.series, y.value, list_dot_product(a.x, list_transform(f.m, lambda r: r[f.k + y.o])) AS guess FROM solve f JOIN at_ a ON a.p = f.p AND a.t = f.hi JOIN target y ON y.t = f.hi WHERE f.step = f.k + 1),
errors AS (SELECT d AS origin, p, s AS shift, sqrt(avg(pow(value - guess, 2))) AS err FROM fits WHERE s >= 0 GROUP BY 1, 2, 3),
best AS (SELECT origin, arg_min(p, (err, p)) AS p_opt, min(err) AS valid_err FROM (SELECT origin, p, avg(err) AS err FROM errors GROUP BY 1, 2) GROUP BY 1)"""


FINAL = " SELECT CAST(d AS INTEGER) AS origin, CAST(hi AS INTEGER) AS t, series, round(guess, 6) + 0.0 AS f FROM fits JOIN best ON origin = d AND p_opt = p WHERE s = -1"
#: The panel's values are of the order of 0.001, so that penalties that matter are small.
ALPHAS = tuple(a * 1e-4 for a in rolling.ALPHAS)


def named(forecasts: DataFrame) -> DataFrame:
    return rolling.long_forecast(forecasts, NAMES).withColumn("f", rounded("f"))


@query("var_ols", models_sql() + FINAL)
def var_ols(spark, d):
    return named(rolling.var(assets(spark, d), None, SPEC, P_MAX))


@query("var_fold_errors", models_sql() + " SELECT origin, p, CAST(NULL AS DOUBLE) AS alpha, 0 AS place, shift, round(err, 6) + 0.0 AS err FROM errors")
def var_fold_errors(spark, d):
    return rolling.var_errors(assets(spark, d), None, SPEC, P_MAX).withColumn("err", rounded("err"))


@query("var_best_lag", models_sql() + " SELECT origin, p_opt, CAST(NULL AS DOUBLE) AS alpha_opt, round(valid_err, 6) + 0.0 AS valid_err FROM best")
def var_best_lag(spark, d):
    return rolling.best(rolling.var_errors(assets(spark, d), None, SPEC, P_MAX)).withColumn("valid_err", rounded("valid_err"))


@query("varx_ols", models_sql(True) + FINAL)
def varx_ols(spark, d):
    return named(rolling.var(*aligned(spark, d), SPEC, P_MAX))


@query("var_lasso")
def var_lasso(spark, d):
    return named(rolling.var(assets(spark, d), None, SPEC, P_MAX, "lasso", ALPHAS))


@query("or_var_ols")
def or_var_ols(spark, d):
    return named(rolling.or_var(*aligned(spark, d), SPEC, P_MAX, "ols", "ols"))


@query("or_var_ols_same_day")
def or_var_ols_same_day(spark, d):
    return named(rolling.or_var(*aligned(spark, d), windows.WindowSpec(L, V, 0), P_MAX, "ols", "ols"))


@query("or_var_trees")
def or_var_trees(spark, d):
    return named(rolling.or_var(*aligned(spark, d), SPEC, P_MAX, "extra_trees", "random_forest"))


@query("oracle_var_ols")
def oracle_var_ols(spark, d):
    return rolling.oracle_var(*aligned(spark, d), lookback=L, p_max=4, significance=0.15, model_y="ols", model_t="ols")


def dml_sql(folds: int = 5) -> str:
    """Linear double machine learning at each origin, one lag: nuisance fits by normal equations over the rows before each test block, final stage and HC1 errors from the residuals.

    Five outcomes (1-5) and five treatments (6-10 of yt); the steps of Gauss-Jordan elimination are those of models_sql.
    """
    h = L // (folds + 1)
    gauss = lambda m: f"CASE WHEN {m}[step][step] > 1e-9 THEN list_transform({m}, lambda r, i: CASE WHEN i = step THEN list_transform(r, lambda v: v / {m}[step][step]) ELSE list_transform(r, lambda v, j: v - r[step] * {m}[step][j] / {m}[step][step]) END) ELSE list_transform({m}, lambda r, i: list_transform(r, lambda v, j: CASE WHEN i = step OR j = step THEN 0.0 ELSE v END)) END"
    return f"""WITH RECURSIVE {PANEL}, {FILLED},
c AS (SELECT p.t, f.series, (f.value - avg(f.value) OVER (PARTITION BY f.series)) / stddev_pop(f.value) OVER (PARTITION BY f.series) AS z FROM filled f JOIN (SELECT DISTINCT t, date FROM panel) p ON p.date = f.date),
x AS (SELECT t, row_number() OVER (PARTITION BY t ORDER BY series) AS i, z FROM (SELECT t + 1 AS t, series, z FROM c UNION ALL SELECT t, '', 1.0 FROM (SELECT DISTINCT t FROM panel)), size WHERE t >= 1 AND t < n),
yt AS (SELECT t, row_number() OVER (PARTITION BY t ORDER BY side, series) AS o, v FROM (SELECT t, 0 AS side, series, value * 100 AS v FROM panel UNION ALL SELECT t + 1, 1, series, value * 100 FROM panel), size WHERE t >= 1 AND t < n),
joint AS (SELECT t, i AS j, z FROM x UNION ALL SELECT t, 4 + o, v FROM yt),
upto AS (SELECT a.t, a.i, b.j, sum(a.z * b.z) OVER (PARTITION BY a.i, b.j ORDER BY a.t) AS s FROM x a JOIN joint b ON a.t = b.t),
job AS (SELECT CAST(d AS INTEGER) AS d, CAST(k AS INTEGER) AS k, d - {L} + 1 AS lo, d - {L} + 1 + {L} - ({folds} - k) * {h} AS mid FROM (SELECT unnest(range({L}, n - 1)) AS d FROM size), range({folds}) r(k)),
entry AS (SELECT j.d, j.k, j.mid, u.i, u.j, u.s - coalesce(v.s, 0.0) AS a FROM job j JOIN upto u ON u.t = j.mid - 1 LEFT JOIN upto v ON v.i = u.i AND v.j = u.j AND v.t = j.lo - 1),
line AS (SELECT d, k, mid, i, list(a ORDER BY j) AS r FROM entry GROUP BY ALL),
nuisance AS (SELECT d, k, mid, 1 AS step, list(r ORDER BY i) AS m FROM line GROUP BY d, k, mid UNION ALL SELECT d, k, mid, step + 1, {gauss('m')} FROM nuisance WHERE step <= 4),
at_x AS (SELECT t, list(z ORDER BY i) AS x FROM x GROUP BY t),
at_y AS (SELECT t, list(v ORDER BY o) AS v FROM yt GROUP BY t),
residual AS (SELECT n.d, a.t, list_transform(y.v, lambda v, o: v - list_dot_product(a.x, list_transform(n.m, lambda r: r[4 + o]))) AS e FROM nuisance n JOIN at_x a ON a.t >= n.mid AND a.t < n.mid + {h} JOIN at_y y ON y.t = a.t WHERE n.step = 5),
each AS (SELECT d, t, CAST(o AS INTEGER) AS o, e[o] AS e FROM residual, range(1, 11) r(o)),
cross_ AS (SELECT a.d, a.o - 5 AS i, CASE WHEN b.o > 5 THEN b.o - 5 ELSE b.o + 5 END AS j, sum(a.e * b.e) AS s FROM each a JOIN each b ON a.d = b.d AND a.t = b.t WHERE a.o > 5 GROUP BY 1, 2, 3),
wide AS (SELECT d, i, list_concat(list(s ORDER BY j), list_transform(range(1, 6), lambda c: CASE WHEN c = i THEN 1.0 ELSE 0.0 END)) AS r FROM cross_ GROUP BY d, i),
final AS (SELECT d, 1 AS step, list(r ORDER BY i) AS m FROM wide GROUP BY d UNION ALL SELECT d, step + 1, {gauss('m')} FROM final WHERE step <= 5),
fit AS (SELECT d, CAST(o AS INTEGER) AS outcome, CAST(i AS INTEGER) AS treatment, m, m[i][5 + o] AS theta FROM final, range(1, 6) a(o), range(1, 6) b(i) WHERE step = 6),
error AS (SELECT f.d, f.outcome, f.treatment, f.theta, pow(list_dot_product(r.e[6:10], f.m[f.treatment][11:15]) * (r.e[f.outcome] - list_dot_product(r.e[6:10], list_transform(f.m, lambda q: q[5 + f.outcome]))), 2) AS v FROM fit f JOIN residual r ON r.d = f.d)
SELECT d AS origin, outcome, treatment, round(any_value(theta), 4) + 0.0 AS theta, round(sqrt(sum(v) * count(*) / (count(*) - 5)), 4) + 0.0 AS stderr FROM error GROUP BY 1, 2, 3"""


@query("dml_coefficients", dml_sql())
def dml_coefficients(spark, d):
    return rolling.dml_coefficients(*aligned(spark, d), lookback=L).withColumns({c: rounded(c, 4) for c in ("theta", "stderr")})


@query("oracle_var_trees")
def oracle_var_trees(spark, d):
    """Significance-tested lags with the default nuisance models."""
    return rolling.oracle_var(*aligned(spark, d), lookback=L, p_max=P_MAX)


@query("oracle_var_legacy")
def oracle_var_legacy(spark, d):
    """The sequential variant with an estimator of the older factory."""
    lasso = {"alpha": 1e-6}
    return rolling.oracle_var(*aligned(spark, d), lookback=L, p_max=P_MAX, significance=0.15, model_y="lasso", model_t="lasso", y_params=lasso, t_params=lasso, profile="legacy")


@query("oracle_var_lag_mask")
def oracle_var_lag_mask(spark, d):
    return rolling.lag_mask(oracle_var_ols(spark, d), 4)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Monthly spend by priority, AR(1) rolling forecasts, weighted long/short, performance."""
    y = tables.spend_panel(spark, d, "month")
    return backtest.performance(backtest.pnl(forecast_sql.ar1(y, 24), y, WEIGHTED, len(NAMES)))
