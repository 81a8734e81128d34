"""DuckDB SQL twins of the registered queries, written independently of the Spark plans."""

from __future__ import annotations

import re

from pricetide.config import FEATURES

ROUNDING_SHIFT = 0.0137

ORACLE: dict[str, str] = {}

TRAIN_END, VAL_END, SEED = "DATE '2000-01-10'", "DATE '2000-04-10'", 42
MULTIPLIERS = [0.9, 0.95, 1.0, 1.05, 1.1]
TREND, LAGS, ROLLING = FEATURES[2:6], FEATURES[6:10], FEATURES[10:14]


def tx(product: str = "supplier") -> str:
    code = {"supplier": "l_suppkey", "part": "l_partkey", "brand": "p_brand"}[product]
    source = "lineitem JOIN part ON l_partkey = p_partkey" if product == "brand" else "lineitem"
    return f"""tx AS (
  SELECT CAST(l_shipdate AS DATE) AS d, CAST({code} AS VARCHAR) AS p,
         CAST(year(l_shipdate) * 100 + weekofyear(l_shipdate) AS INTEGER) AS wk,
         l_extendedprice AS spend, CAST(l_quantity AS BIGINT) AS qty
  FROM {source})"""


def daily(product: str = "supplier") -> str:
    return tx(product) + """, daily AS (
  SELECT d, p, avg(spend / qty) AS avg_price, CAST(sum(qty) AS BIGINT) AS units, sum(spend) AS sales, min(wk) AS wk
  FROM tx GROUP BY d, p)"""


def select_daily(source: str = "daily") -> str:
    return f"""SELECT d AS "SHOP_DATE", p AS "PROD_CODE", round(avg_price, 6) AS avg_price, units AS total_units,
  round(sales, 2) AS total_sales, wk AS "SHOP_WEEK" FROM {source}"""


# --- transactions and panel

ORACLE["load_transactions"] = f"""WITH {tx()} SELECT d AS "SHOP_DATE", wk AS "SHOP_WEEK", p AS "PROD_CODE",
  spend AS "SPEND", qty AS "QUANTITY" FROM tx"""

ORACLE["line_prices"] = f"""WITH {tx('part')} SELECT p AS "PROD_CODE", d AS "SHOP_DATE", qty AS "QUANTITY",
  round(spend / qty, 6) AS "PRICE" FROM tx"""

ORACLE["daily_panel"] = f"WITH {daily()} {select_daily()}"
ORACLE["daily_panel_by_part"] = f"WITH {daily('part')} {select_daily()}"
ORACLE["daily_panel_by_brand"] = f"WITH {daily('brand')} {select_daily()}"

PERIODS = {
    "day": "date_diff('day', DATE '1970-01-01', d)",
    "week": "date_diff('day', DATE '1969-12-29', date_trunc('week', d)) // 7",
    "month": "date_diff('month', DATE '1970-01-01', date_trunc('month', d))",
}


def completeness(product: str, grain: str) -> str:
    return daily(product) + f""", complete AS (
  SELECT p, min(d) AS min_date, max(d) AS max_date, count(DISTINCT {PERIODS[grain]}) AS unique_periods,
         max({PERIODS[grain]}) - min({PERIODS[grain]}) + 1 - count(DISTINCT {PERIODS[grain]}) AS missing_periods,
         sum(sales) AS sales
  FROM daily GROUP BY p)"""


def select_completeness(product: str, grain: str) -> str:
    return f"""WITH {completeness(product, grain)} SELECT p AS "PROD_CODE", min_date, max_date,
  CAST(unique_periods AS BIGINT) AS unique_periods, CAST(missing_periods AS BIGINT) AS missing_periods FROM complete"""


ORACLE["date_completeness"] = select_completeness("supplier", "day")
ORACLE["date_completeness_by_week"] = select_completeness("brand", "week")
ORACLE["date_completeness_by_month"] = select_completeness("supplier", "month")

ORACLE["product_sales"] = f"""WITH {completeness('supplier', 'month')} SELECT p AS "PROD_CODE",
  round(sales, 2) AS total_sales FROM complete WHERE missing_periods = 0"""


def top(product: str, grain: str, n: int) -> str:
    return completeness(product, grain) + f""", best AS (
  SELECT CAST(row_number() OVER (ORDER BY round(sales, 2) DESC, p) AS INTEGER) AS rank, p, round(sales, 2) AS sales
  FROM complete WHERE missing_periods = 0), top AS (SELECT * FROM best WHERE rank <= {n})"""


SELECT_TOP = 'SELECT rank, p AS "PROD_CODE", sales AS total_sales FROM top'
ORACLE["top_products"] = f"WITH {top('supplier', 'month', 100)} {SELECT_TOP}"
ORACLE["top_brands"] = f"WITH {top('brand', 'week', 10)} {SELECT_TOP}"
ORACLE["top_product_panel"] = f"""WITH {top('supplier', 'month', 20)}
{select_daily('daily WHERE p IN (SELECT p FROM top)')}"""
ORACLE["first_products"] = f"""WITH {tx()} SELECT DISTINCT p AS "PROD_CODE" FROM tx ORDER BY 1 LIMIT 5"""

# --- features

CALENDAR = """CAST(isodow(d) AS INTEGER) AS day_of_week, CAST(month(d) AS INTEGER) AS month,
  CAST(year(d) AS INTEGER) AS year, CAST(day(d) AS INTEGER) AS day_of_month,
  CAST(weekofyear(d) AS INTEGER) AS week_of_year, isodow(d) IN (6, 7) AS is_weekend,
  sin(2 * pi() * isodow(d) / 7) AS day_of_week_sin, cos(2 * pi() * isodow(d) / 7) AS day_of_week_cos,
  sin(2 * pi() * month(d) / 12) AS month_sin, cos(2 * pi() * month(d) / 12) AS month_cos"""


def features(source: str = "daily") -> str:
    lags = ", ".join(f"lag(units, {n}) OVER w AS lag_{n}_units" for n in (1, 7, 14, 28))
    rolling = ", ".join(
        f"CASE WHEN count(units) OVER f{n} = {n} THEN {f}(units) OVER f{n} END AS rolling_{name}_{n}_units"
        for n in (7, 28) for name, f in (("mean", "avg"), ("std", "stddev_samp")))
    return f"""feat AS (
  SELECT d, p, avg_price, units AS total_units, sales AS total_sales, wk, {CALENDAR}, {lags}, {rolling},
    avg_price / (lag(avg_price) OVER w + 1e-6) - 1 AS price_change_pct,
    CAST(row_number() OVER w AS INTEGER) AS days_since_price_change,
    (avg_price - min(avg_price) OVER h) / (max(avg_price) OVER h - min(avg_price) OVER h + 1e-6) AS price_position
  FROM {source}
  WINDOW h AS (PARTITION BY p), w AS (PARTITION BY p ORDER BY d),
    f7 AS (PARTITION BY p ORDER BY d ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
    f28 AS (PARTITION BY p ORDER BY d ROWS BETWEEN 27 PRECEDING AND CURRENT ROW))"""


def split_features(source: str = "daily") -> str:
    return features(source) + f""", parts AS MATERIALIZED (
  SELECT *, CASE WHEN d <= {TRAIN_END} THEN 'train' WHEN d <= {VAL_END} THEN 'val' ELSE 'test' END AS split FROM feat)"""


def rounds(columns, places: int) -> str:
    return ", ".join(f"round({c}, {places}) AS {c}" for c in columns)


ORACLE["calendar_features"] = f"""WITH {tx()}, c AS (SELECT d, {CALENDAR} FROM (SELECT DISTINCT d FROM tx))
SELECT d AS "SHOP_DATE", day_of_week, month, year, day_of_month, week_of_year, is_weekend,
  {rounds(TREND, 6)} FROM c"""
ORACLE["lag_features"] = f"""WITH {daily()}, {features()}
SELECT d AS "SHOP_DATE", p AS "PROD_CODE", total_units, {', '.join(LAGS)} FROM feat"""
ORACLE["rolling_features"] = f"""WITH {daily()}, {features()}
SELECT d AS "SHOP_DATE", p AS "PROD_CODE", total_units, {rounds(ROLLING, 6)} FROM feat"""
ORACLE["price_features"] = f"""WITH {daily()}, {features()}
SELECT d AS "SHOP_DATE", p AS "PROD_CODE", {rounds(['price_change_pct', 'price_position'], 6)} FROM feat"""
ORACLE["row_index"] = f"""WITH {daily()}, {features()}
SELECT d AS "SHOP_DATE", p AS "PROD_CODE", days_since_price_change AS row_index, days_since_price_change FROM feat"""


def feature_output(product: str) -> str:
    return f"""WITH {daily(product)}, {features()}
SELECT d AS "SHOP_DATE", p AS "PROD_CODE", total_units, wk AS "SHOP_WEEK", day_of_week, month, year,
  round(avg_price, 6) AS avg_price, round(total_sales, 2) AS total_sales, {rounds(TREND, 6)},
  {', '.join(LAGS)}, {rounds(ROLLING, 6)}, {rounds(['price_change_pct', 'price_position'], 6)},
  day_of_month, week_of_year, is_weekend, days_since_price_change FROM feat"""


ORACLE["feature_panel"] = feature_output("supplier")
ORACLE["feature_panel_by_brand"] = feature_output("brand")
ORACLE["feature_panel_in_blocks"] = ORACLE["feature_panel_by_brand"]

# --- splits and scaling

ORACLE["split_counts"] = f"""WITH {daily()}, {split_features()}
SELECT split, count(*) AS n_rows, min(d) AS first_date, max(d) AS last_date FROM parts GROUP BY split"""

NOT_NULL = " AND ".join(f"{c} IS NOT NULL" for c in FEATURES)
ORACLE["complete_feature_rows"] = f"""WITH {daily()}, {split_features()}
SELECT split, p AS product_id, count(*) AS n_rows FROM parts WHERE {NOT_NULL} GROUP BY split, p"""


def single(c: str) -> str:
    return f"CAST(CAST({c} AS FLOAT) AS DOUBLE)"


def scaler(kind: str) -> str:
    rows = []
    for c in FEATURES:
        v = single(c)
        center = f"avg({v})" if kind == "standard" else f"quantile_cont({v}, 0.5)"
        spread = f"stddev_pop({v})" if kind == "standard" else f"quantile_cont({v}, 0.75) - quantile_cont({v}, 0.25)"
        rows.append(f"""SELECT '{c}' AS "column", '{kind}' AS kind, {center} AS center,
          CASE WHEN {spread} = 0 THEN 1.0::DOUBLE ELSE {spread} END AS scale FROM parts WHERE split = 'train'""")
    return "stats AS MATERIALIZED (" + " UNION ALL ".join(rows) + ")"


for _kind in ("standard", "robust"):
    ORACLE[f"{_kind}_scaler_stats"] = f"""WITH {daily()}, {split_features()}, {scaler(_kind)}
SELECT "column", kind, round(center, 4) AS center, round(scale, 4) AS scale FROM stats"""


def wide_stats() -> str:
    """The standard scaler's statistics as one row: center and scale of each feature."""
    parts = [f"avg({single(c)}) AS center_{c}, CASE WHEN stddev_pop({single(c)}) = 0 THEN 1.0::DOUBLE "
             f"ELSE stddev_pop({single(c)}) END AS scale_{c}" for c in FEATURES]
    return f"wide AS MATERIALIZED (SELECT {', '.join(parts)} FROM parts WHERE split = 'train')"


def scaled_value(c: str) -> str:
    return f"CAST(CAST(({single(c)} - center_{c}) / scale_{c} AS FLOAT) AS DOUBLE)"


def scaled_output(source: str) -> str:
    """Scaled rows, made once; the outer select only rounds."""
    return f"""{split_features(source)}, {wide_stats()}, scaled AS MATERIALIZED (
  SELECT split, d, p, total_units, {', '.join(f'coalesce({scaled_value(c)}, 0.0) AS {c}' for c in FEATURES)} FROM parts, wide)
SELECT split, d AS "SHOP_DATE", p AS product_id, total_units, {rounds(FEATURES, 3)} FROM scaled"""


ORACLE["scaled_panel"] = f"WITH {daily()}, {scaled_output('daily')}"
ORACLE["scaled_panel_without_warmup"] = f"""WITH {daily()}, {split_features()}, {wide_stats()}
SELECT split, count(*) AS n_rows, {', '.join(f'round(avg({scaled_value(c)}), 3) AS {c}' for c in FEATURES)}
FROM parts, wide WHERE {NOT_NULL} GROUP BY split"""
ORACLE["prepared_top_products"] = f"""WITH {top('supplier', 'month', 20)}, kept AS (
  SELECT * FROM daily WHERE p IN (SELECT p FROM top)), {scaled_output('kept')}"""
ORACLE["unscaled_prices"] = f"""WITH {daily()} SELECT d AS "SHOP_DATE", p AS "PROD_CODE",
  round(avg_price, 5) AS avg_price FROM daily"""

# --- registry

ORACLE["product_registry"] = """SELECT p AS product_id, CAST(row_number() OVER (ORDER BY p) - 1 AS INTEGER) AS dense_id
FROM (SELECT DISTINCT CAST(l_partkey AS VARCHAR) AS p FROM lineitem)"""
ORACLE["dense_product_rows"] = f"""WITH {daily()} SELECT CAST(dense_rank() OVER (ORDER BY p) - 1 AS INTEGER) AS dense_id,
  count(*) AS n_days, CAST(sum(units) AS BIGINT) AS total_units FROM daily GROUP BY p"""
ORACLE["median_price"] = f"""WITH {daily()} SELECT p AS "PROD_CODE", round(median(avg_price), 6) AS median_price
FROM daily GROUP BY p"""
ORACLE["global_median_price"] = f"""WITH {daily()} SELECT round(median(avg_price), 6) AS median_price
FROM daily WHERE d <= {TRAIN_END}"""
ORACLE["sales_volatility"] = f"""WITH {daily()} SELECT p AS "PROD_CODE", round(stddev_samp(units), 6) AS sales_volatility
FROM daily GROUP BY p"""
ORACLE["avg_daily_revenue"] = f"""WITH {daily()} SELECT p AS "PROD_CODE",
  round(sum(sales) / count(DISTINCT d), 4) AS avg_daily_revenue FROM daily GROUP BY p"""
ORACLE["attached_constants"] = f"""WITH {daily('part')}, k AS (
  SELECT p, median(avg_price) AS m, stddev_samp(units) AS s FROM daily WHERE d <= {TRAIN_END} GROUP BY p)
SELECT d AS "SHOP_DATE", daily.p AS "PROD_CODE", round(coalesce(m, 0.0), 6) AS median_price,
  round(coalesce(s, 0.0), 6) AS sales_volatility
FROM daily LEFT JOIN k ON daily.p = k.p WHERE d > {VAL_END}"""

# --- demand

LINES = f"""slopes AS (
  SELECT p, CASE WHEN isfinite(regr_slope(units, avg_price)) THEN regr_slope(units, avg_price) END AS slope,
    CASE WHEN isfinite(regr_intercept(units, avg_price)) THEN regr_intercept(units, avg_price) END AS intercept,
    avg(units) AS mean_units
  FROM daily WHERE d <= {TRAIN_END} GROUP BY p)"""


def predicted(price: str) -> str:
    return f"coalesce(intercept + slope * ({price}), mean_units, 0.0)"


def sold(prediction: str) -> str:
    return f"CAST(round_even(greatest(0.0, {prediction}), 0) AS BIGINT)"


ORACLE["price_lines"] = f"""WITH {daily()}, {LINES} SELECT p AS product_id, round(slope, 8) AS slope,
  round(intercept, 4) AS intercept, round(mean_units, 6) AS mean_units FROM slopes"""

PREDICTIONS = f"""{daily()}, {LINES}, pred AS (
  SELECT daily.*, {predicted('avg_price')} AS prediction FROM daily LEFT JOIN slopes ON daily.p = slopes.p)"""
ORACLE["residual_noise"] = f"""WITH {PREDICTIONS} SELECT round(stddev_pop(units - prediction), 6) AS noise_std
FROM pred WHERE d > {TRAIN_END} AND d <= {VAL_END}"""
ORACLE["model_quality"] = f"""WITH {PREDICTIONS}
SELECT round(1 - sum((units - prediction) ** 2) / (count(*) * var_pop(units)), 6) AS r2,
  round(avg(abs(units - prediction)), 6) AS mae, round(sqrt(avg((units - prediction) ** 2)), 6) AS rmse
FROM pred WHERE d > {VAL_END}"""
DRAWN = f"ORDER BY md5('{SEED}|' || p), p LIMIT 1"
ORACLE["prediction_series"] = f"""WITH {PREDICTIONS}, t AS (SELECT * FROM pred WHERE d > {VAL_END})
SELECT p AS product_id, d AS "SHOP_DATE", units AS total_units, round(prediction, 5) AS prediction
FROM t WHERE p = (SELECT p FROM (SELECT DISTINCT p FROM t) {DRAWN})"""
ORACLE["random_product"] = f"""WITH {tx('part')} SELECT p AS product_id FROM (SELECT DISTINCT p FROM tx) {DRAWN}"""


def uniform(key: str) -> str:
    return f"((('0x' || substr(md5({key}), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE)"


def normal(*keys: str) -> str:
    key = " || '|' || ".join([f"'{SEED}'", *keys])
    r, a = f"{key} || '|r'", f"{key} || '|a'"
    return f"sqrt(-2 * ln({uniform(r)})) * cos(2 * pi() * {uniform(a)})"


NOISE = f"0.0719::DOUBLE * {normal('p', 'd::VARCHAR')}"
ORACLE["simulated_demand"] = f"""WITH {PREDICTIONS} SELECT p AS product_id, d AS "SHOP_DATE",
  round(greatest(0.0, prediction + {NOISE}), 5) AS demand, round({NOISE}, 6) AS noise FROM pred WHERE d > {VAL_END}"""

# --- pricing

MEDIANS = "medians AS (SELECT p, median(avg_price) AS median_price FROM daily GROUP BY p)"
GLOBAL = f"(SELECT median(avg_price) FROM daily WHERE d <= {TRAIN_END})"
ORACLE["median_rule"] = f"""WITH {daily()} SELECT d AS "SHOP_DATE", p AS "PROD_CODE",
  round(CASE WHEN avg_price = 0 THEN 1.0 ELSE {GLOBAL} / avg_price END, 6) AS price_multiplier
FROM daily WHERE d > {VAL_END}"""


def actions(multipliers=MULTIPLIERS) -> str:
    rows = ", ".join(f"({i}, {m!r}::DOUBLE)" for i, m in enumerate(multipliers))
    return f"actions(i, m) AS (VALUES {rows})"


ORACLE["nearest_action"] = f"""WITH {daily()}, {actions()}, t AS (
  SELECT p, median(avg_price) AS median_price FROM daily WHERE d <= {TRAIN_END} GROUP BY p), ranked AS (
  SELECT d, daily.p, i, m, row_number() OVER (PARTITION BY d, daily.p ORDER BY abs(m - median_price / avg_price), i) AS r
  FROM daily JOIN t ON daily.p = t.p CROSS JOIN actions WHERE d > {VAL_END})
SELECT d AS "SHOP_DATE", p AS "PROD_CODE", CAST(i AS INTEGER) AS action_index, m AS action FROM ranked WHERE r = 1"""
ORACLE["historical_action"] = f"""WITH {daily()}, requests AS (SELECT DISTINCT p, CAST(d + 1 AS DATE) AS d FROM tx)
SELECT requests.p AS product_id, requests.d AS "SHOP_DATE",
  round(CASE WHEN avg_price IS NULL THEN 0.0
    ELSE greatest(-1.0::DOUBLE, least(1.0::DOUBLE, -1.0 + (avg_price - 500.0) / 2500.0 * 2.0)) END, 6) AS action
FROM requests LEFT JOIN daily ON requests.p = daily.p AND requests.d = daily.d"""
ORACLE["candidate_prices"] = f"""WITH {daily()}, {actions()} SELECT d AS "SHOP_DATE", p AS "PROD_CODE",
  CAST(i AS INTEGER) AS action_index, m AS price_multiplier, round(avg_price * m, 4) AS new_price
FROM daily CROSS JOIN actions"""


def grid(multipliers=MULTIPLIERS, cost: float = 0.75) -> str:
    price = "avg_price * m"
    return f"""{daily()}, {LINES}, {MEDIANS}, {actions(multipliers)}, grid AS (
  SELECT d, daily.p, i, m, {price} AS new_price, {sold(predicted(price))} AS units, {cost}::DOUBLE * median_price AS cost
  FROM daily JOIN medians ON daily.p = medians.p LEFT JOIN slopes ON daily.p = slopes.p CROSS JOIN actions
  WHERE d > {VAL_END}), outcome AS (
  SELECT *, new_price * units AS revenue, (new_price - cost) * units AS profit FROM grid)"""


def best_of(measure: str) -> str:
    return f"""best AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY d, p ORDER BY {measure} DESC, i) AS r FROM outcome) WHERE r = 1)"""


ORACLE["counterfactual_profit"] = f"""WITH {grid()} SELECT d AS "SHOP_DATE", p AS product_id,
  CAST(i AS INTEGER) AS action_index, units, round(revenue, 2) AS revenue, round(profit, 2) AS profit FROM outcome"""
ORACLE["best_multiplier"] = f"""WITH {grid()}, {best_of('profit')} SELECT d AS "SHOP_DATE", p AS product_id,
  m AS best_multiplier, round(profit, 2) AS best_profit FROM best"""
NINE = [0.9 + (1.1 - 0.9) * i / 8 for i in range(9)]
ORACLE["best_revenue_on_grid"] = f"""WITH {grid(NINE)}, {best_of('revenue')} SELECT d AS "SHOP_DATE", p AS product_id,
  round(m, 6) AS best_multiplier, round(revenue, 2) AS best_revenue FROM best"""

# --- episodes and backtest

NUMBERED = f"""numbered AS (
  SELECT *, row_number() OVER (PARTITION BY p ORDER BY d) AS rn, count(*) OVER (PARTITION BY p) AS n,
    lead(d) OVER (PARTITION BY p ORDER BY d) AS next_d
  FROM daily WHERE d > {VAL_END})"""
EPISODES = f"""{NUMBERED}, episode AS (
  SELECT *, greatest(1, least(90, n - 1)) AS steps FROM numbered WHERE rn <= greatest(1, least(90, n - 1)))"""
ORACLE["episode_rows"] = f"""WITH {daily()}, {EPISODES} SELECT p AS product_id, d AS "SHOP_DATE",
  CAST(rn AS INTEGER) AS step, CAST(steps AS INTEGER) AS steps, next_d AS next_date FROM episode"""
ORACLE["random_start_episodes"] = f"""WITH {daily()}, {NUMBERED}, started AS (
  SELECT *, CASE WHEN n - 90 > 1 THEN ('0x' || substr(md5('{SEED}|' || p), 1, 12))::BIGINT % (n - 90) ELSE 0 END AS s
  FROM numbered)
SELECT p AS product_id, d AS "SHOP_DATE", CAST(rn - s AS INTEGER) AS step,
  CAST(greatest(1, least(90, n - 1 - s)) AS INTEGER) AS steps
FROM started WHERE rn > s AND rn - s <= greatest(1, least(90, n - 1 - s))"""
ORACLE["horizon_rows"] = f"""WITH {daily()}, {NUMBERED} SELECT p AS product_id, d AS "SHOP_DATE",
  CAST(rn AS INTEGER) AS position, round(avg_price, 6) AS avg_price FROM numbered WHERE rn <= 90"""
POSITIONS = "positions AS (SELECT p, avg_price AS raw_price, row_number() OVER (PARTITION BY p ORDER BY d) AS rn FROM daily)"
ORACLE["aligned_by_position"] = f"""WITH {daily()}, {NUMBERED}, {POSITIONS} SELECT p AS product_id, d AS "SHOP_DATE",
  round(avg_price, 6) AS avg_price, round(raw_price, 6) AS raw_price FROM numbered JOIN positions USING (p, rn)"""
ORACLE["aligned_by_date"] = f"""WITH {daily()} SELECT p AS product_id, d AS "SHOP_DATE",
  round(avg_price, 6) AS avg_price, round(avg_price, 6) AS raw_price FROM daily WHERE d > {VAL_END}"""

def nearest(x: str) -> str:
    """The closest multiplier by comparing neighbours; ties go to the lower one."""
    cases = " ".join(f"WHEN abs({a!r}::DOUBLE - ({x})) <= abs({b!r}::DOUBLE - ({x})) THEN {a!r}::DOUBLE"
                     for a, b in zip(MULTIPLIERS, MULTIPLIERS[1:]))
    return f"CASE {cases} ELSE {MULTIPLIERS[-1]!r}::DOUBLE END"


def backtest(noise_std: float = 0.0, measure: str = "profit") -> str:
    """Steps of the three standard policies."""
    prediction = predicted("price")
    if noise_std:
        prediction += f" + {noise_std}::DOUBLE * {normal('run.p', 'd::VARCHAR', 'policy')}"
    return f"""{grid()}, {best_of(measure)}, {EPISODES}, chosen AS (
  SELECT e.*, {GLOBAL} / avg_price AS rule_m, best.m AS best_m, best.cost
  FROM episode e JOIN best ON e.p = best.p AND e.d = best.d), run AS (
  SELECT *, 'Historical' AS policy, 1.0::DOUBLE AS mult, avg_price AS price FROM chosen
  UNION ALL SELECT *, 'Rule-Based (Median)', rule_m, avg_price * ({nearest('rule_m')}) FROM chosen
  UNION ALL SELECT *, 'Best Multiplier', best_m, avg_price * best_m FROM chosen), steps AS (
  SELECT run.* EXCLUDE (units, sales), {sold(prediction)} AS sold
  FROM run LEFT JOIN slopes ON run.p = slopes.p), results AS (
  SELECT *, (price - cost) * sold AS reward FROM steps WHERE rn < steps)"""


def select_log(date: str, reward: str, source: str = "results") -> str:
    return f"""SELECT {date} AS date, p AS product_id, policy, round(mult, 6) AS price_multiplier,
  round(price, 5) AS price, round({reward}, 2) AS reward, sold AS units_sold FROM {source}"""


ORACLE["policy_backtest"] = f"WITH {backtest()} {select_log('next_d', 'reward')}"
ORACLE["policy_backtest_own_date"] = f"""WITH {backtest(measure='revenue')}
{select_log('d', 'price * sold', 'steps')}"""
ORACLE["noisy_policy_backtest"] = f"WITH {backtest(0.0719)} {select_log('next_d', 'reward')}"


def simple_backtest(base: str, ratio: float, discount: float) -> str:
    """Historical prices and a flat discount, on a base price per row."""
    return f"""{daily()}, {LINES}, {MEDIANS}, {EPISODES}, {POSITIONS}, run AS (
  SELECT episode.* EXCLUDE (units), {base} AS base, policy, mult, applied
  FROM episode JOIN positions USING (p, rn)
  CROSS JOIN (VALUES ('Historical', 1.0::DOUBLE, 1.0::DOUBLE), ('Discount', 0.93::DOUBLE, {discount}::DOUBLE))
    v(policy, mult, applied)), steps AS (
  SELECT run.*, base * applied AS price, {ratio}::DOUBLE * median_price AS cost,
    {sold(predicted('base * applied'))} AS sold
  FROM run JOIN medians ON run.p = medians.p LEFT JOIN slopes ON run.p = slopes.p), results AS (
  SELECT *, (price - cost) * sold AS reward FROM steps WHERE rn < steps)"""


ORACLE["raw_price_backtest"] = f"WITH {simple_backtest('raw_price', 0.7, 0.95)} {select_log('next_d', 'reward')}"
ORACLE["continuous_action_backtest"] = f"WITH {simple_backtest('avg_price', 0.75, 0.93)} {select_log('next_d', 'reward')}"

# --- KPIs

PER_PRODUCT = """stepped AS (
  SELECT *, lag(price) OVER (PARTITION BY policy, p ORDER BY next_d) AS prev FROM results), per_product AS (
  SELECT policy, p, stddev_samp(price) AS sd, count(*) FILTER (prev IS NULL OR prev <> price) - 1 AS changes,
    sum(reward) AS reward, CAST(sum(sold) AS BIGINT) AS units, sum(price) AS price_sum, count(price) AS price_n
  FROM stepped GROUP BY policy, p)"""


def kpis(keys: str, per_product: str, days: str) -> str:
    return f"""(SELECT {keys}, sum(reward) AS total_revenue, CAST(sum(units) AS BIGINT) AS total_units_sold,
  sum(price_sum) / sum(price_n) AS average_price, avg(sd) AS price_volatility,
  CAST(sum(changes) AS BIGINT) AS total_price_changes FROM {per_product} GROUP BY {keys})
  JOIN (SELECT {keys}, count(DISTINCT next_d) AS n_days FROM {days} GROUP BY {keys}) USING ({keys})"""


SELECT_KPIS = """policy, round(total_revenue, 2) AS total_revenue, total_units_sold,
  round(average_price, 5) AS average_price, round(total_revenue / n_days, 4) AS average_daily_revenue,
  round(price_volatility, 5) AS price_volatility, total_price_changes"""
KPI_NAMES = ["total_revenue", "total_units_sold", "average_price", "average_daily_revenue", "price_volatility",
             "total_price_changes"]

ORACLE["policy_kpis"] = f"""WITH {backtest()}, {PER_PRODUCT}
SELECT {SELECT_KPIS} FROM {kpis('policy', 'per_product', 'results')}"""


def replicates(count: int) -> str:
    return f"""{backtest()}, {PER_PRODUCT}, ids AS (
  SELECT p, row_number() OVER (ORDER BY p) - 1 AS i FROM (SELECT DISTINCT p FROM results)), size AS (
  SELECT count(*) AS n FROM ids), draws AS MATERIALIZED (
  SELECT DISTINCT rep AS replicate,
    ('0x' || substr(md5('{SEED}|' || rep || '|' || slot), 1, 12))::BIGINT % (SELECT n FROM size) AS i
  FROM range({count}) r(rep) CROSS JOIN (SELECT unnest(range((SELECT n FROM size))) AS slot) s), drawn AS (
  SELECT replicate, p FROM draws JOIN ids USING (i)), seen AS MATERIALIZED (
  SELECT DISTINCT policy, p, next_d FROM results), rep_days AS (
  SELECT replicate, policy, next_d FROM drawn JOIN seen USING (p)), rep_products AS (
  SELECT replicate, per_product.* FROM drawn JOIN per_product USING (p)), reps AS (
  SELECT *, total_revenue / n_days AS average_daily_revenue
  FROM {kpis('replicate, policy', 'rep_products', 'rep_days')})"""


ORACLE["bootstrap_replicates"] = f"WITH {replicates(1000)} SELECT replicate, {SELECT_KPIS} FROM reps"

# Every draw is a row here, so a product drawn twice is summed twice; days stay distinct.
ORACLE["bootstrap_replicates_counted"] = (f"WITH {replicates(1000)} SELECT replicate, {SELECT_KPIS} FROM reps"
                                          .replace("SELECT DISTINCT rep AS replicate", "SELECT rep AS replicate"))


def bounds() -> str:
    return ", ".join(f"quantile_cont(CAST({k} AS DOUBLE), {q}::DOUBLE) AS {k}_{side}"
                     for k in KPI_NAMES for side, q in (("lower", 0.025), ("upper", 0.975)))


BOUND_NAMES = [f"{k}_{side}" for k in KPI_NAMES for side in ("lower", "upper")]
ORACLE["bootstrap_ci"] = f"""WITH {replicates(1000)}, ci AS (SELECT policy, {bounds()} FROM reps GROUP BY policy)
SELECT policy, {rounds(BOUND_NAMES, 3)} FROM ci"""
ORACLE["policy_report"] = f"""WITH {replicates(1000)}, ci AS (SELECT policy, {bounds()} FROM reps GROUP BY policy), k AS (
  SELECT {SELECT_KPIS} FROM {kpis('policy', 'per_product', 'results')})
SELECT k.*, {rounds(BOUND_NAMES, 3)} FROM k LEFT JOIN ci USING (policy)"""

# --- per-product evaluation

ORACLE["price_step_volatility"] = f"""WITH {daily()}, steps AS (
  SELECT p, avg_price - lag(avg_price) OVER (PARTITION BY p ORDER BY d) AS diff FROM daily)
SELECT p AS "PROD_CODE", round(coalesce(stddev_pop(diff), 0.0), 5) AS price_volatility FROM steps GROUP BY p"""


def baseline(paid: str, noise_std: float = 0.0, cost: float = 0.7) -> str:
    prediction = predicted("avg_price")
    if noise_std:
        prediction += f" + {noise_std}::DOUBLE * {normal('p', 'd::VARCHAR', "'history'")}"
    return f"""{NUMBERED}, {POSITIONS}, head AS (
  SELECT numbered.p, rn, avg_price, {paid} AS paid, {sold(prediction)} AS sold
  FROM numbered JOIN positions USING (p, rn) LEFT JOIN slopes USING (p) WHERE rn <= 90), moved AS (
  SELECT *, paid - lag(paid) OVER (PARTITION BY p ORDER BY rn) AS diff FROM head), history AS (
  SELECT p, sum((paid - {cost} * paid) * sold) AS historical_profit, coalesce(stddev_pop(diff), 0.0) AS historical_volatility
  FROM moved GROUP BY p)"""


for _name, _paid in (("historical_baseline", "raw_price"), ("historical_baseline_by_date", "avg_price")):
    ORACLE[_name] = f"""WITH {daily()}, {LINES}, {baseline(_paid)}
SELECT p AS product_id, round(historical_profit, 2) AS historical_profit,
  round(historical_volatility, 5) AS historical_volatility FROM history"""


ORACLE["historical_baseline_with_noise"] = f"""WITH {daily()}, {LINES}, {baseline('raw_price', 2.0)}
SELECT p AS product_id, round(historical_profit, 2) AS historical_profit,
  round(historical_volatility, 5) AS historical_volatility FROM history"""


def product_evaluation(episodes: int, noise_std: float, cost: float | None = None) -> str:
    prediction = predicted("price")
    if noise_std:
        prediction += f" + {noise_std}::DOUBLE * {normal('played.p', 'd::VARCHAR', 'episode')}"
    return f"""{grid(cost=cost or 0.75)}, {best_of('profit')}, {NUMBERED.replace('numbered AS', 'test_rows AS')}, cut AS (
  SELECT *, greatest(1, least(90, n - 1)) AS steps FROM test_rows WHERE rn <= greatest(1, least(90, n - 1))), chosen AS (
  SELECT cut.p, cut.d, rn, steps, avg_price * m AS price, cost FROM cut JOIN best ON cut.p = best.p AND cut.d = best.d),
played AS (
  SELECT *, CASE WHEN rn < steps THEN price - lag(price) OVER (PARTITION BY p ORDER BY rn) END AS diff
  FROM chosen), realised AS (
  SELECT played.p, episode, diff, (price - cost) * {sold(prediction)} AS profit
  FROM played LEFT JOIN slopes ON played.p = slopes.p CROSS JOIN range({episodes}) e(episode)), per_episode AS (
  SELECT p, episode, sum(profit) AS profit, coalesce(stddev_pop(diff), 0.0) AS volatility FROM realised GROUP BY p, episode),
agent AS (
  SELECT p, avg(profit) AS agent_profit_mean, stddev_pop(profit) AS agent_profit_std, avg(volatility) AS agent_volatility
  FROM per_episode GROUP BY p), {baseline('raw_price', noise_std, cost or 0.7)}, evaluated AS (
  SELECT p, agent_profit_mean, agent_profit_std, agent_volatility, historical_profit, historical_volatility,
    CASE WHEN historical_profit = 0 THEN 'inf'::DOUBLE
      ELSE (agent_profit_mean - historical_profit) / abs(historical_profit) * 100 END AS improvement_pct,
    coalesce((SELECT stddev_samp(units) FROM daily WHERE daily.p = agent.p), 0.0) AS sales_volatility
  FROM agent JOIN history USING (p))"""


EVALUATED = ["agent_profit_mean", "agent_profit_std", "agent_volatility", "historical_profit", "historical_volatility",
             "improvement_pct", "sales_volatility"]
for _name, _args in (("product_evaluation", (1, 0.0)), ("product_evaluation_with_noise", (3, 2.0)),
                     ("product_evaluation_cost_ratio", (1, 0.0, 0.6))):
    ORACLE[_name] = f"WITH {product_evaluation(*_args)} SELECT p AS product_id, {rounds(EVALUATED, 3)} FROM evaluated"
ORACLE["portfolio_summary"] = f"""WITH {product_evaluation(1, 0.0)}, t AS (
  SELECT sum(agent_profit_mean) AS a, sum(historical_profit) AS h FROM evaluated)
SELECT round(a, 2) AS total_agent_profit, round(h, 2) AS total_historical_profit,
  round(CASE WHEN h = 0 THEN 'inf'::DOUBLE ELSE (a - h) / abs(h) * 100 END, 2) AS improvement_pct FROM t"""
ORACLE["sales_improvement"] = f"""WITH {daily('part')}, now AS (
  SELECT p, sum(sales) / count(DISTINCT d) AS a FROM daily WHERE d > {VAL_END} GROUP BY p), before AS (
  SELECT p, sum(sales) / count(DISTINCT d) AS h FROM daily WHERE d <= {TRAIN_END} GROUP BY p)
SELECT p AS "PROD_CODE", coalesce(h, 0.0) = 0.0 AS is_new,
  round(CASE WHEN coalesce(h, 0.0) <> 0.0 THEN (a - h) / abs(h) * 100 END, 4) AS gain_pct
FROM now LEFT JOIN before USING (p)"""


def shift_rounds(sql: str) -> str:
    """Add the catalog's rounding shift (see ``queries.rounded``) inside every ``round(x, n)``."""
    parts, rest = [], sql
    while match := re.search(r"\bround\(", rest):
        depth, end = 1, match.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(rest[end], 0)
            end += 1
        value, places = rest[match.end():end - 1].rsplit(",", 1)
        shift = f"{ROUNDING_SHIFT}::DOUBLE * 1e-{places.strip()}"
        parts += [rest[:match.start()], f"round({shift_rounds(value)} + {shift},{places})"]
        rest = rest[end:]
    return "".join([*parts, rest])


ORACLE = {name: shift_rounds(sql) for name, sql in ORACLE.items()}


# --- boosted trees: what is known for certain

TEST_ROWS = f"(SELECT count(*) FROM (SELECT DISTINCT CAST(l_shipdate AS DATE), l_suppkey FROM lineitem WHERE l_shipdate > {VAL_END}))"

ORACLE["boosted_demand_facts"] = f"""SELECT CAST(2000 AS INTEGER) AS trees, CAST(31 AS INTEGER) AS most_leaves,
  {TEST_ROWS} AS rows, {TEST_ROWS} AS finite, true AS better_than_mean"""

ORACLE["boosted_price_response"] = f"SELECT {TEST_ROWS} AS rows, " + ", ".join(
    f"{TEST_ROWS} AS equal_{k}" for k in range(len(MULTIPLIERS)))

ORACLE["continuous_best_price"] = f"""SELECT {TEST_ROWS} AS rows, {TEST_ROWS} AS inside, {TEST_ROWS} AS not_below_5,
  {TEST_ROWS} AS not_below_41"""

# --- stores and jobs: what went through a store is what went in

ORACLE["stored_panel"] = ORACLE["daily_panel"]
ORACLE["stored_top_products"] = f"""WITH {top('supplier', 'month', 100)} SELECT rank, p AS "PROD_CODE" FROM top"""
ORACLE["stored_product_registry"] = ORACLE["product_registry"]
ORACLE["raw_product_rows"] = f"""WITH {daily()} SELECT p AS product_id, count(*) AS n_days,
  CAST(sum(units) AS BIGINT) AS total_units FROM daily GROUP BY p"""
ORACLE["stored_scaler_stats"] = ORACLE["standard_scaler_stats"]
ORACLE["stored_csv_report"] = ORACLE["daily_panel_by_brand"]
ORACLE["stored_feature_names"] = "SELECT CAST(place AS INTEGER) AS place, feature FROM (VALUES " + ", ".join(
    f"({k}, '{c}')" for k, c in enumerate(FEATURES)) + ") v(place, feature)"
ORACLE["registry_job"] = f"""WITH {daily()}, {split_features()}, wide AS (
  SELECT avg({single('total_sales')}) AS center_total_sales, stddev_pop({single('total_sales')}) AS scale_total_sales
  FROM parts WHERE split = 'train')
SELECT p AS product_id, CAST(dense_rank() OVER (ORDER BY p) - 1 AS INTEGER) AS dense_id, count(*) AS n_rows,
  round(avg({scaled_value('total_sales')}), 3) AS avg_daily_revenue
FROM parts, wide WHERE split = 'test' GROUP BY p"""
ORACLE["prepare_data_job"] = ORACLE["prepared_top_products"]
ORACLE["evaluate_policies_job"] = f"""WITH {backtest()} SELECT policy, count(*) AS n_rows, count(DISTINCT p) AS n_products,
  min(next_d) AS first_date, max(next_d) AS last_date, true AS has_intervals FROM results GROUP BY policy"""
ORACLE["evaluate_products_job"] = f"""SELECT count(DISTINCT l_suppkey) AS n_products, true AS adds_up FROM lineitem
WHERE l_shipdate > {VAL_END}"""
ORACLE["panel_in_two_steps"] = ORACLE["daily_panel"]
ORACLE["registry_with_arrivals"] = f"""WITH {tx('part')}, seen AS (SELECT p, min(d) <= {TRAIN_END} AS early FROM tx GROUP BY p)
SELECT p AS product_id, CAST(row_number() OVER (ORDER BY early DESC, p) - 1 AS INTEGER) AS dense_id FROM seen"""
