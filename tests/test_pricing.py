import math
import random

import pytest
from pyspark.sql import functions as F

from helpers import DAY0, day, panel, rows_by
from pricetide.config import Settings
from pricetide.functions import noise, numeric
from pricetide.operators import backtest, demand, episodes, evaluation, pricing
from pricetide.schemas import standard_product_id

ACTIONS = Settings.multipliers


def column(spark, values, expression, kind="double"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r.y for r in df.withColumn("y", expression(F.col("x"))).orderBy("i").collect()]


def test_units_round_half_to_even_and_never_negative(spark):
    assert column(spark, [0.5, 1.5, 2.5, -0.3], lambda x: pricing.sold_units(x)) == [0, 2, 2, 0]


def test_nearest_action(spark):
    pick = lambda x: pricing.nearest_action(x, [0.25, 0.75])["index"]
    assert column(spark, [0.5, 0.51, 0.1, 9.0], pick) == [0, 1, 0, 1]
    assert column(spark, [3.0], lambda x: pricing.nearest_action(x, [1.0])["action"]) == [1.0]


def test_median_rule(spark):
    rule = lambda x: pricing.median_multiplier(x, F.lit(6.0))
    assert column(spark, [3.0, 0.0, None], rule) == [2.0, 1.0, 1.0]


def test_action_lookup(spark):
    prices = spark.createDataFrame([("A", 1, 10.0), ("A", 1, 20.0), ("A", 3, 99.0), ("A", 4, 5.0)],
                                   "product_id string, step int, price double")
    requests = spark.createDataFrame([("A", 1), ("A", 2), ("A", 3), ("A", 4)], "product_id string, step int")
    got = rows_by(pricing.historical_actions(requests, prices, "step", 10.0, 30.0), "step")
    assert {k: r.action for k, r in got.items()} == {1: -0.5, 2: 0.0, 3: 1.0, 4: -1.0}
    with pytest.raises(ValueError):
        pricing.historical_actions(requests, prices, "step", 10.0, 10.0)


def test_improvement(spark):
    df = spark.createDataFrame([(12.0, 10.0), (-5.0, -10.0), (3.0, 0.0)], "a double, h double")
    got = [r.i for r in df.withColumn("i", numeric.improvement_pct(F.col("a"), F.col("h"))).collect()]
    assert got == [20.0, 50.0, math.inf]


@pytest.mark.parametrize("n, steps", [(1, 1), (2, 1), (5, 4), (90, 89), (91, 90), (200, 90)])
def test_episode_length(spark, n, steps):
    df = standard_product_id(panel(spark, [("A", d, 1, 1) for d in range(n)]))
    cut = episodes.episode_rows(df, 90).orderBy("step").collect()
    assert [r.step for r in cut] == list(range(1, steps + 1))
    assert cut[0].SHOP_DATE == DAY0 and cut[0].steps == steps


def test_random_start_leaves_a_whole_horizon(spark):
    df = standard_product_id(panel(spark, [(f"P{p}", d, 1, 1) for p in range(40) for d in range(30)]))
    starts = set()
    for r in episodes.episode_rows(df, 10, seed=7).groupBy("product_id").agg(
            F.count("*").alias("n"), F.min("SHOP_DATE").alias("first")).collect():
        assert r.n == 10
        starts.add((r["first"] - DAY0).days)
    assert len(starts) > 5 and min(starts) >= 0 and max(starts) <= 19


def test_noise_does_not_depend_on_partitions(spark):
    df = spark.range(2000).select(F.col("id").alias("i"))
    draw = lambda d: {r.i: r.z for r in d.withColumn("z", noise.hash_normal(1, F.col("i"))).collect()}
    one, many = draw(df.coalesce(1)), draw(df.repartition(64))
    assert one == many
    mean = sum(one.values()) / 2000
    assert abs(mean) < 0.1 and abs(sum((z - mean) ** 2 for z in one.values()) / 2000 - 1) < 0.15


def priced(spark, n=12, products=("A", "B")):
    rng = random.Random(5)
    rows = [(p, d, 4 + rng.randrange(5), 20 + rng.randrange(30)) for p in products for d in range(n)]
    df = standard_product_id(panel(spark, rows))
    return df, df.withColumn("price", F.col("avg_price")).withColumn("unit_cost", F.lit(3.0))


def test_best_multiplier_against_every_candidate(spark):
    df, rows = priced(spark)
    scorer = demand.line_scorer(demand.price_lines(df))
    grid = pricing.counterfactual(rows, scorer, ACTIONS).collect()
    best = pricing.best_multiplier(scorer.prepare(rows), scorer, ACTIONS).collect()
    assert len(best) == 24 and len(grid) == 24 * len(ACTIONS)
    for r in best:
        options = [g for g in grid if (g.product_id, g.SHOP_DATE) == (r.product_id, r.SHOP_DATE)]
        top = max(options, key=lambda g: (g.profit, -g.action_index))
        assert (r.best_multiplier, r.best_profit) == (top.price_multiplier, top.profit)


def test_constant_price_scores_mean_units(spark):
    df = standard_product_id(panel(spark, [("A", d, 5, d) for d in range(5)]))
    scorer = demand.line_scorer(demand.price_lines(df))
    rows = scorer.predict(scorer.prepare(df), {"avg_price": "p"})
    assert {r.p for r in rows.collect()} == {2.0}


def test_logs(spark):
    df, rows = priced(spark)
    scorer = demand.line_scorer(demand.price_lines(df))
    policies = {"H": pricing.historical_multiplier(), "D": F.lit(0.93)}
    shifted = backtest.evaluate_policies(rows, policies, scorer, ACTIONS, 5).collect()
    own = backtest.evaluate_policies(rows, policies, scorer, ACTIONS, 5, log="own_date").collect()
    assert len(shifted) == 2 * 2 * 4 and len(own) == 2 * 2 * 5
    first = {(r.product_id, r.SHOP_DATE): r.avg_price for r in df.collect()}
    for r in shifted:
        # date of the next row, price of the current one; the logged multiplier is the policy's own
        base = first[r.product_id, day((r.date - DAY0).days - 1)]
        assert r.price == pytest.approx(base * (1.0 if r.policy == "H" else 0.95))
        assert r.price_multiplier == (1.0 if r.policy == "H" else 0.93)
        assert r.reward == pytest.approx((r.price - 3.0) * r.units_sold)


def test_price_step_volatility(spark):
    df = spark.createDataFrame([("A", 1, 1.0), ("A", 2, 3.0), ("A", 3, 2.0), ("B", 1, 5.0)], "p string, i int, price double")
    got = {r.p: r.price_volatility for r in evaluation.price_step_volatility(df, ["p"], "i").collect()}
    assert got == {"A": 1.5, "B": 0.0}


def test_baseline_is_zero_when_raw_rows_run_short(spark):
    df, rows = priced(spark)
    raw = df.where(f"product_id = 'A' OR SHOP_DATE < '{day(3)}'")
    scorer = demand.line_scorer(demand.price_lines(df))
    got = rows_by(evaluation.historical_baseline(rows, raw, scorer, 5), "product_id")
    assert got["A"].historical_profit != 0 and got["A"].historical_volatility > 0
    assert (got["B"].historical_profit, got["B"].historical_volatility) == (0.0, 0.0)


def test_alignment(spark):
    raw = standard_product_id(panel(spark, [("A", d, 10 + d, 1) for d in range(5)]))
    rows = raw.where(f"SHOP_DATE >= '{day(2)}'")
    pair = lambda how: [r.raw_price for r in episodes.align_rows(rows, raw, how).orderBy("SHOP_DATE").collect()]
    assert pair("position") == [10.0, 11.0, 12.0] and pair("date") == [12.0, 13.0, 14.0]
    with pytest.raises(ValueError):
        pair("nearest")


def test_units_scaler_is_undone(spark):
    df, _ = priced(spark)
    stats = spark.createDataFrame([("total_units", "standard", 100.0, 10.0)], "column string, kind string, center double, scale double")
    plain = demand.line_scorer(demand.price_lines(df))
    wrapped = demand.unscale_units(plain, stats)
    a = plain.predict(plain.prepare(df), {"avg_price": "p"}).orderBy("product_id", "SHOP_DATE").collect()
    b = wrapped.predict(wrapped.prepare(df), {"avg_price": "p"}).orderBy("product_id", "SHOP_DATE").collect()
    assert [r.p for r in b] == pytest.approx([r.p * 10 + 100 for r in a])


def test_category_columns_default_to_zero(spark):
    df = spark.createDataFrame([(1.0, None)], "a double, b double")
    row = df.select(demand.model_inputs(df, ["a", "b", "PROD_CATEGORY_DEP_X"])).first()
    assert (row.a, row.b, row.PROD_CATEGORY_DEP_X) == (1.0, None, 0.0)
    with pytest.raises(ValueError):
        demand.model_inputs(df, ["nowhere"])
