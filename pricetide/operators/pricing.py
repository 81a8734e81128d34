"""Candidate prices, pricing rules and profit. A policy is a multiplier expression per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..config import PRODUCT_ID
from ..functions.numeric import clip, round_half_even
from .demand import Scorer, simulate_demand

# Policy labels.
HISTORICAL = "Historical"
RULE_MEDIAN = "Rule-Based (Median)"
BEST = "Best Multiplier"


def historical_multiplier() -> Column:
    """Keep the observed price."""
    return F.lit(1.0)


def median_multiplier(price: Column, median: Column) -> Column:
    """The multiplier that moves the price to the median; 1 at price zero and on days without a price.

    A day whose lines all have zero quantity has no price; there is nothing to move, so the day keeps what it has.
    """
    return F.when(price.isNull() | F.isnan(price) | (price == 0), 1.0).otherwise(median / price)


def nearest_action(multiplier: Column, actions: Sequence[float]) -> Column:
    """Index and value of the closest allowed multiplier; the lower index on a tie."""
    choices = [F.struct(F.abs(F.lit(float(a)) - multiplier).alias("gap"), F.lit(i).alias("index"),
                        F.lit(float(a)).alias("action")) for i, a in enumerate(actions)]
    nearest = choices[0] if len(choices) == 1 else F.least(*choices)
    return F.struct(nearest["index"].alias("index"), nearest["action"].alias("action"))


def action_grid(low: float, high: float, count: int) -> list[float]:
    """Evenly spaced multipliers, for a continuous action range."""
    if count < 2:
        raise ValueError("a grid needs at least two multipliers")
    return [low + (high - low) * i / (count - 1) for i in range(count)]


def candidate_prices(df: DataFrame, multipliers: Sequence[float], price: str = "price") -> DataFrame:
    """One row per row and multiplier, made in place without a join or a shuffle."""
    grid = F.array(*[F.lit(float(m)) for m in multipliers])
    return df.select("*", F.posexplode(grid).alias("action_index", "price_multiplier")) \
        .withColumn("new_price", F.col(price) * F.col("price_multiplier"))


def unit_cost(median_price: Column, cost_ratio: float) -> Column:
    return F.coalesce(median_price, F.lit(0.0)) * F.lit(float(cost_ratio))


def sold_units(prediction: Column, noise: Column | None = None) -> Column:
    """Whole units: simulated demand rounded half to even."""
    return round_half_even(simulate_demand(prediction, noise)).cast("long")


def profit(price: Column, cost: Column, units: Column) -> Column:
    return (price - cost) * units


def revenue(price: Column, units: Column) -> Column:
    return price * units


def counterfactual(df: DataFrame, scorer: Scorer, multipliers: Sequence[float], price: str = "price",
                   cost: str = "unit_cost") -> DataFrame:
    """Units, revenue and profit of every row at every candidate price, one row per candidate."""
    grid = scorer.predict(candidate_prices(scorer.prepare(df), multipliers, price), {"new_price": "predicted"})
    units, new_price = F.col("units"), F.col("new_price")
    return grid.withColumn("units", sold_units(F.col("predicted"))).withColumns({
        "revenue": revenue(new_price, units),
        "profit": profit(new_price, F.col(cost), units),
    })


def best_multiplier(df: DataFrame, scorer: Scorer, multipliers: Sequence[float], price: str = "price",
                    cost: str = "unit_cost", measure: str = "profit") -> DataFrame:
    """Add ``best_multiplier``, the candidate with the highest expected profit (or revenue), its
    ``best_price``, predicted demand and gain.

    Prices never enter later rows' features, so the best price of a row is an argmax over its own
    candidates. They are scored side by side as columns of the row: no extra rows, no shuffle. The
    lower index wins a tie. ``df`` must come from ``scorer.prepare``.
    """
    if measure not in ("profit", "revenue"):
        raise ValueError(f"measure must be profit or revenue, not {measure!r}")
    indices = range(len(multipliers))
    df = df.withColumns({f"_price_{i}": F.col(price) * F.lit(float(multipliers[i])) for i in indices})
    df = scorer.predict(df, {f"_price_{i}": f"_units_{i}" for i in indices})

    def choice(i: int) -> Column:
        new_price, units = F.col(f"_price_{i}"), sold_units(F.col(f"_units_{i}"))
        gain = profit(new_price, F.col(cost), units) if measure == "profit" else revenue(new_price, units)
        return F.struct(gain.alias("gain"), F.lit(-i).alias("order"),
                        F.lit(float(multipliers[i])).alias("multiplier"), new_price.alias("price"),
                        F.col(f"_units_{i}").alias("predicted"))

    choices = [choice(i) for i in indices]
    best = choices[0] if len(choices) == 1 else F.greatest(*choices)
    return df.withColumn("_best", best).withColumns({
        "best_multiplier": F.col("_best.multiplier"), "best_price": F.col("_best.price"),
        "best_predicted": F.col("_best.predicted"), f"best_{measure}": F.col("_best.gain"),
    }).drop("_best", *[f"_price_{i}" for i in indices], *[f"_units_{i}" for i in indices])


def best_price_on_steps(df: DataFrame, steps: str = "price_steps", cost: str = "unit_cost", measure: str = "profit") -> DataFrame:
    """Add the best price of a continuous range and its predicted units and gain; exact.

    ``steps`` holds the units as a step function of price (`demand.price_steps`). Units are constant on a step, so
    profit and revenue are largest at its upper end; the lower price wins a tie. NULL where there are no steps.
    """
    if measure not in ("profit", "revenue"):
        raise ValueError(f"measure must be profit or revenue, not {measure!r}")

    def choice(step: Column) -> Column:
        units = sold_units(step["units"])
        gain = profit(step["upper"], F.col(cost), units) if measure == "profit" else revenue(step["upper"], units)
        return F.struct(gain.alias("gain"), (-step["upper"]).alias("order"), step["upper"].alias("price"),
                        step["units"].alias("predicted"))

    return df.withColumn("_best", F.array_max(F.transform(steps, choice))).withColumns({
        "best_price": F.col("_best.price"), "best_predicted": F.col("_best.predicted"), f"best_{measure}": F.col("_best.gain"),
    }).drop("_best")


def mean_prices(prices: DataFrame, step: str, price: str = "price", product: str = PRODUCT_ID) -> DataFrame:
    """One price per product and step; duplicates are averaged."""
    return prices.groupBy(product, step).agg(F.avg(price).alias(price))


def historical_actions(requests: DataFrame, prices: DataFrame, step: str, min_price: float, max_price: float,
                       low: float = -1.0, high: float = 1.0, price: str = "price",
                       product: str = PRODUCT_ID) -> DataFrame:
    """The historical price of each requested (product, step), as an action in [low, high].

    The price's place between ``min_price`` and ``max_price`` is mapped to the action range and
    clipped to it; a request without a historical price gets 0.
    """
    if not max_price > min_price:
        raise ValueError("max_price must be greater than min_price")
    place = (F.col(price) - F.lit(float(min_price))) / F.lit(float(max_price - min_price))
    action = clip(F.lit(float(low)) + place * F.lit(float(high - low)), float(low), float(high))
    joined = requests.join(mean_prices(prices, step, price, product), [product, step], "left")
    return joined.withColumn("action", F.coalesce(action, F.lit(0.0)))
