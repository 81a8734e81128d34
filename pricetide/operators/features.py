"""Calendar, lag, rolling and price features of the daily panel.

All windows partition by product, so the panel is shuffled and sorted once. A window group has one
row per calendar day of one product: it grows with the length of the calendar, not with sales.

Few products with long histories give few tasks. `block_rows` then deals each product's rows in blocks of that
many, each with the `OVERLAP` rows before it, so that the number of groups grows with the days as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..config import DATE, LAGS, PRICE_EPSILON, PRODUCT, ROLLING_WINDOWS, TARGET
from ..functions.calendar import cycle, day_of_week, is_weekend
from ..functions.numeric import finite_or_zero


#: Rows before a row that its windows reach.
OVERLAP = max(*LAGS, *(n - 1 for n in ROLLING_WINDOWS))

#: Columns of a panel dealt in blocks, dropped from the result.
_ERA, _NUMBER, _LOW, _HIGH, _BLOCK, _OWN = (f"__{c}" for c in ("era", "number", "low", "high", "block", "own"))


def _by_date(*block: str) -> WindowSpec:
    return Window.partitionBy(PRODUCT, *block).orderBy(DATE)


def calendar_columns() -> dict[str, Column]:
    date = F.col(DATE)
    weekday_sin, weekday_cos = cycle(day_of_week(date), 7)
    month_sin, month_cos = cycle(F.month(date), 12)
    return {
        "day_of_week": day_of_week(date),
        "month": F.month(date),
        "year": F.year(date),
        "day_of_month": F.dayofmonth(date),
        "week_of_year": F.weekofyear(date),
        "is_weekend": is_weekend(date),
        "day_of_week_sin": weekday_sin,
        "day_of_week_cos": weekday_cos,
        "month_sin": month_sin,
        "month_cos": month_cos,
    }


def lag_columns(*block: str) -> dict[str, Column]:
    """Units some rows back; a row is a day only where the product has no gap."""
    return {f"lag_{n}_units": F.lag(TARGET, n).over(_by_date(*block)) for n in LAGS}


def rolling_columns(*block: str) -> dict[str, Column]:
    """Mean and sample deviation over the last n rows, this row included; NULL until n rows exist."""
    columns = {}
    for n in ROLLING_WINDOWS:
        frame = _by_date(*block).rowsBetween(1 - n, Window.currentRow)
        full = F.count(TARGET).over(frame) == n
        columns[f"rolling_mean_{n}_units"] = F.when(full, F.avg(TARGET).over(frame))
        columns[f"rolling_std_{n}_units"] = F.when(full, F.stddev_samp(TARGET).over(frame))
    return columns


def price_columns(*block: str) -> dict[str, Column]:
    """Change against the previous row, and position between the product's lowest and highest price.

    The price range covers the product's whole history, later rows included.
    """
    price = F.col("avg_price")
    change = price / (F.lag(price, 1).over(_by_date(*block)) + PRICE_EPSILON) - 1
    history = Window.partitionBy(PRODUCT)
    low, high = (F.col(_LOW), F.col(_HIGH)) if block else (F.min(price).over(history), F.max(price).over(history))
    return {
        "price_change_pct": finite_or_zero(change),
        "price_position": finite_or_zero((price - low) / (high - low + PRICE_EPSILON)),
    }


def row_index_columns() -> dict[str, Column]:
    """1-based row number in the product. The stored name promises days since a price change, but
    the value is the row number whatever the price did; both names carry it."""
    index = F.row_number().over(_by_date())
    return {"row_index": index, "days_since_price_change": index}


def _dealt(panel: DataFrame, block_rows: int, era_days: int) -> DataFrame:
    """Each row with its number in the product and the product's price range, dealt to its block and, if it is one of
    the last `OVERLAP` rows of a block, to the next one as well.

    Numbers come from two levels: rows are numbered inside spans of ``era_days`` days, and a table of one row per product
    and span has the rows before it. A product or date that is null is a value of its own, as in a window.
    """
    if block_rows < OVERLAP:
        raise ValueError(f"blocks need {OVERLAP} rows at least")
    rows = panel.withColumn(_ERA, F.floor(F.unix_date(F.col(DATE)) / era_days))
    eras = rows.groupBy(F.col(PRODUCT).alias("p"), F.col(_ERA).alias("e")).agg(
        F.count(F.lit(1)).alias("n"), F.min("avg_price").alias("low"), F.max("avg_price").alias("high"))
    of_product = Window.partitionBy("p")
    before = F.sum("n").over(of_product.orderBy("e").rowsBetween(Window.unboundedPreceding, -1))
    eras = eras.select("p", "e", F.coalesce(before, F.lit(0)).alias("before"), F.min("low").over(of_product).alias(_LOW),
                       F.max("high").over(of_product).alias(_HIGH))
    inside = F.row_number().over(_by_date(_ERA))
    numbered = rows.withColumn(_NUMBER, inside).join(
        eras, F.col(PRODUCT).eqNullSafe(F.col("p")) & F.col(_ERA).eqNullSafe(F.col("e"))).withColumn(
        _NUMBER, F.col("before") + F.col(_NUMBER)).drop("p", "e", "before", _ERA)
    index = F.col(_NUMBER) - 1
    block = F.floor(index / block_rows)
    place = lambda b, own: F.struct(b.alias(_BLOCK), F.lit(own).alias(_OWN))
    places = F.when(index % block_rows >= block_rows - OVERLAP, F.array(place(block, True), place(block + 1, False))
                    ).otherwise(F.array(place(block, True)))
    return numbered.select("*", F.inline(places))


def time_series_features(panel: DataFrame, block_rows: int | None = None, era_days: int = 365) -> DataFrame:
    """The panel with every feature the demand model reads.

    With ``block_rows`` the windows run over blocks of a product's rows; the panel is then read twice (store it if it
    is dear) and shuffled twice. The rows are the same.
    """
    if block_rows is None:
        windows = {**lag_columns(), **rolling_columns(), **price_columns()}
        windows["days_since_price_change"] = row_index_columns()["days_since_price_change"]
        return panel.select("*", *[c.alias(n) for n, c in windows.items()]).withColumns(calendar_columns())
    windows = {**lag_columns(_BLOCK), **rolling_columns(_BLOCK), **price_columns(_BLOCK),
               "days_since_price_change": F.col(_NUMBER).cast("int")}
    return _dealt(panel, block_rows, era_days).select("*", *[c.alias(n) for n, c in windows.items()]).where(_OWN).drop(
        _NUMBER, _LOW, _HIGH, _BLOCK, _OWN).withColumns(calendar_columns())
