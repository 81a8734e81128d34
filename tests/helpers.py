"""Small hand-made tables."""

import datetime as dt

DAY0 = dt.date(2008, 1, 1)


def day(n):
    return DAY0 + dt.timedelta(days=n)


def panel(spark, rows):
    """Rows of (product, day number, price, units)."""
    from pricetide.schemas import DAILY

    return spark.createDataFrame([(day(d), p, float(price), int(units), float(price) * units, 200801)
                                  for p, d, price, units in rows], DAILY)


def rows_by(df, key):
    return {r[key]: r for r in df.collect()}
