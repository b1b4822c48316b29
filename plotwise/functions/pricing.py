"""Prices, areas and distances as Columns. Zero counts as missing, as everywhere in listings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Plausible price per square metre by (kind, deal).
SANE_PPM2 = {
    ("apartment", "sale"): (250, 9000),
    ("house", "sale"): (60, 6000),
    ("weekend_house", "sale"): (30, 4000),
    ("land", "sale"): (0.5, 2500),
    ("apartment", "rent"): (1.5, 40),
    ("house", "rent"): (0.8, 30),
}
#: Upper bounds of the size bands by kind; the last band is open.
BAND_EDGES = {"apartment": (45, 75, 110), "house": (100, 180, 300), "weekend_house": (60, 120), "land": (400, 800, 1500, 3000, 10000)}
#: Kinds whose size matters more than the neighbourhood.
SIZE_FIRST = ("land", "house", "weekend_house")


def missing_if_zero(c: Column) -> Column:
    return F.nullif(c, F.lit(0.0))


def total_price() -> Column:
    """P5: null for a placeholder, price times area for a price per square metre."""
    price, area = F.col("price_eur"), missing_if_zero(F.col("area_m2"))
    return F.when(F.col("price_note") == "placeholder", None).when(F.col("price_note") == "per_m2", price * area).otherwise(price)


def ppm2(deal: Column | None = None) -> Column:
    """Price per square metre, null outside the plausible range of its kind and deal."""
    deal = F.col("deal") if deal is None else deal
    v = F.try_divide(missing_if_zero(total_price()), missing_if_zero(F.col("area_m2")))
    # the bounds are picked, not the test: the expression of the price stands three times in the plan, not twice for each kind and deal
    low, high = (reduce(lambda acc, kv: acc.when((F.col("kind") == kv[0][0]) & (deal == kv[0][1]), float(kv[1][i])), SANE_PPM2.items(), F.when(F.lit(False), 0.0)) for i in (0, 1))
    return F.when(low.isNull() | v.between(low, high), v)


def size_band() -> Column:
    """Number of the size band of a kind, from 0; null without area or bands."""
    area = missing_if_zero(F.col("area_m2"))
    out = F.when(area.isNull(), None)
    for kind, edges in BAND_EDGES.items():
        out = out.when(F.col("kind") == kind, reduce(lambda a, b: a + b, [(area >= e).cast("int") for e in edges]))
    return out.cast("int")


def clamp(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def arc_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance by the law of cosines."""
    a, b = F.radians(lat1), F.radians(lat2)
    x = F.sin(a) * F.sin(b) + F.cos(a) * F.cos(b) * F.cos(F.radians(lng2 - lng1))
    return 6371 * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))


def days_since(as_of: str, *dates: Column) -> Column:
    """Days from the latest of the dates to the day of analysis; 0 if all are null."""
    last = F.greatest(*dates, F.lit(None).cast("date")) if len(dates) > 1 else dates[0]
    return F.coalesce(F.datediff(F.lit(as_of).cast("date"), last), F.lit(0))
