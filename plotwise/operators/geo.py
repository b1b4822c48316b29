"""Places: nearest town, gazetteer hits, pins against places, routes and elevations as dimension joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotwise.functions.pricing import arc_km, missing_if_zero


def refile(rows: DataFrame, towns: list[tuple[str, float, float]], max_km: float = 40, near_km: float = 25) -> DataFrame:
    """A pin further than ``max_km`` from the filed town moves the listing to the nearest town within ``near_km``, else to none; the
    district goes. Adds city_form (the town as filed) where that happened.

    ``towns`` is a fixed list that is part of the expression, so nothing is shuffled. The distance to the filed town comes first; all
    towns are looked at only for listings that move. Of towns equally near, the first by name is taken.
    """
    lat, lng = missing_if_zero(F.col("lat")), missing_if_zero(F.col("lng"))
    places = {name: F.struct(F.lit(float(a)).alias("lat"), F.lit(float(b)).alias("lng"), F.lit(name).alias("town")) for name, a, b in towns}
    own = F.create_map(*[x for name, place in places.items() for x in (F.lit(name), place)])[F.col("city")]
    moved = F.coalesce(arc_km(lat, lng, own["lat"], own["lng"]) > max_km, F.lit(False))
    nearest = F.array_min(F.transform(F.array(*places.values()), lambda p: F.struct(arc_km(lat, lng, p["lat"], p["lng"]).alias("km"), p["town"].alias("town"))))
    rows = rows.withColumn("moved", moved).withColumn("nearest", F.when(F.col("moved"), nearest))
    rows = rows.withColumns({"city_form": F.when(F.col("moved"), F.col("city")), "district": F.when(~F.col("moved"), F.col("district"))})
    return rows.withColumn("city", F.when(F.col("moved"), F.when(F.col("nearest.km") <= near_km, F.col("nearest.town"))).otherwise(F.col("city"))).drop("moved", "nearest")


def first_hit(rows: DataFrame, candidates: str, gazetteer: DataFrame, plausible: Column, key: str = "id") -> DataFrame:
    """J15 + W2: (id, name, lat, lng, pos) of the first candidate name that the gazetteer has and that is plausible."""
    named = rows.select(key, "city", F.posexplode(candidates).alias("pos", "name"))
    hits = named.hint("merge").join(gazetteer, "name").where(plausible)
    return hits.groupBy(key).agg(F.min_by(F.struct("name", "place_lat", "place_lng", "pos"), "pos").alias("h")).select(key, "h.*")


def near_town(hits: DataFrame, centres: DataFrame, max_km: float, resorts: tuple[str, ...] = ()) -> DataFrame:
    """Hits within ``max_km`` of their filed town; named resorts and unknown towns always pass. ``centres``: city, c_lat, c_lng."""
    joined = hits.hint("merge").join(centres, "city", "left")
    km = arc_km(F.col("place_lat"), F.col("place_lng"), F.col("c_lat"), F.col("c_lng"))
    return joined.where(F.col("name").isin(*resorts) | F.col("c_lat").isNull() | (km <= max_km)) if resorts else joined.where(F.col("c_lat").isNull() | (km <= max_km))


def pin_against_place(rows: DataFrame, hits: DataFrame, max_km: float = 15) -> DataFrame:
    """(id, lat, lng, pin_dropped): a pin too far from the named place gives way to the place."""
    lat, lng = missing_if_zero(F.col("lat")), missing_if_zero(F.col("lng"))
    joined = rows.hint("merge").join(hits.select("id", "place_lat", "place_lng"), "id", "left")
    far = F.coalesce(arc_km(lat, lng, F.col("place_lat"), F.col("place_lng")) > max_km, F.lit(False))
    return joined.select("id", F.when(far, F.col("place_lat")).otherwise(lat).alias("lat"), F.when(far, F.col("place_lng")).otherwise(lng).alias("lng"), far.alias("pin_dropped"))


def cell(lat: Column, lng: Column, digits: int = 3) -> Column:
    """A coordinate as a join key, in whole steps of 10 ** -digits."""
    step = 10.0**digits
    return F.concat_ws(",", F.floor(lat * step + 0.5).cast("long"), F.floor(lng * step + 0.5).cast("long"))


def with_dimension(rows: DataFrame, dimension: DataFrame, digits: int = 3) -> DataFrame:
    """Left join of a dimension keyed by ``cell``; rows without a pin keep nulls."""
    pinned = rows.withColumn("cell", F.when((F.coalesce("lat", F.lit(0.0)) != 0) & (F.coalesce("lng", F.lit(0.0)) != 0), cell(F.col("lat"), F.col("lng"), digits)))
    return pinned.join(dimension, "cell", "left")


def missing_cells(rows: DataFrame, dimension: DataFrame, digits: int = 3) -> DataFrame:
    """Distinct cells that the dimension lacks: the work list for the next look-up."""
    pinned = rows.where("coalesce(lat, 0) <> 0 and coalesce(lng, 0) <> 0").select(cell(F.col("lat"), F.col("lng"), digits).alias("cell")).distinct()
    return pinned.join(dimension, "cell", "left_anti")
