"""Reasons for turning a deal down, as a registry that the penalty fold reads: a new reason is one more entry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotwise.functions.text import has_keyword, norm
from plotwise.operators.feedback import fold_penalties

ALL = ("airbnb", "land", "weekend", "flip", "motivated", "auctions")
BUILT, SIZED, GROUND = ("airbnb", "flip", "motivated", "auctions"), ALL, ("land", "weekend")


@dataclass(frozen=True)
class Reason:
    """``learn``: how rejections for this reason move the scores of other deals.

    size_min, size_max: deals as small, or as large, as half of those rejected; places: deals that agree with a rejected one in all of ``keys`` (and fit
    ``also``); text: deals whose text has one of the ``stems``; rule: deals for which the Column builder ``also`` holds; data and self: none.
    """

    code: str
    label: str
    researchers: tuple[str, ...] = ALL
    learn: str = "self"
    stems: tuple[str, ...] = ()
    keys: tuple[str, ...] = ()
    also: Callable[[], Column] | None = None


def far_district() -> Column:
    """Quirk kept on purpose: every district but these two is far from the centre."""
    return ~F.coalesce(F.col("district").isin("Скопје Центар", "Карпош"), F.lit(False))


#: Codes, labels, models, and stems in plain Latin.
REASONS = (
    Reason("loc", "Bad location / neighbourhood", learn="places", keys=("city", "district")),
    Reason("far", "Too far from the centre", ("airbnb", "flip", "motivated"), "places", keys=("city",), also=far_district),
    Reason("prc", "Not really under market / overpriced", learn="places", keys=("kind", "city")),
    Reason("pm2", "Price is per m² or misleading", learn="data"),
    Reason("sml", "Too small", SIZED, "size_min"), Reason("big", "Too big", SIZED, "size_max"),
    Reason("ren", "Needs too much renovation", BUILT, "text", ("renovir", "adaptac", "stara gradba", "star stan", "za rusenje")),
    Reason("bsm", "Basement / ground floor / no light", BUILT, "text", ("suteren", "podrum", "prizem", "visoko prizemje", "polupodrum")),
    Reason("old", "Old building / no lift", ("airbnb", "flip", "motivated"), "text", ("bez lift", "nema lift", "stara zgrada")),
    Reason("nhm", "Not a home (office, shop, garage…)", BUILT, "text", ("deloven", "kancelar", "lokal", "garaz", "magacin")),
    Reason("tit", "No clean title deed (имотен лист)", learn="text", stems=("bez imoten", "vo postapka", "legaliz")),
    Reason("shr", "Ownership share / co-owners", learn="text", stems=("idealen del", "sosopstven")),
    Reason("ill", "Illegal / not legalised build", ("flip", "motivated", "auctions", "land", "weekend"), "text", ("legaliz", "divo")),
    Reason("noe", "No electricity", GROUND), Reason("now", "No water", GROUND), Reason("nor", "No road access", GROUND),
    Reason("agr", "Agricultural — can't build", ("land", "weekend", "auctions", "motivated"), "text", ("zemjodel", "niva", "lozje", "livada")),
    Reason("ter", "Bad terrain (steep, flood, forest)", GROUND, "text", ("strmn", "padina", "suma", "reka")),
    Reason("dup", "Duplicate / already seen", learn="data"), Reason("sold", "Already sold / rented"), Reason("fake", "Fake or bait ad", learn="data"),
    Reason("agc", "Agency won't share details", ("airbnb", "flip", "motivated", "land", "weekend")), Reason("rnt", "Rent too high for Airbnb", ("airbnb",)),
    Reason("sub", "Landlord won't allow subletting", ("airbnb",)), Reason("str", "Not my strategy", learn="places", keys=("kind", "city")), Reason("oth", "Other — I'll type a note"),
)


def reason_table(spark, reasons: tuple[Reason, ...] = REASONS) -> DataFrame:
    """(code, label, learn, researcher): a row for each model that a reason applies to."""
    return spark.createDataFrame([(r.code, r.label, r.learn, m) for r in reasons for m in r.researchers], "code string, label string, learn string, researcher string")


def penalties(items: DataFrame, rejections: DataFrame, reasons: tuple[Reason, ...] = REASONS) -> DataFrame:
    """D10 (J14): (researcher, id, penalty, reasons) of ``items`` (researcher, id, kind, city, district, area, title, description) after ``rejections``
    (researcher, listing_id, reason, kind, city, district, area).

    Each reason that fits costs by how often it was given, an item's own rejection apart. Texts are folded once.
    """
    of = lambda learn: [r for r in reasons if r.learn == learn]
    places = {keys: {r.code: r.also() if r.also else None for r in of("places") if r.keys == keys} for keys in sorted({r.keys for r in of("places")})}
    rows = items.withColumn("text of the item", norm(F.concat_ws(" ", "title", "description")))
    said = [F.when(has_keyword(F.col("text of the item"), list(r.stems)), r.code) for r in of("text")] + [F.when(r.also(), r.code) for r in of("rule")]
    return fold_penalties(rows, rejections, [r.code for r in of("size_min")], [r.code for r in of("size_max")], places, F.array_compact(F.array(*said)) if said else None)
