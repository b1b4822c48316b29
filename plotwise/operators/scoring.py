"""Deal models: each filters listings, adds arithmetic columns and an unrounded score of 0 to 100."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotwise.functions.pricing import arc_km, clamp, missing_if_zero, ppm2, size_band, total_price
from plotwise.operators.market import exact_median, high_plot_refs, high_plots, with_discount, with_high_plot_reference, with_reference

UTILITIES = ("electricity", "water", "road")


@dataclass(frozen=True)
class Settings:
    """Thresholds of the models; every one can be changed without touching stored listings."""

    as_of: str
    city: str = ""
    centre: tuple[float, float] = (41.9961, 21.4317)
    budget_home: float = 170000
    budget_business: float = 80000
    #: rental
    rent_range: tuple[float, float] = (120, 900)
    nightly: tuple[float, ...] = (38, 46, 58, 72)
    nightly_weight: float = 5
    nightly_least: int = 5
    nightly_range: tuple[float, float] = (15, 250)
    occupancy: float = 0.50
    decay: float = 0.95
    decay_floor: float = 0.60
    fee: float = 0.155
    utilities_fixed: float = 40
    utilities_area: float = 1.5
    cleaning: float = 12
    stay: float = 3.0
    tourist_tax: float = 0.65
    guests: float = 2
    income_tax: float = 0.075
    supplies: float = 35
    furnishing: float = 3500
    furnishing_months: float = 24
    least_profit: float = 150
    #: land
    cities: tuple[str, ...] = ()
    land_area: tuple[float, float] = (250, 20000)
    plot_area: tuple[float, float] = (200, 20000)
    high: float = 700
    building_bonus: float = 15
    #: flip
    flip_discount: tuple[float, float] = (0.15, 0.65)
    flip_area: float = 25
    flip_price: float = 400000
    renovate: tuple[float, float] = (120, 400)
    buying: float = 0.055
    selling: float = 0.03
    gains_tax: float = 0.09
    resale: float = 0.10
    holding: tuple[float, float] = (9, 60)
    least_roi: float = 0.10
    #: motivated
    least_drop: float = 0.05
    most_drop: float = 0.5
    least_price: float = 5000
    #: auctions
    auction_kinds: tuple[str, ...] = ("apartment", "house", "land")
    auction_least: float = 1000
    most_premium: float = 0.30
    district_factor: dict = field(default_factory=dict)


def rooms_key() -> Column:
    """1 to 4: rooms rounded down, or guessed from the area."""
    area = missing_if_zero(F.col("area_m2"))
    guess = F.when(area < 42, 1.0).when(area < 65, 2.0).when(area < 90, 3.0).when(area.isNotNull(), 4.0)
    return F.least(F.lit(4), F.greatest(F.lit(1), F.floor(F.coalesce(missing_if_zero(F.col("rooms")), guess, F.lit(2.0))))).cast("int")


def location_factor(c: Settings) -> Column:
    """Demand against the centre: falls with the distance of the pin, else by district."""
    lat, lng = missing_if_zero(F.col("lat")), missing_if_zero(F.col("lng"))
    km = arc_km(lat, lng, F.lit(c.centre[0]), F.lit(c.centre[1]))
    by_district = F.coalesce(F.create_map(*[F.lit(x) for kv in c.district_factor.items() for x in kv])[F.col("district")], F.lit(0.4)) if c.district_factor else F.lit(0.4)
    return F.when(lat.isNotNull() & lng.isNotNull(), F.greatest(F.lit(c.decay_floor), F.pow(F.lit(c.decay), km))).otherwise(by_district)


def calibrated_rates(rows: DataFrame, c: Settings) -> DataFrame:
    """A4: (rooms, rate, seen): nightly rates from observed per-night listings, blended with the prior and never below it."""
    observed = rows.where((F.col("kind") == "apartment") & (F.col("deal") == "short_term") & ~F.coalesce("abroad", F.lit(False)) & F.col("price_note").isNull() & F.col("price_eur").between(*map(float, c.nightly_range)))
    per = exact_median(observed.select(rooms_key().alias("rooms"), (F.col("price_eur") / (0.75 + 0.25 * location_factor(c))).alias("v")), ["rooms"], "v").withColumnRenamed("median", "m")
    prior = rows.sparkSession.createDataFrame([(i + 1, float(x)) for i, x in enumerate(c.nightly)], "rooms int, prior double")
    n = F.coalesce("n", F.lit(0))
    blended = F.when(n >= c.nightly_least, F.greatest("prior", (n * F.col("m") + c.nightly_weight * F.col("prior")) / (n + c.nightly_weight))).otherwise(F.col("prior"))
    return prior.join(per, "rooms", "left").select("rooms", blended.alias("rate"), n.alias("seen"))


def score_rental(rows: DataFrame, rates: DataFrame, c: Settings) -> DataFrame:
    """What a flat for rent would earn per night, after costs and rent. ``furnished`` may be null (half of the furnishing)."""
    rent, area = total_price(), F.coalesce(missing_if_zero(F.col("area_m2")), F.lit(55.0))
    rows = rows.where(F.col("kind").isin("apartment", "house") & (F.col("deal") == "rent") & rent.between(*map(float, c.rent_range)))
    rows = rows.withColumns({"rooms_key": rooms_key(), "factor": location_factor(c), "rent": rent}).join(F.broadcast(rates.withColumnRenamed("rooms", "rooms_key")), "rooms_key")
    nights = 30 * (c.occupancy * F.col("factor"))
    furnishing = F.when(F.col("furnished"), 0.0).when(~F.col("furnished"), c.furnishing).otherwise(c.furnishing / 2)
    rows = rows.withColumns({"nights": nights, "gross": F.col("rate") * (0.75 + 0.25 * F.col("factor")) * nights, "fitting": furnishing})
    costs = F.col("gross") * c.fee + (c.utilities_fixed + c.utilities_area * area) + c.cleaning * F.when(F.col("rooms_key") >= 3, 1.5).otherwise(1.0) * (F.col("nights") / c.stay) + c.supplies + F.col("fitting") / c.furnishing_months
    costs = costs + c.tourist_tax * c.guests * F.col("nights") + F.col("gross") * c.income_tax
    rows = rows.withColumn("profit", F.col("gross") - costs - F.col("rent")).withColumn("margin", F.coalesce(F.try_divide("profit", "gross"), F.lit(0.0)))
    rows = rows.where((F.col("profit") >= c.least_profit) & (F.col("rent") * 2 + F.col("fitting") <= c.budget_business))
    return rows.withColumn("score", 100 * clamp(0.55 * clamp(F.col("profit") / 300) + 0.25 * clamp(F.col("factor")) + 0.20 * clamp(F.col("margin") / 0.35)))


def utility(name: str, assumed: bool) -> Column:
    """Yes, no, assumed or unknown."""
    v = F.col("utilities")[name]
    return F.when(v, "yes").when(~v, "no").otherwise("assumed" if assumed else "unknown")


def with_utilities(rows: DataFrame, assumed: bool) -> DataFrame:
    """confirmed: utilities that are there; lacking: whether one is said to be missing."""
    states = [utility(u, assumed) for u in UTILITIES]
    confirmed = sum(((s == "yes").cast("int") for s in states), F.lit(0))
    lacking = (states[0] == "no") | (states[1] == "no") | (states[2] == "no")
    return rows.withColumns({"confirmed": confirmed, "lacking": lacking})


def score_land(rows: DataFrame, refs: DataFrame, c: Settings, mins: tuple[int, int, int] = (15, 8, 15)) -> DataFrame:
    """Building land in listed cities or high up. Needs utilities (map) and land_type."""
    area, price = F.col("area_m2"), total_price()
    high = F.coalesce(F.col("elevation"), F.lit(0.0)) >= c.high
    rows = rows.where((F.col("kind") == "land") & (F.col("deal") == "sale") & ~F.coalesce("abroad", F.lit(False)) & area.between(*map(float, c.land_area)) & (price <= c.budget_home) & (F.col("city").isin(*c.cities) | high))
    rows = with_utilities(rows, False).where("not lacking")
    rows = with_discount(with_reference(rows, refs, mins))
    score = 100 * clamp(0.30 * clamp(F.coalesce("discount", F.lit(0.0)) / 0.5) + 0.35 * (F.col("confirmed") / 3) + F.when(F.col("land_type") == "building", c.building_bonus / 100).otherwise(0.0) + 0.10 * F.when(area.between(400, 3000), 1.0).otherwise(0.6) + 0.10 * F.when(high, 1.0).otherwise(0.6))
    return rows.withColumns({"qualified": F.col("confirmed") == 3, "score": score * F.when(F.col("land_type") == "agricultural", 0.7).otherwise(1.0)})


def score_high_plots(rows: DataFrame, c: Settings) -> DataFrame:
    """D3: high plots against other high plots of their size. Needs utilities, land_type and skopje_min (minutes by car, may be null)."""
    refs = high_plot_refs(rows, c.high)
    area = F.col("area_m2")
    rows = high_plots(rows, c.high).where((total_price() <= c.budget_home) & area.between(*map(float, c.plot_area)))
    rows = with_discount(with_high_plot_reference(with_utilities(rows, False).where("not lacking"), refs).withColumn("ref_level", F.lit("mountain")))
    reach = F.when(F.col("skopje_min").isNull(), 0.5).otherwise(clamp((180 - F.col("skopje_min")) / 120))
    score = 100 * clamp(0.30 * clamp(F.coalesce("discount", F.lit(0.0)) / 0.5) + 0.30 * (F.col("confirmed") / 3) + 0.10 * F.when(F.col("land_type") == "building", 1.0).otherwise(0.0) + 0.10 * F.when(area.between(300, 2500), 1.0).otherwise(0.6) + 0.10 * reach + 0.10 * F.when(F.bround("elevation") <= 1500, 1.0).otherwise(0.7))
    return rows.withColumns({"qualified": F.col("confirmed") == 3, "score": score * F.when(F.col("land_type") == "agricultural", 0.7).otherwise(1.0)})


def score_flip(rows: DataFrame, refs: DataFrame, c: Settings, mins: tuple[int, int, int] = (15, 8, 15)) -> DataFrame:
    """Homes under local value, after renovation, fees and tax. Needs renovation (boolean) and year_built (may be null)."""
    price, unit, area = total_price(), ppm2(), F.col("area_m2")
    rows = rows.where(F.col("kind").isin("apartment", "house", "weekend_house") & (F.col("deal") == "sale") & ~F.coalesce("abroad", F.lit(False)) & unit.isNotNull() & (area >= c.flip_area) & (price <= c.flip_price))
    rows = with_discount(with_reference(rows, refs, mins)).where(F.col("discount").between(*c.flip_discount))
    heavy = F.coalesce("renovation", F.lit(False)) | F.coalesce(F.col("year_built") < 1980, F.lit(False))
    rows = rows.withColumns({"price": price, "reno": area * F.when(heavy, c.renovate[1]).otherwise(c.renovate[0]), "sold_for": F.col("ref_median") * area * (1 - c.resale * F.when(F.col("kind") != "apartment", 1.5).otherwise(1.0))})
    held = c.holding[0] * c.holding[1]
    rows = rows.withColumns({"gain": F.col("sold_for") - F.col("price") - F.col("price") * c.buying - F.col("reno") - held - F.col("sold_for") * c.selling, "cash": F.col("price") + F.col("price") * c.buying + F.col("reno") + held})
    rows = rows.withColumn("profit", F.col("gain") - F.greatest(F.lit(0.0), "gain") * c.gains_tax).withColumn("roi", F.col("profit") / F.col("cash"))
    rows = rows.where((F.col("cash") <= c.budget_business) & (F.col("roi") >= c.least_roi))
    sure = F.when(F.col("ref_level") == "district", 1.0).otherwise(0.75) * F.least(F.lit(1.0), F.greatest(F.lit(0.4), F.col("ref_n") / 30))
    return rows.withColumns({"qualified": F.col("detail_at").isNotNull(), "score": 100 * clamp(0.5 * clamp(F.col("roi") / 0.6) + 0.3 * clamp(F.col("discount") / 0.5) + 0.2 * sure)})


def opening_offer(price: Column, drop: Column, ref: Column, area: Column, discount: Column) -> Column:
    """15 % under the price, 8 % after a big cut, not under 90 % of the local value, at most 92 %, in hundreds."""
    offer = price * F.when(drop >= 0.15, 0.92).otherwise(0.85)
    offer = F.when(discount.isNotNull(), F.greatest(offer, ref * area * 0.9)).otherwise(offer)
    return (F.floor(F.least(offer, price * 0.92) / 100) * 100).cast("long")


def score_motivated(rows: DataFrame, refs: DataFrame, c: Settings, mins: tuple[int, int, int] = (15, 8, 15)) -> DataFrame:
    """Sellers who cut the price or write that it is urgent. Needs urgent_words (int) and id_age_days (may be null) or days_listed."""
    price, raw = total_price(), F.col("price_eur")
    limit = F.when(F.col("kind") == "land", c.budget_home).otherwise(c.budget_business)
    rows = rows.where((F.col("deal") == "sale") & ~F.coalesce("abroad", F.lit(False)) & (price >= c.least_price) & (price <= limit))
    start = F.greatest("first_price", "site_old_price", "price_eur")
    unit_change = (F.col("price_note") == "per_m2") & (F.col("site_old_price") > 6000)
    drop = F.when(F.coalesce(unit_change, F.lit(False)), 1 - price / F.col("site_old_price")).otherwise(1 - raw / start)
    rows = rows.withColumn("drop", drop).withColumn("drop", F.when((F.col("drop") > c.most_drop) | (F.col("drop") < 0), 0.0).otherwise(F.col("drop")))
    rows = rows.where((F.col("drop") >= c.least_drop) | (F.col("urgent_words") > 0))
    rows = with_reference(rows, refs, mins)
    local = F.coalesce(F.col("ref_level") != "national", F.lit(False)) & ~((F.col("kind") == "house") & (F.col("detail_at").isNull() | F.col("district").isNull()))
    rows = rows.withColumn("discount", F.when(local, 1 - ppm2() / F.col("ref_median"))).where("discount is null or discount >= -0.25")
    age = F.coalesce(F.nullif(F.col("id_age_days").cast("double"), F.lit(0.0)), F.col("days_listed").cast("double"))
    score = 100 * clamp(0.40 * clamp(F.col("drop") / 0.2) + 0.20 * clamp(F.col("urgent_words") / 2) + 0.15 * clamp(age / 365) + 0.25 * clamp((F.coalesce("discount", F.lit(0.0)) + 0.05) / 0.35))
    return rows.withColumns({"offer": opening_offer(price, F.col("drop"), F.col("ref_median"), F.col("area_m2"), F.col("discount")), "score": score})


def score_auction(rows: DataFrame, refs: DataFrame, c: Settings, mins: tuple[int, int, int] = (15, 8, 15)) -> DataFrame:
    """Coming auctions against the city's asking median. Needs auction_date, auction_round and share (null: whole)."""
    price = total_price()
    days = F.datediff("auction_date", F.lit(c.as_of).cast("date"))
    limit = F.when(F.col("kind") == "land", c.budget_home).otherwise(c.budget_business)
    rows = rows.where((F.col("deal") == "auction") & F.col("kind").isin(*c.auction_kinds) & (days >= 0) & (price >= c.auction_least) & (price <= limit) & F.col("share").isNull())
    rows = with_reference(rows, refs, mins, deal=F.lit("sale"), district=F.lit(None).cast("string"))
    local = F.coalesce(F.col("ref_level") != "national", F.lit(False))
    rows = rows.withColumn("discount", F.when(local, 1 - ppm2(F.lit("sale")) / F.col("ref_median"))).where(F.col("discount").isNull() | (F.col("discount") >= -c.most_premium))
    turn = F.coalesce("auction_round", F.lit(1))
    appraisal = price * F.when(turn == 2, 1.5).when(turn == 3, 2.0).otherwise(1.0)
    score = 100 * clamp(0.55 * clamp((F.coalesce("discount", F.lit(0.0)) + 0.05) / 0.45) + 0.15 * (turn - 1) / 2 + 0.15 * F.when(F.col("discount").isNotNull(), 1.0).otherwise(0.3) + 0.15 * F.when(days >= 3, 1.0).otherwise(0.6))
    return rows.withColumns({"appraisal": appraisal, "score": score})


TIERS = ((90, "once"), (80, "exceptional"), (70, "great"), (55, "good"), (0, "watch"))
NEEDS_MARKET = ("land", "weekend", "flip", "auctions")


def rating(researcher: Column) -> Column:
    """Rank of the tier, 0 best. Needs score, qualified, has_details, status, warned (boolean), below_market (text), comps."""
    score, market = F.col("score"), researcher.isin(*NEEDS_MARKET)
    rank = F.when(score >= 90, 0).when(score >= 80, 1).when(score >= 70, 2).when(score >= 55, 3).otherwise(4)
    evidence = F.col("qualified") & F.col("has_details") & ~F.coalesce(F.col("status").isin("needs_info", "pending"), F.lit(False)) & ~F.col("warned") & (~market | (F.coalesce("below_market", F.lit("")) != ""))
    rank = F.when((rank < 2) & ~evidence, 2).otherwise(rank)
    counted = market | (researcher == "airbnb")
    rank = F.when(counted & (rank == 0) & (F.coalesce("comps", F.lit(0)) < 30), 1).otherwise(rank)
    rank = F.when(counted & (rank == 1) & (F.coalesce("comps", F.lit(0)) < 15), 2).otherwise(rank)
    return F.when(~F.col("qualified"), F.greatest(rank, F.lit(3))).otherwise(rank)


#: Signs and names of the tiers, best first.
TIER_LABELS = (("💎", "Once-in-a-lifetime"), ("🔥", "Exceptional deal"), ("⭐", "Great deal"), ("👍", "Good deal"), ("👀", "Worth a look"))


def rating_label(rank: Column) -> Column:
    """What a tier is called."""
    return F.get(F.array(*[F.lit(f"{sign} {name}") for sign, name in TIER_LABELS]), rank)


def best_first(deals: DataFrame) -> DataFrame:
    """O2: ``deals`` (researcher, id, rank, score) list by list, the better tier first, then the higher score. A sort by ranges: no task holds a list."""
    return deals.orderBy("researcher", "rank", F.desc("score"), "id")


def questions(researcher: Column) -> Column:
    """Codes of what only the seller can say. Needs has_details, kind, electricity, water, road, land_type, area."""
    land = F.col("kind") == "land"
    asked = [F.when(land & (F.col(u) == "unknown"), u) for u in UTILITIES]
    asked += [F.when(land & (F.col("land_type") == "unknown"), "building_land"), F.when(land & (F.col("land_type") == "agricultural"), "rezoning"), F.when(F.coalesce("area", F.lit(0.0)) == 0, "area")]
    return F.when(F.col("has_details"), F.array_compact(F.array(*asked))).otherwise(F.array().cast("array<string>"))


def deal_status(asked: Column, least: float = 45) -> Column:
    """Confirmed, needs_info, pending or ready. Needs confirmed_by_owner, score, qualified."""
    return F.when(F.col("confirmed_by_owner"), "confirmed").when((F.size(asked) > 0) & (F.col("score") >= least), "needs_info").when(~F.col("qualified") & (F.size(asked) == 0), "pending").otherwise("ready")
