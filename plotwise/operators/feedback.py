"""Votes, rejections and facts folded into the ranking."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotwise.operators.market import exact_median
from plotwise.scratch import write_table


def latest(events: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """The last row of each key: the state that replace-by-key writes would leave."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("r")).select(*keys, "r.*")


def lean(up: Column, down: Column) -> Column:
    """From -1 to 1, held back for few votes."""
    return (up - down) / (up + down + 3)


def vote_counts(votes: DataFrame, keys: list[str]) -> DataFrame:
    return votes.groupBy(keys).agg(F.count_if(F.col("vote") > 0).alias("up"), F.count_if(F.col("vote") < 0).alias("down"))


def rerank(items: DataFrame, votes: DataFrame, least: float = 2) -> DataFrame:
    """D9 (J6, J13): items without those voted down; scores moved by what was voted on others of the district, city and kind.

    Votes are summed once for each key and an item's own vote is taken off, so items never meet votes one by one. ``votes`` has one row for each
    researcher and listing_id, with kind, city and district; ``items`` has researcher, id, kind, city, district, score, qualified.
    """
    own = votes.select("researcher", F.col("listing_id").alias("id"), "vote", F.col("kind").alias("own_kind"), F.col("city").alias("own_city"), F.col("district").alias("own_district"))
    joined = items.join(own.where("vote < 0").select("researcher", "id"), ["researcher", "id"], "left_anti").join(own, ["researcher", "id"], "left")
    delta = F.lit(0.0)
    for keys, weight in ((["city", "district"], 10), (["city"], 5), (["kind"], 5)):
        tag = keys[-1]
        joined = joined.join(vote_counts(votes.dropna(subset=keys), ["researcher", *keys]).select("researcher", *keys, F.col("up").alias(f"up_{tag}"), F.col("down").alias(f"down_{tag}")), ["researcher", *keys], "left")
        mine = F.lit(True)
        for k in keys:
            mine = mine & F.coalesce(F.col(f"own_{k}") == F.col(k), F.lit(False))
        up = F.coalesce(f"up_{tag}", F.lit(0)) - F.when(mine & (F.col("vote") > 0), 1).otherwise(0)
        delta = delta + weight * lean(up, F.coalesce(f"down_{tag}", F.lit(0)))
    out = joined.withColumn("delta", delta)
    moved = F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.bround(F.col("score") + F.col("delta")))).cast("double")
    return out.withColumn("score", F.when(F.abs("delta") >= least, moved).otherwise(F.col("score"))).select(*items.columns, "delta")


def size_limits(rejections: DataFrame) -> DataFrame:
    """A10: for each researcher and reason the number of rejections and the upper median of their areas, nulls and zeros left out."""
    key = ["researcher", "reason"]
    n = rejections.groupBy(key).agg(F.count("*").alias("n"))
    limit = exact_median(rejections.where("coalesce(area, 0) <> 0"), key, "area", upper=True).select(*key, F.col("median").alias("limit"))
    return n.join(limit, key, "left")


def penalty(n: Column) -> Column:
    return -12 * n / (n + 2)


def fold_penalties(items: DataFrame, rejections: DataFrame, smaller: Iterable[str], larger: Iterable[str], places: dict[tuple[str, ...], dict[str, Column | None]], said: Column | None = None) -> DataFrame:
    """D10 (J14): (researcher, id, penalty, reasons) of the ``items`` that reasons fit. An item's own rejection is left out.

    ``smaller`` and ``larger`` are the reasons that go by size, ``places`` the keys that an item must share with a rejected one, with the reasons
    that go by them and what must hold besides, ``said`` an array of further reasons that fit an item. What was rejected is summed to one row for
    each researcher and for each place, with its reasons as an array. So an item stays one row, and it is moved once, to its own rejections.
    """
    needed = dict.fromkeys(["researcher", "listing_id", "reason", "area", *(k for keys in places for k in keys)])
    rejections = write_table(rejections.where("reason is not null").select(*needed), "rejections")
    # one row for each researcher or place; small files are broadcast, large ones are not
    totals = size_limits(rejections).groupBy("researcher").agg(F.collect_list(F.struct("reason", "n", "limit")).alias("totals"))
    totals = write_table(totals, "totals")
    kind, nowhere = "array<struct<reason:string,here:bigint>>", F.lit(None).cast("bigint")
    anywhere = lambda reasons: F.transform(reasons, lambda r: F.struct(r.alias("reason"), nowhere.alias("here")))
    # what a text says is a few codes, and the text itself goes no further
    rows = (items if said is None else items.withColumn("said", said)).join(totals, "researcher")
    by_size = F.filter("totals", lambda t: (t["reason"].isin(list(smaller)) & (F.col("area") <= t["limit"])) | (t["reason"].isin(list(larger)) & (F.col("area") >= t["limit"])))
    fits = [anywhere(by_size["reason"])] + ([anywhere(F.col("said"))] if said is not None else [])
    for i, (keys, reasons) in enumerate(places.items()):
        here = rejections.where(F.col("reason").isin(list(reasons))).groupBy("researcher", "reason", *keys).agg(F.count("*").alias("here"))
        there = here.groupBy("researcher", *keys).agg(F.collect_list(F.struct("reason", "here")).alias(f"place {i}"))
        rows = rows.join(write_table(there, "places"), ["researcher", *keys], "left")
        holds = F.array_compact(F.array(*[F.lit(r) if also is None else F.when(also, r) for r, also in reasons.items()]))
        fits.append(F.coalesce(F.filter(f"place {i}", lambda p: F.array_contains(holds, p["reason"])), F.array().cast(kind)))
    may = rows.select("researcher", "id", F.concat(*fits).alias("may")).where("size(may) > 0")
    own = rejections.groupBy("researcher", F.col("listing_id").alias("id"), "reason").agg(F.count("*").alias("own"))
    own = own.groupBy("researcher", "id").agg(F.map_from_entries(F.collect_list(F.struct("reason", "own"))).alias("own"))
    mine = lambda reason: F.coalesce(F.try_element_at(F.col("own"), reason), F.lit(0))
    # a place counts if others than the item were rejected there; a reason counts once for an id, also where items repeat it
    left = F.filter("may", lambda x: x["here"].isNull() | (x["here"] > mine(x["reason"])))["reason"]
    found = may.hint("merge").join(own, ["researcher", "id"], "left").groupBy("researcher", "id").agg(F.array_distinct(F.flatten(F.collect_list(left))).alias("found"), F.first("own").alias("own"))
    given = F.transform(F.filter("totals", lambda t: F.array_contains("found", t["reason"])), lambda t: F.struct(t["reason"].alias("reason"), (t["n"] - mine(t["reason"])).alias("n")))
    counted = found.join(totals, "researcher").select("researcher", "id", F.filter(given, lambda x: x["n"] > 0).alias("given")).where("size(given) > 0")
    return counted.select("researcher", "id", F.aggregate("given", F.lit(0.0), lambda total, x: total + penalty(x["n"])).alias("penalty"), F.array_sort(F.col("given")["reason"]).alias("reasons"))


def rejection_penalties(items: DataFrame, rejections: DataFrame) -> DataFrame:
    """D10 (J14): (researcher, id, penalty) for the reasons that go by size, district, city and kind."""
    places = {("city", "district"): {"loc": None}, ("kind", "city"): {"prc": None, "str": None}}
    return fold_penalties(items, rejections, ["sml"], ["big"], places).drop("reasons")


def pivot_facts(facts: DataFrame) -> DataFrame:
    """(id, facts): the last value of every field of a listing as a map."""
    last = latest(facts, ["listing_id", "field"], ["set_at", "value"])
    return last.groupBy(F.col("listing_id").alias("id")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value")))).alias("facts"))


def apply_facts(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Facts told by sellers replace price and area."""
    joined = rows.join(pivot_facts(facts), "id", "left")
    told = lambda k: F.try_element_at(F.col("facts"), F.lit(k)).try_cast("double")
    return joined.withColumns({"price_eur": F.coalesce(told("price"), F.col("price_eur")), "area_m2": F.coalesce(told("area"), F.col("area_m2")), "price_note": F.when(told("price").isNotNull(), None).otherwise(F.col("price_note"))}).drop("facts")


def fold_votes(events: DataFrame) -> DataFrame:
    """State of each (researcher, listing_id) after an ordered stream of up, down, ok and clear.

    Every new event first clears the earlier vote, rejection and confirmation, so the last event alone decides them; the pipeline is
    entered by the first up or ok after the last down, and keeps that time.
    """
    key = ["researcher", "listing_id"]
    w = Window.partitionBy(*key).orderBy("at", "event_id")
    downs = F.sum(F.when(F.col("event") == "down", 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    last_run = F.max("run").over(Window.partitionBy(*key))
    rows = events.withColumn("run", downs).withColumn("last_run", last_run)
    state = rows.groupBy(key).agg(F.max_by("event", F.struct("at", "event_id")).alias("last"), F.min(F.when((F.col("run") == F.col("last_run")) & F.col("event").isin("up", "ok"), F.col("at"))).alias("pipeline_since"))
    return state.select(*key, F.when(F.col("last").isin("up", "ok"), 1).when(F.col("last") == "down", -1).alias("vote"), (F.col("last") == "down").alias("rejected"), (F.col("last") == "ok").alias("confirmed"), "pipeline_since")


def top_n(items: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The first n of each key."""
    return items.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("place") <= n)
