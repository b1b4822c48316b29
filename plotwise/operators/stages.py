"""The stages a deal goes through, folded from ordered events, and the nested export of ranked items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Stages in order and the next step that each suggests; auctions have some of their own.
STAGES = ["interested", "contacted", "viewing", "checks", "offer", "negotiating", "won", "dropped"]
NEXT_STEP = {
    "interested": "Call the seller / agency",
    "contacted": "Book a viewing",
    "viewing": "Visit: condition, documents, utilities on site",
    "checks": "Check the property sheet (имотен лист), debts and charges on it (товари), zoning / building permit",
    "offer": "Wait for the answer — follow up in 2 days",
    "negotiating": "Agree price, deposit and notary date",
    "won": "Done 🎉",
    "dropped": "—",
}
NEXT_STEP_AUCTION = {
    "interested": "Read the official notice",
    "contacted": "Ask the bailiff for a viewing",
    "checks": "Check debts and charges (товари) and whether it's occupied",
    "offer": "Pay the deposit before the sale",
    "negotiating": "Attend the sale",
}


def default_step(stage: Column, researcher: Column) -> Column:
    """The next step that a stage suggests."""
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    return F.coalesce(F.when(researcher == "auctions", table(NEXT_STEP_AUCTION)[stage]), table(NEXT_STEP)[stage])


def fold_stages(events: DataFrame) -> DataFrame:
    """(listing_id, stage, next_step, active) after ordered events (listing_id, researcher, stage, next_step, at, event_id).

    A deal begins as interested. An unknown stage is ignored. A new stage sets its own next step, unless one is typed with it or later; a dropped
    deal is no longer active. Events of a listing are ordered by a window, which spills.
    """
    w = Window.partitionBy("listing_id").orderBy("at", "event_id")
    known = F.when(F.col("stage").isin(*STAGES), F.col("stage"))
    rows = events.withColumn("now", F.coalesce(F.last(known, True).over(w), F.lit("interested")))
    rows = rows.withColumn("moved", (F.col("now") != F.coalesce(F.lag("now").over(w), F.lit("interested"))).cast("int"))
    rows = rows.withColumn("turn", F.sum("moved").over(w))
    order = F.struct("at", "event_id")
    last = rows.groupBy("listing_id").agg(F.max_by("now", order).alias("stage"), F.max("turn").alias("turn"), F.min_by("researcher", order).alias("researcher"))
    typed = rows.where("next_step is not null").groupBy("listing_id", "turn").agg(F.max_by("next_step", order).alias("typed"))
    default = default_step(F.col("stage"), F.col("researcher"))
    out = last.join(typed, ["listing_id", "turn"], "left")
    return out.select("listing_id", "stage", F.coalesce("typed", default).alias("next_step"), (F.col("stage") != "dropped").alias("active"))


def export_items(items: DataFrame, cap: int = 300) -> DataFrame:
    """SNK7, A12: for each researcher the number of items, of qualified ones, and the first ``cap`` as an array, ready for ``write.json``.

    Items are ranked before they are gathered, so an array never holds more than ``cap``.
    """
    counts = items.groupBy("researcher").agg(F.count("*").alias("count"), F.count_if(F.col("qualified")).alias("n_qualified"))
    ranked = items.withColumn("place", F.row_number().over(Window.partitionBy("researcher").orderBy(F.col("qualified").desc(), F.desc("score"), "id"))).where(F.col("place") <= cap)
    own = [c for c in items.columns if c != "researcher"]
    tops = ranked.groupBy("researcher").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", F.struct(*own).alias("item")))), lambda x: x["item"]).alias("items"))
    return counts.join(tops, "researcher", "left")
