"""What to read, to send and to be reminded of: work lists and outbox tables, no transport."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotwise.functions.pricing import ppm2
from plotwise.operators.market import exact_median


def detail_priority(home_cities: tuple[str, ...], rent_range: tuple[float, float], min_elevation: float = 700, least_discount: float = 0.15, budget: float = 80000) -> Column:
    """How much a listing's detail page may matter: the greatest of the rules that apply. Needs ref_median and urgent_words."""
    kind, deal, price, unit = F.col("kind"), F.col("deal"), F.nullif("price_eur", F.lit(0.0)), ppm2()
    here, built = F.col("city").isin(*home_cities), kind.isin("apartment", "house", "weekend_house")
    region = here | (F.coalesce("elevation", F.lit(0.0)) >= min_elevation)
    cheap = F.coalesce(unit < F.col("ref_median") * (1 - least_discount + 0.05), F.lit(False))
    rules = [
        F.when(kind.isin("apartment", "house") & (deal == "rent") & here & price.between(*map(float, rent_range)), 3.0),
        F.when((kind == "apartment") & (deal == "short_term") & here, 1.5),
        F.when((kind == "land") & (deal == "sale"), F.when(region, F.when(price.isNotNull(), 3.5).otherwise(2.5)).otherwise(0.5)),
        F.when(built & (deal == "sale"), F.when(cheap, 2.5).when(kind == "weekend_house", 0.5)),
        F.when(kind.isin("house", "weekend_house") & (deal == "sale") & (F.coalesce("area_m2", F.lit(0.0)) == 0) & (price <= budget), 1.0),
        F.when((deal == "sale") & ((F.col("urgent_words") > 0) | (F.coalesce("site_old_price", F.lit(0.0)) > F.coalesce("price_eur", F.lit(0.0)))), 2.0),
    ]
    return F.greatest(F.lit(0.0), *rules)


def detail_queue(pending: DataFrame, stale: DataFrame, budget: int, stale_budget: int) -> DataFrame:
    """U1 + O4: the most promising pages; those read before count 0.6 and have a quota of their own. Needs priority, last_seen, id."""
    order = [F.desc("priority"), F.desc("last_seen"), "id"]
    again = stale.withColumn("priority", F.col("priority") * 0.6).where("priority > 0").orderBy(*order).limit(stale_budget)
    return pending.where("priority > 0").orderBy(*order).limit(budget).unionByName(again)


def alert_outbox(items: DataFrame, ledger: DataFrame, least: float = 60, each: int = 5) -> DataFrame:
    """D15 (J8, W1): for each researcher the best qualified items without open questions that were not sent before."""
    fresh = items.where((F.col("score") >= least) & F.col("qualified") & (F.col("status") != "needs_info")).join(ledger.select("researcher", "id"), ["researcher", "id"], "left_anti")
    return fresh.withColumn("place", F.row_number().over(Window.partitionBy("researcher").orderBy(F.desc("score"), "id"))).where(F.col("place") <= each)


def open_leads(items: DataFrame, most: int = 5) -> DataFrame:
    """The best items with open questions over all researchers, each listing once."""
    best = items.where("status = 'needs_info'").groupBy("id").agg(F.max_by("researcher", F.struct("score", "researcher")).alias("researcher"), F.max("score").alias("score"))
    return best.orderBy(F.desc("score"), "id").limit(most)


def due_steps(pipeline: DataFrame, as_of: str, most: int = 15) -> DataFrame:
    """Steps that are due and still open, earliest first. Needs id, stage, due."""
    return pipeline.where((F.col("due") <= F.lit(as_of).cast("date")) & ~F.col("stage").isin("won", "dropped")).orderBy("due", "id").limit(most)


def bare_downvotes(votes: DataFrame, rejections: DataFrame) -> DataFrame:
    """Down-votes for which no reason was given. Votes: researcher, listing_id, vote."""
    return votes.where("vote < 0").join(rejections.select("researcher", "listing_id").distinct(), ["researcher", "listing_id"], "left_anti").select("researcher", "listing_id")


def suggestions(rejections: DataFrame, least: int = 3) -> DataFrame:
    """(researcher, reason, n, suggested): a larger minimum area where several were too small (five above the median, in fives)."""
    counts = rejections.groupBy("researcher", "reason").agg(F.count("*").alias("n"))
    found = counts.join(exact_median(rejections, ["researcher", "reason"], "area").drop("n"), ["researcher", "reason"], "left")
    step = F.bround(F.col("median") / 5) * 5 + 5
    return found.where(F.col("n") >= least).select("researcher", "reason", "n", F.when(F.col("reason") == "sml", step).alias("suggested"))


def pages_over(notices: DataFrame, as_of: str) -> DataFrame:
    """(page, over): whether all dated sales on a page lie before the day of analysis, and there is one. Needs page, auction_date."""
    return notices.groupBy("page").agg(F.coalesce(F.bool_and(F.col("auction_date") < F.lit(as_of).cast("date")), F.lit(False)).alias("over"))
