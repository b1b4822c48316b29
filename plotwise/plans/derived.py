"""Tables that queries derive from the given ones: votes from events, items and deals from listings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from plotwise.operators import feedback, scoring
from plotwise.plans import oracle
from plotwise.sources.listings import listings


def votes(spark, sf_dir, events=None, rows=None):
    """Votes derived from events: purchase and click are up, error is down; the user picks a researcher, the event any order of the table. ``rows``: listings
    that are joined already."""
    e = (spark.read.parquet(f"{sf_dir}/events.parquet") if events is None else events).where("event_type in ('purchase', 'click', 'error')")
    rows = listings(spark, sf_dir) if rows is None else rows
    rows = rows.select(*[c for c in ("id", "kind", "city", "district", "area_m2", "price_eur", "source_no") if c in rows.columns])
    # the least id of a number, found where the listings then meet the events
    first = F.rank().over(Window.partitionBy("source_no").orderBy("id"))
    own = rows.withColumn("turn", first).where("turn = 1").drop("turn")
    e = e.select("event_id", F.col("ts").alias("at"), F.concat(F.lit("r"), (F.col("user_id") % 4).cast("string")).alias("researcher"), F.when(F.col("event_type") == "error", -1).otherwise(1).alias("vote"), "event_type", "value")
    span = spark.read.parquet(f"{sf_dir}/lineitem.parquet").agg((F.max("l_orderkey") + 1).alias("span"))
    order = F.col("event_id") * oracle.VOTE_STEP % F.col("span")
    e = e.crossJoin(F.broadcast(span))
    e = e.withColumn("source_no", order * 10 + 1 + F.col("event_id") % 6).drop("span")
    return e.join(own, "source_no").withColumnRenamed("id", "listing_id")


def items(spark, sf_dir):
    rows = listings(spark, sf_dir)
    return rows.select(F.concat(F.lit("r"), (F.col("source_no") % 4).cast("string")).alias("researcher"), "id", "kind", "city", "district", F.col("area_m2").alias("area"), (F.col("source_no") % 101 + 0.0).alias("score"), (F.col("source_no") % 3 != 0).alias("qualified"))


def latest_votes(spark, sf_dir):
    return feedback.latest(votes(spark, sf_dir).select("researcher", "listing_id", "vote", "kind", "city", "district", "at", "event_id"), ["researcher", "listing_id"], ["at", "event_id"])


def deals(spark, sf_dir):
    names = F.array(*map(F.lit, ("airbnb", "land", "weekend", "flip", "motivated", "auctions")))
    n = F.col("source_no")
    return listings(spark, sf_dir).select("id", "kind", F.col("area_m2").alias("area"), F.element_at(names, (n % 6 + 1).cast("int")).alias("researcher"), (n % 101 + 0.0).alias("score"), (n % 7 != 0).alias("qualified"), F.col("detail_at").isNotNull().alias("has_details"), F.element_at(F.array(*map(F.lit, ("ready", "needs_info", "pending", "ready"))), (n % 4 + 1).cast("int")).alias("status"), (n % 13 == 0).alias("warned"), F.when(n % 3 != 0, "12%").alias("below_market"), (n % 40).alias("comps"), (n % 17 == 0).alias("confirmed_by_owner"), *[F.when((n + k) % 3 == 0, "yes").otherwise("unknown").alias(u) for k, u in enumerate(scoring.UTILITIES)], F.when(n % 3 == 0, "building").when(n % 3 == 1, "agricultural").otherwise("unknown").alias("land_type"))
