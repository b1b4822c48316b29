"""The queries over all listings: none is left out at any size, and votes meet listings of the whole table."""

from pyspark.sql import functions as F

from plotwise.plans import catalog
from plotwise.sources.listings import listings

DIR = "/root/testdata/sf0.01"


def test_every_listing_is_met(spark):
    n = listings(spark, DIR).count()
    for name in ("rating_tiers", "open_questions", "facts_applied"):
        assert catalog.QUERIES[name](spark, DIR).count() == n == 60000
    assert catalog.QUERIES["exported_items"](spark, DIR).agg(F.sum("count")).first()[0] == n


def test_votes_meet_the_whole_range(spark):
    top = listings(spark, DIR).agg(F.max("source_no")).first()[0]
    orders = [int(r.listing_id.split("-")[0]) for r in catalog.QUERIES["latest_vote"](spark, DIR).select("listing_id").distinct().collect()]
    assert min(orders) < top / 10 * 0.01 and max(orders) > top / 10 * 0.99
    assert len({int(x / (top / 10) * 50) for x in orders}) >= 50 and len(orders) > 2500
