"""Queries over the listings from two sides join them once and write them."""

import pytest
from pyspark.sql import functions as F

from plotwise.plans import derived
from plotwise.plans.catalog import QUERIES
from plotwise.sources.listings import listings

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["all_penalties", "quick_check"])
def test_the_listings_are_joined_once(spark, name):
    assert not any("lineitem" in f for f in QUERIES[name](spark, DIR).inputFiles())


def test_votes_take_all_rows_of_the_least_id_of_a_number(spark):
    """One join finds the listing of an event and its columns; an id that comes twice counts twice, as in the SQL."""
    rows = listings(spark, DIR).select("id", "kind", "city", "district", "area_m2", "source_no")
    own = rows.groupBy("source_no").agg(F.min("id").alias("id"))
    again = rows.unionByName(rows.where("source_no % 2 = 1"))
    votes = derived.votes(spark, DIR, rows=again)
    assert "price_eur" not in votes.columns
    counted = {(r.listing_id, r.source_no): r.n for r in votes.groupBy("listing_id", "source_no", "event_id").count().groupBy("listing_id", "source_no").agg(F.min("count").alias("n")).collect()}
    least = {r.source_no: r.id for r in own.collect()}
    assert counted and all(least[n] == i and c >= 1 + n % 2 for (i, n), c in counted.items())
