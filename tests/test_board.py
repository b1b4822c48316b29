from plotwise.plans import owner


def test_auction_deals_keep_their_score(spark):
    """No deal stands twice in one list, so that none of two scores is left to chance."""
    deals = spark.createDataFrame([("auctions", "a", 10.0), ("flip", "b", 20.0), ("flip", "c", 21.0)], "researcher string, id string, score double")
    assert sorted(map(tuple, owner.in_auctions_too(deals).collect())) == [("auctions", "a", 10.0), ("auctions", "b", 21.0), ("flip", "b", 20.0), ("flip", "c", 21.0)]
