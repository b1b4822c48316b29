"""Market values: districts of few and of many prices, null places, and what a listing's reference costs."""

import random
from statistics import median

from plotwise.operators import market


def _rows(spark, n=1200):
    random.seed(11)
    rows = []
    for i in range(n):
        kind, deal, city = random.choice(["land", "house", "apartment", "other", None]), random.choice(["sale", "rent"]), random.choice(["A", "B", "", None])
        district = random.choice(["X", "X", "X", "Y", None, "", f"Z{i % 7}"])
        area = random.choice([None, 0.0, 30.0, 80.0, 150.0, 500.0, 2000.0])
        rows.append((str(i), kind, deal, city, district, random.choice([None, 900.0, 50000.0, round(random.random() * 90000, 2)]), random.choice([None, None, "placeholder", "per_m2"]), area))
    return spark.createDataFrame(rows, "id string, kind string, deal string, city string, district string, price_eur double, price_note string, area_m2 double")


def test_medians_do_not_depend_on_what_counts_as_few(spark):
    prices = market.unit_prices(_rows(spark)).collect()
    said = {}
    for p in prices:
        for level, city, district in ([("district", p.city, p.district)] if p.district else []) + ([("city", p.city, None)] if p.city else []) + [("national", None, None)]:
            for band in {p.band, None}:
                said.setdefault((p.kind, p.deal, level, city, district, band), []).append(p.v)
    for few in (20, 10_000):
        got = market.market_refs(_rows(spark), few).collect()
        assert len(got) == len(said)
        for r in got:
            v = said[r.kind, r.deal, r.level, r.city, r.district, r.band]
            assert r.n == len(v) and abs(r["median"] - median(v)) < 1e-9


def test_references_are_the_first_in_order(spark):
    rows = _rows(spark)
    refs = market.market_refs(rows)
    found = {(r.kind, r.deal, r.level, r.city, r.district, r.band): (r["median"], r.n) for r in refs.collect()}
    mins = dict(zip(market.LEVELS, (6, 9, 12)))
    checked = market.with_reference(rows, refs, (6, 9, 12)).withColumn("band", market.size_band()).collect()
    assert len(checked) == 1200
    for r in checked:
        city, district = r.city or None, r.district or None
        places = [("district", city, district)] * bool(district) + [("city", city, None)] * bool(city) + [("national", None, None)]
        bands = [r.band, None] if r.band is not None else [None]
        tries = [(p, b) for b in bands for p in places] if r.kind in market.SIZE_FIRST else [(p, b) for p in places for b in bands]
        want = next(((*found[r.kind, r.deal, *p, b], p[0], b) for p, b in tries if found.get((r.kind, r.deal, *p, b), (0, 0))[1] >= mins[p[0]]), (None,) * 4)
        assert (r.ref_median, r.ref_n, r.ref_level, r.ref_band) == want


def test_listings_do_not_meet_their_reference_through_a_list_of_their_keys(spark, monkeypatch):
    """The rows asked about are not made distinct in a shuffle of their own: only tables of places are written."""
    written = []
    kept = market.write_table
    monkeypatch.setattr(market, "write_table", lambda df, name: written.append(name) or kept(df, name))
    rows = _rows(spark, 200)
    market.with_reference(rows, market.market_refs(rows)).count()
    assert "asked" not in written and {"district_references", "city_references", "national_references"} <= set(written)
