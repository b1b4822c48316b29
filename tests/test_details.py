"""Merging details, reading stored listings anew, the registries of sources, reasons and models."""

import dataclasses

from pyspark.sql import functions as F

from plotwise.operators import analysis, details, reasons
from plotwise.plans.catalog import MINS, _scored_base, as_settings
from plotwise.sources import sites

DIR = "/root/testdata/sf0.001"
LISTING = "id string, kind string, title string, price_eur double, area_m2 double, rooms double, city string, district string, posted date"
DETAIL = "id string, title string, price_eur double, description string, fields map<string,string>, area_m2 double, rooms double, lat double, lng double, city string, district string, address string, posted date, agency boolean"


def merged(spark, *cases):
    """The merged rows of cases (kind, area, description, {what else the listing or the page has}), in their order."""
    listings, pages = [("none", "land", "x", 1.0, 1.0, None, None, None, None)], []
    for i, (kind, area, description, more) in enumerate(cases):
        listings.append((str(i), kind, "Стан", more.get("price", 100_000.0), area, 2.0, "Скопје", "Центар", None))
        pages.append((str(i), None, None, description, more.get("fields"), more.get("d_area"), None, more.get("lat"), 21.5 if "lat" in more else None, None, "", "ul. 5, 076 506 300", None, None))
    rows = {r.id: r for r in details.merged_details(spark.createDataFrame(listings, LISTING), spark.createDataFrame(pages, DETAIL)).collect()}
    assert len(rows) == len(cases)
    return [rows[str(i)] for i in range(len(cases))]


def test_rules_in_their_order(spark):
    rows = merged(
        spark, ("apartment", 116.0, "116 m2: внатрешен простор 35 м2 и тераса 81 м2", {}), ("apartment", 100.0, "корисна површина од околу 60 м2", {}), ("apartment", 900.0, "стан од 90 m2", {}), ("apartment", 900.0, "голем стан", {}),
        ("house", 600.0, "Се продава куќа од 168м2", {}), ("house", 300.0, "Се продава куќа од 168м2", {}), ("land", 3000.0, "куќа од 168м2", {}), ("apartment", 50.0, None, {"d_area": 70.0}),
        ("apartment", 80.0, "Цена..20000евра", {"price": 1.0}), ("apartment", 80.0, "Цена 20000 евра", {"price": 90_000.0}),
        ("land", 800.0, "надморска висина 1100 м, 41.12345, 21.54321, продадено", {"fields": {"Тип на земјиште": "Градежно земјиште", "Состојба": "За реновирање"}}), ("apartment", 80.0, "јави се 076 506 300", {"lat": 42.0}))
    # usable area below 35 hundredths; within; beyond the largest flat twice; a house below half, above half; land; the page's own area
    assert [r.area_m2 for r in rows[:8]] == [116, 60, 90, None, 168, 300, 3000, 70]
    assert (rows[8].price_eur, rows[8].price_note, rows[8].deal) == (20000, "from_text", "sale") and rows[9].price_eur == 90_000
    r = rows[10]
    assert (r.elevation, r.elevation_src, r.lat, r.lng, r.sold, r.renovation, r.land_type) == (1100, "text", 41.12345, 21.54321, True, True, "building")
    r = rows[11]
    assert "[phone]" in r.description and "[phone]" in r.address and r.lat == 42.0 and r.district == "Центар" and r.sold is False and r.agency is False


def test_texts_are_searched_once_before_the_last_step(spark):
    merged = details.merged_details(spark.createDataFrame([], LISTING), spark.createDataFrame([], DETAIL))
    assert "nadmorska" not in merged._jdf.queryExecution().analyzed().toString()


def test_reading_anew_twice_changes_nothing(spark):
    said = ["Цена: 55000 €", "висина 900 м надморска висина, тел. 076 506 300", "", None, "cena 40000 evra"]
    rows = [(str(i), "house", "Куќа", p, note, deal, 500.0, "grid", said[i % 5]) for i, (p, note, deal) in enumerate([(1.0, "placeholder", "sale"), (9e4, None, "sale"), (5.0, "per_m2", "sale"), (None, None, "sale"), (2000.0, None, "auction"), (2000.0, None, "sale"), (1.0, None, "sale"), (7e4, None, "rent"), (3.0, None, "sale"), (9e4, None, "sale")])]
    frame = spark.createDataFrame(rows, "id string, kind string, title string, price_eur double, price_note string, deal string, elevation double, elevation_src string, description string")
    first = details.read_anew(frame)
    assert first.where("price_read").count() == 2 and first.where("altitude_read").count() == 2
    again = details.read_anew(first.drop("price_read", "altitude_read"))
    assert again.where("price_read or altitude_read").count() == 0
    assert sorted(map(str, again.drop("price_read", "altitude_read").collect())) == sorted(map(str, first.drop("price_read", "altitude_read").collect()))


def test_cards_as_they_are_meant(spark):
    cards = spark.createDataFrame([("a", "Продавам стан 076 506 300", "apartment", 1400.0, 60.0), ("b", "Куќа на Халкидики", "house", 1.0, None)], "id string, title string, kind string, price_eur double, area_m2 double")
    got = {r.id: r for r in details.normalised_cards(cards).collect()}
    assert (got["a"].title, got["a"].price_note, got["a"].deal) == ("Продавам стан [phone]", "per_m2", "sale") and not got["a"].abroad
    assert got["b"].abroad and got["b"].price_eur is None and got["b"].price_note == "placeholder"


def test_a_reason_more_without_touching_the_fold(spark):
    items = spark.createDataFrame([("flip", "x", "house", "A", "S", 50.0, "со базен", ""), ("flip", "y", "house", "A", "S", 200.0, "", None), ("flip", "z", "house", "A", None, None, None, "сутерен")], "researcher string, id string, kind string, city string, district string, area double, title string, description string")
    turned = spark.createDataFrame([("flip", "q", "pool", "land", "B", None, 9.0), ("flip", "w", "tall", "land", "B", None, 9.0), ("flip", "x", "bsm", "house", "A", "S", 50.0), ("flip", "z", "far", "house", "A", "T", None), ("land", "q", "sml", "house", "A", "S", 80.0), ("flip", "q", "dup", "house", "A", "S", 80.0)], "researcher string, listing_id string, reason string, kind string, city string, district string, area double")
    more = (reasons.Reason("pool", "Has a pool", learn="text", stems=("bazen",)), reasons.Reason("tall", "Over 100 m²", learn="rule", also=lambda: F.col("area") > 100))
    got = {r.id: (round(r.penalty, 3), r.reasons) for r in reasons.penalties(items, turned, reasons.REASONS + more).collect()}
    assert got == {"x": (-8.0, ["far", "pool"]), "y": (-8.0, ["far", "tall"]), "z": (-4.0, ["bsm"])}
    assert {r.id for r in reasons.penalties(items, turned).collect()} == {"x", "y", "z"}
    table = reasons.reason_table(spark)
    assert table.select("code").distinct().count() == 26 and table.where("researcher = 'airbnb' and code = 'rnt'").count() == 1


def test_references_are_worked_out_once_for_all_models(spark, monkeypatch):
    calls = []
    kept = analysis.market_refs
    monkeypatch.setattr(analysis, "market_refs", lambda rows: calls.append(1) or kept(rows))
    cheap = analysis.Model("cheap", "All below 1000", lambda x: x.rows.where("price_eur < 1000").select("id", F.lit(50.0).alias("score")))
    found = analysis.analyse(_scored_base(spark, DIR), dataclasses.replace(as_settings()), MINS, analysis.MODELS | {"cheap": cheap})
    n = {r.researcher: r["count"] for r in found.groupBy("researcher").count().collect()}
    assert calls == [1] and n["cheap"] > 100 and set(n) >= {"land", "motivated", "cheap"}


def test_a_site_more_and_refused_values(spark):
    sites.register(sites.Site("tiny", split=r'<li class="ad"', need="source_id", columns={
        "source_id": sites.Read((sites.source(r'data-id="(\d+)"'),)),
        "price_eur": sites.Read((sites.markup(r"<b>(.*?)</b>"), sites.markup(r"<i>(.*?)</i>")), lambda c: c.try_cast("double"), lambda v: v > 10),
    }, keep=("source_id", "price_eur")))
    pages = spark.createDataFrame([(1, "u", '<ul><li class="ad" data-id="7"><b>1</b><i>900</i></li><li class="ad"><b>50</b></li><li class="ad" data-id="8"><b>&nbsp;70</b></li></ul>'), (2, "u", None), (3, "u", ""), (4, "u", "<p>nothing</p>")], "page_id int, url string, html string")
    try:
        assert [(r.page_id, r.source_id, r.price_eur) for r in sites.read_pages(pages, "tiny").orderBy("source_id").collect()] == [(1, "7", 900.0), (1, "8", 70.0)]
    finally:
        del sites.SITES["tiny"]
    for name in sites.SITES:
        assert sites.read_pages(pages.where("page_id in (2, 3)"), name).count() in (0, 1)


def test_auction_helpers(spark):
    rows = [("1/6 идеален дел", "второ усно"), ("1/2 (една половина) идеален дел", "3-та усна"), ("идеални дел од куќа", "прва"), ("цела куќа", "")]
    got = spark.createDataFrame(rows, "note string, t string").select(sites.ownership_share(F.col("note")).alias("s"), sites.auction_round(F.col("t")).alias("r")).collect()
    assert [(r.s, r.r) for r in got] == [("1/6", 2), ("1/2", 3), ("", 1), (None, None)]
    said = ["Денес 13:00", "Скопје Вчера", "23 сеп 12:32", "5 мар", "31 фев", "x"]
    days = spark.createDataFrame([(s,) for s in said], "s string").select(sites.posted_on(F.col("s"), "2024-05-10").cast("string").alias("d")).collect()
    assert [r.d for r in days] == ["2024-05-10", "2024-05-09", "2023-09-23", "2024-03-05", None, None]
    notices = spark.createDataFrame([(1, "2024-01-01"), (1, None), (2, "2024-01-01"), (2, "2024-09-01"), (3, None)], "page_id int, d string").selectExpr("page_id", "to_date(d) as auction_date")
    assert [r.page_id for r in sites.all_past(notices, "2024-05-01").collect()] == [1]
