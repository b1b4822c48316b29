"""Queries over texts and pages that are made of the listings' own numbers, in the words and the markup that sellers and sites use, each with the SQL that
gives the same rows from those numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotwise.operators import details, places
from plotwise.plans.oracle import L
from plotwise.sources import sites
from plotwise.sources.listings import listings, spread_listings

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def joined(*parts) -> Column:
    """Strings and columns one after the other; a null column counts as empty."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def whole(c: str) -> Column:
    return F.format_string("%.0f", F.col(c))


def _pages(rows: DataFrame, card: Column, head: Column, url: Column | None = None) -> DataFrame:
    """A page of cards for each ten numbers of listings, in their order."""
    n = F.col("source_no")
    made = rows.select(F.floor(n / 10).alias("page_id"), head.alias("head"), F.struct(n.alias("n"), "id", card.alias("card")).alias("c"))
    cards = F.array_join(F.transform(F.sort_array(F.collect_list("c")), lambda c: c["card"]), "\n")
    return made.groupBy("page_id", "head").agg(cards.alias("cards")).select("page_id", F.lit("https://x/").alias("url"), F.concat(F.lit("<html><body>"), "head", "cards", F.lit("</body></html>")).alias("html"))


def _page(rows: DataFrame, html: Column, url: Column | None = None) -> DataFrame:
    return rows.select(F.col("id").alias("page_id"), (F.lit("https://x/") if url is None else url).alias("url"), html.alias("html"))


@query(f"""{L} select cast(source_no as varchar) as source_id, title || ' & co' as title, round(price_eur) as price_eur, case when source_no % 4 = 0 then round(round(price_eur) * 2) end as old_price_eur,
case when source_no % 3 <> 1 then round(area_m2) end as area_m2, case when source_no % 3 = 2 then 3e0 end as rooms, city, district, source_no % 2 = 0 as promoted, 'https://img/' || source_no || '.jpg' as image from L""")
def classified_cards(spark, sf_dir):
    """SRC9, X25: title, specs, price, struck-through price, place, picture and promotion of each card of a search page."""
    n = F.col("source_no")
    specs = F.when(n % 3 == 0, joined("Парцела: 90000 m² • Изградена: ", whole("area_m2"), " m²")).when(n % 3 == 1, "Парцела: 900 m²").otherwise(joined(whole("area_m2"), " m², 3 соби"))
    old = F.when(n % 4 == 0, joined('<div class="oglasDiscount">-<s>', F.format_string("%.0f", F.round("price_eur") * 2), " €</s></div>"))
    card = joined('<div class="OglasResults', F.when(n % 2 == 0, " topAdResults"), '"><a class="SearchAdTitle" href="/AdDetails?ad=', n, '">', F.col("title"), " &amp; co<p> ", specs, ' </p></a><div class="price-mobile-box">', old, whole("price_eur"),
                  ' €</div><div class="adDate">', F.col("city"), F.when(F.col("district").isNotNull(), joined(" &gt; ", F.col("district"))), ' 23 сеп 12:32</div><img class="profilethumbs" src="//img/', n, '.jpg"></div>')
    found = sites.read_pages(_pages(listings(spark, sf_dir), card, F.lit('<div class="menu">OglasResults</div>')), "classified_cards")
    return found.select("source_id", "title", "price_eur", "old_price_eur", "area_m2", "rooms", "city", "district", "promoted", "image")


@query(f"""{L} select id as page_id, title, round(price_eur) as price_eur, case when source_no % 3 = 0 then 77e0 else round(area_m2) end as area_m2, case when source_no % 2 = 0 then 4e0 end as rooms, case when nullif(lat, 0) is not null and source_no % 5 <> 0 then round(lat, 5) end as lat,
city, district, '2024-03-05' as posted, source_no % 7 = 0 as agency, title || chr(10) || 'втор ред' as description from L""")
def classified_details(spark, sf_dir):
    """SRC10: facts, description, pin, place, date and kind of seller of each advert's page; one in five has the form's own pin."""
    n = F.col("source_no")
    fact = lambda k, v: joined('<div class="itemDescription"><div class="itemStatic">', k, '</div><div class="itemDinamic">', v, "</div></div>")
    at = F.when(n % 5 == 0, "41.98707, 21.45193").otherwise(F.format_string("%.5f, %.5f", "lat", "lng"))
    html = joined('<div class="adDetailsMobile title"><h2>', F.col("title"), '</h2></div><div class="adDetailPrice">', whole("price_eur"), " €</div>", fact("Површина", joined(whole("area_m2"), " m²")), F.when(n % 3 == 0, fact("Изградена површина", F.lit("77 m²"))), F.when(n % 2 == 0, fact("Број на соби", F.lit("4"))),
                  '<p class="oglasDescription"> ', F.col("title"), "<br/>втор   ред<br></p><script>showMap(", at, ');</script><div class="show-map"><span class="place">', F.col("city"), "<i> / </i>", F.col("district"), '</span></div>Објавен на: 05.03.2024<div class="user-name"> <b>', F.when(n % 7 == 0, "Home Invest").otherwise("Ana"), "</b></div>")
    found = sites.read_pages(_page(spread_listings(spark, sf_dir), html), "classified_details")
    return found.select("page_id", "title", "price_eur", "area_m2", "rooms", F.col("pin.lat").alias("lat"), "city", "district", F.col("posted").cast("string").alias("posted"), "agency", "description")


@query(f"""{L} select 'A' || (100 + source_no % 900000) as source_id, case when source_no % 4 = 0 then 'Novel A' || (100 + source_no % 900000) else 'Се ' || case when source_no % 2 = 0 then 'издава' else 'продава' end || ' Кат од куќа во ' || city end as title, case when source_no % 4 = 0 then 'house' else 'apartment' end as kind,
case when deal = 'rent' then 'rent' when source_no % 4 = 0 then null when source_no % 2 = 0 then 'rent' else 'sale' end as deal, case when source_no % 4 <> 0 then city end as area, case when source_no % 3 > 0 then round(price_eur) end as price_eur, round(area_m2) as area_m2 from L""")
def agency_cards(spark, sf_dir):
    """SRC11, X27, X33: the page's own deal goes before the card's words, its type after them; a price of 0 is none."""
    n = F.col("source_no")
    code = joined("A", 100 + n % 900000)
    said = F.when(n % 4 != 0, joined("Се ", F.when(n % 2 == 0, "издава").otherwise("продава"), " Кат од куќа во ", F.col("city"), " - ", code))
    card = joined('<div class="estate-card"><a class="prop-title" href="estate_view.html?id=', code, '">Шифра ', code, '</a><img class="thumb" alt="', said, '" src="a.jpg"><h4>Стан <span class="pull-right">', whole("area_m2"), " <span>m<sup>2</sup></span></span></h4>", '<div class="price">', F.when(n % 3 > 0, whole("price_eur")).otherwise("0"), " €</div></div>")
    head = joined('<input type="hidden" id="serviceType" value="', F.when(F.col("deal") == "rent", "renting"), '"><input type="hidden" id="estateType" value="house">')
    return sites.read_pages(_pages(listings(spark, sf_dir), card, head), "agency_cards").select("source_id", "title", "kind", "deal", "area", "price_eur", "area_m2")


@query(f"""{L} select id as page_id, title || ', Скопје' as title, case when source_no % 3 > 0 then round(price_eur) end as price_eur, round(area_m2) as area_m2, 2.5e0 as rooms, city as area, district as address, 'да' as lift, case when source_no % 2 = 0 then 'наместен' end as fittings, 'јави се на [phone]' as description from L""")
def agency_details(spark, sf_dir):
    """SRC12: the table of facts; a check mark means yes, and fittings go by either name."""
    n = F.col("source_no")
    row = lambda k, v: joined("<tr><td>", k, ":</td><td>", v, "</td></tr>")
    html = joined("<title>Novel | ", F.col("title"), ', Скопје, Шифра: A1</title><table class="details">', row("Цена", joined(F.when(n % 3 > 0, whole("price_eur")).otherwise("0"), " €")), row("Површина", joined(whole("area_m2"), " m2")), row("Број на соби", F.lit("2,5 соби")), row("Населба", F.col("city")), row("Локација", F.col("district")), row("Лифт", F.lit('<img src="/img/ok.png">')), F.when(n % 2 == 0, row("Ентериер", F.lit("наместен"))), '</table><div class="estate-description">јави се на 076 506 300</div>')
    found = sites.read_pages(_page(spread_listings(spark, sf_dir), html), "agency_details")
    return found.select("page_id", "title", "price_eur", "area_m2", "rooms", "area", "address", F.try_element_at("fields", F.lit("Лифт")).alias("lift"), F.try_element_at("fields", F.lit("Опрема")).alias("fittings"), "description")


@query(f"""{L}, C as (select cast(floor(source_no / 10) as bigint) as page_id, case source_no % 3 when 0 then 'Стан' when 1 then 'Куќа' else '' end as type, city, round(price_eur) as p, round(area_m2) as a, source_no, id from L),
V as (select *, case type when 'Стан' then 'apartment' when 'Куќа' then 'house' else 'other' end as kind, case when source_no % 4 = 0 then 5000e0 when source_no % 4 = 1 then null else round(p * 61 / 61.5e0) end as price_eur, case when source_no % 5 = 0 then null when source_no % 5 < 3 then '2024-06-01' else '2024-07-01' end as auction_date from C),
K as (select *, row_number() over (partition by page_id, kind, city, price_eur, a, auction_date order by source_no, id) as k from V)
select page_id, cast(source_no as varchar) as source_id, 'Bailiff sale: ' || case when type = '' then 'property' else type end || ', ' || cast(cast(a as bigint) as varchar) || ' m² — ' || city as title, kind, price_eur, case when price_eur is null then 'placeholder' end as price_note, a as area_m2, city, auction_date,
case source_no % 4 when 0 then 2 when 1 then 1 when 2 then 3 end as auction_round, case source_no % 4 when 0 then '1/6' when 1 then 'partial' end as share from K where k = 1""")
def auction_notices(spark, sf_dir):
    """SRC13, X24, U4: notices with their price in denars, or in euros in the note; of the same sale on a page, the first."""
    n = F.col("source_no")
    note = F.when(n % 4 == 0, "второ усно, 1/6 идеален дел, вредност 5.000,00 евра").when(n % 4 == 1, "1-ва усна, идеални дел од куќа").when(n % 4 == 2, "3 усна").otherwise("")
    denars = F.when(n % 4 < 2, "0").otherwise(F.regexp_replace(F.format_number(F.round("price_eur").cast("long") * 61, 0), ",", "."))
    day = F.when(n % 5 == 0, "—").when(n % 5 < 3, "01.06.2024").otherwise("01.07.2024")
    card = joined('<div class="kirm-listing"><h3 class="kirm-listing-title">', F.when(n % 3 == 0, "Стан").when(n % 3 == 1, "Куќа"), '</h3><div class="kirm-listing-sub">', F.col("city"), "</div><dl><dt>Број на оглас</dt><dd>", n, "</dd><dt>Дата на продажба</dt><dd>", day, '</dd></dl><div class="kirm-price"><b>', denars, " ден.</b> ", whole("area_m2"), ' м²</div><div class="kirm-note">', note, '</div><a href="/pdf/x.pdf">PDF</a></div>')
    found = sites.read_pages(_pages(listings(spark, sf_dir), card, F.lit("")), "auctions")
    return found.select("page_id", "source_id", "title", "kind", "price_eur", "price_note", "area_m2", "city", F.col("auction_date").cast("string").alias("auction_date"), "auction_round", "share")


@query(f"""{L} select cast(source_no as varchar) as source_id, title, case when source_no % 3 = 0 then 'weekend_house' when source_no % 3 = 1 then 'land' else 'apartment' end as kind, case when source_no % 4 = 0 then 'short_term' when source_no % 4 = 1 then 'rent' else 'sale' end as deal, case when source_no % 3 < 2 and source_no % 5 = 0 then round(round(round(price_eur) * 61.5e0) / 61.5e0, 2) else round(price_eur) end as price_eur, round(area_m2) as area_m2,
case when source_no % 3 < 2 then city end as city, coalesce(case when source_no % 3 < 2 then district end, 'улица') as address, case when nullif(lat, 0) is not null then round(lat, 4) end as lat, case when source_no % 3 < 2 then '2024-05-04' end as posted, 'https://nedviznosti.com.mk/m/1.jpg' as image, source_no % 2 = 0 as agency from
(select * replace (case when source_no % 3 = 0 then 'Викендица ' || title else title end as title) from L)""")
def portal_listings(spark, sf_dir):
    """SRC14, UD1: two in three pages have their data as embedded JSON, the others only as markup; the pin is in a script in either case."""
    n = F.col("source_no")
    title = F.when(n % 3 == 0, joined("Викендица ", F.col("title"))).otherwise(F.col("title"))
    duration = F.when(n % 4 == 0, ',"eligibleDuration":{"unitCode":"DAY"}')
    way = F.when(n % 4 < 2, "forRent").otherwise("forSale")
    ld = joined('{"@context":"https://schema.org","@type":"RealEstateListing","name":"', title, '","datePosted":"2024-05-04T10:00:00Z","image":["/m/1.jpg"],"floorSize":{"value":', whole("area_m2"), '},"offers":{"price":"', F.format_string("%.0f", F.round("price_eur") * F.when(n % 5 == 0, 61.5).otherwise(1.0)), '","priceCurrency":"', F.when(n % 5 == 0, "MKD").otherwise("EUR"), '"', duration,
                '},"address":{"addressLocality":"', F.col("city"), '","streetAddress":"', F.col("district"), '"},"additionalProperty":[{"name":"propertyType","value":"', F.when(n % 3 == 0, "house").otherwise("land"), '"},{"name":"transactionType","value":"', way, '"}]}')
    script = F.when(n % 3 < 2, joined('<script type="application/ld+json">{"@type":"Organization"}</script><script type="application/ld+json">', ld, "</script>"))
    html = joined('<html><head><meta property="og:image" content="/m/1.jpg">', script, '</head><body><nav aria-label="Breadcrumb"><a href="/oglasi/stanovi">Станови ', F.when((n % 3 == 2) & (n % 4 < 2), "издавање"), "</a></nav><h1>", title, '</h1><div><span data-testid="listing-detail-price">99 €/м²</span> ≈ ', whole("price_eur"), " € ", F.when((n % 3 == 2) & (n % 4 == 0), "дневно"),
                  "</div><section><h2>Површина</h2><dl><dt>Површина</dt><dd>", whole("area_m2"), " m²</dd></dl></section><section><h2>Локација</h2><span>улица</span></section><section><h2>Контактирај</h2><p>", F.when(n % 2 == 0, "Агенција").otherwise("Корисник"), r'</p></section><script>x("{\"location\":{\"id\":1,\"lat\":', F.format_string("%.4f", "lat"), r',\"lng\":', F.format_string("%.4f", "lng"), '}}")</script></body></html>')
    found = sites.read_pages(_page(spread_listings(spark, sf_dir), html, joined("https://nedviznosti.com.mk/oglasi/oglas/stan-skopje-", n)), "portal")
    return found.select("source_id", "title", "kind", "deal", "price_eur", "area_m2", "city", "address", F.col("pin.lat").alias("lat"), F.col("posted").cast("string").alias("posted"), "image", "agency")


def _gazetteer(spark, sf_dir) -> DataFrame:
    """Names of the nations with their region as district."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return places.normed_names(nation.select(F.col("n_name").alias("name"), F.concat(F.lit("REGION "), F.col("n_regionkey").cast("string")).alias("district")))


@query(f"""{L}, T as (select id, district, source_no % 25 as a, source_no * 7 % 25 as b, source_no % 4 as k from L),
R as (select T.*, case when k in (0, 3) then 'REGION ' || x.n_regionkey when k = 1 and x.n_regionkey = y.n_regionkey then 'REGION ' || x.n_regionkey end as named from T left join nation x on x.n_name = 'NATION_' || a left join nation y on y.n_name = 'NATION_' || b)
select id, coalesce(named, district) as district, case when named is not null then district end as district_form from R""")
def districts_from_titles(spark, sf_dir):
    """Titles that name one place, two, one twice or none, against a gazetteer of names."""
    n = F.col("source_no")
    a, b = joined("NATION_", n % 25), joined("NATION_", n * 7 % 25)
    title = F.when(n % 4 == 0, joined("Стан, ", a)).when(n % 4 == 1, joined(a, " или ", b)).when(n % 4 == 3, joined(a, "/", a, "!")).otherwise("Плац 500 м2")
    rows = listings(spark, sf_dir).withColumn("title", title).withColumn("city", F.lit("Скопје"))
    return places.fix_districts(rows.select("id", "title", "city", "district"), _gazetteer(spark, sf_dir), "Скопје").select("id", "district", "district_form")


_DIGRAPHS = ("dzh", "џ"), ("dz", "џ"), ("zh", "ж"), ("ch", "ч"), ("sh", "ш"), ("kj", "ќ"), ("gj", "ѓ"), ("lj", "љ"), ("nj", "њ")


def _spelled(word: str) -> str:
    for a, b in _DIGRAPHS:
        word = f"replace({word}, '{a}', '{b}')"
    word = f"translate({word}, 'abcdefghijklmnoprstuvz', 'абцдефгхијклмнопрстувз')"
    return f"upper(substr({word}, 1, 1)) || substr({word}, 2)"


@query(f"""{L}, W as (select id, city, district, split_part(title, ' ', 1) as w1, split_part(title, ' ', 2) as w2, source_no from L), S as (select *, {_spelled('w1')} as c1, {_spelled('w2')} as c2 from W)
select id, concat_ws(',', case when len(w1) >= 3 then c1 end, case when len(w2) >= 4 and not (len(w1) >= 3 and c1 = c2) then c2 end, case when source_no % 5 = 0 then 'Маврово' end, district, city) as candidates from S""")
def place_candidates(spark, sf_dir):
    """Names to look up, from title and text, the most exact first."""
    n = F.col("source_no")
    word = lambda i: F.initcap(F.get(F.split("title", " "), i))
    rows = spread_listings(spark, sf_dir).select("id", "city", "district", F.concat(F.lit("Се продава плац во "), word(0), F.lit(", "), word(1)).alias("title"), F.when(n % 5 == 0, "погледнете mavrovo!").alias("description"), F.lit(None).cast("string").alias("note"), F.lit("ul. 5").alias("address"))
    named = places.normed_names(spark.createDataFrame([("mavrovo", "Маврово"), ("popova sapka", "Попова Шапка")], "name string, spelled string"))
    return places.with_candidates(rows, named).select("id", F.array_join("candidates", ",").alias("candidates"))


@query(f"""{L} select id, case source_no % 6 when 1 then round(area_m2 * 0.5) when 2 then case when kind in ('house', 'weekend_house') and area_m2 > 120 then 60e0 else area_m2 end else area_m2 end as area_m2, case when source_no % 6 = 3 then 55000e0 end as stated_price, case when source_no % 6 = 4 then 900e0 end as elevation,
case when source_no % 6 = 5 then 41.1234 end as lat, source_no % 6 = 5 as sold, case when source_no % 2 = 0 then 3e0 else rooms end as rooms, case when source_no % 3 = 0 then 'Охрид' else city end as city, source_no % 4 = 0 as renovation from L""")
def detail_merge(spark, sf_dir):
    """P2, J24, SNK2: what detail pages change in their listings: usable area, house in the text, stated price, altitude, pin in the text, sold."""
    n = F.col("source_no")
    said = F.when(n % 6 == 1, joined("Корисна површина ", F.format_string("%.0f", F.col("area_m2") * 0.5), " m2")).when(n % 6 == 2, "se prodava kuka od 60 m2").when(n % 6 == 3, "Цена: 55000 €").when(n % 6 == 4, "надморска висина 900 м").when(n % 6 == 5, "GPS 41.1234, 21.4567 продадено").otherwise("")
    rows = listings(spark, sf_dir).select("id", "kind", "title", "price_eur", "area_m2", "rooms", "city", "district", F.lit(None).cast("date").alias("posted"), "source_no").dropDuplicates(["id"])
    none = lambda kind: F.lit(None).cast(kind)
    read = rows.select("id", none("string").alias("title"), F.when(n % 6 == 3, 1.0).alias("price_eur"), said.alias("description"), F.create_map(F.lit("Состојба"), F.when(n % 4 == 0, "За реновирање").otherwise("добра")).alias("fields"), none("double").alias("area_m2"), F.when(n % 2 == 0, 3.0).alias("rooms"), none("double").alias("lat"), none("double").alias("lng"),
                       F.when(n % 3 == 0, "Охрид").alias("city"), none("string").alias("district"), none("string").alias("address"), none("date").alias("posted"), F.lit(False).alias("agency"))
    out = details.merged_details(rows, read)
    return out.select("id", "area_m2", F.when(F.col("price_note") == "from_text", F.col("price_eur")).alias("stated_price"), "elevation", "lat", "sold", "rooms", "city", "renovation")


SQL["detail_merge"] = SQL["detail_merge"].replace("from L", "from (select * from L qualify row_number() over (partition by id order by price_eur) = 1)")


@query(f"""{L} select id, case when source_no % 4 = 0 and price_note is distinct from 'from_text' and (price_note = 'placeholder' or price_note = 'per_m2' or price_eur < 4000) then 40000e0 else price_eur end as price_eur, case when source_no % 4 = 0 and (price_note in ('placeholder', 'per_m2') or price_eur < 4000) then 'from_text' else price_note end as price_note,
case when source_no % 4 = 1 then 1200e0 else elevation end as elevation, case when source_no % 4 = 2 then 'звони [phone]' when source_no % 4 = 0 then 'cena 40000 evra' when source_no % 4 = 1 then '1200 m nadmorska visina' end as description from L""")
def stored_anew(spark, sf_dir):
    """Stored listings read by the present rules: a stated price, a stated altitude, contacts taken out."""
    n = F.col("source_no")
    said = F.when(n % 4 == 0, "cena 40000 evra").when(n % 4 == 1, "1200 m nadmorska visina").when(n % 4 == 2, "звони 076 506 300")
    rows = listings(spark, sf_dir).select("id", "kind", "title", "price_eur", "price_note", "deal", "elevation", F.lit("grid").alias("elevation_src"), said.alias("description"))
    return details.read_anew(rows).select("id", "price_eur", "price_note", "elevation", "description")
