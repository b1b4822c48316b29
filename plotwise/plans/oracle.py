"""The same results in SQL for another engine, over the raw tables."""

from __future__ import annotations

import re

from plotwise.functions.pricing import BAND_EDGES, SANE_PPM2
from plotwise.operators.stages import NEXT_STEP, NEXT_STEP_AUCTION, STAGES
from plotwise.sources.listings import AS_OF, LISTINGS_SQL

_TOTAL = "case when price_note = 'placeholder' then null when price_note = 'per_m2' then price_eur * nullif(area_m2, 0) else price_eur end"
_UNIT = f"(nullif({_TOTAL}, 0) / nullif(area_m2, 0))"


def unit_sql(deal: str = "deal") -> str:
    tests = " ".join(f"when kind = '{k}' and {deal} = '{d}' then {_UNIT} between {lo} and {hi}" for (k, d), (lo, hi) in SANE_PPM2.items())
    return f"case when case when {_UNIT} is null then false {tests} else true end then {_UNIT} end"


BAND = "case when nullif(area_m2, 0) is null then null " + " ".join(f"when kind = '{k}' then " + " + ".join(f"cast(area_m2 >= {e} as int)" for e in edges) for k, edges in BAND_EDGES.items()) + " end"
L = f"with L as ({LISTINGS_SQL}), P as (select *, {_TOTAL} as tp, {unit_sql()} as v, {BAND} as band from L)"


def _buckets() -> str:
    places = (("district", "city", "district", "district is not null"), ("city", "city", "null", "city is not null"), ("national", "null", "null", "true"))
    return " union all ".join(f"select kind, deal, '{lv}' as level, {c} as city, {d} as district, {b} as band, v from P where v is not null and {w} and {bw}" for lv, c, d, w in places for b, bw in (("band", "band is not null"), ("cast(null as int)", "true")))


REFS = f"{L}, B as ({_buckets()}), R as (select kind, deal, level, cast(city as varchar) as city, cast(district as varchar) as district, band, median(v) as m, count(*) as n from B group by all)"


def lookup(rows: str, deal: str = "deal", district: str = "district", mins: tuple[int, int, int] = (15, 8, 15)) -> str:
    """CTE body: rows of ``rows`` (with id, kind, city, band) with the first reference bucket that has enough samples."""
    tries = []
    for i, (level, least) in enumerate(zip(("district", "city", "national"), mins)):
        city = "x.city = R.city" if level != "national" else "true"
        dist = f"x.{district} = R.district" if level == "district" else "true"
        for banded in (1, 0):
            order = f"case when x.kind in ('land', 'house', 'weekend_house') then {i + (0 if banded else 3)} else {2 * i + (0 if banded else 1)} end"
            band = "x.band = R.band" if banded else "R.band is null"
            tries.append(f"select x.id, {order} as o, R.m, R.n, R.level, R.band from {rows} x join R on R.kind = x.kind and R.deal = {deal} and R.level = '{level}' and {city} and {dist} and {band} and R.n >= {least}")
    return f"select id, min_by(m, o) as ref_median, min_by(n, o) as ref_n, min_by(level, o) as ref_level, case when min_by(coalesce(band, -1), o) >= 0 then min_by(coalesce(band, -1), o) end as ref_band from ({' union all '.join(tries)}) group by id"


_KM = "6371 * acos(greatest(-1, least(1, sin(radians({a})) * sin(radians({c})) + cos(radians({a})) * cos(radians({c})) * cos(radians({d} - ({b}))))))"


def km(a: str, b: str, c: str, d: str) -> str:
    return _KM.format(a=a, b=b, c=c, d=d)


def c01(x: str) -> str:
    return f"least(1.0, greatest(0.0, {x}))"


DAY = f"timestamp '{AS_OF}'"
J = f"{REFS}, F as ({lookup('P', 'x.deal')}), G as (select P.*, F.ref_median, F.ref_n, F.ref_level, F.ref_band, case when F.ref_level <> 'national' then 1 - P.v / F.ref_median end as discount from P left join F using (id))"

SQL: dict[str, str] = {}
SQL["deals_below_local_median"] = f"{J} select id, kind, deal, city, district, round(v, 4) as ppm2, round(ref_median, 4) as ref_median, ref_n, ref_level, ref_band, round(discount, 4) as discount from G where discount > 0"
SQL["active_listings"] = f"{L} select id, kind, last_seen from L where last_seen >= {DAY} - interval 300 days"
SQL["market_window_rows"] = f"{L} select id, kind, deal, city, district, (price_eur) as price_eur, (area_m2) as area_m2 from L where not abroad and coalesce(price_note, '') <> 'placeholder' and last_seen >= {DAY} - interval 800 days"
SQL["pending_detail_rows"] = f"{L} select id, kind from L where detail_at is null and not abroad and last_seen >= {DAY} - interval 300 days"
SQL["stale_detail_rows"] = f"{L} select id, detail_at from L where detail_at < {DAY} - interval 60 days and not sold and last_seen >= {DAY} - interval 300 days"
SQL["prices_and_bands"] = f"{L} select id, (tp) as total, (v) as ppm2, band from P"
SQL["market_buckets"] = f"{REFS} select kind, deal, level, city, district, band, round(m, 4) as median, n from R"
SQL["market_summary"] = f"{REFS} select kind, deal, city, round(m, 4) as median, n from R where band is null and level <> 'district' and n >= 5"
SQL["market_reference"] = f"{J} select id, round(ref_median, 4) as ref_median, ref_n, ref_level, ref_band from G"
_HIGH = "kind = 'land' and deal = 'sale' and not abroad and elevation >= 700"
HIGH = f"{L}, H as (select * from P where {_HIGH}), HB as (select band, median(v) as m, count(*) as n from H where v is not null group by band), HA as (select median(v) as m, count(*) as n from H where v is not null)"
_HREF = "coalesce(case when HB.n >= 8 then HB.m end, case when HA.n >= 15 then HA.m end)"
SQL["high_plot_reference"] = f"{HIGH} select id, round({_HREF}, 4) as ref_median, coalesce(case when HB.n >= 8 then HB.n end, case when HA.n >= 15 then HA.n end) as ref_n, case when HB.n >= 8 then H.band end as ref_band from H left join HB on H.band = HB.band cross join HA"
_ROOMS = "least(4, greatest(1, cast(floor(coalesce(nullif(rooms, 0), case when nullif(area_m2, 0) is null then 2 when area_m2 < 42 then 1 when area_m2 < 65 then 2 when area_m2 < 90 then 3 else 4 end)) as int)))"
SQL["rate_calibration"] = f"{L}, N as (select {_ROOMS} as rooms, median(price_eur / (0.75 + 0.25 * 0.4)) as m, count(*) as n from L where kind = 'apartment' and deal = 'rent' and not abroad and price_note is null and price_eur between 15 and 250 group by 1), Q(rooms, prior) as (values (1, 38e0), (2, 46e0), (3, 58e0), (4, 72e0)) select rooms, round(case when coalesce(n, 0) >= 5 then greatest(prior, (n * m + 5 * prior) / (n + 5)) else prior end, 4) as rate, coalesce(n, 0) as seen from Q left join N using (rooms)"
SQL["real_age"] = f"{L} select id, case when source = 'ads' then cast(floor(((select max(source_no) from L where source = 'ads') - source_no) / 975e0) as bigint) end as id_age_days from L"
SQL["shared_pins"] = f"{L} select round(lat, 4) as lat, round(lng, 4) as lng, count(*) as n, 4 as digits from L where lat <> 0 and lng <> 0 group by 1, 2 having count(*) > 5 union all select round(lat, 5), round(lng, 5), count(*), 5 from L where lat <> 0 and lng <> 0 group by 1, 2 having count(*) > 3"
_W = lambda t: f"list_distinct(list_filter(string_split(lower({t}), ' '), lambda w: length(w) >= 3))"
DUP = f"""{L}, D as (select * from P where nullif(tp, 0) is not null and area_m2 <> 0),
E as (select a.id as a, b.id as b from D a join D b on a.kind = b.kind and a.deal = b.deal and a.city is not distinct from b.city and (b.tp > a.tp or b.tp = a.tp and b.id > a.id) and b.tp <= a.tp * 1.01 and abs(a.area_m2 - b.area_m2) <= 0.03 * a.area_m2
where not coalesce(a.district <> b.district, false) and case when a.source <> b.source then a.deal = 'sale' or coalesce(a.district = b.district, false)
else (a.deal = 'sale' and a.tp >= 30000 and a.district is not null and b.district is not null) or len(list_intersect({_W('a.title')}, {_W('b.title')})) * 1.0 / len(list_distinct(list_concat({_W('a.title')}, {_W('b.title')}))) >= 0.5 end)"""
SQL["dedupe_pairs"] = f"{DUP} select a, b from E"
CLUSTERS = DUP.replace("with L as", "with recursive L as", 1) + ", U as (select a as x, b as y from E union select b, a from E), T as (select distinct x as node, x as root from U union select U.y, T.root from T join U on U.x = T.node), C as (select node as id, min(root) as cluster from T group by 1)"
SQL["dedupe_clusters"] = f"{CLUSTERS} select id, cluster from C"
SQL["dedupe_survivors"] = f"{CLUSTERS}, S as (select P.*, coalesce(C.cluster, P.id) as k from P left join C using (id)), O as (select id, row_number() over (partition by k order by detail_at is null, source <> 'ads', source_no, id) as r, count(*) over (partition by k) - 1 as duplicates from S) select id, duplicates from O where r = 1"
SQL["dedupe_ages"] = f"{CLUSTERS}, S as (select P.*, coalesce(C.cluster, P.id) as k, case when source = 'ads' then cast(floor(((select max(source_no) from L where source = 'ads') - source_no) / 975e0) as bigint) end as age from P left join C using (id)), O as (select id, row_number() over (partition by k order by detail_at is null, source <> 'ads', source_no, id) as r, count(*) over (partition by k) - 1 as duplicates, max(age) over (partition by k) as id_age_days from S) select id, duplicates, id_age_days from O where r = 1"
SQL["pins_cleared"] = f"{L}, PN as (select round(lat, 4) as a, round(lng, 4) as b from L where lat <> 0 and lng <> 0 group by 1, 2 having count(*) > 5) select id, case when PN.a is null then lat end as lat, case when PN.a is null then lng end as lng from L left join PN on round(lat, 4) = a and round(lng, 4) = b"
SQL["exact_copies_first"] = f"{L}, M as (select kind, city, cast(floor(price_eur / 100) as bigint) as price_step, area_m2, id, source_no, row_number() over (partition by kind, city, floor(price_eur / 100), area_m2 order by source_no) as r, count(*) over (partition by kind, city, floor(price_eur / 100), area_m2) as copies from L) select kind, city, price_step, area_m2, id, copies from M where r = 1"
TOWNS = "TW as (select 'NATION_' || cast(i as varchar) as town, 41 + i * 0.05e0 as tlat, 20.5e0 + i * 0.1e0 as tlng from range(25) t(i))"
SQL["refile_nearest_town"] = f"{L}, {TOWNS}, K as (select id, L.city as filed, town, {km('lat', 'lng', 'tlat', 'tlng')} as d from L cross join TW where lat <> 0), Z as (select id, filed, min_by(town, d) as near, min(d) as dn, max(case when town = filed then d end) as df from K group by 1, 2) select id, case when dn <= 60 then near end as city, filed as city_form from Z where df > 40"
SQL["distance_to_centres"] = f"{L} select id, round({km('nullif(lat, 0)', 'nullif(lng, 0)', '41.9961', '21.4317')}, 3) as km_a, round({km('nullif(lat, 0)', 'nullif(lng, 0)', '41.1172', '20.8016')}, 3) as km_b from L"
HITS = f"{L}, {TOWNS}, NM as (select id, city, 0 as pos, 'NATION_' || cast(source_no % 25 as varchar) as name from L union all select id, city, 1, city from L union all select id, city, 2, 'NATION_0' from L), HT as (select NM.id, NM.name, NM.pos, g.tlat as plat, g.tlng as plng from NM join TW g on g.town = NM.name and cast(substr(g.town, 8) as int) % 2 = 0 join TW c on c.town = NM.city where {km('g.tlat', 'g.tlng', 'c.tlat', 'c.tlng')} <= 60), H1 as (select id, min_by(name, pos) as name, min_by(plat, pos) as plat, min_by(plng, pos) as plng, min(pos) as pos from HT group by 1)"
SQL["gazetteer_first_hit"] = f"{HITS} select id, name, pos from H1"
SQL["pin_against_place"] = f"{HITS}, PD as (select L.id, nullif(lat, 0) as la, nullif(lng, 0) as ln, plat, plng, coalesce({km('nullif(lat, 0)', 'nullif(lng, 0)', 'plat', 'plng')} > 40, false) as far from L left join H1 using (id)) select id, round(case when far then plat else la end, 4) as lat, round(case when far then plng else ln end, 4) as lng, far as pin_dropped from PD"
_CELL = "cast(cast(floor(lat * 100e0 + 0.5) as bigint) as varchar) || ',' || cast(cast(floor(lng * 100e0 + 0.5) as bigint) as varchar)"
SQL["elevation_lookup"] = f"{L}, X as (select {_CELL} as cell, max(elevation) as cell_elevation from L where lat <> 0 group by 1 having max(elevation) < 1590) select id, case when lat <> 0 then {_CELL} end as cell, cell_elevation from L left join X on X.cell = case when lat <> 0 then {_CELL} end"
#: A prime step through the order numbers: events in turn meet all orders before any comes again.
VOTE_STEP = 7919
VOTES = f"{L}, MX as (select max(l_orderkey) + 1 as span from lineitem), OWN as (select source_no, min(id) as id from L group by 1), V as (select e.event_id, e.ts as ts, 'r' || cast(e.user_id % 4 as varchar) as researcher, case when e.event_type = 'error' then -1 else 1 end as vote, e.event_type, e.value, l.id as listing_id, l.kind, l.city, l.district, l.area_m2 from events e cross join MX join OWN on OWN.source_no = (e.event_id * {VOTE_STEP} % MX.span) * 10 + 1 + e.event_id % 6 join L l on l.id = OWN.id where e.event_type in ('purchase', 'click', 'error')), LV as (select * from (select *, row_number() over (partition by researcher, listing_id order by ts desc, event_id desc) as r from V) where r = 1)"
SQL["latest_vote"] = f"{VOTES} select researcher, listing_id, vote from LV"
SQL["vote_lean"] = f"{VOTES}, Y as (select researcher, city, count(*) filter (vote > 0) as up, count(*) filter (vote < 0) as down from V group by 1, 2) select researcher, city, up, down, round((up - down) * 1e0 / (up + down + 3), 4) as lean from Y"
ITEMS = "I as (select 'r' || cast(source_no % 4 as varchar) as researcher, id, kind, city, district, area_m2 as area, source_no % 101 + 0e0 as score, source_no % 3 <> 0 as qualified from L)"
_lean = lambda c: f"(select (count(*) filter (v.vote > 0) - count(*) filter (v.vote < 0)) * 1e0 / (count(*) + 3) from LV v where v.researcher = i.researcher and v.listing_id <> i.id and {c})"
SQL["feedback_rerank"] = f"{VOTES}, {ITEMS}, DL as (select i.*, 10 * {_lean('v.district = i.district and v.city = i.city')} + 5 * {_lean('v.city = i.city')} + 5 * {_lean('v.kind = i.kind')} as delta from I i where not exists (select 1 from LV d where d.researcher = i.researcher and d.listing_id = i.id and d.vote < 0)) select researcher, id, round(case when abs(delta) >= 2 then least(100.0, greatest(0.0, round_even(score + delta, 0))) else score end, 4) as score, round(delta, 4) as delta from DL"
SQL["vote_fold"] = f"{VOTES}, EV as (select researcher, listing_id, ts, event_id, case when vote < 0 then 'down' when event_id % 7 = 0 then 'clear' when event_type = 'purchase' then 'ok' else 'up' end as event from V), LD as (select researcher, listing_id, max_by(event, (ts, event_id)) as last from EV group by 1, 2), DN as (select researcher, listing_id, max((ts, event_id)) as d from EV where event = 'down' group by 1, 2), PS as (select e.researcher, e.listing_id, min(e.ts) as since from EV e left join DN using (researcher, listing_id) where e.event in ('up', 'ok') and (DN.d is null or (e.ts, e.event_id) > DN.d) group by 1, 2) select researcher, listing_id, case when last in ('up', 'ok') then 1 when last = 'down' then -1 end as vote, last = 'down' as rejected, last = 'ok' as confirmed, since as pipeline_since from LD left join PS using (researcher, listing_id)"
SQL["facts_applied"] = f"{VOTES}, FT as (select listing_id, case when event_id % 2 = 0 then 'price' else 'area' end as field, value, ts from V where vote > 0), FL as (select listing_id, max_by(value, ts) filter (field = 'price') as p, max_by(value, ts) filter (field = 'area') as a from FT group by 1) select id, (coalesce(p, price_eur)) as price_eur, (coalesce(a, area_m2)) as area_m2 from L left join FL on FL.listing_id = L.id"
SQL["reviewed_hidden"] = f"{VOTES}, {ITEMS} select researcher, id from I i where not exists (select 1 from LV d where d.researcher = i.researcher and d.listing_id = i.id and d.vote < 0)"
SQL["known_ids"] = f"{VOTES} select id, kind from L where id in (select listing_id from V)"
SQL["top_n_per_model"] = f"{L}, {ITEMS}, RN as (select researcher, id, score, row_number() over (partition by researcher order by score desc, id) as place from I where qualified) select researcher, id, score, place from RN where place <= 5"
SQL["price_changes"] = f"{L}, PD as (select district as listing_id, last_seen as seen_at, min(price_eur) as price_eur from L where district is not null group by 1, 2), BF as (select *, lag(price_eur) over (partition by listing_id order by seen_at) as before from PD) select listing_id, seen_at, (price_eur) as price_eur, (before) as before from BF where abs(price_eur - before) > 0.5"
SQL["price_history_arrays"] = f"{L} select district, count(*) as n, (min_by(price_eur, (last_seen, id))) as first, (max_by(price_eur, (last_seen, id))) as last from L where district is not null group by 1"
TWO = f"{L}, C as (select * from L where source_no % 3 <> 0), N as (select id, title || ' new' as title, case when source_no % 4 = 0 then price_eur * 0.9e0 else price_eur end as price_eur, site_old_price, last_seen from L where source_no % 2 = 0)"
SQL["upsert_merge"] = f"{TWO} select id, case when C.id is null then N.title when N.id is not null and C.detail_at is null then coalesce(N.title, C.title) else C.title end as title, (case when C.id is null then N.price_eur when abs(N.price_eur - C.price_eur) > 0.5 then N.price_eur else C.price_eur end) as price_eur, (case when C.id is null then coalesce(N.site_old_price, N.price_eur) else C.first_price end) as first_price, C.id is null as is_new, coalesce(abs(N.price_eur - C.price_eur) > 0.5, false) as changed from C full join N using (id)"
SQL["partial_update"] = f"{TWO} select id, coalesce(N.title, C.title) as title, (case when N.id is not null then N.site_old_price else C.site_old_price end) as site_old_price, (C.price_eur) as price_eur from C left join N using (id)"
SQL["prune_cascade"] = f"{L} select id as listing_id, (price_eur) as price_eur from L where last_seen >= {DAY} - interval 400 days"
SQL["changed_urls"] = "with P as (select url, min(page_id) as page_id from pages group by 1), EN as (select url, case when page_id % 5 = 0 then '' else cast(page_id % 7 as varchar) end as lastmod from P), KN as (select url, cast(page_id % 6 as varchar) as lastmod from P where page_id % 3 <> 0) select url, EN.lastmod from EN left join KN using (url) where KN.url is null or (EN.lastmod <> '' and EN.lastmod is distinct from KN.lastmod)"
_flag = lambda k: f"case when (source_no + {k}) % 3 = 0 then 1 when (source_no + {k}) % 11 = 0 then -1 else 0 end"
SB = f"{REFS}, Q as (select *, {_flag(0)} as u0, {_flag(1)} as u1, {_flag(2)} as u2, case source_no % 3 when 0 then 'building' when 1 then 'agricultural' else 'unknown' end as land_type, case when source_no % 4 <> 0 then source_no % 240 + 0e0 end as skopje_min from P), Q2 as (select *, cast(u0 = 1 as int) + cast(u1 = 1 as int) + cast(u2 = 1 as int) as confirmed from Q)"
_AGRI = "case when land_type = 'agricultural' then 0.7 else 1.0 end"
SQL["score_land"] = f"{SB}, A as (select * from Q2 where kind = 'land' and deal = 'sale' and not abroad and area_m2 between 250 and 20000 and tp <= 170000 and (city in ('NATION_1', 'NATION_2', 'NATION_3') or elevation >= 700) and least(u0, u1, u2) >= 0), F as ({lookup('A', 'x.deal')}), S as (select A.*, case when F.ref_level <> 'national' then 1 - v / F.ref_median end as discount from A left join F using (id)) select id, round(discount, 4) as discount, confirmed, confirmed = 3 as qualified, round(100 * {c01(f'''0.30 * {c01('coalesce(discount, 0) / 0.5')} + 0.35 * (confirmed / 3.0) + case when land_type = 'building' then 0.15 else 0 end + 0.10 * case when area_m2 between 400 and 3000 then 1.0 else 0.6 end + 0.10 * case when elevation >= 700 then 1.0 else 0.6 end''')} * {_AGRI}, 4) as score from S"
SQL["score_high_plots"] = f"{SB}, H as (select * from Q2 where {_HIGH}), HB as (select band, median(v) as m, count(*) as n from H where v is not null group by band), HA as (select median(v) as m, count(*) as n from H where v is not null), S as (select H.*, 1 - v / {_HREF} as discount from H left join HB on H.band = HB.band cross join HA where tp <= 170000 and area_m2 between 200 and 20000 and least(u0, u1, u2) >= 0) select id, round(discount, 4) as discount, confirmed = 3 as qualified, round(100 * {c01(f'''0.30 * {c01('coalesce(discount, 0) / 0.5')} + 0.30 * (confirmed / 3.0) + 0.10 * case when land_type = 'building' then 1.0 else 0 end + 0.10 * case when area_m2 between 300 and 2500 then 1.0 else 0.6 end + 0.10 * case when skopje_min is null then 0.5 else {c01('(180 - skopje_min) / 120')} end + 0.10 * case when elevation <= 1500 then 1.0 else 0.7 end''')} * {_AGRI}, 4) as score from S"
SQL["score_flip"] = f"""{J}, A as (select *, source_no % 5 = 0 or coalesce(case when source_no % 2 = 0 then 1950 + source_no % 70 end < 1980, false) as heavy, case when kind <> 'apartment' then 1.5 else 1.0 end as hc from G
where kind in ('apartment', 'house', 'weekend_house') and deal = 'sale' and not abroad and v is not null and area_m2 >= 25 and tp <= 400000 and discount between 0.15 and 0.65),
A1 as (select *, area_m2 * case when heavy then 400 else 120 end as reno, ref_median * area_m2 * (1 - 0.10 * hc) as sold_for from A),
A2 as (select *, sold_for - tp - tp * 0.055 - reno - 540 - sold_for * 0.03 as gain, tp + tp * 0.055 + reno + 540 as cash from A1),
A3 as (select *, gain - greatest(0.0, gain) * 0.09 as profit from A2), A4 as (select *, profit / cash as roi from A3)
select id, round(discount, 4) as discount, round(profit, 4) as profit, round(roi, 4) as roi, round(100 * {c01(f'''0.5 * {c01('roi / 0.6')} + 0.3 * {c01('discount / 0.5')} + 0.2 * (case when ref_level = 'district' then 1.0 else 0.75 end * least(1.0, greatest(0.4, ref_n / 30.0)))''')}, 4) as score from A4 where cash <= 80000 and roi >= 0.10"""
_OFFER = "tp * case when drp >= 0.15 then 0.92e0 else 0.85e0 end"
SQL["score_motivated"] = f"""{J}, A as (select *, case when coalesce(price_note = 'per_m2' and site_old_price > 6000, false) then 1 - tp / site_old_price else 1 - price_eur / greatest(first_price, site_old_price, price_eur) end as d0, source_no % 3 as words,
case when ref_level <> 'national' and not (kind = 'house' and (detail_at is null or district is null)) then 1 - v / ref_median end as disc, coalesce(nullif(case when source_no % 2 = 0 then source_no % 500 end, 0), source_no % 90) as age from G
where deal = 'sale' and not abroad and tp >= 5000 and tp <= case when kind = 'land' then 170000 else 80000 end),
B1 as (select *, case when d0 > 0.5 or d0 < 0 then 0.0 else d0 end as drp from A)
select id, round(drp, 4) as drop, round(disc, 4) as discount, cast(floor(least(case when disc is not null then greatest({_OFFER}, ref_median * area_m2 * 0.9e0) else {_OFFER} end, tp * 0.92e0) / 100) * 100 as bigint) as offer,
round(100 * {c01(f'''0.40 * {c01('drp / 0.2')} + 0.20 * {c01('words / 2.0')} + 0.15 * {c01('age / 365.0')} + 0.25 * {c01('(coalesce(disc, 0) + 0.05) / 0.35')}''')}, 4) as score from B1 where (drp >= 0.05 or words > 0) and (disc is null or disc >= -0.25)"""
SQL["score_auction"] = f"""{REFS}, A as (select *, source_no % 12 - 2 as days, source_no % 3 + 1 as turn, {unit_sql("'sale'")} as sv from P where deal = 'sale' and source <> 'portal' and price_note is null and source_no % 10 <> 0 and kind in ('apartment', 'house', 'land')),
A1 as (select * from A where days >= 0 and tp >= 1000 and tp <= case when kind = 'land' then 170000 else 80000 end), A2 as (select *, cast(null as varchar) as no_district from A1), F as ({lookup('A2', "'sale'", 'no_district')}),
S as (select A2.*, case when F.ref_level <> 'national' then 1 - sv / F.ref_median end as discount from A2 left join F using (id))
select id, round(discount, 4) as discount, round(tp * case turn when 2 then 1.5 when 3 then 2.0 else 1.0 end, 4) as appraisal, round(100 * {c01(f'''0.55 * {c01('(coalesce(discount, 0) + 0.05) / 0.45')} + 0.15 * (turn - 1) / 2.0 + 0.15 * case when discount is not null then 1.0 else 0.3 end + 0.15 * case when days >= 3 then 1.0 else 0.6 end''')}, 4) as score from S where discount is null or discount >= -0.30"""
_DEALS = f"{L}, DE as (select *, ['airbnb', 'land', 'weekend', 'flip', 'motivated', 'auctions'][source_no % 6 + 1] as researcher, source_no % 101 as sc, source_no % 7 <> 0 as qualified, detail_at is not null as det, ['ready', 'needs_info', 'pending', 'ready'][source_no % 4 + 1] as st, source_no % 13 = 0 as warned, source_no % 3 <> 0 as below, source_no % 40 as comps, source_no % 17 = 0 as okd from L)"
SQL["rating_tiers"] = f"{_DEALS}, T0 as (select *, case when sc >= 90 then 0 when sc >= 80 then 1 when sc >= 70 then 2 when sc >= 55 then 3 else 4 end as r0, researcher in ('land', 'weekend', 'flip', 'auctions') as mk from DE), T1 as (select *, case when r0 < 2 and not (qualified and det and st not in ('needs_info', 'pending') and not warned and (not mk or below)) then 2 else r0 end as r1 from T0), T2 as (select *, case when (mk or researcher = 'airbnb') and r1 = 0 and comps < 30 then 1 else r1 end as r2 from T1), T3 as (select *, case when (mk or researcher = 'airbnb') and r2 = 1 and comps < 15 then 2 else r2 end as r3 from T2) select id, researcher, case when not qualified then greatest(r3, 3) else r3 end as rank from T3"
_ask = lambda k, u: f"case when kind = 'land' and (source_no + {k}) % 3 <> 0 then '{u}' end"
SQL["open_questions"] = f"{_DEALS}, QS as (select *, case when det then concat_ws(',', {_ask(0, 'electricity')}, {_ask(1, 'water')}, {_ask(2, 'road')}, case when kind = 'land' then case source_no % 3 when 2 then 'building_land' when 1 then 'rezoning' end end) else '' end as questions from DE) select id, questions, case when okd then 'confirmed' when questions <> '' and sc >= 45 then 'needs_info' when not qualified and questions = '' then 'pending' else 'ready' end as deal_status from QS"
_T = lambda c: f"list_distinct(list_filter(string_split(lower({c}), ' '), lambda w: length(w) >= 3))"
SQL["title_jaccard"] = f"with N as (select p_brand, p_type, min(p_name) as a, max(p_name) as b from part group by 1, 2) select p_brand, p_type, round(len(list_intersect({_T('a')}, {_T('b')})) * 1e0 / len(list_distinct(list_concat({_T('a')}, {_T('b')}))), 4) as jaccard from N"
SQL["stream_alerts_once"] = "select cast(event_id % 500 as varchar) as listing_id, cast(user_id % 4 as varchar) as researcher, min(ts) as at from events group by 1, 2"
SQL["stream_price_changes"] = "with B as (select cast(user_id as varchar) as listing_id, ts as seen_at, lag(value) over (partition by user_id order by ts, value) as before, value from events) select listing_id, seen_at, round(before, 4) as before, round(value, 4) as price_eur from B where abs(value - before) > 0.5"
_RENT = f"{L}, A as (select *, {_ROOMS} as rk, case when nullif(lat, 0) is not null and nullif(lng, 0) is not null then greatest(0.95, pow(0.95, {km('lat', 'lng', '41.9961', '21.4317')})) else 0.4 end as f, case source_no % 3 when 0 then 0.0 when 1 then 3500.0 else 1750.0 end as fit from P where kind in ('apartment', 'house') and deal = 'rent' and tp between 120 and 900)"
SQL["score_rental"] = f"""{_RENT}, A1 as (select *, 30 * (0.50 * f) as nights, [38e0, 46e0, 58e0, 72e0][rk] * (0.75 + 0.25 * f) * (30 * (0.50 * f)) as gross from A),
A2 as (select *, gross - (gross * 0.155 + (40 + 1.5 * coalesce(nullif(area_m2, 0), 55)) + 12 * case when rk >= 3 then 1.5 else 1.0 end * (nights / 3.0) + 35 + fit / 24 + 0.65 * 2 * nights + gross * 0.075) - tp as profit from A1)
select id, round(profit, 3) as profit, round(100 * {c01(f'''0.55 * {c01('profit / 300')} + 0.25 * {c01('f')} + 0.20 * {c01('profit / gross / 0.35')}''')}, 3) as score from A2 where profit >= 150 and tp * 2 + fit <= 80000"""
_PRIO = f"""{J}, PR as (select *, greatest(0e0,
case when kind in ('apartment', 'house') and deal = 'rent' and city in ('NATION_1', 'NATION_2', 'NATION_3') and price_eur between 120 and 900 then 3e0 end,
case when kind = 'land' and deal = 'sale' then case when city in ('NATION_1', 'NATION_2', 'NATION_3') or elevation >= 700 then 3.5e0 else 0.5e0 end end,
case when kind in ('apartment', 'house', 'weekend_house') and deal = 'sale' then case when v < ref_median * (1 - 0.15e0 + 0.05e0) then 2.5e0 when kind = 'weekend_house' then 0.5e0 end end,
case when deal = 'sale' and (source_no % 3 > 0 or site_old_price > price_eur) then 2e0 end) as priority from G)"""
SQL["detail_priority"] = f"{_PRIO} select id, priority from PR"
SQL["detail_queue"] = f"{_PRIO}, Q1 as (select id, priority from PR where detail_at is null and priority > 0 order by priority desc, last_seen desc, id limit 900), Q3 as (select id, priority * 0.6e0 as priority from PR where detail_at is not null and priority > 0 order by priority desc, last_seen desc, id limit 80) select * from Q1 union all select * from Q3"
_SENT = VOTES + ", DE as " + _DEALS.split(", DE as ", 1)[1]
SQL["alert_outbox"] = f"{_SENT}, OB as (select researcher, id, sc + 0e0 as score, row_number() over (partition by researcher order by sc desc, id) as place from DE where sc >= 60 and qualified and st <> 'needs_info' and not (researcher = 'flip' and id in (select listing_id from LV))) select researcher, id, score, place from OB where place <= 5"
SQL["open_leads"] = f"{_DEALS} select id, researcher, sc + 0e0 as score from DE where st = 'needs_info' order by sc desc, id limit 5"
SQL["due_steps"] = f"{L}, ST as (select id, ['new', 'offer', 'won', 'dropped'][source_no % 4 + 1] as stage, cast(date '{AS_OF}' + cast(source_no % 400 - 200 as int) as date) as due from L) select id, stage, cast(due as varchar) as due from ST where due <= date '{AS_OF}' and stage not in ('won', 'dropped') order by due, id limit 15"
SQL["bare_downvotes"] = f"{VOTES} select researcher, listing_id from LV d where vote < 0 and not exists (select 1 from V where V.vote < 0 and V.event_id % 2 = 0 and V.researcher = d.researcher and V.listing_id = d.listing_id)"
SQL["learning_suggestions"] = f"{VOTES}, SG as (select researcher, case when event_id % 2 = 0 then 'sml' else 'loc' end as reason, count(*) as n, median(area_m2) as md from V where vote < 0 group by 1, 2) select researcher, reason, n, round(case when reason = 'sml' then round_even(md / 5, 0) * 5 + 5 end, 4) as suggested from SG where n >= 3"
SQL["rejection_penalties"] = f"""{VOTES}, {ITEMS}, RJ as (select researcher, listing_id, ['sml', 'big', 'loc', 'prc', 'str'][event_id % 5 + 1] as reason, kind, city, district, area_m2 as area from V where vote < 0),
SL as (select researcher, reason, count(*) as n, list_sort(list(area))[cast(floor(count(area) / 2) as int) + 1] as lim from RJ group by 1, 2),
HP as (select i.researcher, i.id, SL.reason from I i join SL using (researcher) where (SL.reason = 'sml' and i.area <= SL.lim) or (SL.reason = 'big' and i.area >= SL.lim)
union select i.researcher, i.id, r.reason from I i join RJ r on r.researcher = i.researcher and r.listing_id <> i.id and ((r.reason = 'loc' and r.city = i.city and r.district = i.district) or (r.reason in ('prc', 'str') and r.kind = i.kind and r.city = i.city))),
HN as (select HP.*, (select count(*) from RJ r where r.researcher = HP.researcher and r.reason = HP.reason and r.listing_id <> HP.id) as n from HP)
select researcher, id, round(sum(-12e0 * n / (n + 2)), 4) as penalty from HN where n > 0 group by 1, 2"""
_step = lambda d: "case now " + " ".join("when '%s' then '%s'" % (k, v.replace("'", "''")) for k, v in d.items()) + " end"
SQL["deal_stages"] = f"""with EV as (select user_id as listing_id, ts, event_id, case when event_id % 10 = 0 then 'dropped' when event_type = 'view' then 'viewing' when event_type = 'click' then 'contacted' when event_type = 'purchase' then 'offer' when event_type = 'error' then null else 'checks' end as stage, case when event_id % 4 = 0 then 'step ' || cast(event_id as varchar) end as typed from events),
N1 as (select *, coalesce(last_value(stage ignore nulls) over (partition by listing_id order by ts, event_id rows between unbounded preceding and current row), '{STAGES[0]}') as now from EV),
N2 as (select *, now <> coalesce(lag(now) over (partition by listing_id order by ts, event_id), '{STAGES[0]}') as moved, row_number() over (partition by listing_id order by ts desc, event_id desc) as back from N1),
N3 as (select *, (select coalesce(max((m.ts, m.event_id)), (timestamp '1900-01-01', 0)) from N2 m where m.listing_id = N2.listing_id and m.moved) as since from N2 where back = 1)
select listing_id, now as stage, coalesce((select max_by(t.typed, (t.ts, t.event_id)) from EV t where t.listing_id = N3.listing_id and t.typed is not null and (t.ts, t.event_id) >= N3.since), case when listing_id % 3 = 0 then {_step(NEXT_STEP_AUCTION)} end, {_step(NEXT_STEP)}) as next_step, now <> 'dropped' as active from N3"""
SQL["exported_items"] = f"{_DEALS}, RK as (select *, row_number() over (partition by researcher order by qualified desc, sc desc, id) as place from DE) select researcher, count(*) as count, count(*) filter (qualified) as n_qualified, count(*) filter (place <= 300) as n_items, min(id) filter (place = 1) as first_id from RK group by 1"
SQL["stream_daily_counts"] = "select cast(date_trunc('day', ts) as timestamp) as day, event_type, count(*) as n from events group by 1, 2"
SQL["advert_facts"] = r"""with A as (select o_orderkey, cast(floor(o_totalprice) as bigint) as a from orders),
T as (select o_orderkey, case o_orderkey % 6 when 0 then 'Цена: ' || a || ' €, 3 соби, за реновирање' when 1 then 'prodavam za ' || (1000 + a % 9000) || 'k evra, ' || (100 + a % 3000) || 'm nadmorska visina' when 2 then 'Куќа на Халкидики, цена ' || a || ' денари'
  when 3 then '80 €/м2, надморска висина ' || (100 + a % 3000) || ' м' when 4 then '2,5 SOBI &amp; balkon, namesten, cena ' || a || ' mkd' end as t from A),
S as (select *, regexp_extract(t, '(?i)(?:цена|cena|prodavam za)[^0-9€]{0,25}?([0-9]{4,7})(k?) *(€|evra|денари|mkd)', ['n', 'k', 'u']) as p, coalesce(try_cast(regexp_extract(t, '([0-9]{3,4})m nadmorska', 1) as double), try_cast(regexp_extract(t, 'надморска висина ([0-9]{3,4})', 1) as double)) as m from T),
E as (select *, try_cast(p.n as double) * case p.k when 'k' then 1000 else 1 end / case when p.u in ('денари', 'mkd') then 61.5e0 else 1 end as v from S)
select o_orderkey, coalesce(t like '%€/м2%', false) as per_m2, coalesce(t like '%Халкидики%', false) as abroad, round(case when v between 1000 and 5000000 then v end, 4) as price, case when m between 100 and 2800 then m end as altitude,
  try_cast(replace(regexp_extract(t, '(?i)([0-9,]+) (?:соби|sobi)', 1), ',', '.') as double) as rooms, case when t like '%namesten%' then 'true' end as furnished, coalesce(t like '%реновирање%', false) as renovate from E"""
SQL["due_urls"] = f"select * from ({SQL['changed_urls']}) order by lastmod desc nulls last, url limit 150"
_RUNS = """with RU as (select event_id as id, user_id as job, ts as started, case event_type when 'error' then 'running' when 'signup' then 'failed' else 'ok' end as status,
  case when event_type = 'click' and user_id % 2 = 0 then 'full' when event_type = 'view' then 'quick' end as mode, event_id % 500 as pages from events)"""
SQL["run_status"] = f"{_RUNS} select id, job, case when status = 'running' and row_number() over (partition by job order by started desc, id desc) > 1 then 'interrupted' else status end as status from RU"
SQL["hours_since_full"] = f"""{_RUNS}, F as (select job, max(started) as at from RU where status = 'ok' and mode = 'full' group by 1), G as (select job, max(started) as at from RU where status = 'ok' and mode is null and pages > 250 group by 1)
select j.job, round((epoch_us(timestamp '2024-02-01') - epoch_us(coalesce(F.at, G.at) + interval 10 minutes)) / 3.6e9, 4) as hours from (select distinct job from RU) j left join F using (job) left join G using (job)"""
SQL["recent_runs"] = f"{_RUNS} select id, job, status, pages from RU order by id desc limit 10"
# off the ties, as the queries round
SQL.update({k: re.sub(r", ([34])\) as ", r" + 1e-9, \1) + 0 as ", v) for k, v in SQL.items()})
SQL["stream_feedback"], SQL["stream_deal_stages"] = SQL["vote_fold"], SQL["deal_stages"]
SQL["stream_expiry"] = f"{L} select id as listing_id, price_eur from L where id in (select id from L where last_seen >= {DAY} - interval 400 days)"
_SAID = f"select id, kind, city, district, 'sale' as deal, nullif(round(price_eur), 0) as price_eur, cast(null as varchar) as price_note, nullif(round(area_m2), 0) as area_m2 from L"
SQL["quick_check"] = f"""{REFS}, SA as ({_SAID}), PQ as (select *, {unit_sql()} as v, {BAND} as band from SA), F as ({lookup('PQ', 'x.deal')}), D as (select PQ.id, 1 - PQ.v / F.ref_median as discount from PQ left join F using (id))
select id, round(discount + 1e-9, 4) + 0.0 as discount, case when discount >= 0.35 then 'too good' when discount >= 0.25 then 'very cheap' when discount >= 0.15 then 'cheap' when discount >= 0 then 'fair' when discount is not null then 'dear' else 'unknown' end as verdict from D"""
SQL["stream_post_check"] = SQL["quick_check"]
SQL["stream_sitemap"] = """with EN as (select url, cast(s as bigint) as snapshot, max(case when (page_id + s) % 5 = 0 then '' else cast(page_id * (s + 1) % 3 as varchar) end) as lastmod from pages cross join range(3) r(s) where url is not null group by 1, 2),
B as (select *, row_number() over (partition by url order by snapshot) as k, last_value(nullif(lastmod, '') ignore nulls) over (partition by url order by snapshot rows between unbounded preceding and 1 preceding) as stored from EN)
select snapshot, url, lastmod from B where k = 1 or (lastmod <> '' and lastmod <> coalesce(stored, ''))"""
_LAST = "qualify row_number() over (partition by id order by last_seen desc, price_eur desc) = 1"
SQL["stream_upsert"] = f"select id, title, price_eur, first_price, cast((is_new or changed) and price_eur is not null as bigint) as n_history from ({SQL['upsert_merge'].replace(TWO, f'{TWO}, C1 as (select * from C {_LAST}), N1 as (select * from N {_LAST})').replace(' from C full join N ', ' from C1 C full join N1 N ')})"
SQL["eligible_listings"] = f"{L} select id, deal, source_no % 90 as days_listed from L where deal <> 'wanted' and not sold and source_no % 90 <= 45"
_MODEL_SQL = (("land", "score_land", "qualified"), ("weekend", "score_high_plots", "qualified"), ("flip", "score_flip", "cast(right(id, 1) as int) % 3 <> 0"), ("motivated", "score_motivated", "true"))
SQL["all_models"] = " union all ".join(f"select '{name}' as researcher, id, score, {fine} as qualified from ({SQL[q]})" for name, q, fine in _MODEL_SQL)
_CODES = "['sml', 'big', 'loc', 'prc', 'str', 'far', 'ren', 'bsm', 'old', 'nhm', 'tit', 'shr', 'agr', 'ter', 'dup']"
SQL["all_penalties"] = f"""{VOTES}, IT as (select 'r' || source_no % 4 as researcher, id, kind, city, district, area_m2 as area, ['ren', 'bsm', 'old', 'nhm', 'tit', 'shr', 'agr', 'ter', ''][source_no % 9 + 1] as says from L),
RJ as (select researcher, listing_id, {_CODES}[event_id % 15 + 1] as reason, kind, city, district, area_m2 as area from V where vote < 0),
SL as (select researcher, reason, count(*) as n, list_sort(list(area))[cast(floor(count(area) / 2) as int) + 1] as lim from RJ group by 1, 2),
HP as (select i.researcher, i.id, SL.reason from IT i join SL using (researcher) where (SL.reason = 'sml' and i.area <= SL.lim) or (SL.reason = 'big' and i.area >= SL.lim) or SL.reason = i.says
union select i.researcher, i.id, r.reason from IT i join RJ r on r.researcher = i.researcher and r.listing_id <> i.id and ((r.reason = 'loc' and r.city = i.city and r.district = i.district) or (r.reason in ('prc', 'str') and r.kind = i.kind and r.city = i.city) or (r.reason = 'far' and r.city = i.city))),
HN as (select HP.*, (select count(*) from RJ r where r.researcher = HP.researcher and r.reason = HP.reason and r.listing_id <> HP.id) as n from HP)
select researcher, id, round(sum(-12e0 * n / (n + 2)) + 1e-9, 4) + 0.0 as penalty, string_agg(reason, ',' order by reason) as reasons from HN where n > 0 group by 1, 2"""
