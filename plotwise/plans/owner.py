"""Queries over what the owner says about deals, each with its SQL. Votes, replies and typed facts are made of the tables' own rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotwise.functions import auctions
from plotwise.operators import alerts, feedback, owner, scoring
from plotwise.operators.reasons import REASONS
from plotwise.plans import derived, oracle
from plotwise.sources.listings import listings, tables

QUERIES: dict = {}
SQL: dict = {}
CODES = ("sml", "big", "loc", "prc", "str", "far", "ren", "dup", "oth")
_CODE = "[" + ", ".join(f"'{c}'" for c in CODES) + "]"
_LABELS = "LB as (select * from (values " + ", ".join("('%s', '%s', '%s')" % (r.code, r.label.replace("'", "''"), owner.LEARNED.get(r.learn, owner.SIMILAR)) for r in REASONS) + ") t(reason, label, learned))"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def _pick(values, i):
    return F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))


_CHAT = ("undo", "up", "ok", "down", "loc", "sml", "dup", "no such reason")


@query(f"""with E as (select user_id as listing_id, 'r' || cast(event_id % 2 as varchar) as researcher, ts as tm, event_id, {list(_CHAT)!r}[event_id // 2 % 8 + 1] as event from events),
K as (select *, case when event in ('up', 'ok') then 1 when event = 'down' then -1 when event = 'undo' then 0 end as v, case when event in ('loc', 'sml', 'dup') then event when event = 'undo' then '' end as code from E),
A as (select researcher, listing_id, last(v order by tm, event_id) filter (v is not null) as v, last(code order by tm, event_id) filter (code is not null) as code, last(tm order by tm, event_id) filter (code is not null) as rat from K where v is not null or code is not null group by all),
S as (select listing_id, last(event order by tm, event_id) = 'ok' as confirmed from E where event in ('ok', 'undo') group by 1)
select researcher, listing_id, nullif(v, 0) as vote, nullif(code, '') as reason, case when code <> '' then rat end as rejected_at, coalesce(confirmed, false) as confirmed from A left join S using (listing_id)""")
def chat_votes(spark, sf_dir):
    """D22."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return owner.fold_chat(e.select(F.col("user_id").alias("listing_id"), F.concat(F.lit("r"), (F.col("event_id") % 2).cast("string")).alias("researcher"), _pick(_CHAT, F.floor(F.col("event_id") / 2) % 8).alias("event"), F.col("ts").alias("at"), "event_id"))


def _messages(spark, sf_dir):
    c = tables(spark, sf_dir, "customer")["customer"]
    model = F.when(F.col("c_custkey") % 2 == 0, "flip").otherwise("land")
    sent = c.where("c_custkey % 5 <> 0").select(F.col("c_custkey").alias("message_id"), F.floor(F.col("c_custkey") / 2).alias("listing_id"), model.alias("researcher"))
    note = F.when(F.col("c_custkey") % 2 == 0, "seen")
    turned = c.where("c_custkey % 3 = 0").select(model.alias("researcher"), F.floor(F.col("c_custkey") / 2).alias("listing_id"), F.lit("oth").alias("reason"), note.alias("note"), F.date_add(F.lit("1995-06-01").cast("date"), (F.col("c_custkey") % 500).cast("int")).cast("timestamp").alias("rejected_at"))
    return sent, turned


def _routed(spark, sf_dir):
    o = tables(spark, sf_dir, "orders")["orders"]
    a = F.floor("o_totalprice").cast("string")
    said = [F.lit("voda da, struja ne"), F.lit("Има вода и нема пат"), F.concat(F.lit("cena "), a, F.lit(" €")), F.lit("povrsina 450 m2, gradezno zemjiste"), F.lit("земјоделско, cena 32k"), F.lit("не знам"), F.lit(" цена 45.000 €, 1.200 м2 "), F.lit(None).cast("string")]
    text = F.element_at(F.array(*said), (F.col("o_orderkey") % 8 + 1).cast("int"))
    replies = o.select(F.col("o_orderkey").alias("reply_id"), F.col("o_custkey").alias("message_id"), text.alias("text"), F.col("o_orderdate").cast("timestamp").alias("at"))
    return owner.routed_replies(replies, *_messages(spark, sf_dir))


_REPLIES = """with M as (select c_custkey as message_id, c_custkey // 2 as listing_id, case when c_custkey % 2 = 0 then 'flip' else 'land' end as researcher from customer where c_custkey % 5 <> 0),
RJ as (select case when c_custkey % 2 = 0 then 'flip' else 'land' end as researcher, c_custkey // 2 as listing_id, case when c_custkey % 2 = 0 then 'seen' end as note, timestamp '1995-06-01' + to_days(cast(c_custkey % 500 as int)) as rejected_at from customer where c_custkey % 3 = 0),
FR as (select listing_id, min(rejected_at) as first from RJ group by 1),
R0 as (select o_orderkey as reply_id, o_custkey as message_id, o_orderdate as tm, o_orderkey % 8 as k, cast(floor(o_totalprice) as bigint) as a from orders),
R1 as (select R0.*, M.listing_id, M.researcher, coalesce(FR.first <= R0.tm, false) as noted,
  case k when 0 then 'voda da, struja ne' when 1 then 'Има вода и нема пат' when 2 then 'cena ' || a || ' €' when 3 then 'povrsina 450 m2, gradezno zemjiste' when 4 then 'земјоделско, cena 32k' when 5 then 'не знам' when 6 then 'цена 45.000 €, 1.200 м2' else '' end as text,
  case k when 0 then 'no' end as electricity, case k when 0 then 'yes' when 1 then 'yes' end as water, case k when 1 then 'no' end as road,
  case when k = 2 and a >= 100 then a when k = 4 then 32000 when k = 6 then 45000 end as price, case k when 3 then 450 when 6 then 1200 end as area, case k when 3 then 'building' when 4 then 'agricultural' end as land
  from R0 left join M using (message_id) left join FR using (listing_id)),
R2 as (select *, case when listing_id is not null and not noted and (k in (5, 7) or (k = 2 and a < 100)) then text end as note from R1)"""


@query(f"""{_REPLIES} select reply_id, listing_id, researcher, noted, note, {', '.join(f'case when listing_id is not null then {c} end as {c}' for c in ('electricity', 'water', 'road', 'land'))},
case when listing_id is not null then price + 0e0 end as price, case when listing_id is not null then area + 0e0 end as area from R2""")
def chat_replies(spark, sf_dir):
    """D23, J23, X28."""
    fact = lambda k: F.try_element_at("facts", F.lit(k))
    return _routed(spark, sf_dir).select("reply_id", "listing_id", "researcher", "noted", "note", *[fact(k).alias(k) for k in ("electricity", "water", "road")], fact("land_type").alias("land"), fact("price_eur").cast("double").alias("price"), fact("area_m2").cast("double").alias("area"))


@query(f"""{_REPLIES}, U as ({' union all '.join(f"select listing_id, tm, reply_id, '{f}' as field, {v} as value from R2 where {c} is not null" for f, c, v in (('electricity', 'electricity', 'electricity'), ('water', 'water', 'water'), ('road', 'road', 'road'), ('land_type', 'land', 'land'), ('price_eur', 'price', 'cast(price as varchar)'), ('area_m2', 'area', 'cast(area as varchar)'), ('note', 'note', 'note')))})
select listing_id, field, last(value order by tm, reply_id) as value from U where listing_id is not null group by 1, 2""")
def reply_overrides(spark, sf_dir):
    """D23, SNK6."""
    value = F.when(F.col("field").isin(*owner.NUMBERS), F.col("value").cast("double").cast("long").cast("string")).otherwise(F.col("value"))
    return owner.told_overrides(_routed(spark, sf_dir)).select("listing_id", "field", value.alias("value"))


@query(f"""{_REPLIES} select r.researcher, r.listing_id, case when count(x.reply_id) = 0 then any_value(r.note) else concat_ws(' / ', any_value(r.note), string_agg(x.text, ' / ' order by x.tm, x.reply_id)) end as note
from RJ r left join R2 x on x.listing_id = r.listing_id and x.noted and r.rejected_at <= x.tm group by 1, 2""")
def rejection_notes(spark, sf_dir):
    """SNK10."""
    return owner.noted_rejections(_messages(spark, sf_dir)[1], _routed(spark, sf_dir)).select("researcher", "listing_id", "note")


_FIELDS = ("electricity", "water", "road", "area_m2", "price_eur", "land_type", "note", "colour")
_VALUES = ("yes", "no", "", "unknown", "450", " 12.5e1 ", "-3", "12x", "building", "agricultural")
_EDITS = f"""with T as (select l_orderkey as edit_id, l_linenumber as pos, min(l_partkey) as p, min(l_suppkey) as s from lineitem group by 1, 2),
X as (select edit_id, pos, o_orderdate as tm, o_custkey as listing_id, {list(_FIELDS)!r}[p % 8 + 1] as field, case when (p + s) % 11 < 10 then {list(_VALUES)!r}[(p + s) % 11 + 1] end as value from T join orders on o_orderkey = edit_id),
Y as (select *, coalesce(value, '') = '' as empty, field in ('area_m2', 'price_eur') as num from X),
Z as (select *, case when num and not empty then case when value in ('450', ' 12.5e1 ') then null when value = '-3' then field || ' must be positive' else field || ' must be a number' end end as error,
  case when field in ('electricity', 'water', 'road') then case when value in ('yes', 'no') then value end when field = 'land_type' then case when value in ('building', 'agricultural') then value end when field = 'note' and not empty then value when num then case value when '450' then '450.0' when ' 12.5e1 ' then '125.0' end end as sets from Y),
W as (select *, case when num or field = 'note' then empty when field = 'land_type' then sets is null when field in ('electricity', 'water', 'road') then empty or value = 'unknown' else false end as removes from Z),
C as (select * from W where (error is not null or sets is not null or removes) and pos <= coalesce((select min(b.pos) from W b where b.edit_id = W.edit_id and b.error is not null), pos))"""


def _edits(spark, sf_dir):
    t = tables(spark, sf_dir, "lineitem", "orders")
    rows = t["lineitem"].groupBy(F.col("l_orderkey").alias("edit_id"), F.col("l_linenumber").alias("pos")).agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    rows = rows.join(t["orders"].select(F.col("o_orderkey").alias("edit_id"), F.col("o_orderdate").alias("at"), F.col("o_custkey").alias("listing_id")), "edit_id")
    v = (F.col("p") + F.col("s")) % 11
    return owner.checked_facts(rows.select("edit_id", "pos", "at", "listing_id", _pick(_FIELDS, F.col("p") % 8).alias("field"), F.when(v < 10, _pick((*_VALUES, ""), v)).alias("value")))


@query(f"{_EDITS} select edit_id, pos, listing_id, field, case when error is null then sets end as value, removes, error from C")
def typed_facts(spark, sf_dir):
    """D19."""
    return _edits(spark, sf_dir).select("edit_id", "pos", "listing_id", "field", "value", "removes", "error")


@query(f"{_EDITS}, Q as (select listing_id, field, sets, removes, row_number() over (partition by listing_id, field order by tm desc, edit_id desc, pos desc) as r from C where error is null) select listing_id, field, sets as value from Q where r = 1 and not removes")
def owner_facts(spark, sf_dir):
    """D19, SNK6."""
    return owner.current_facts(_edits(spark, sf_dir))


def _rejections(spark, sf_dir):
    v = derived.votes(spark, sf_dir).where("vote < 0 and event_id % 2 = 0")
    rows = v.select("researcher", "listing_id", _pick(CODES, F.floor(F.col("event_id") / 2) % len(CODES)).alias("reason"), F.col("kind").alias("title"), "city", "district", F.when(F.col("event_id") % 3 == 0, "too loud").alias("note"), F.col("at").alias("rejected_at"), "event_id")
    return feedback.latest(rows, ["researcher", "listing_id"], ["rejected_at", "event_id"])


_REJ = f"{oracle.VOTES}, {_LABELS}, RJ as (select * from (select researcher, listing_id, {_CODE}[event_id // 2 % {len(CODES)} + 1] as reason, kind as title, city, district, case when event_id % 3 = 0 then 'too loud' end as note, ts as rejected_at, row_number() over (partition by researcher, listing_id order by ts desc, event_id desc) as r from V where vote < 0 and event_id % 2 = 0) where r = 1)"


@query(f"""{_REJ}, AL as (select researcher, listing_id, title, reason, note, rejected_at from RJ union all select researcher, listing_id, kind, null, null, ts from LV where vote < 0 and not exists (select 1 from RJ where RJ.researcher = LV.researcher and RJ.listing_id = LV.listing_id))
select listing_id as id, researcher, title, AL.reason, coalesce(label, '{owner.NO_REASON}') as reason_label, coalesce(learned, '{owner.NOTHING}') as learned, note, rejected_at from AL left join LB on LB.reason = AL.reason""")
def rejected_deals(spark, sf_dir):
    """U3, X30, O8."""
    votes = feedback.latest(derived.votes(spark, sf_dir).select("researcher", "listing_id", "vote", F.col("kind").alias("title"), "at", "event_id"), ["researcher", "listing_id"], ["at", "event_id"])
    return owner.rejected_list(_rejections(spark, sf_dir), votes)


@query(f"{_REJ}, RC as (select researcher, reason, count(*) as n from RJ group by 1, 2) select researcher, RC.reason, n, coalesce(label, RC.reason) as label, coalesce(learned, '') as effect, row_number() over (partition by researcher order by n desc, RC.reason) as place from RC left join LB on LB.reason = RC.reason")
def learning_report(spark, sf_dir):
    """A11, O8."""
    return owner.reason_report(_rejections(spark, sf_dir))


@query(f"{_REJ}, DC as (select researcher, district, count(*) as n from RJ where reason = 'loc' and coalesce(district, '') <> '' group by 1, 2) select * from (select *, row_number() over (partition by researcher order by n desc, district) as place from DC) where place <= 5")
def bad_districts(spark, sf_dir):
    """The five worst of each researcher are the feature."""
    return owner.bad_districts(_rejections(spark, sf_dir))


@query(f"""{_REJ}, {oracle.ITEMS}, OK as (select distinct listing_id from V where event_type = 'purchase'),
FA as (select listing_id, case when event_id % 2 = 0 then 'area_m2' else 'note' end as field, last(case when event_id % 4 = 0 then 'big' else cast(cast(floor(value) as bigint) as varchar) end order by ts, event_id) as value from V where vote > 0 group by 1, 2),
FS as (select listing_id, string_agg(field || '=' || value, ',' order by field) as facts from FA where not (field = 'area_m2' and value = 'big') group by 1)
select I.researcher, I.id, case when OK.listing_id is not null then 'ok' when LV.vote > 0 then 'up' when LV.vote < 0 then 'down' end as my_vote, RJ.reason as my_reason, RJ.note as my_note, coalesce(facts, '') as my_facts
from I left join LV on LV.researcher = I.researcher and LV.listing_id = I.id left join OK on OK.listing_id = I.id left join RJ on RJ.researcher = I.researcher and RJ.listing_id = I.id left join FS on FS.listing_id = I.id""")
def annotated_deals(spark, sf_dir):
    """J11."""
    v = derived.votes(spark, sf_dir)
    told = v.where("vote > 0").select("listing_id", F.when(F.col("event_id") % 2 == 0, "area_m2").otherwise("note").alias("field"), F.when(F.col("event_id") % 4 == 0, "big").otherwise(F.floor("value").cast("long").cast("string")).alias("value"), "at", "event_id")
    facts = feedback.latest(told, ["listing_id", "field"], ["at", "event_id"])
    out = owner.annotated(derived.items(spark, sf_dir), derived.latest_votes(spark, sf_dir), v.where("event_type = 'purchase'").select("listing_id"), _rejections(spark, sf_dir), facts)
    pairs = F.transform(F.map_entries("my_facts"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.select("researcher", "id", "my_vote", "my_reason", "my_note", F.coalesce(F.array_join(pairs, ","), F.lit("")).alias("my_facts"))


MODELS = ("airbnb", "land", "weekend", "flip", "motivated", "auctions")


def in_auctions_too(deals):
    """Deals with a round score stand in the auctions besides, one more; those that are there already keep the score that they have."""
    return deals.unionByName(deals.where("score % 10 = 0 and researcher <> 'auctions'").withColumns({"researcher": F.lit("auctions"), "score": F.col("score") + 1}))


def _board(spark, sf_dir):
    deals = in_auctions_too(derived.deals(spark, sf_dir).select("researcher", "id", "score")).dropDuplicates(["researcher", "id"])
    n = F.col("source_no")
    rows = listings(spark, sf_dir).where(n % 5 == 0)
    gone = n % 7 == 0
    board = rows.select(F.when(gone, F.concat("id", F.lit("-gone"))).otherwise(F.col("id")).alias("listing_id"), F.lit("flip").alias("researcher"), F.lit("offer").alias("stage"), F.lit("call").alias("next_step"), F.lit(None).cast("date").alias("due"), F.col("last_seen").alias("updated_at"), F.when(n % 2 == 0, F.lit('{"id":"kept"}')).alias("snapshot"))
    return owner.split_board(deals, board, MODELS)


_BOARD = f"{oracle._DEALS}, DL as (select researcher, id, sc from DE union all select 'auctions', id, sc + 1 from DE where sc % 10 = 0 and researcher <> 'auctions'), BO as (select case when source_no % 7 = 0 then id || '-gone' else id end as listing_id, source_no, last_seen from L where source_no % 5 = 0)"


@query(f"""{_BOARD}, NW as (select id, min_by('{{"researcher":"' || researcher || '","id":"' || id || '","score":' || sc || '.0}}', list_position({list(MODELS)!r}, researcher)) as now from DL group by 1)
select listing_id as id, now is null as removed, coalesce(now, case when source_no % 2 = 0 then '{{"id":"kept"}}' end, '{{"id":"' || listing_id || '"}}') as item, coalesce(now, case when source_no % 2 = 0 then '{{"id":"kept"}}' end) as snapshot, last_seen as updated_at from BO left join NW on NW.id = BO.listing_id""")
def board_entries(spark, sf_dir):
    """J12, O8."""
    return _board(spark, sf_dir)[1].select("id", "removed", "item", "snapshot", "updated_at")


@query(f"{_BOARD} select researcher, id from DL where id not in (select listing_id from BO)")
def deals_off_board(spark, sf_dir):
    """What stays in the lists."""
    return _board(spark, sf_dir)[0].select("researcher", "id")


_TIER = "[" + ", ".join(f"'{sign} {label}'" for sign, label in scoring.TIER_LABELS) + "]"


@query(f"select id, researcher, rank, {_TIER}[rank + 1] as label, status from (select t.id, t.researcher, t.rank, d.sc, case when d.okd then 'ready' else d.st end as status from ({oracle.SQL['rating_tiers']}) t join (select id, sc, st, okd from ({oracle._DEALS} select * from DE)) d using (id))")
def public_deals(spark, sf_dir):
    """The lists as anyone may see them, best tier first."""
    deals = derived.deals(spark, sf_dir).withColumn("owner_note", F.lit("called"))
    rank = scoring.rating(F.col("researcher"))
    rated = deals.withColumn("rank", rank).withColumn("status", F.when(F.col("confirmed_by_owner"), "confirmed").otherwise(F.col("status")))
    return scoring.best_first(owner.public(rated)).select("id", "researcher", "rank", scoring.rating_label(F.col("rank")).alias("label"), "status")


_SUGGEST = ("sml", "agr", "rnt", "shr")
_LEAST = {"land": 40.0, "flip": 20.0, "weekend": 500.0}


@query(f"""{oracle.VOTES}, RJ as (select ['airbnb', 'land', 'flip', 'weekend'][cast(right(researcher, 1) as int) + 1] as researcher, {list(_SUGGEST)!r}[event_id // 2 % 4 + 1] as reason, case when event_id % 5 > 0 then area_m2 else 0 end as area, value as price from V where vote < 0),
GR as (select researcher, reason, count(*) as n, count(nullif(area, 0)) as given, median(nullif(area, 0)) as ma, median(nullif(price, 0)) as mp from RJ group by 1, 2)
select researcher, 'min_area' as setting, round_even(ma / 5, 0) * 5 + 5 as suggested, n from GR where reason = 'sml' and given >= 3 and round_even(ma / 5, 0) * 5 + 5 > case researcher when 'land' then 40 when 'flip' then 20 when 'weekend' then 500 end
union all select researcher, 'require_building_land', 1, n from GR where reason = 'agr' and researcher = 'land' and n >= 3
union all select researcher, 'max_rent', floor(mp - 50), n from GR where reason = 'rnt' and researcher = 'airbnb' and n >= 3 and mp - 50 < 900
union all select researcher, 'include_partial_shares', 0, n from GR where reason = 'shr'""")
def setting_suggestions(spark, sf_dir):
    """D13."""
    v = derived.votes(spark, sf_dir).where("vote < 0")
    model = _pick(("airbnb", "land", "flip", "weekend"), F.right("researcher", F.lit(1)).cast("int"))
    return owner.setting_suggestions(v.select(model.alias("researcher"), _pick(_SUGGEST, F.floor(F.col("event_id") / 2) % 4).alias("reason"), F.when(F.col("event_id") % 5 > 0, F.col("area_m2")).otherwise(0.0).alias("area"), F.col("value").alias("price")), _LEAST, 900)


_SHARES = ("Продажба на 1/6 идеален дел од стан", "2/4 (две четвртини) Идеален дел", "идеални делови", "цел стан", "")
_SAID_ROUNDS = ("Прва усна јавна продажба", "ВТОРА продажба", "3-та усна", "по втор пат, трета", "нема")


@query(f"""select o_orderkey, case o_orderkey % 5 when 0 then '1/6' when 1 then '2/4' when 2 then 'partial' end as share, case o_orderkey // 5 % 5 when 0 then 1 when 1 then 2 when 2 then 3 when 3 then 3 end as sale_round,
case when o_orderkey % 7 <> 0 then floor(o_totalprice) + 0.5 end as price from orders""")
def auction_notices(spark, sf_dir):
    """Notices made of the orders' numbers, in the words that bailiffs use."""
    o = tables(spark, sf_dir, "orders")["orders"]
    k, whole = F.col("o_orderkey"), F.reverse(F.regexp_replace(F.reverse(F.floor("o_totalprice").cast("string")), r"(\d{3})(?=\d)", "$1."))
    price = F.when(k % 7 == 0, "по договор").otherwise(F.concat(F.lit(" "), whole, F.lit(",50")))
    return o.select("o_orderkey", auctions.ownership_share(_pick(_SHARES, k % 5)).alias("share"), auctions.sale_round(F.lit(None).cast("string"), _pick(_SAID_ROUNDS, F.floor(k / 5) % 5)).alias("sale_round"), auctions.grouped_number(price).alias("price"))


@query("select o_custkey as page, coalesce(bool_and(d < timestamp '1998-01-01') filter (d is not null), false) as over from (select o_custkey, case when o_orderkey % 3 > 0 then o_orderdate end as d from orders) group by 1")
def auction_pages_over(spark, sf_dir):
    """A page for each customer; sales without a date do not count."""
    o = tables(spark, sf_dir, "orders")["orders"]
    return alerts.pages_over(o.select(F.col("o_custkey").alias("page"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderdate")).alias("auction_date")), "1998-01-01")
