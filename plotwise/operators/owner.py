"""What the owner of the searches says about deals: votes and reasons by chat, replies with a seller's facts, typed facts, and the board of deals followed up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotwise.functions.text import norm, once
from plotwise.operators.market import exact_median
from plotwise.operators.reasons import REASONS, Reason

#: What a rejection for a reason teaches, by the way its registry entry learns.
LEARNED = {"size_min": "smaller deals now rank lower", "size_max": "bigger deals now rank lower", "data": "reported as a data problem", "self": "this deal only"}
SIMILAR, NO_REASON, NOTHING = "similar deals now rank lower", "no reason given", "no reason given — nothing learned"

# Words of answers, in plain Latin.
YES, NO, HAS = ("yes", "y", "da", "ima", "ok", "true", "potvrdeno"), ("no", "n", "ne", "nema", "false"), ("ima", "has")
ASKED = {"electricity": ("struja", "elektrika", "elektricna", "power", "electricity", "current"), "water": ("voda", "vodovod", "water"), "road": ("pat", "patot", "asfalt", "road", "pristap", "access")}
PRICE_SAID = r"(?U)(?:price|cena|цена|€|eur)\s*[:=]?\s*(\d[\d.,]*)\s*(k\b|илј|ilj)?"
AREA_SAID = r"(?U)(?:area|povrsina|површина|kvadratura|квадратура|size)\s*[:=]?\s*(\d[\d.,]*)"
AREA_UNIT = r"(\d[\d.,]*)\s*(?:m2|м2|m²|м²|kv|кв)"
FARMLAND, BUILDABLE, BUILD_WORD = "zemjodel|agricultur", "(?<![a-z])gradezn", "(?:building|gradez[a-z]*)"

#: Facts that may be typed, and what each may be.
CHOICES = {"electricity": ("yes", "no"), "water": ("yes", "no"), "road": ("yes", "no"), "land_type": ("building", "agricultural")}
NUMBERS = ("area_m2", "price_eur")
NOTE_LENGTH = 500
DECIMAL = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def _any(words) -> str:
    return "(?:" + "|".join(words) + ")"


def told_facts(text: Column) -> Column:
    """Facts of a reply as a map of strings, absent ones left out: yes or no for each utility, price_eur of 100 or more, area_m2 of 10 or more, and
    land_type. A null or empty text tells nothing."""
    n, raw = norm(text), F.lower(F.coalesce(text, F.lit("")))
    facts = {}
    for field, words in ASKED.items():
        w = _any(words)
        denied = n.rlike(rf"(?<![a-z])(?:{w} {_any(NO)}|{_any(NO)} {w})(?![a-z])")
        granted = n.rlike(rf"(?<![a-z]){w} {_any(YES)}(?![a-z])|(?<![a-z]){_any(HAS)} {w}(?![a-z])")
        facts[field] = F.when(denied, "no").when(granted, "yes")
    thousands = F.when(F.regexp_extract(raw, PRICE_SAID, 2) != "", 1000.0).otherwise(1.0)
    price = F.nullif(F.regexp_replace(F.regexp_extract(raw, PRICE_SAID, 1), r"\D", ""), F.lit("")).try_cast("double") * thousands
    labelled = F.regexp_extract(raw, AREA_SAID, 1)
    digits = F.regexp_replace(F.when(labelled != "", labelled).otherwise(F.regexp_extract(raw, AREA_UNIT, 1)), "[.,]+$", "")
    area = F.when(digits.rlike(r"^\d{1,3}([.,]\d{3})+$"), F.regexp_replace(digits, "[.,]", "")).otherwise(F.replace(digits, F.lit(","), F.lit("."))).try_cast("double")
    facts["price_eur"] = once(price, lambda v: F.when(v >= 100, v).cast("string"))
    facts["area_m2"] = once(area, lambda v: F.when(v >= 10, v).cast("string"))
    farm = n.rlike(rf"{BUILD_WORD} {_any(NO)}(?![a-z])|{FARMLAND}")
    facts["land_type"] = F.when(farm, "agricultural").when(n.rlike(rf"{BUILD_WORD} {_any(YES)}(?![a-z])|{BUILDABLE}"), "building")
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in facts.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def fold_chat(events: DataFrame, reasons: tuple[Reason, ...] = REASONS) -> DataFrame:
    """(researcher, listing_id, vote, reason, rejected_at, confirmed) after chat events (researcher, listing_id, event, at, event_id) in any order.

    ``event`` is up, ok, down, undo or the code of a reason; anything else is ignored. A down-vote counts at once; it becomes a rejection only
    when a reason is picked, and a later vote does not take that back: undo alone clears vote and rejection. Confirmations belong to the listing:
    ok under one researcher confirms it for all, undo under any takes it back. Two sums by key; no event meets another.
    """
    at = F.struct("at", "event_id")
    vote = F.when(F.col("event").isin("up", "ok"), 1).when(F.col("event") == "down", -1).when(F.col("event") == "undo", 0)
    code = F.when(F.col("event").isin(*[r.code for r in reasons]), F.col("event")).when(F.col("event") == "undo", "")
    known = events.select("researcher", "listing_id", "event", "at", "event_id", vote.alias("v"), code.alias("code")).where("v is not null or code is not null")
    last = lambda value, given: F.max_by(F.when(given, value), F.when(given, at))
    each = known.groupBy("researcher", "listing_id").agg(last(F.col("v"), F.col("v").isNotNull()).alias("v"), last(F.struct("code", "at"), F.col("code").isNotNull()).alias("r"))
    sure = known.where("event in ('ok', 'undo')").groupBy("listing_id").agg((F.max_by("event", at) == "ok").alias("confirmed"))
    picked = F.col("r.code") != ""
    return each.join(sure, "listing_id", "left").select("researcher", "listing_id", F.when(F.col("v") != 0, F.col("v")).alias("vote"), F.when(picked, F.col("r.code")).alias("reason"), F.when(picked, F.col("r.at")).alias("rejected_at"), F.coalesce("confirmed", F.lit(False)).alias("confirmed"))


def routed_replies(replies: DataFrame, messages: DataFrame, rejections: DataFrame) -> DataFrame:
    """D23 (J23): (reply_id, listing_id, researcher, at, text, facts, noted, note) of replies (reply_id, message_id, text, at).

    ``messages`` (message_id, listing_id, researcher) says which deal a message was about; replies to other messages have nulls and do nothing.
    ``noted``: the listing had been rejected by then, so the text is also added there; ``note``: the text, up to 500 signs, where it is neither
    that nor a fact. The first rejection of a listing decides, so replies meet one row each.
    """
    first = rejections.groupBy("listing_id").agg(F.min("rejected_at").alias("first"))
    rows = replies.select("reply_id", "message_id", F.trim(F.coalesce("text", F.lit(""))).alias("text"), "at").join(messages.select("message_id", "listing_id", "researcher"), "message_id", "left").join(first, "listing_id", "left")
    rows = rows.withColumn("facts", F.when(F.col("listing_id").isNotNull(), told_facts(F.col("text")))).withColumn("noted", F.coalesce(F.col("first") <= F.col("at"), F.lit(False)))
    return rows.withColumn("note", F.when((F.size("facts") == 0) & ~F.col("noted"), F.left("text", F.lit(NOTE_LENGTH)))).select("reply_id", "listing_id", "researcher", "at", "text", "facts", "noted", "note")


def told_overrides(routed: DataFrame) -> DataFrame:
    """D23, SNK6: (listing_id, field, value): the last value that replies gave to each field of a listing, notes included."""
    facts = routed.where("listing_id is not null").select("listing_id", "at", "reply_id", F.explode(F.map_concat("facts", F.when(F.col("note").isNotNull(), F.create_map(F.lit("note"), F.col("note"))).otherwise(F.create_map().cast("map<string,string>")))).alias("field", "value"))
    return facts.groupBy("listing_id", "field").agg(F.max_by("value", F.struct("at", "reply_id")).alias("value"))


def noted_rejections(rejections: DataFrame, routed: DataFrame) -> DataFrame:
    """SNK10: ``rejections`` (researcher, listing_id, rejected_at, note, ...) with the texts of later replies added to their note, in order, joined by ' / '.

    A note is one string in the end, so the replies to one rejection meet in one row, as they must.
    """
    said = routed.where("noted").select("listing_id", "at", "reply_id", "text")
    joined = rejections.alias("r").join(said.alias("s"), (F.col("r.listing_id") == F.col("s.listing_id")) & (F.col("r.rejected_at") <= F.col("s.at")))
    texts = F.transform(F.sort_array(F.collect_list(F.struct("s.at", "s.reply_id", "s.text"))), lambda x: x["text"])
    added = joined.groupBy("r.researcher", "r.listing_id").agg(texts.alias("texts of replies"))
    return rejections.join(added, ["researcher", "listing_id"], "left").withColumn("note", F.when(F.col("texts of replies").isNull(), F.col("note")).otherwise(F.concat_ws(" / ", "note", "texts of replies"))).drop("texts of replies")


def checked_facts(edits: DataFrame) -> DataFrame:
    """(edit_id, at, listing_id, field, value, removes, error) of typed facts ``edits`` (edit_id, pos, at, listing_id, field, value), those that count and the
    first error of each edit.

    Unknown fields and answers that are none are left out; an empty value, ``unknown`` for a utility, or a land type that is none removes the fact. Numbers
    must be plain decimals above zero: an edit ends at its first bad number, and what stood before it counts. Notes are cut to 500 signs.
    """
    value, field = F.col("value"), F.col("field")
    empty = F.coalesce(value, F.lit("")) == ""
    number, utility = field.isin(*NUMBERS), field.isin("electricity", "water", "road")
    error = F.when(number & ~empty, F.when(~value.rlike(DECIMAL), F.concat(field, F.lit(" must be a number"))).when(value.try_cast("double") <= 0, F.concat(field, F.lit(" must be positive"))))
    chosen = F.lit(False)
    for name, allowed in CHOICES.items():
        chosen = chosen | ((field == name) & F.coalesce(value.isin(*allowed), F.lit(False)))
    sets = F.when(chosen, value).when(number & ~empty, value.try_cast("double").cast("string")).when((field == "note") & ~empty, F.left(value, F.lit(NOTE_LENGTH)))
    removes = F.when(number | (field == "note"), empty).when(utility, empty | (value == "unknown")).when(field == "land_type", ~chosen)
    rows = edits.withColumns({"error": error, "sets": sets, "removes": F.coalesce(removes, F.lit(False))}).where("error is not null or sets is not null or removes")
    bad = rows.where("error is not null").groupBy("edit_id").agg(F.min("pos").alias("stop"))
    rows = rows.join(bad, "edit_id", "left").where("stop is null or pos <= stop")
    return rows.select("edit_id", "pos", "at", "listing_id", "field", F.when(F.col("error").isNull(), F.col("sets")).alias("value"), "removes", "error")


def current_facts(checked: DataFrame) -> DataFrame:
    """D19, SNK6: (listing_id, field, value): what the checked edits leave, the last one of each field first asked."""
    done = checked.where("error is null").groupBy("listing_id", "field").agg(F.max_by(F.struct("value", "removes"), F.struct("at", "edit_id", "pos")).alias("r"))
    return done.where("not r.removes").select("listing_id", "field", "r.value")


def reason_labels(spark, reasons: tuple[Reason, ...] = REASONS) -> DataFrame:
    """(reason, reason_label, learned) of every code: one row each."""
    return spark.createDataFrame([(r.code, r.label, LEARNED.get(r.learn, SIMILAR)) for r in reasons], "reason string, reason_label string, learned string")


def rejected_list(rejections: DataFrame, votes: DataFrame, reasons: tuple[Reason, ...] = REASONS) -> DataFrame:
    """(id, researcher, title, reason, reason_label, learned, note, rejected_at), newest first: rejections, and down-votes without one."""
    bare = votes.where("vote < 0").join(rejections.select("researcher", "listing_id").distinct(), ["researcher", "listing_id"], "left_anti").select("researcher", "listing_id", "title", F.col("at").alias("rejected_at"))
    rows = rejections.select("researcher", "listing_id", "title", "reason", "note", "rejected_at").unionByName(bare, allowMissingColumns=True)
    named = rows.join(F.broadcast(reason_labels(rows.sparkSession, reasons)), "reason", "left")  # as many rows as the registry has reasons
    out = named.select(F.col("listing_id").alias("id"), "researcher", "title", "reason", F.coalesce("reason_label", F.lit(NO_REASON)).alias("reason_label"), F.coalesce("learned", F.lit(NOTHING)).alias("learned"), "note", "rejected_at")
    return out.orderBy(F.desc("rejected_at"), "id", "researcher")


def annotated(deals: DataFrame, votes: DataFrame, confirmed: DataFrame, rejections: DataFrame, facts: DataFrame) -> DataFrame:
    """``deals`` (researcher, id, ...) with my_vote (ok, up, down or null), my_reason, my_note and my_facts (a map; numbers that are none are left out).

    votes: researcher, listing_id, vote; confirmed: listing_id; rejections: researcher, listing_id, reason, note; facts: listing_id, field, value; one row
    for each key. All four are joined by key.
    """
    sane = facts.where(~F.col("field").isin(*NUMBERS) | F.coalesce(F.col("value").rlike(DECIMAL), F.lit(False)))
    told = sane.groupBy(F.col("listing_id").alias("id")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("field", "value")))).alias("my_facts"))
    key = ["researcher", "id"]
    rows = deals.join(votes.select("researcher", F.col("listing_id").alias("id"), F.col("vote").alias("own vote")), key, "left")
    rows = rows.join(confirmed.select(F.col("listing_id").alias("id"), F.lit(True).alias("own ok")).distinct(), "id", "left")
    rows = rows.join(rejections.select("researcher", F.col("listing_id").alias("id"), F.col("reason").alias("my_reason"), F.col("note").alias("my_note")), key, "left").join(told, "id", "left")
    return rows.withColumn("my_vote", F.when(F.col("own ok"), "ok").when(F.col("own vote") > 0, "up").when(F.col("own vote") < 0, "down")).drop("own vote", "own ok")


def split_board(deals: DataFrame, board: DataFrame, order: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(deals that stay in the lists, the board with its deals).

    ``board`` (listing_id, researcher, stage, next_step, due, updated_at, snapshot) holds what is followed up; its listings leave the lists of all
    researchers. Each entry carries the deal as it is now, of the first researcher in ``order`` that has it, as JSON; else the snapshot saved before, else
    its bare id. ``removed``: no researcher has it now. The ``snapshot`` column is what to save.
    """
    ids = board.select(F.col("listing_id").alias("id")).distinct()
    kept = deals.join(ids, "id", "left_anti")
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col("researcher")), F.lit(0)), F.lit(len(order) + 1))
    now = deals.join(ids, "id", "left_semi").groupBy(F.col("id").alias("listing_id")).agg(F.min_by(F.to_json(F.struct(*deals.columns)), F.struct(place, "researcher")).alias("now"))
    rows = board.join(now, "listing_id", "left").withColumn("snapshot", F.coalesce("now", "snapshot"))
    out = rows.withColumns({"removed": F.col("now").isNull(), "item": F.coalesce("snapshot", F.to_json(F.struct(F.col("listing_id").alias("id"))))})
    return kept, out.select(F.col("listing_id").alias("id"), "researcher", "stage", "next_step", "due", "updated_at", "removed", "item", "snapshot").orderBy(F.desc("updated_at"), "id")


def public(deals: DataFrame) -> DataFrame:
    """Deals as anyone may see them: a confirmed one looks ready, and nothing that the owner said is left."""
    own = [c for c in ("owner_note", "my_vote", "my_reason", "my_note", "my_facts") if c in deals.columns]
    return deals.withColumn("status", F.when(F.col("status") == "confirmed", "ready").otherwise(F.col("status"))).drop(*own)


def reason_report(rejections: DataFrame, reasons: tuple[Reason, ...] = REASONS) -> DataFrame:
    """(researcher, reason, n, label, effect, place): how often each reason was given, the most frequent first."""
    counts = rejections.groupBy("researcher", "reason").agg(F.count("*").alias("n"))
    named = counts.join(F.broadcast(reason_labels(counts.sparkSession, reasons)), "reason", "left")
    place = F.row_number().over(Window.partitionBy("researcher").orderBy(F.desc("n"), "reason"))
    return named.select("researcher", "reason", "n", F.coalesce("reason_label", "reason").alias("label"), F.coalesce("learned", F.lit("")).alias("effect"), place.alias("place"))


def bad_districts(rejections: DataFrame, most: int = 5) -> DataFrame:
    """(researcher, district, n, place): the districts most often rejected for their location. Counted before they are ranked."""
    counts = rejections.where("reason = 'loc' and coalesce(district, '') <> ''").groupBy("researcher", "district").agg(F.count("*").alias("n"))
    return counts.withColumn("place", F.row_number().over(Window.partitionBy("researcher").orderBy(F.desc("n"), "district"))).where(F.col("place") <= most)


def setting_suggestions(rejections: DataFrame, least_areas: dict[str, float], most_rent: float, building_only: bool = False, partial_shares: bool = True, least: int = 3) -> DataFrame:
    """(researcher, setting, suggested, n): settings that rejections (researcher, reason, area, price) speak for, beyond what is set.

    ``least_areas``: the least area set by researcher; it goes five above the median of what was too small, in fives. Rents: fifty below the median of what
    was too high. Zeros and nulls count neither for a median nor for the areas needed, but a rent needs only rejections. Medians are exact.
    """
    key = ["researcher", "reason"]
    n = rejections.groupBy(key).agg(F.count("*").alias("n"))
    said = rejections.where("reason in ('sml', 'rnt')").select(*key, F.when(F.col("reason") == "sml", F.nullif("area", F.lit(0.0))).otherwise(F.nullif("price", F.lit(0.0))).alias("v"))
    rows = n.join(exact_median(said, key, "v").withColumnRenamed("n", "given"), key, "left")
    current = F.create_map(*[F.lit(x) for k, v in least_areas.items() for x in (k, float(v))])
    area, rent = F.bround(F.col("median") / 5) * 5 + 5, F.col("median") - 50
    rules = {
        "min_area": ((F.col("reason") == "sml") & (F.col("given") >= least) & (area > F.try_element_at(current, F.col("researcher"))), area),
        "require_building_land": ((F.col("reason") == "agr") & (F.col("researcher") == "land") & (F.col("n") >= least) & F.lit(not building_only), F.lit(1.0)),
        "max_rent": ((F.col("reason") == "rnt") & (F.col("researcher") == "airbnb") & (F.col("n") >= least) & (rent < most_rent), F.floor(rent).cast("double")),
        "include_partial_shares": ((F.col("reason") == "shr") & F.lit(partial_shares), F.lit(0.0)),
    }
    found = F.array_compact(F.array(*[F.when(fits, F.struct(F.lit(name).alias("setting"), value.alias("suggested"))) for name, (fits, value) in rules.items()]))
    return rows.select("researcher", "n", F.explode(found).alias("s")).select("researcher", "s.setting", "s.suggested", "n")
