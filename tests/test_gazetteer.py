"""Few names are looked for in the texts themselves; many meet their runs of words in a join, with the same candidates."""

import pytest

from plotwise.operators import places
from plotwise.plans.catalog import QUERIES

SCHEMA = "id string, title string, description string, note string, address string, district string, city string"


@pytest.fixture(scope="module")
def rows(spark):
    texts = ["погледнете mavrovo!", "Маврово, Попова Шапка", "маврово-попова  шапка", "попова. шапка", "немавровоx", "", None, "mavrovomavrovo mavrovo", "MAVROVO"]
    return spark.createDataFrame([(f"i{i}", "Плац", t, None, None, None, "Охрид") for i, t in enumerate(texts)], SCHEMA)


def test_few_names_and_many_give_the_same(spark, rows):
    names = places.normed_names(spark.createDataFrame([("mavrovo", "Маврово"), ("mavrovo", "Мавровско"), ("popova sapka", "Попова Шапка"), ("nad grad plac", "x")], "name string, spelled string"))
    few, many = ({(r.id, tuple(r.candidates)) for r in places.with_candidates(rows, names, few=n).collect()} for n in (200, 0))
    assert few == many and ("i0", ("Маврово", "Мавровско", "Охрид")) in few and ("i3", ("Охрид",)) in few


def test_no_names(spark, rows):
    names = places.normed_names(spark.createDataFrame([], "name string, spelled string"))
    assert {tuple(r.candidates) for r in places.with_candidates(rows, names).collect()} == {("Охрид",)}


def test_candidates_move_no_text(spark):
    plan = QUERIES["place_candidates"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
