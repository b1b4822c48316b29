"""The corpus pipeline: each stage against brute force or a rule, and with odd tables."""

import itertools
import re

import pytest

import corpus_pipeline as cp
from plotwise.llm.edit_dups import alike

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def odd(spark):
    """Documents with null ids and texts, an empty and a long text, repeated rows, and columns whose names clash or hold any sign."""
    long = "It was in the house of the and with that. " * 4000
    rows = [(1, "mail a@b.co now"), (None, "mail a@b.co now"), (2, None), (2, None), (3, ""), (4, long), (5, "Call +1 (555) 010-9999 at 10.0.0.1 today."), (5, "Call +1 (555) 010-9999 at 10.0.0.1 today."), (None, None)]
    frame = spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return frame.selectExpr("*", "1 as kept", "'r' as row", "2 as `a.b`", "3 as `key of the row`", "4 as `spans of the row`", "5 as quality_score", "'x' as text_md5", "6 as uid")


def test_stages_are_the_listed_operators():
    assert [name for name, _ in cp.STAGES] == ["quality", "near duplicates", "personal data", "packing"] and cp.ORACLE_SQL is None


@pytest.mark.parametrize("name", ["quality", "near duplicates", "personal data", "packing"])
def test_stage_with_odd_and_empty_tables(spark, odd, name):
    stage = dict(cp.STAGES)[name]
    got, none = stage(spark, odd, DIR), stage(spark, odd.limit(0), DIR)
    rows = got.collect()
    assert none.count() == 0 and rows
    if name == "packing":
        return
    assert got.columns == odd.columns and none.columns == odd.columns
    assert {(r["key of the row"], r["a.b"], r.row, r.kept, r.text_md5) for r in rows} == {(3, 2, "r", 1, "x")}
    if name == "near duplicates":
        assert sorted(map(str, ((r.doc_id, (r.text or "")[:20]) for r in rows))) == sorted(map(str, [(1, "mail a@b.co now"), (2, ""), (4, "It was in the house "), (5, "Call +1 (555) 010-99")]))
    if name == "personal data":
        assert len(rows) == odd.count()
        assert sorted({r.text for r in rows if r.text and len(r.text) < 99}) == ["Call [PHONE] at [IP] today.", "mail [EMAIL] now"]
        assert all(r.n_chars == len(r.text or "") for r in rows)


def test_near_duplicates_against_all_pairs(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    kept = {r.doc_id for r in cp.near_duplicates(spark, docs, DIR).collect()}
    rows = [(r.doc_id, (r.text or "")) for r in docs.collect()]
    root = {i: i for i, _ in rows}
    for (i, a), (j, b) in itertools.combinations(rows, 2):
        x, y = a.split(), b.split()
        if a == b or (x and y and min(len(x), len(y)) >= 0.79 * max(len(x), len(y)) and alike(x, y, 0.8)):
            p, q = root[i], root[j]
            root = {k: min(p, q) if v in (p, q) else v for k, v in root.items()}
    assert kept == set(root.values())


def test_run_is_the_stages_one_after_the_other(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    fine = cp.quality(spark, docs, DIR)
    assert set(map(str, fine.collect())) <= set(map(str, docs.collect())) and fine.columns == docs.columns
    pieces = cp.run(spark, DIR).toPandas()
    assert set(pieces.doc_id) <= {r.doc_id for r in fine.collect()} and pieces.groupby("sequence_id")["length"].sum().max() <= 4096
    whole = pieces.groupby("doc_id").agg(n=("length", "sum"), tokens=("doc_tokens", "first"))
    assert (whole.n == whole.tokens).all()
    for _, own in pieces.sort_values("offset").groupby("sequence_id"):
        assert (own.offset.to_numpy() == own["length"].cumsum().shift(fill_value=0).to_numpy()).all()


def test_masked_documents_hold_no_addresses(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    clean = cp.personal_data(spark, docs, DIR)
    assert clean.count() == docs.count() and clean.columns == docs.columns
    assert not [r for r in clean.collect() if re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9-]+", r.text or "")]
