"""Operators 11 to 13 against brute force, SQL and held-out accuracy, and their edge cases."""

import functools
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from plotwise.llm import conversation_repair as cr
from plotwise.llm import hard_negatives as hn
from plotwise.llm import toxicity as tx

DIR = "/root/testdata/sf0.001"
ROWS = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """(cost, initials) of the cheapest edits of rows (initial, must go, truncated), by trying all."""

    @functools.lru_cache(None)
    def go(i, state, inserted):
        out = [(0, "")] if i == len(rows) and state in (cr.START, cr.ASSISTANT) else []
        step = lambda letter, cost, rest: out.append((cost + rest[0], letter + rest[1])) if rest else None
        to = cr.NEXT[state][cr.WANTED[state][0]]
        if inserted < 3:
            step("I", 5, go(i, to, inserted + 1))
        if i < len(rows):
            initial, must_go, cut = rows[i]
            step("D", 2, go(i + 1, state, 0))
            if not must_go:
                if initial in cr.NEXT[state]:
                    step("K", 5 * cut, go(i + 1, cr.NEXT[state][initial], 0))
                step("R", 1 + 5 * cut, go(i + 1, to, 0))
        return min(out) if out else None

    return go(0, cr.START, 0)


def test_repair_is_the_cheapest_and_least_of_all_edits():
    r = random.Random(7)
    for _ in range(4000):
        rows = [(r.choice("suaxua"), r.random() < 0.15, r.random() < 0.2) for _ in range(r.randint(0, 11))]
        search = cr.Repair()
        edits = [e for row in rows for e in search.push((*row, None))] + search.finish()
        cost = sum(cr.COSTS[e.letter] + (5 if e.row and e.row[2] and e.letter != "D" else 0) for e in edits)
        assert (cost, "".join(e.letter for e in edits)) == cheapest(rows), rows


def test_repair_holds_only_what_is_unsettled():
    r = random.Random(3)
    search, most = cr.Repair(), 0
    for _ in range(50_000):
        search.push((r.choice("ua"), r.random() < 0.05, r.random() < 0.05, None))
        most = max(most, search.held)
    assert most < 400


def by_hand(rows):
    """What op11 asks for, from the words of its contract."""
    kept = {c: [] for c in {r[0] for r in rows}}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(x for x in text if x not in ".!?") if kind == 2 else text
        kept[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = {}
    for conv, own in kept.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
            seen.add((role, text))
        turns = {r[0] for r in own if r[0] is not None}
        cost, audit = cheapest([(r[1][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(own, faults)])
        lines, at, last = [], 0, ""
        for letter in audit:
            wanted = "assistant" if last == "u" else "user"
            if letter == "I":
                lines.append(f"{wanted}:")
            else:
                role = own[at][1] if letter == "K" else wanted
                lines += [f"{role}:{own[at][2]}"] if letter != "D" else []
                at += 1
            last = lines[-1][:1] if lines else ""
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def digest(spark, rows):
    found = cr.digests(cr.repair_conversations(cr.damaged(spark.createDataFrame(rows, ROWS)))).toPandas()
    return {None if pd.isna(r[0]) else int(r[0]): (*map(int, r[1:7]), r[7], r[8]) for r in found.itertuples(index=False)}


def test_repair_against_the_contract(spark):
    r = random.Random(11)
    words = ["Yes.", "No!", "what", " \n\t", "", "Fine. ", "café? ", None, "Yes."]
    rows = [(r.choice([None, *range(60)]), r.choice([None, *range(9)]), r.choice(["system", "user", "assistant", "user", "assistant", "tool", None, ""]), r.choice(words)) for _ in range(420)]
    rows += rows[:40]
    want, got = by_hand(rows), digest(spark, rows)
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert {c: got.get(c, empty) for c in want} == want and len(want) == 61


def test_repair_query_has_every_conversation(spark):
    source = pd.read_parquet(f"{DIR}/conversations.parquet")
    got = {r[0]: tuple(r[1:]) for r in cr.op11_conversation_repair(spark, DIR).collect()}
    assert got == by_hand(list(source[["conv_id", "turn", "role", "text"]].itertuples(index=False, name=None)))


def test_repair_gives_the_conversation_itself(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Well?"), (1, 2, "assistant", "Good."), (2, 5, "assistant", "x" * 300_000 + ".")]
    odd = spark.createDataFrame(rows, ROWS).selectExpr("*", "'z' as edit", "1 as fault", "2 as place")
    got = {(r.conv_id, r.place): (r.edit, r.role, len(r.text)) for r in cr.repair_conversations(odd).collect()}
    # a second user's row becomes the assistant's, then there is one too many; deleting one of the two costs 2
    assert [got[k] for k in sorted(got) if k[0] == 1] == [("D", None, 3), ("K", "user", 5), ("K", "assistant", 5)]
    assert [got[k] for k in sorted(got) if k[0] == 2] == [("D", None, 300_001)]
    assert cr.repair_conversations(odd.limit(0)).count() == 0


# --- hard negatives


def test_hard_negatives_equal_sql(spark):
    got = hn.op12_hard_negatives(spark, DIR).toPandas()
    c = duckdb.connect()
    c.execute(f"create view embeddings as select * from '{DIR}/embeddings.parquet'")
    want = c.execute(hn.SQL).fetchdf()[got.columns]
    assert len(got) and sorted(map(tuple, got.values.tolist())) == sorted(map(tuple, want.values.tolist()))


def mined_by_hand(rows, every=100):
    fine = [(i, np.floor(256 * np.array(v, float)), lab) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(int(x) * int(y) for x, y in zip(a, b))
    out = []
    for k, (i, v, lab) in enumerate(fine):
        if i % every:
            continue
        scores = [(-dot(v, w), j, other == lab) for m, (j, w, other) in enumerate(fine) if m != k]
        for s, j, _ in sorted(x for x in scores if x[2])[:5]:
            s = max(-hn.LONG, min(hn.LONG, s))
            near = sorted(x for x in scores if not x[2] and 30 * -s <= 100 * -x[0] <= 90 * -s)[:10]
            out += [(i, j, n + 1, x[1], -s, -x[0]) for n, x in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("wide", [1.0, 3000.0, 1e12])
def test_hard_negatives_with_odd_rows(spark, wide):
    rng = np.random.default_rng(5)
    rows = [(int(i), (rng.normal(size=12) * 0.3 + 0.4).tolist(), int(rng.integers(0, 3))) for i in range(0, 400)]
    rows[7] = (300, rows[7][1], rows[7][2])  # an anchor's id twice
    rows += [(400 + k, rows[100][1], k % 3) for k in range(60)]  # one vector many times
    rows += [(None, [0.1] * 12, 1), (901, None, 1), (902, [0.1, None], 2), (903, [float("nan")] * 12, 1), (904, [float("inf")] * 12, 1), (905, [0.2] * 12, None), (906, [0.5] * 7, 1), (907, [], 2), (1000, [0.0] * 12, 1), (1100, [-0.4] * 12, 2)]
    if wide > 1:
        rows += [(2000 + k, [wide * x for x in rows[k][1]], k % 3) for k in range(100, 140)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").selectExpr("*", "1 as uid", "2 as block").repartition(3)
    got = sorted(tuple(r) for r in hn.mine_hard_negatives(frame).collect())
    want = mined_by_hand(rows)
    top = hn.LONG
    assert got == sorted((*w[:4], max(-top, min(top, w[4])), max(-top, min(top, w[5]))) for w in want) and len(got) > 100
    assert hn.mine_hard_negatives(frame.limit(0)).count() == 0


def test_scan_leaves_out_only_what_cannot_win():
    rng = np.random.default_rng(2)
    cells = np.floor(rng.normal(size=(900, 32)) * 90)
    block = hn.Block(pd.Series(hn.block_of(np.arange(900), np.arange(900), np.zeros(900), cells)))
    for anchor in cells[:25]:
        exact = (cells @ anchor).astype(int)
        at, score = hn.scan(anchor, block, np.arange(900), hn.among_best(5))
        assert (exact[at] == score).all() and set(np.argsort(-exact)[:5]) <= set(at) and len(at) < 100
        windows = [(2000, 30_000), (40_000, 60_000)]
        at, score = hn.scan(anchor, block, np.arange(900), hn.within_windows(windows, 10))
        for low, high in windows:
            inside = np.flatnonzero((exact >= low) & (exact <= high))
            assert set(inside[np.argsort(-exact[inside], kind="stable")[:10]]) <= set(at)


# --- toxicity


def test_toxicity_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = tx.fit_toxicity(docs, labels.where(~tx.held_out()))
    got = tx.score_toxicity(docs.join(labels.where(tx.held_out()), "doc_id").select("doc_id", "text"), model).toPandas()
    truth = labels.toPandas().groupby("doc_id").toxic.max()[got.doc_id].to_numpy()
    assert got.predicted[truth == 1].mean() > 0.9 and got.predicted[truth == 0].mean() < 0.01
    again = tx.fit_toxicity(docs.repartition(5), labels.where(~tx.held_out()))
    assert (again.buckets == model.buckets).all() and np.allclose(again.weights, model.weights, atol=1e-6)


def test_ngrams_are_those_of_the_words():
    words = ["abc", "Straße", "", "a", "übel😀x"]
    of, bucket = tx.ngram_buckets(pa.array(words))
    for i, w in enumerate(words):
        padded = f" {w} "
        assert np.count_nonzero(of == i) == sum(max(0, len(padded) - n + 1) for n in tx.SIZES)
    a, b = (sorted(tx.ngram_buckets(pa.array([*front, "moron"]))[1][-3:].tolist()) for front in ([], ["x", "yy"]))
    assert len(bucket) and a == b  # a word's n-grams do not depend on its neighbours


def test_toxicity_gradient_and_ratios():
    rng = np.random.default_rng(4)
    docs, cols, values = rng.integers(0, 30, 300), rng.integers(0, 12, 300), rng.normal(size=300)
    labels, x = rng.integers(0, 2, 30).astype(float), rng.normal(size=13) * 0.3
    _, slope = tx.loss_and_slope(x, docs, cols, values, labels, 0.2)
    for k in range(13):
        step = np.eye(13)[k] * 1e-6
        diff = (tx.loss_and_slope(x + step, docs, cols, values, labels, 0.2)[0] - tx.loss_and_slope(x - step, docs, cols, values, labels, 0.2)[0]) / 2e-6
        assert abs(diff - slope[k]) < 1e-4
    r = tx.log_count_ratios(np.array([50, 0, 1, 100]), np.array([0, 400, 0, 800]), 10.0, 3.0)
    assert r[0] > 1 and r[1] < 0 and r[2] == 0


def test_toxicity_edge_cases(spark):
    rows = [(1, "you moron. " * 3), (None, "Moron!"), (2, None), (2, ""), (3, " \n"), (4, "lorem ipsum dolor " * 40_000), (5, "you moron. " * 3), (5, "bonjour")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0.5d as score", "1 as predicted", "'x' as toxic")
    labels = spark.createDataFrame([(i, i % 2) for i in range(100, 180)] + [(None, 1), (7, None), (8, 5)], "doc_id long, toxic int")
    train = spark.createDataFrame([(i, "a stupid moron here" if i % 2 else "a kind friend here") for i in range(100, 180)], "doc_id long, text string")
    model = tx.fit_toxicity(train, labels)
    got = tx.score_toxicity(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r.predicted for r in got if r.doc_id in (1, 3, 4, None)}
    assert by_id[1] == 1 and by_id[None] == 1
    none = tx.fit_toxicity(train.limit(0), labels)
    assert {r.score for r in tx.score_toxicity(docs, none).collect()} == {0.5} and tx.score_toxicity(docs.limit(0), model).count() == 0
