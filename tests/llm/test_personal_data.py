"""Spans, contexts and masks of operator 8 against plain Python, also where one text has very many of them."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from plotwise.llm import personal_data as pd8


def test_running_folds(spark):
    rows = [(list(range(n)),) for n in (0, 1, 2, 3, 7, 8, 9, 100)] + [([5, -3, 8, 8, 1],)]
    got = spark.createDataFrame(rows, "x array<int>").select("x", pd8.running(F.col("x"), lambda a, b: a + b).alias("sums"), pd8.running(F.col("x"), lambda a, b: F.greatest(a, b)).alias("most")).collect()
    for r in got:
        assert r.sums == [sum(r.x[: i + 1]) for i in range(len(r.x))] and r.most == [max(r.x[: i + 1]) for i in range(len(r.x))]


def test_spans_and_contexts_against_python(spark):
    rng = random.Random(4)
    parts = ["é", "word", " ", "\n", "x9y8z", "a@b.co", "id-77-aé", ", ", "1.2.3.4", "😀", "Ünder ", "+1 (555) 010-9999", "  "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", pd8.candidates(F.col("text")).alias("c"), pd8.match_spans(F.col("text"), pd8.PATTERNS["ip"]).alias("ip")).collect()
    for r in rows:
        text = texts[r.id]
        assert [(m.start, m.end) for m in r.ip] == [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)]
        assert [text[c.start : c.end].lower() for c in r.c] == [c.value for c in r.c]
        for c in r.c:
            before = text[max(0, c.start - pd8.BEFORE) : c.start].lower().split()
            after = re.match(r"^\S*\s+(\S+)", text[c.end : c.end + pd8.AFTER].lower())
            assert c.left == (" ".join(before[-2:]) if len(before) > 1 else None)
            assert c.around == (f"{before[-1]} _ {after.group(1)}" if before and after else None)


def test_overlaps_and_masks_against_python(spark):
    rng, rows = random.Random(8), []
    for i in range(120):
        n = rng.choice([0, 5, 60, 3000])
        cuts = sorted(rng.sample(range(n + 1), min(n + 1, rng.randrange(0, 21, 2))))
        tokens = list(zip(cuts[::2], cuts[1::2]))
        spans = [(rng.randrange(5), a, min(n, a + rng.randint(1, 30))) for a in (rng.randrange(max(n, 1)) for _ in range(rng.randrange(6)))] if n else []
        rows.append((i, "".join(rng.choice("aé😀 \n") for _ in range(n)), tokens, spans))
    frame = spark.createDataFrame(rows, "id int, text string, tokens array<struct<start:int,end:int>>, spans array<struct<kind:int,start:int,end:int>>")
    got = frame.select("id", pd8.overlapping(F.col("tokens"), F.col("spans")).alias("hit"), pd8.masked(F.col("text"), F.col("spans")).alias("masked")).collect()
    names = [f"[{k.upper()}]" for k in (*pd8.KINDS, "found")]
    for r in got:
        _, text, tokens, spans = rows[r.id]
        assert r.hit == [any(a < e and b > s for _, s, e in spans if e > s) for a, b in tokens]
        at, out = 0, ""
        for s, e, k in sorted((s, e, k) for k, s, e in spans):
            out += text[at:s] + names[k] if s >= at else ""
            at = max(at, e)
        assert r.masked == out + text[at:]


@pytest.mark.parametrize("n", [100_000])
def test_very_many_matches_in_one_text(spark, n):
    """A text of 1.6 MB with 100,000 addresses, within a minute."""
    rows = spark.createDataFrame([(1, "mail a@b.co word " * n), (2, None)], "doc_id long, text string")
    began = time.time()
    found = pd8.find_personal_data(rows).collect()
    took = time.time() - began
    assert {r.doc_id: r.n_email for r in found} == {1: n, 2: 0} and took < 60
    spans = next(r.spans_list for r in found if r.doc_id == 1)
    assert [(s.start, s.end) for s in spans[:2]] == [(5, 11), (22, 28)]
