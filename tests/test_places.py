"""Folding of text by the Unicode and HTML tables, and places that texts name, against plain Python."""

import html
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from plotwise.functions import places as fp
from plotwise.functions import text
from plotwise.operators import places


def folded(t):
    """What ``norm`` means, sign by sign."""
    pairs = dict(zip(text.CYRILLIC, text.LATIN)) | dict(text.PAIRS)
    t = "".join(pairs.get(c, c) for c in html.unescape(t).lower())
    t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
    for a, b in text.DIGRAPHS:
        t = t.replace(a, b)
    t = re.sub(r"[.,;:!?\n\r()/\-–—•]+", " . ", t)
    t = re.sub(r"(?:\s*\.\s*)+", " . ", re.sub(r"[^a-z0-9.]+", " ", t))
    return f" {' '.join(t.split())} "


def test_norm_by_the_tables(spark):
    rng = random.Random(6)
    given = ["80 m² ½", "&euro;5 &scaron;tip &Scaron;", "ＡＢＣ１２３ ﬁn ㎡ ⅷ ⒈ ⑴ …x", "&#x41;&#65;&#8364;&#150;b &notit; &amp;lt; &ampx &unknown; &#xD800; &#0;7", "Ѓорче Петров — ѐ №5", "𝐚𝐛 ﷺ ǆ Ǆ İstanbul", "&eacute;t&eacute &copy2 &;&#;", "Kj GJ dzh Sh"]
    parts = ["&amp;", "&frac12;", "½", "²", "Ж", "ѓ", "é", "-", " ", "x", "7", "ﬂ", "&nbsp;", "/", "ǳ", "№", "é", "&lt", ";"]
    given += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 30))) for _ in range(200)]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string").select("i", text.norm(F.col("t")).alias("n"), text.clean(F.col("t")).alias("c")).collect()
    for r in got:
        assert r.n == folded(given[r.i]), given[r.i]
        assert r.c == " ".join(html.unescape(given[r.i]).split()), given[r.i]


GAZ = [("дебар маало", "Центар"), ("кеј", "Центар"), ("карпош", "Карпош"), ("влае", "Карпош"), ("нас. ново лисиче", "Аеродром"), ("лисиче", "Аеродром"), ("хром", "Ѓорче")]


@pytest.mark.parametrize(("title", "city", "want"), [
    ("Стан Дебар Маало", "Скопје", "Центар"), ("stan debar maalo, kej", "Скопје", "Центар"), ("Карпош или Кеј", "Скопје", None), ("Novo LISICE 60m2", "Скопје", "Аеродром"),
    ("хромиран кран", "Скопје", None), ("Vlae", "Охрид", None), (None, "Скопје", None), ("10 min do centar", "Скопје", None)])
def test_district_that_one_title_names(spark, title, city, want):
    rows = spark.createDataFrame([(1, title, city, "Бутел", 5)], "id int, title string, city string, district string, words int")
    r = places.fix_districts(rows, places.normed_names(spark.createDataFrame(GAZ, "name string, district string")), "Скопје").first()
    assert (r.district, r.district_form) == ((want, "Бутел") if want else ("Бутел", None)) and r.words == 5


def test_other_towns_centre_and_agencies(spark):
    rows = spark.createDataFrame([(1, "Stan vo Ohrid", None, None, "Скопје", "Скопје Центар"), (2, "Стан", "во строг центар", None, "Скопје", "Скопје Центар"), (3, "Стан", None, None, "Охрид", None), (4, "Охридска улица", None, "кеј 5", "Скопје", "Скопје Центар")], "id int, title string, description string, address string, city string, district string")
    towns = places.normed_names(spark.createDataFrame([("охрид", "Охрид"), ("струга", "Струга")], "name string, town string"))
    hints = places.normed_names(spark.createDataFrame([("строг центар",), ("кеј",)], "name string"))
    assert {r.id for r in places.other_town(rows, towns, "Скопје").where("other_town").collect()} == {1}
    assert {r.id for r in places.centre_unconfirmed(rows, hints, "Скопје Центар").where("centre_unconfirmed").collect()} == {1}
    areas = spark.createDataFrame([(1, "Струга, до Охрид", "x"), (2, "Влае", None), (3, "", None), (4, "Влае - Кеј", None)], "id int, area string, city string").withColumn("district", F.lit(None).cast("string"))
    got = {r.id: (r.city, r.district) for r in places.agency_place(areas, towns, places.normed_names(spark.createDataFrame(GAZ, "name string, district string")), "area", "Скопје").collect()}
    assert got == {1: ("Струга", None), 2: ("Скопје", "Карпош"), 3: ("Скопје", None), 4: ("Скопје", None)}
    assert places.other_town(rows, towns.limit(0), "Скопје").where("other_town").count() == 0


def test_candidates_in_order(spark):
    rows = [(1, "Се продава плац во близина на Охрид, Мешеишта", None, None, None, "Дебарца", "Охрид"), (2, "Plac vo s.Orman", "blizu do Mavrovo", None, None, "Скопје Центар", "Скопје"), (3, "Bailiff sale", None, "ИЛ бр.416 КО ГРУПЧИН Продажбата", None, None, "Тетово"), (4, "Plac na PONIKVA", None, None, "ul. Mala 5", None, "Кочани"), (5, None, None, "КО Долно Лисиче-вон град", " Kukja ", None, None)]
    frame = spark.createDataFrame(rows, "id int, title string, description string, note string, address string, district string, city string")
    named = places.normed_names(spark.createDataFrame([("mavrovo", "Маврово"), ("ponikva", "Пониква")], "name string, spelled string"))
    got = {r.id: r.candidates for r in places.with_candidates(frame, named).collect()}
    assert got[1] == ["Мешеишта", "Дебарца", "Охрид"]
    assert got[2] == ["Орман", "Маврово", "Центар", "Скопје"]
    assert got[3] == ["Баилифф", "Групчин", "Тетово"]
    assert got[4] == ["Пониква", "Кочани"]
    assert got[5] == ["Долно Лисиче", "Куќа"]


def test_map_links(spark):
    rows = [("ul. Ilindenska 5", None, "Скопје Центар", "Скопје"), ("12, 3", "КО ГРУПЧИН", None, "Тетово"), (None, None, "Струга", "Струга"), (None, None, None, None)]
    frame = spark.createDataFrame(rows, "address string, note string, district string, city string")
    got = [r.q for r in frame.select(fp.map_query(*[F.col(c) for c in ("address", "note", "district", "city")]).alias("q")).collect()]
    assert got == ["ul. Ilindenska 5, Центар, Скопје, North Macedonia", "Групчин, Тетово, North Macedonia", "Струга, North Macedonia", None]
    link = spark.range(1).select(fp.map_url(F.lit(41.5), F.lit(21.25), F.lit("x")).alias("a"), fp.map_url(F.lit(0.0), F.lit(21.0), F.lit("a b")).alias("b"), fp.map_url(F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("string")).alias("c")).first()
    assert link.a.endswith("query=41.500000,21.250000") and link.b.endswith("query=a+b") and link.c is None
