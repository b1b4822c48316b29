import random
from statistics import median

from pyspark.sql import functions as F

from plotwise.operators import feedback
from plotwise.operators.components import connected_components
from plotwise.operators.feedback import size_limits
from plotwise.operators.market import exact_median
from plotwise.sources import pages, sites


def test_components(spark):
    random.seed(4)
    edges = [(random.randint(0, 200), random.randint(0, 200)) for _ in range(150)] + [(5, 5), (None, 3), (7, 8), (7, 8)] + [(1000, i) for i in range(1001, 1200)] + [(i, i + 1) for i in range(2000, 2060)]
    parent = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_exact_median_is_the_trimmed_one(spark):
    random.seed(5)
    rows = [(k, random.choice([round(random.random() * 100, 2), 7.0])) for k in ("a", "b", None) for _ in range(random.randint(1, 400))]
    got = {r.k: (r.median, r.n) for r in exact_median(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    for k in ("a", "b", None):
        v = sorted(x for y, x in rows if y == k)
        cut = len(v) // 10 if len(v) >= 10 else 0
        assert got[k] == (median(v[cut : len(v) - cut]), len(v))
    narrowed = exact_median(spark.createDataFrame(rows + [("a", 1e9), ("c", None), ("d", 3.0), ("d", 4.0)], "k string, v double"), ["k"], "v", few=3, parts=4, upper=True)
    for r in narrowed.collect():
        v = sorted([x for y, x in rows if y == r.k] + ([1e9] if r.k == "a" else []) + ([3.0, 4.0] if r.k == "d" else []))
        assert (r.median, r.n) == (v[len(v) // 2], len(v)) and r.k != "c"


def test_upper_median_of_sizes(spark):
    rows = [("r", "sml", x) for x in (25.0, 28.0, 33.0, 40.0)] + [("r", "sml", None), ("r", "big", None)]
    got = {(r.reason, r.n, r.limit) for r in size_limits(spark.createDataFrame(rows, "researcher string, reason string, area double")).collect()}
    assert got == {("sml", 5, 33.0), ("big", 1, None)}


def test_pages(spark):
    html = '<html lang="mk"><title>A &amp; B</title><table><tr><th>Кат</th><td>3</td></tr></table><script type="application/ld+json">{"@type": "RealEstateListing", "price": 600}</script><a>lat: 41.99, lng: 21.43</a></html>'
    df = spark.createDataFrame([(1, html)], "page_id long, html string")
    assert pages.extract(df, pages.ARTICLE).first().title == "A & B"
    r = df.select(pages.key_values(F.col("html")).alias("kv"), pages.pin(F.col("html")).alias("pin"), F.variant_get(pages.json_ld(F.col("html"), "RealEstateListing"), "$.price", "int").alias("price")).first()
    assert r.kv == {"Кат": "3"} and tuple(r.pin) == (41.99, 21.43) and r.price == 600


def test_sitemap(spark, tmp_path):
    (tmp_path / "s.xml").write_text('<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"><url><loc>https://x/ad/1</loc><lastmod>2026-01-02T00:00:00.000Z</lastmod></url><url><loc>https://x/about</loc></url></urlset>')
    assert [tuple(r) for r in pages.sitemap(spark, str(tmp_path / "s.xml"), "/ad/").collect()] == [("https://x/ad/1", "2026-01-02T00:00:00.000Z")]


def test_penalties_move_an_item_once(spark, tmp_path):
    random.seed(8)
    some = lambda *x: random.choice(x)
    items = [(some("r0", "r1", "r2", None), some(*"abcdefgh", None), some("flat", "land"), some("X", "Y", None), some("S", "T", None), some(10.0, 40.0, 90.0, None)) for _ in range(60)]
    turned = [(some("r0", "r1", None), some(*"abcdefgh"), some("sml", "big", "loc", "prc", "str", "oth", None), some("flat", "land"), some("X", "Y", None), some("S", None), some(20.0, 50.0, 0.0, None)) for _ in range(50)]
    spark.createDataFrame(items, "researcher string, id string, kind string, city string, district string, area double").write.parquet(str(tmp_path / "items"))
    given = spark.createDataFrame(turned, "researcher string, listing_id string, reason string, kind string, city string, district string, area double")
    found = feedback.rejection_penalties(spark.read.parquet(str(tmp_path / "items")), given)
    assert sum("items" in f for f in found.inputFiles()) and found._jdf.queryExecution().executedPlan().toString().count(f"{tmp_path}/items") == 1
    want = {}
    for who, item, kind, city, district, area in items:
        for reason in ("sml", "big", "loc", "prc", "str"):
            said = [t for t in turned if who is not None and t[0] == who and t[2] == reason]
            sizes = sorted(t[6] for t in said if t[6])
            mine = [t for t in said if t[1] == item]
            place = (city, district) if reason == "loc" else (kind, city)
            here = [t for t in said if None not in place and place == (t[4:6] if reason == "loc" else t[3:5])]
            fits = (sizes and area is not None and (area <= sizes[len(sizes) // 2] if reason == "sml" else area >= sizes[len(sizes) // 2])) if reason in ("sml", "big") else len(here) > len(mine)
            if fits and len(said) > len(mine):
                want.setdefault((who, item), {})[reason] = -12 * (len(said) - len(mine)) / (len(said) - len(mine) + 2)
    assert want and {(r.researcher, r.id): round(r.penalty, 9) for r in found.collect()} == {k: round(sum(v.values()), 9) for k, v in want.items()}


def test_a_value_is_read_from_its_page_once(spark):
    read = sites.Read((sites.markup("first(.)x"), sites.markup("second(.)x")), lambda c: F.concat(c, c), lambda v: v != "nn")
    rows = spark.createDataFrame([("firstax secondbx",), ("firstnx secondbx",), ("secondnx",), ("first x second&amp;x",), (None,)], "html string").select("html", read.column().alias("v"), pages.key_values(F.col("html"), "third(.)(.)").alias("m"))
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("first(.)x"), plan.count("second(.)x"), plan.count("third(.)(.)")) == (1, 1, 2)
    assert [r.v for r in rows.collect()] == ["aa", "bb", None, None, None]
    got = spark.createDataFrame([("thirdab thirdac third<x",), (None,), ("",)], "html string").select(pages.key_values(F.col("html"), "third(.)(.)").alias("m")).collect()
    assert got[0].m["a"] == "b" and got[1].m is None and got[2].m == {}
