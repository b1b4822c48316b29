"""Local market values: medians by kind, deal, place and size band, and the fallback lookup."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotwise.functions.pricing import SIZE_FIRST, ppm2, size_band
from plotwise.scratch import write_table

KEYS = ["kind", "deal", "level", "city", "district", "band"]
PLACE = ["kind", "deal", "city", "district"]
LEVELS = ("district", "city", "national")


#: Rows of a group that are put in order at a time, and parts into which the range of a larger group is cut.
FEW, PARTS = 10_000, 256


def _same(keys: list[str], a: str, b: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def exact_median(rows: DataFrame, keys: list[str], value: str, few: int = FEW, parts: int = PARTS, upper: bool = False, reread: bool = False, groups: DataFrame | None = None) -> DataFrame:
    """(keys, median, n): exact medians, with null values left out and null keys as keys.

    A group of at most ``few`` rows is put in order at once. In a larger one the range of values is cut into ``parts`` and narrowed to the parts that
    hold the middle ranks, until few rows or single values are left; equal values are counted before they meet, and what the first cut leaves is written, so
    that later ones read little. So no task holds a large group, also where one value makes up most of it. Cutting the same number of values from both ends
    does not move a median, so this is also the robust median that trims a tenth at each end. ``upper``: of two middle values the greater one instead of
    their mean. The rows are read once for each step, so they are written first; ``reread``: they come from a written table by cheap steps and need not be.
    ``groups``: (keys, n, lo, hi) of the values, if they are known. Only rows of small groups are shuffled: the large groups, one for each ``few`` rows at
    most, are sent to the rows, not the rows to all groups.
    """
    rows = rows.where(F.col(value).isNotNull()).select(*keys, (F.col(value).cast("double") + 0.0).alias("v"))
    rows = rows if reread else write_table(rows, "values")
    # written tables of one row a group: their true size decides how they are joined
    groups = rows.groupBy(keys).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")) if groups is None else groups
    state = write_table(groups.select(*keys, "n", "lo", "hi"), "groups")
    low, high = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    own = [F.col(f"s.{k}") for k in keys]
    values = rows.withColumn("c", F.lit(1).cast("long"))

    def within(ranges: DataFrame) -> DataFrame:
        return values.alias("r").join(ranges.alias("s"), _same(keys, "r", "s")).where(F.col("v").between(F.col("lo"), F.col("hi")))

    large = write_table(state.where(f"n > {few}").withColumns({"below": F.lit(0).cast("long"), "inside": F.col("n")}), "large_groups")
    few_rows = rows.alias("r").join(large.alias("s"), _same(keys, "r", "s"), "left_anti")
    small = few_rows.alias("r").join(state.where(f"n <= {few}").alias("s"), _same(keys, "r", "s")).select(*own, "n", F.lit(0).cast("long").alias("below"), "v", F.lit(1).cast("long").alias("c"))
    settled, single = [], []
    # each turn leaves at most two parts of a range; doubles are told apart long before the last one
    for turn in range(80):
        single.append(large.where("lo = hi").select(*keys, "n", "below", F.col("lo").alias("v"), F.col("inside").alias("c")))
        settled.append(large.where(f"inside <= {few} and lo < hi"))
        large = large.where(f"inside > {few} and lo < hi")
        if large.isEmpty():
            break
        part = F.least(F.lit(parts - 1), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * parts)).cast("int")
        bins = within(large).groupBy(*own, "n", "below", part.alias("part")).agg(F.sum("c").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        upto = F.col("below") + F.sum("c").over(Window.partitionBy(*keys).orderBy("part"))  # at most ``parts`` rows a group
        hit = bins.withColumn("upto", upto).where(((F.col("upto") >= low) & (F.col("upto") - F.col("c") < low)) | ((F.col("upto") >= high) & (F.col("upto") - F.col("c") < high)))
        large = write_table(hit.groupBy(*keys, "n").agg(F.min("least").alias("lo"), F.max("most").alias("hi"), F.min(F.col("upto") - F.col("c")).alias("below"), F.sum("c").alias("inside")), "ranges")
        if turn == 0:
            values = write_table(within(large).groupBy(*own, "v").agg(F.sum("c").alias("c")), "inside")
    else:
        settled.append(large)
    if len(single) > 1:
        inner = within(reduce(lambda a, b: a.unionByName(b), settled))
        small = small.unionByName(inner.groupBy(*own, "n", "below", "v").agg(F.sum("c").alias("c")))
    small = reduce(lambda a, b: a.unionByName(b), single, small)
    upto = F.col("below") + F.sum("c").over(Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    middle = small.withColumn("upto", upto).where(((F.col("upto") >= low) & (F.col("upto") - F.col("c") < low)) | ((F.col("upto") >= high) & (F.col("upto") - F.col("c") < high)))
    return middle.groupBy(*keys).agg((F.max("v") if upper else (F.min("v") + F.max("v")) / 2).alias("median"), F.max("n").alias("n"))


def unit_prices(rows: DataFrame) -> DataFrame:
    """(kind, deal, city, district, band, v): the price per square metre of every listing that has one."""
    return rows.select("kind", "deal", F.nullif("city", F.lit("")).alias("city"), F.nullif("district", F.lit("")).alias("district"), size_band().alias("band"), ppm2().alias("v")).where("v is not null")


def bucketed(rows: DataFrame, district: Column | None = None) -> DataFrame:
    """A1: each of the ``unit_prices``, or sums of them, once for its district, city and the country, with and without its size band. ``district``: where the
    district counts, if not everywhere."""
    none = F.lit(None).cast("string")
    filed = F.col("district").isNotNull() if district is None else F.col("district").isNotNull() & district
    places = F.array_compact(F.array(
        F.when(filed, F.struct(F.lit("district").alias("level"), F.col("city").alias("city"), F.col("district").alias("district"))),
        F.when(F.col("city").isNotNull(), F.struct(F.lit("city").alias("level"), F.col("city").alias("city"), none.alias("district"))),
        F.struct(F.lit("national").alias("level"), none.alias("city"), none.alias("district")),
    ))
    values = [c for c in rows.columns if c not in (*PLACE, "band", "large")]
    spread = rows.select("kind", "deal", "band", *values, F.explode(places).alias("p")).select("kind", "deal", "p.*", "band", *values)
    return spread.select("kind", "deal", "level", "city", "district", *values, F.explode(F.when(F.col("band").isNull(), F.array(F.lit(None).cast("int"))).otherwise(F.array(F.col("band"), F.lit(None).cast("int")))).alias("band"))


def _district_medians(rows: DataFrame) -> DataFrame:
    """The buckets of districts of few rows each: a district's prices meet once, in order, and its size bands are picked out of them."""
    filed = rows.groupBy(*PLACE).agg(F.sort_array(F.collect_list(F.struct("v", "band"))).alias("all"))
    bands = F.array_distinct(F.array_append(F.transform("all", lambda x: x["band"]), F.lit(None).cast("int")))
    one = filed.select(*PLACE, "all", F.explode(bands).alias("band"))
    one = one.select(*PLACE, "band", F.when(F.col("band").isNull(), F.col("all")).otherwise(F.filter("all", lambda x: x["band"] == F.col("band"))).alias("some")).withColumn("n", F.size("some"))
    at = lambda i: F.get("some", i.cast("int"))["v"]
    middle = (at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2
    return one.select("kind", "deal", F.lit("district").alias("level"), "city", "district", "band", middle.alias("median"), F.col("n").cast("long").alias("n"))


def market_refs(rows: DataFrame, few: int = FEW) -> DataFrame:
    """A1 + A2: (kind, deal, level, city, district, band, median, n) of every bucket, as a written table.

    Prices per square metre are worked out once and written by place, large places over several files, so that sums and lists before a shuffle leave about
    one row a place. Each price is shuffled once more, in its district's list; cities and the country, and districts of more than ``few`` prices, are narrowed
    where the rows are. The number of such districts is below a row for each ``few`` prices, so they are sent to the rows.
    """
    prices = write_table(unit_prices(rows).hint("rebalance", *PLACE), "unit_prices")
    cells = write_table(prices.groupBy(*PLACE, "band").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "cells")
    large = write_table(cells.where("district is not null").groupBy(*PLACE).agg(F.sum("n").alias("rows")).where(f"rows > {few}").select(*PLACE, F.lit(True).alias("large")), "large_districts")

    def marked(t: DataFrame) -> DataFrame:
        return t.alias("r").join(large.alias("s"), _same(PLACE, "r", "s"), "left").select("r.*", F.coalesce("s.large", F.lit(False)).alias("large"))

    groups = bucketed(marked(cells), F.col("large")).groupBy(*KEYS).agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    wide = exact_median(bucketed(marked(prices), F.col("large")), KEYS, "v", few, reread=True, groups=groups)
    near = _district_medians(marked(prices).where("district is not null and not large").drop("large"))
    return write_table(near.unionByName(wide), "references")


def market_summary(refs: DataFrame, least: int = 5) -> DataFrame:
    """A3: unbanded city and national buckets with enough samples; the median unrounded."""
    return refs.where(f"band is null and level <> 'district' and n >= {least}").select("kind", "deal", "city", "median", "n")


def _by_place(refs: DataFrame, level: str, least: int) -> DataFrame:
    """One row for each place of a level: the bucket of all sizes and those of the size bands that have enough samples. Written: its true size decides how
    it is joined."""
    keys = ["kind", "deal", *{"district": ["city", "district"], "city": ["city"], "national": []}[level]]
    bucket = F.struct("median", "n", "level", "band")
    found = refs.where((F.col("level") == level) & (F.col("n") >= least)).groupBy(*keys)
    found = found.agg(F.max(F.when(F.col("band").isNull(), bucket)).alias("all sizes"), F.collect_list(F.when(F.col("band").isNotNull(), bucket)).alias("bands"))
    return write_table(found.select(*[F.col(c).alias(f"{level} {c}") for c in (*keys, "all sizes", "bands")]), f"{level}_references")


def with_reference(rows: DataFrame, refs: DataFrame, mins: tuple[int, int, int] = (15, 8, 15), deal: Column | None = None, district: Column | None = None, prefix: str = "ref_") -> DataFrame:
    """The first bucket with enough samples, as columns ref_median, ref_n, ref_level, ref_band.

    Kinds of ``SIZE_FIRST`` try all places with the same size band first; others try both at each place. The usable buckets of a place are one row, so a
    listing meets one row for its district, one for its city and one for the country, and takes the first in order; only the districts can be many.
    """
    deal, district = (F.col("deal") if deal is None else deal), F.nullif(F.col("district") if district is None else district, F.lit(""))
    asked = {"kind": F.col("kind"), "deal": deal, "city": F.nullif("city", F.lit("")), "district": district, "band": size_band()}
    rows = rows.withColumn("key of the lookup", F.struct(*[c.alias(k) for k, c in asked.items()]))
    own = {k: F.col(f"key of the lookup.{k}") for k in asked}
    added, tries = [], {}
    for level, least in zip(LEVELS, mins):
        there = _by_place(refs, level, least)
        keys = there.columns[:-2]
        added += there.columns
        # a row without a district has none to meet; all other keys may be null
        rows = rows.join(there, reduce(lambda a, b: a & b, [own["district"] == F.col(c) if c == "district district" else own[c.removeprefix(f"{level} ")].eqNullSafe(F.col(c)) for c in keys]), "left")
        tries[level] = (F.when(own["band"].isNotNull(), F.get(F.filter(f"{level} bands", lambda x: x["band"] == own["band"]), 0)), F.col(f"{level} all sizes"))
    by_size, by_place = [tries[level][i] for i in (0, 1) for level in LEVELS], [t for level in LEVELS for t in tries[level]]
    best = F.when(own["kind"].isin(*SIZE_FIRST), F.coalesce(*by_size)).otherwise(F.coalesce(*by_place))
    rows = rows.withColumn("answer of the lookup", best)
    return rows.withColumns({f"{prefix}{c}": F.col(f"answer of the lookup.{c}") for c in ("median", "n", "level", "band")}).drop("key of the lookup", "answer of the lookup", *added)


def with_discount(rows: DataFrame, local_only: bool = True) -> DataFrame:
    """How far the price per square metre lies below the reference; null against a national one, if ``local_only``."""
    fine = F.col("ref_median").isNotNull() & (F.col("ref_level") != "national") if local_only else F.col("ref_median").isNotNull()
    return rows.withColumn("discount", F.when(fine, 1 - ppm2() / F.col("ref_median")))


#: Least discounts and what they are called in a verdict on one offer; a price above the reference is dear.
VERDICTS = ((0.35, "too good"), (0.25, "very cheap"), (0.15, "cheap"), (0.0, "fair"))


def verdicts(posts: DataFrame, refs: DataFrame, mins: tuple[int, int, int] = (15, 8, 15)) -> DataFrame:
    """(id, discount, verdict) of posts (id, kind, deal, city, district, price_eur, price_note, area_m2) against their reference, a national one
    included; unknown where price, area or reference lack."""
    # a post meets its district with what is asked of it alone: its texts stay where they are
    asked = posts.select("id", "kind", "deal", "city", "district", "price_eur", "price_note", "area_m2")
    found = with_discount(with_reference(asked, refs, mins), False)
    word = reduce(lambda acc, v: acc.when(F.col("discount") >= v[0], v[1]), VERDICTS[1:], F.when(F.col("discount") >= VERDICTS[0][0], VERDICTS[0][1]))
    return found.select("id", "discount", word.when(F.col("discount").isNotNull(), "dear").otherwise("unknown").alias("verdict"))


def deals_below_median(rows: DataFrame, refs: DataFrame, mins: tuple[int, int, int] = (15, 8, 15)) -> DataFrame:
    """The flagship: listings below their local median, furthest first."""
    out = with_discount(with_reference(rows, refs, mins)).where("discount > 0")
    return out.select("id", "kind", "deal", "city", "district", ppm2().alias("ppm2"), "ref_median", "ref_n", "ref_level", "ref_band", "discount").orderBy(F.desc("discount"), "id")


def high_plots(rows: DataFrame, min_elevation: float = 700) -> DataFrame:
    """Land for sale at this height or above."""
    return rows.where(f"kind = 'land' and deal = 'sale' and not coalesce(abroad, false) and elevation >= {min_elevation}")


def high_plot_refs(rows: DataFrame, min_elevation: float = 700) -> DataFrame:
    """A5: (band, median, n) of high plots, the row without a band for all of them."""
    v = high_plots(rows, min_elevation).select(size_band().alias("band"), ppm2().alias("v")).where("v is not null")
    return exact_median(v.select("v", F.explode(F.array(F.col("band"), F.lit(None).cast("int"))).alias("band")), ["band"], "v")


def with_high_plot_reference(rows: DataFrame, refs: DataFrame, min_band: int = 8, min_all: int = 15) -> DataFrame:
    """The same band's median if it has enough samples, else that of all high plots. Both tables have one row a band at most."""
    own = refs.where(f"band is not null and n >= {min_band}").select(F.col("band").alias("own_band"), F.col("median").alias("m1"), F.col("n").alias("n1"))
    rest = refs.where(f"band is null and n >= {min_all}").agg(F.max("median").alias("m2"), F.max("n").alias("n2"))
    out = rows.join(F.broadcast(own), size_band() == F.col("own_band"), "left").crossJoin(F.broadcast(rest))
    return out.withColumns({"ref_median": F.coalesce("m1", "m2"), "ref_n": F.coalesce("n1", "n2"), "ref_band": F.col("own_band")}).drop("m1", "m2", "n1", "n2", "own_band")
