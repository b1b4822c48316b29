"""Places that texts name, by a gazetteer table of any size: runs of words meet the names in an equi-join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotwise.functions import places as fp
from plotwise.functions.text import norm, once
from plotwise.scratch import write_table


def normed_names(gazetteer: DataFrame) -> DataFrame:
    """(words, n, and the columns of ``gazetteer``) with its ``name`` folded as texts are. Written, so that joins know its size."""
    words = F.trim(norm(F.col("name")))
    rows = gazetteer.withColumn("words", words).where("words <> ''").withColumn("n", F.size(F.split("words", " ")))
    return write_table(rows.dropDuplicates(), "gazetteer")


def named_places(rows: DataFrame, names: DataFrame, text: Column, key: str = "id") -> DataFrame:
    """(key, pos, and the columns of ``names``) of every name of :func:`normed_names` that stands in the text as whole words.

    The text's runs of as many words as names have are exploded and joined; a run that is no name costs one probe. Only distinct lengths, one number
    for each, reach the driver.
    """
    lengths = sorted(r.n for r in names.select("n").distinct().collect())
    if not lengths:
        return rows.select(key, F.lit(0).alias("pos")).limit(0).crossJoin(names.limit(0))
    words = F.filter(F.split(F.trim(norm(text)), " "), lambda w: w != "")
    run = lambda n: F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.struct(i.alias("pos"), F.array_join(F.slice("w", i, n), " ").alias("words")))
    runs = F.concat(*[F.when(F.size("w") >= n, run(n)).otherwise(F.array().cast("array<struct<pos:int,words:string>>")) for n in lengths])
    spread = rows.select(key, words.alias("w")).select(key, F.explode(runs).alias("r")).select(key, "r.pos", "r.words")
    return spread.hint("shuffle_hash").join(names, "words")


def fix_districts(rows: DataFrame, names: DataFrame, city: str, key: str = "id") -> DataFrame:
    """The district that the title of an advert in ``city`` names, if its names are of one district alone, in place of the one filed, which
    stays as ``district_form``. ``names``: the gazetteer's (name, district)."""
    found = named_places(rows.where(F.col("city") == city), names, F.col("title"), key)
    one = found.groupBy(key).agg(F.min("district").alias("named"), F.max("district").alias("last")).where("named = last").select(key, "named")
    moved = F.col("named").isNotNull() & ~F.col("named").eqNullSafe(F.col("district"))
    joined = rows.hint("merge").join(one, key, "left")
    return joined.withColumns({"district_form": F.when(moved, F.col("district")), "district": F.when(moved, F.col("named")).otherwise(F.col("district"))}).drop("named")


def with_flag(rows: DataFrame, names: DataFrame, text: Column, flag: str, where: Column, key: str = "id") -> DataFrame:
    """``rows`` with a flag: whether ``where`` holds and the text has one of the names."""
    hit = named_places(rows.where(where), names, text, key).select(key).distinct().withColumn(flag, F.lit(True))
    return rows.hint("merge").join(hit, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def other_town(rows: DataFrame, towns: DataFrame, city: str, key: str = "id") -> DataFrame:
    """other_town: filed in ``city``, but the title names another town."""
    return with_flag(rows, towns, F.col("title"), "other_town", F.col("city") == city, key)


def centre_unconfirmed(rows: DataFrame, hints: DataFrame, centre: str, key: str = "id") -> DataFrame:
    """centre_unconfirmed: filed in the ``centre``, which forms suggest, and nothing in the advert says so."""
    text = F.concat_ws(" ", "title", "description", "address")
    filed = F.col("district").eqNullSafe(F.lit(centre))
    return with_flag(rows, hints, text, "said", filed, key).withColumn("centre_unconfirmed", filed & ~F.col("said")).drop("said")


#: Names up to which a gazetteer is sent to the texts and looked for in each; a larger one meets their runs of words in a join.
FEW_NAMES = 200


def with_candidates(rows: DataFrame, named: DataFrame, key: str = "id", few: int = FEW_NAMES) -> DataFrame:
    """``candidates``, the names to look up. ``named``: a gazetteer (name, spelled) of places that are taken wherever the text has them."""
    text = F.concat_ws(" ", "title", "description")
    columns = [F.col(c) for c in ("title", "named", "note", "address", "district", "city")]
    if named.limit(few + 1).count() <= few:
        names = named.agg(F.array_sort(F.collect_set(F.struct("words", "spelled"))).alias("names"))  # one row
        # folded texts and names have single spaces between words
        said = once(norm(text), lambda t: F.filter("names", lambda g: F.contains(t, F.concat(F.lit(" "), g["words"], F.lit(" ")))))
        return rows.crossJoin(F.broadcast(names)).withColumn("named", F.transform(said, lambda g: g["spelled"])).withColumn("candidates", fp.candidates(*columns)).drop("named", "names")
    found = named_places(rows, named, text, key).groupBy(key).agg(F.transform(F.array_sort(F.collect_set(F.struct("words", "spelled"))), lambda x: x["spelled"]).alias("named"))
    return rows.hint("merge").join(found, key, "left").withColumn("candidates", fp.candidates(*columns)).drop("named")


def agency_place(rows: DataFrame, towns: DataFrame, districts: DataFrame, area: str, city: str, key: str = "id") -> DataFrame:
    """City and district from an agency's one ``area`` text: another town that it names (the first in the text), else ``city`` with the
    district that it names, if only one. ``towns``: (name, town), ``districts``: (name, district)."""
    town = named_places(rows, towns, F.col(area), key).groupBy(key).agg(F.min_by("town", "pos").alias("town"))
    one = named_places(rows, districts, F.col(area), key).groupBy(key).agg(F.min("district").alias("named"), F.max("district").alias("last")).where("named = last").select(key, "named")
    joined = rows.drop("city", "district").hint("merge").join(town, key, "left").hint("merge").join(one, key, "left")
    return joined.withColumns({"city": F.coalesce("town", F.lit(city)), "district": F.when(F.col("town").isNull(), F.col("named"))}).drop("town", "named")
