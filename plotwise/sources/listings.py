"""The listings view over the order tables, and scans of it.

``LISTINGS_SQL`` is plain SQL that Spark and DuckDB both run; every operator of the library takes listings by column names, not this view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: All operators take the day of analysis as a parameter; this is the last ship date of the tables.
AS_OF = "2001-11-04"

LISTINGS_SQL = """
select concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) as id,
  case l_returnflag when 'A' then 'ads' when 'N' then 'agency' else 'portal' end as source,
  l_orderkey * 10 + l_linenumber as source_no,
  case p_type when 'STANDARD' then 'apartment' when 'MEDIUM' then 'apartment' when 'LARGE' then 'house'
    when 'SMALL' then 'weekend_house' else 'land' end as kind,
  case l_linestatus when 'O' then 'sale' else 'rent' end as deal,
  n_name as city,
  case when l_linenumber = 7 then null else 'S' || cast(l_suppkey as varchar(20)) end as district,
  case l_linestatus when 'O' then l_extendedprice else l_extendedprice / 100 end as price_eur,
  case when l_discount >= 0.1 then 'placeholder' when l_linestatus = 'O' and l_discount = 0 and l_linenumber = 1 then 'per_m2' end as price_note,
  case when p_type in ('ECONOMY', 'PROMO') then l_quantity * 20 else l_quantity * 5 end as area_m2,
  l_linenumber % 5 + 0e0 as rooms,
  p_name as title, p_brand as brand,
  case when l_linenumber = 4 then 0e0 else 41 + (l_suppkey % 140) / 100e0 end as lat,
  case when l_linenumber = 4 then 0e0 else 20.5e0 + n_nationkey / 10e0 end as lng,
  l_partkey % 1600 + 0e0 as elevation,
  o_orderdate as first_seen, l_shipdate as last_seen,
  case when l_linenumber % 3 = 0 then null else l_shipdate end as detail_at,
  (case l_linestatus when 'O' then l_extendedprice else l_extendedprice / 100 end) * (1 + l_discount) as first_price,
  case when l_linenumber = 3 then l_extendedprice * 1.2e0 end as site_old_price,
  l_tax > 0.07 as sold, l_linenumber = 2 and l_tax > 0.05 as abroad
from lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey
  join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
"""


def tables(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def listings(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None) -> DataFrame:
    """The listings view; columns that a query does not use are never read. With ``lineitem``, a stream of that table, it is a stream of listings."""
    given = tables(spark, sf_dir, "lineitem", "orders", "part", "supplier", "nation") | ({} if lineitem is None else {"lineitem": lineitem})
    return spark.sql(LISTINGS_SQL.replace("from lineitem join orders", "from {lineitem} join {orders}").replace("join part on", "join {part} on").replace("join supplier on", "join {supplier} on").replace("join nation on", "join {nation} on"), **given)


def spread(rows: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` dealt over the cluster before work that is long for each row: a table in few or large row groups is read by few tasks. Streams stay as they are."""
    return rows if rows.isStreaming else rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, key)


def spread_listings(spark: SparkSession, sf_dir: str, lineitem: DataFrame | None = None) -> DataFrame:
    """The listings view, dealt over the cluster before it is joined: by the key of its first join, which then moves no row again, and as bare numbers."""
    return listings(spark, sf_dir, spread(tables(spark, sf_dir, "lineitem")["lineitem"] if lineitem is None else lineitem, "l_orderkey"))


def active(rows: DataFrame, as_of: str, stale_days: int = 10) -> DataFrame:
    """SRC1: seen within ``stale_days``."""
    return rows.where(F.col("last_seen") >= F.date_sub(F.lit(as_of).cast("date"), stale_days).cast("timestamp"))


def market_rows(rows: DataFrame, as_of: str, window_days: int = 150) -> DataFrame:
    """SRC2: rows that may count for the market, and only the columns it needs."""
    fine = rows.where("price_eur is not null and area_m2 is not null and not coalesce(abroad, false) and deal <> 'auction' and coalesce(price_note, '') <> 'placeholder'")
    return active(fine, as_of, window_days).select("id", "source", "kind", "deal", "city", "district", "price_eur", "price_note", "area_m2", "title", "detail_at")


def pending_details(rows: DataFrame, as_of: str, days: int = 3) -> DataFrame:
    """SRC3: no detail page read yet."""
    return active(rows.where("detail_at is null and deal <> 'wanted' and not coalesce(abroad, false)"), as_of, days)


def stale_details(rows: DataFrame, as_of: str, days: int = 7, stale_days: int = 10) -> DataFrame:
    """SRC4: details older than ``days``, still listed, not sold."""
    return active(rows.where(F.col("detail_at") < F.date_sub(F.lit(as_of).cast("date"), days).cast("timestamp")).where("not coalesce(sold, false)"), as_of, stale_days)


def by_ids(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """SRC5 / J5: rows whose id is in a table of ids."""
    return rows.join(ids.select("id").distinct(), "id", "left_semi")
