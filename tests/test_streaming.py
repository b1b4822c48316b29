"""Streams over events in several files that are not in time order, against the same SQL over all events."""

import duckdb
import pytest

from plotwise.plans.catalog import QUERIES
from plotwise.plans.oracle import SQL

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def unordered(tmp_path_factory):
    top = tmp_path_factory.mktemp("events")
    (top / "events.parquet").mkdir()
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{DIR}/events.parquet'")
    # the newest days come first; the last file has rows of every day
    for i, rows in enumerate(("event_id % 5 > 0 and day(ts) > 20", "event_id % 5 > 0 and day(ts) <= 10", "event_id % 5 > 0 and day(ts) between 11 and 20", "event_id % 5 = 0")):
        c.execute(f"copy (select * from events where {rows} order by event_id) to '{top}/events.parquet/{i}.parquet' (format parquet)")
    return str(top), c


@pytest.mark.parametrize("name", ["stream_daily_counts", "stream_alerts_once", "stream_price_changes"])
def test_file_order_does_not_count(spark, unordered, name):
    top, c = unordered
    a, b = QUERIES[name](spark, top).toPandas(), c.execute(SQL[name]).fetchdf()[QUERIES[name](spark, top).columns]
    shown = lambda x: sorted(tuple(f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) for r in x.values.tolist())
    assert len(a) and shown(a) == shown(b)
    if name == "stream_daily_counts":
        assert a.n.sum() == 1000


# --- jobs that are stopped, fail and go on


def _rows(frame, columns):
    return sorted(tuple("None" if v is None or v != v else str(v) for v in r) for r in frame.select(*columns).toPandas().astype(object).values.tolist())


def _in_two_runs(spark, tmp_path, job, source, write):
    """The result of a job over a folder that gets its files in two parts, with a run after each and one in between whose second batch fails."""
    from plotwise.streaming.tables import BatchTable

    folder, root = tmp_path / "in.parquet", f"file://{tmp_path}/job"
    folder.mkdir()
    write(folder, range(0, 2))
    job(source(str(folder)), root)
    write(folder, range(2, 5))
    kept, calls = BatchTable.write, []

    def failing(self, rows, n):
        kept(self, rows, n)
        calls.append(n)
        if len(calls) == 2:
            raise RuntimeError("the executor with this batch is gone")

    BatchTable.write = failing
    try:
        with pytest.raises(Exception, match="gone"):
            job(source(str(folder)), root)
    finally:
        BatchTable.write = kept
    return job(source(str(folder)), root)


def _event_files(c):
    def write(folder, parts):
        for i in parts:  # dealt by a hash of the id: every file has rows of all times
            c.execute(f"copy (select * from events where event_id * 7 % 5 = {i} order by event_id desc) to '{folder}/{i}.parquet' (format parquet)")

    return write


def test_stages_and_votes_go_on_after_a_failure(spark, tmp_path, unordered):
    from pyspark.sql import functions as F

    from plotwise.operators.feedback import fold_votes
    from plotwise.operators.stages import fold_stages
    from plotwise.plans.catalog import _stage_events
    from plotwise.streaming import folds, jobs

    c, all_events = unordered[1], spark.read.parquet(f"{DIR}/events.parquet")
    votes = lambda e: e.select((F.col("user_id") % 4).cast("string").alias("researcher"), (F.col("event_id") % 40).cast("string").alias("listing_id"), F.col("event_type").alias("event"), F.col("ts").alias("at"), "event_id").withColumn("event", F.when(F.col("event") == "error", "down").when(F.col("event") == "view", "clear").when(F.col("event") == "click", "ok").otherwise("up"))
    source = lambda path: jobs.read_stream(spark, path)
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    got = _in_two_runs(spark, tmp_path / "a", lambda e, root: folds.stage_stream(_stage_events(e), root), source, _event_files(c))
    want = fold_stages(_stage_events(all_events))
    assert _rows(got, want.columns) == _rows(want, want.columns)
    got = _in_two_runs(spark, tmp_path / "b", lambda e, root: folds.vote_stream(votes(e), root), source, _event_files(c))
    want = fold_votes(votes(all_events))
    assert _rows(got, want.columns) == _rows(want, want.columns)


@pytest.mark.parametrize("name", ["daily", "alerts", "prices"])
def test_tables_go_on_after_a_failure(spark, tmp_path, unordered, name):
    from pyspark.sql import functions as F

    from plotwise.streaming import jobs

    job = {
        "daily": lambda e, root: jobs.daily_counts(e.select(F.col("ts").cast("timestamp").alias("ts"), "event_type"), "ts", "event_type", None, root),
        "alerts": lambda e, root: jobs.alerts_once(e.select((F.col("event_id") % 500).cast("string").alias("listing_id"), (F.col("user_id") % 4).cast("string").alias("researcher"), F.col("ts").cast("timestamp").alias("at")), root),
        "prices": lambda e, root: jobs.price_change_stream(e.select(F.col("user_id").cast("string").alias("listing_id"), F.col("ts").cast("timestamp").alias("seen_at"), F.col("value").alias("price_eur")), root=root),
    }[name]
    got = _in_two_runs(spark, tmp_path, job, lambda path: jobs.read_stream(spark, path), _event_files(unordered[1]))
    query = {"daily": "stream_daily_counts", "alerts": "stream_alerts_once", "prices": "stream_price_changes"}[name]
    want = QUERIES[query](spark, DIR)
    digits = lambda f: f.select(*[F.round(c, 4).alias(c) if k == "double" else F.col(c) for c, k in f.dtypes])
    assert _rows(digits(got), want.columns) == _rows(want, want.columns)
    if name == "alerts":
        first, third = (jobs.sent_by(spark, f"file://{tmp_path}/job", n) for n in (0, 2))
        assert first.count() > 0 and first.join(third, ["listing_id", "researcher"]).count() == 0


def test_expiry_with_late_rows(spark, tmp_path):
    from plotwise.streaming import folds, jobs

    days = [("a", "2024-01-01"), ("b", "2024-03-01"), ("c", "2024-02-20"), ("a", "2024-01-05"), ("d", "2023-01-01"), ("e", "2024-02-10"), ("f", "2024-02-09"), ("g", None)]
    frame = spark.createDataFrame(days, "id string, day string").selectExpr("id", "to_timestamp(day) as last_seen")
    root, folder = f"file://{tmp_path}/job", tmp_path / "in.parquet"
    folder.mkdir()
    run = lambda: folds.expiry_stream(jobs.read_stream(spark, str(folder)), 20, root)
    for part in (slice(1, 2), slice(0, 1), slice(2, 8)):  # the newest row first, then rows that are over when they come
        spark.createDataFrame(frame.collect()[part], frame.schema).coalesce(1).write.mode("append").parquet(str(folder))
        got = {r.id for r in run().collect()}
    assert got == {"b", "c", "e"}  # e: seen 20 days before the newest row, to the day
    spark.createDataFrame([("z", "2024-03-02"), ("d", "2024-02-25")], "id string, day string").selectExpr("id", "to_timestamp(day) as last_seen").coalesce(1).write.mode("append").parquet(str(folder))
    assert {r.id for r in run().collect()} == {"b", "c", "d", "z"}


def test_sitemap_snapshots_in_sequence(spark, tmp_path):
    import time

    from plotwise.operators.upsert import changed_urls
    from plotwise.streaming import jobs

    shots = [{"a": "1", "b": "", "c": "1"}, {"a": "1", "b": "2", "d": None, "x": "9"}, {"a": "3", "b": "", "c": "1", "d": "4"}, {"a": "1", "b": "2", "c": "2"}]
    known, want = spark.createDataFrame([], "url string, lastmod string"), []
    folder, root = tmp_path / "maps", f"file://{tmp_path}/job"
    folder.mkdir()
    for i, shot in enumerate(shots):
        rows = spark.createDataFrame([(f"http://h/oglasi/oglas/{u}", m or "") for u, m in shot.items() if u != "x"], "url string, lastmod string")
        due = changed_urls(rows, known).collect()
        want += [(i, r.url, r.lastmod) for r in due]
        known = spark.createDataFrame(list({**{r.url: r.lastmod for r in known.collect()}, **{r.url: r.lastmod for r in due}}.items()), "url string, lastmod string")
        body = "".join(f"<url><loc>http://h/{'blog' if u == 'x' else 'oglasi/oglas'}/{u}</loc>" + (f"<lastmod>{m}</lastmod>" if m is not None else "") + "</url>" for u, m in shot.items())
        (folder / f"sitemap-{i}.xml").write_text(f"<urlset>{body}</urlset>")
        if i in (1, 3):  # two runs, two snapshots each
            got = jobs.sitemap_stream(jobs.read_sitemaps(spark, str(folder), "/oglasi/oglas/"), root)
        time.sleep(1.1)  # files are taken by their time
    assert sorted((r.snapshot, r.url, r.lastmod) for r in got.collect()) == sorted(want)


def test_upsert_stream_against_one_merge_after_another(spark, tmp_path):
    from plotwise.operators.upsert import upsert
    from plotwise.plans.catalog import _two_batches
    from plotwise.streaming import jobs

    current, cards = (f.dropDuplicates(["id"]) for f in _two_batches(spark, DIR))
    folder = tmp_path / "in.parquet"
    folder.mkdir()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    parts = [cards.where("abs(hash(id)) % 3 = 0"), cards.where("abs(hash(id)) % 3 > 0").selectExpr("*"), cards.where("abs(hash(id)) % 3 = 0").selectExpr("id", "title", "price_eur * 0.8 as price_eur", "site_old_price", "image", "deal", "price_note", "area_m2", "last_seen")]
    state = current
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(str(folder))
        got, history = jobs.upsert_stream(jobs.read_stream(spark, str(folder)), current, f"file://{tmp_path}/job")
        state = spark.createDataFrame(upsert(state, part).select(*current.columns).collect(), current.schema)
    assert _rows(got, current.columns) == _rows(state, current.columns)
    assert history.count() > cards.count() / 3


def test_post_check_meets_the_newer_references(spark, tmp_path):
    from plotwise.streaming import jobs

    folder = tmp_path / "in.parquet"
    folder.mkdir()
    for i in (1, 2):
        spark.createDataFrame([(f"p{i}", 10.0)], "id string, price double").coalesce(1).write.mode("append").parquet(str(folder))
        refs = spark.createDataFrame([(20.0 * i,)], "ref double")
        got = jobs.post_check_stream(jobs.read_stream(spark, str(folder)), lambda n, refs=refs: refs, lambda posts, refs: posts.crossJoin(refs).selectExpr("id", "1 - price / ref as discount"), "id string, discount double", f"file://{tmp_path}/job")
    assert {r.id: r.discount for r in got.collect()} == {"p1": 0.5, "p2": 0.75}


def test_keyed_table_whole_and_deltas(spark, tmp_path):
    from plotwise.streaming.tables import KeyedTable

    t = KeyedTable(spark, f"file://{tmp_path}/t", "id string, v int, gone boolean", ["id"], every=3)
    assert t.state().count() == 0
    for n in range(8):
        t.write(spark.createDataFrame([(f"k{n % 3}", n, n == 6)], "id string, v int, gone boolean"), n)
    assert {r.id: r.v for r in t.state().collect()} == {"k1": 7, "k2": 5} and {r.id: r.v for r in t.state(6).collect()} == {"k0": 3, "k1": 4, "k2": 5}
