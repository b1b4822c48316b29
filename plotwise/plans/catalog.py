"""All queries of the library by name, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plotwise.functions import pricing, text
from plotwise.operators import alerts, analysis, dedupe, feedback, geo, market, reasons, runs, scoring, stages, upsert
from plotwise.plans import derived, oracle, owner, texts
from plotwise.scratch import write_table
from plotwise.sources import pages
from plotwise.sources.listings import AS_OF, active, by_ids, listings, market_rows, pending_details, spread, spread_listings, stale_details
from plotwise.streaming import folds, jobs

QUERIES: dict = {}
SQL = oracle.SQL
#: Minimum samples at district, city and national level.
MINS = (15, 8, 15)
#: (town, lat, lng): the test tables' cities on a grid; the towns of a real deployment come as the same kind of list.
TOWNS = [(f"NATION_{i}", 41 + i * 0.05, 20.5 + i * 0.1) for i in range(25)]


def query(f):
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded, a little off the ties, so that the last bits of two engines do not count."""
    return df.select(*[(F.round(F.col(c) + 1e-9, digits) + 0.0).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def as_settings() -> scoring.Settings:
    return scoring.Settings(as_of=AS_OF, cities=("NATION_1", "NATION_2", "NATION_3"), decay_floor=0.95)


@query
def deals_below_local_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = listings(spark, sf_dir)
    return rounded(market.deals_below_median(rows, market.market_refs(rows), MINS))


@query
def active_listings(spark, sf_dir):
    return active(listings(spark, sf_dir), AS_OF, 300).select("id", "kind", "last_seen")


@query
def market_window_rows(spark, sf_dir):
    return market_rows(listings(spark, sf_dir), AS_OF, 800).select("id", "kind", "deal", "city", "district", "price_eur", "area_m2")


@query
def pending_detail_rows(spark, sf_dir):
    return pending_details(listings(spark, sf_dir), AS_OF, 300).select("id", "kind")


@query
def stale_detail_rows(spark, sf_dir):
    return stale_details(listings(spark, sf_dir), AS_OF, 60, 300).select("id", "detail_at")


@query
def prices_and_bands(spark, sf_dir):
    """P5, P6, P7."""
    return listings(spark, sf_dir).select("id", pricing.total_price().alias("total"), pricing.ppm2().alias("ppm2"), pricing.size_band().alias("band"))


@query
def market_buckets(spark, sf_dir):
    return rounded(market.market_refs(listings(spark, sf_dir)))


@query
def market_summary(spark, sf_dir):
    return rounded(market.market_summary(market.market_refs(listings(spark, sf_dir))))


@query
def market_reference(spark, sf_dir):
    """J1 in both orders: size first for land and houses, place first for flats."""
    rows = listings(spark, sf_dir)
    return rounded(market.with_reference(rows, market.market_refs(rows), MINS).select("id", "ref_median", "ref_n", "ref_level", "ref_band"))


@query
def high_plot_reference(spark, sf_dir):
    rows = listings(spark, sf_dir)
    refs = market.high_plot_refs(rows)
    return rounded(market.with_high_plot_reference(market.high_plots(rows), refs).select("id", "ref_median", "ref_n", "ref_band"))


@query
def rate_calibration(spark, sf_dir):
    nightly = listings(spark, sf_dir).where("price_eur between 15 and 250").withColumn("deal", F.when(F.col("deal") == "rent", "short_term").otherwise(F.col("deal"))).withColumns({"lat": F.lit(0.0), "lng": F.lit(0.0)})
    return rounded(scoring.calibrated_rates(nightly, as_settings()))


@query
def real_age(spark, sf_dir):
    return dedupe.with_real_age(listings(spark, sf_dir), "ads", 975).select("id", "id_age_days")


@query
def shared_pins(spark, sf_dir):
    rows = listings(spark, sf_dir)
    small = dedupe.shared_pins(rows, 4, 5).withColumn("digits", F.lit(4))
    return small.unionByName(dedupe.shared_pins(rows, 5, 3).withColumn("digits", F.lit(5)))


def _for_dedupe(spark, sf_dir):
    return listings(spark, sf_dir).withColumn("image", F.lit(None).cast("string"))


@query
def dedupe_pairs(spark, sf_dir):
    return dedupe.same_property(dedupe.candidate_pairs(_for_dedupe(spark, sf_dir))).select("a", "b")


@query
def dedupe_clusters(spark, sf_dir):
    return dedupe.clusters(_for_dedupe(spark, sf_dir))


def _written_for_dedupe(spark, sf_dir):
    return write_table(_for_dedupe(spark, sf_dir).select("id", "kind", "deal", "city", "district", "source", "source_no", "title", "image", "price_eur", "price_note", "area_m2", "detail_at"), "rows")


@query
def dedupe_survivors(spark, sf_dir):
    return dedupe.dedupe(_written_for_dedupe(spark, sf_dir)).select("id", "duplicates")


@query
def dedupe_ages(spark, sf_dir):
    """Survivors with the greatest age of their cluster."""
    return dedupe.dedupe(dedupe.with_real_age(_written_for_dedupe(spark, sf_dir), "ads", 975)).select("id", "duplicates", "id_age_days")


@query
def pins_cleared(spark, sf_dir):
    """A7."""
    return dedupe.without_shared_pins(listings(spark, sf_dir)).select("id", "lat", "lng")


@query
def exact_copies_first(spark, sf_dir):
    rows = listings(spark, sf_dir)
    return dedupe.first_of_copies(rows.withColumn("price_step", F.floor(F.col("price_eur") / 100)), ["kind", "city", "price_step", "area_m2"], "source_no")


@query
def refile_nearest_town(spark, sf_dir):
    return geo.refile(listings(spark, sf_dir), TOWNS, 40, 60).where("city_form is not null").select("id", "city", "city_form")


@query
def distance_to_centres(spark, sf_dir):
    rows = listings(spark, sf_dir)
    km = lambda p: pricing.arc_km(pricing.missing_if_zero(F.col("lat")), pricing.missing_if_zero(F.col("lng")), F.lit(p[0]), F.lit(p[1]))
    return rounded(rows.select("id", km((41.9961, 21.4317)).alias("km_a"), km((41.1172, 20.8016)).alias("km_b")), 3)


def _gazetteer(spark):
    return spark.createDataFrame([(f"NATION_{i}", 41 + i * 0.05, 20.5 + i * 0.1) for i in range(0, 25, 2)], "name string, place_lat double, place_lng double")


def _hits(spark, sf_dir):
    rows = listings(spark, sf_dir).withColumn("names", F.array(F.concat(F.lit("NATION_"), (F.col("source_no") % 25).cast("string")), F.col("city"), F.lit("NATION_0")))
    centres = spark.createDataFrame([(n, a, b) for n, a, b in TOWNS], "city string, c_lat double, c_lng double")
    named = rows.select("id", "city", F.posexplode("names").alias("pos", "name")).join(F.broadcast(_gazetteer(spark)), "name")
    plausible = geo.near_town(named, F.broadcast(centres), 60)
    return rows, plausible.groupBy("id").agg(F.min_by(F.struct("name", "place_lat", "place_lng", "pos"), "pos").alias("h")).select("id", "h.*")


@query
def gazetteer_first_hit(spark, sf_dir):
    """The first candidate name that is in the gazetteer and near the filed town."""
    return _hits(spark, sf_dir)[1].select("id", "name", "pos")


@query
def pin_against_place(spark, sf_dir):
    return rounded(geo.pin_against_place(*_hits(spark, sf_dir), 40))


@query
def elevation_lookup(spark, sf_dir):
    """Dimension by rounded coordinates, and the cells it lacks."""
    rows = listings(spark, sf_dir)
    pinned = rows.where("lat <> 0").select(geo.cell(F.col("lat"), F.col("lng"), 2).alias("cell"), "elevation")
    dimension = pinned.groupBy("cell").agg(F.max("elevation").alias("cell_elevation")).where("cell_elevation < 1590")
    return geo.with_dimension(rows, dimension, 2).select("id", "cell", "cell_elevation")


@query
def latest_vote(spark, sf_dir):
    return feedback.latest(derived.votes(spark, sf_dir).select("researcher", "listing_id", "vote", "at", "event_id"), ["researcher", "listing_id"], ["at", "event_id"]).select("researcher", "listing_id", "vote")


@query
def vote_lean(spark, sf_dir):
    counts = feedback.vote_counts(derived.votes(spark, sf_dir), ["researcher", "city"])
    return rounded(counts.select("researcher", "city", "up", "down", feedback.lean(F.col("up"), F.col("down")).alias("lean")))


@query
def feedback_rerank(spark, sf_dir):
    return rounded(feedback.rerank(derived.items(spark, sf_dir), derived.latest_votes(spark, sf_dir)).select("researcher", "id", "score", "delta"))


@query
def rejection_penalties(spark, sf_dir):
    v = derived.votes(spark, sf_dir).where("vote < 0")
    code = F.element_at(F.array(*map(F.lit, ("sml", "big", "loc", "prc", "str"))), (F.col("event_id") % 5 + 1).cast("int"))
    rejections = v.select("researcher", "listing_id", code.alias("reason"), "kind", "city", "district", F.col("area_m2").alias("area"))
    return rounded(feedback.rejection_penalties(derived.items(spark, sf_dir), rejections))


def _vote_events(votes):
    name = F.when(F.col("vote") < 0, "down").when(F.col("event_id") % 7 == 0, "clear").when(F.col("event_type") == "purchase", "ok").otherwise("up")
    return votes.select("researcher", "listing_id", name.alias("event"), "at", "event_id")


@query
def vote_fold(spark, sf_dir):
    """D18 over an ordered stream of up, down, ok and clear."""
    return feedback.fold_votes(_vote_events(derived.votes(spark, sf_dir)))


@query
def stream_feedback(spark, sf_dir):
    """ST4: the same as a stream in any order."""
    return folds.vote_stream(_vote_events(derived.votes(spark, sf_dir, jobs.read_stream(spark, f"{sf_dir}/events.parquet"))))


@query
def facts_applied(spark, sf_dir):
    """A17, J4."""
    v = derived.votes(spark, sf_dir).where("vote > 0")
    facts = v.select("listing_id", F.when(F.col("event_id") % 2 == 0, "price").otherwise("area").alias("field"), F.col("value").cast("string").alias("value"), F.col("at").alias("set_at"))
    return feedback.apply_facts(listings(spark, sf_dir), facts).select("id", "price_eur", "area_m2")


@query
def reviewed_hidden(spark, sf_dir):
    """J6 / J7."""
    down = derived.latest_votes(spark, sf_dir).where("vote < 0").select("researcher", F.col("listing_id").alias("id"))
    return derived.items(spark, sf_dir).join(down, ["researcher", "id"], "left_anti").select("researcher", "id")


@query
def known_ids(spark, sf_dir):
    """J5, SRC5."""
    return by_ids(listings(spark, sf_dir), derived.votes(spark, sf_dir).select(F.col("listing_id").alias("id"))).select("id", "kind")


@query
def top_n_per_model(spark, sf_dir):
    """W1, O1."""
    return feedback.top_n(derived.items(spark, sf_dir).where("qualified"), "researcher", [F.desc("score"), F.col("id")], 5).select("researcher", "id", "score", "place")


@query
def price_changes(spark, sf_dir):
    rows = listings(spark, sf_dir).select(F.col("district").alias("listing_id"), F.col("last_seen").alias("seen_at"), "price_eur").where("listing_id is not null")
    per_day = rows.groupBy("listing_id", "seen_at").agg(F.min("price_eur").alias("price_eur"))
    return upsert.price_changes(per_day)


@query
def price_history_arrays(spark, sf_dir):
    """SRC6 in batch form: first and last of each listing's history and its length."""
    rows = listings(spark, sf_dir).where("district is not null")
    return rows.groupBy("district").agg(F.count("*").alias("n"), F.min_by("price_eur", F.struct("last_seen", "id")).alias("first"), F.max_by("price_eur", F.struct("last_seen", "id")).alias("last"))


def _cards(rows):
    return rows.where("source_no % 2 = 0").select("id", F.concat("title", F.lit(" new")).alias("title"), F.when(F.col("source_no") % 4 == 0, F.col("price_eur") * 0.9).otherwise(F.col("price_eur")).alias("price_eur"), "site_old_price", F.lit(None).cast("string").alias("image"), "deal", "price_note", "area_m2", "last_seen")


def _two_batches(spark, sf_dir):
    rows = listings(spark, sf_dir).withColumn("image", F.lit(None).cast("string"))
    cols = ["id", "title", "price_eur", "site_old_price", "image", "deal", "price_note", "area_m2", "last_seen"]
    current = rows.where("source_no % 3 <> 0").select(*cols, "first_price", "detail_at")
    batch = _cards(rows)
    return current, batch


@query
def upsert_merge(spark, sf_dir):
    return upsert.upsert(*_two_batches(spark, sf_dir)).select("id", "title", "price_eur", "first_price", "is_new", "changed")


@query
def partial_update(spark, sf_dir):
    current, batch = _two_batches(spark, sf_dir)
    return upsert.partial_update(current, batch, ["title", "site_old_price"]).select("id", "title", "site_old_price", "price_eur")


@query
def prune_cascade(spark, sf_dir):
    rows = listings(spark, sf_dir)
    _, children = upsert.prune(rows, rows.select(F.col("id").alias("listing_id"), "price_eur"), AS_OF, 400)
    return children


def _sitemap(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").groupBy("url").agg(F.min("page_id").alias("page_id"))
    entries = p.select("url", F.when(F.col("page_id") % 5 == 0, "").otherwise((F.col("page_id") % 7).cast("string")).alias("lastmod"))
    known = p.where("page_id % 3 <> 0").select("url", (F.col("page_id") % 6).cast("string").alias("lastmod"))
    return entries, known


@query
def changed_urls(spark, sf_dir):
    return upsert.changed_urls(*_sitemap(spark, sf_dir))


@query
def due_urls(spark, sf_dir):
    """A run reads 150 pages at most."""
    return upsert.due_urls(*_sitemap(spark, sf_dir), 150)


def _scored_base(spark, sf_dir):
    """The listings with what the models read besides: derived from the same columns."""
    mod = F.col("source_no") % 3
    flag = lambda k: F.when((F.col("source_no") + k) % 3 == 0, True).when((F.col("source_no") + k) % 11 == 0, False)
    return listings(spark, sf_dir).withColumns({
        "utilities": F.create_map(F.lit("electricity"), flag(0), F.lit("water"), flag(1), F.lit("road"), flag(2)),
        "land_type": F.when(mod == 0, "building").when(mod == 1, "agricultural").otherwise("unknown"),
        "skopje_min": F.when(F.col("source_no") % 4 != 0, (F.col("source_no") % 240) + 0.0),
        "renovation": F.col("source_no") % 5 == 0, "year_built": F.when(F.col("source_no") % 2 == 0, 1950 + F.col("source_no") % 70),
        "urgent_words": (F.col("source_no") % 3).cast("int"), "id_age_days": F.when(F.col("source_no") % 2 == 0, F.col("source_no") % 500), "days_listed": (F.col("source_no") % 90).cast("long"),
        "furnished": F.when(mod == 0, True).when(mod == 1, False),
    })


@query
def score_rental(spark, sf_dir):
    rows, c = _scored_base(spark, sf_dir), as_settings()
    rates = spark.createDataFrame([(i + 1, float(r), 0) for i, r in enumerate(c.nightly)], "rooms int, rate double, seen int")
    return rounded(scoring.score_rental(rows, rates, c).select("id", "profit", "score"), 3)


@query
def score_land(spark, sf_dir):
    rows = _scored_base(spark, sf_dir)
    return rounded(scoring.score_land(rows, market.market_refs(rows), as_settings(), MINS).select("id", "discount", "confirmed", "qualified", "score"))


@query
def score_high_plots(spark, sf_dir):
    return rounded(scoring.score_high_plots(_scored_base(spark, sf_dir), as_settings()).select("id", "discount", "qualified", "score"))


@query
def score_flip(spark, sf_dir):
    rows = _scored_base(spark, sf_dir)
    return rounded(scoring.score_flip(rows, market.market_refs(rows), as_settings(), MINS).select("id", "discount", "profit", "roi", "score"))


@query
def score_motivated(spark, sf_dir):
    rows = _scored_base(spark, sf_dir)
    return rounded(scoring.score_motivated(rows, market.market_refs(rows), as_settings(), MINS).select("id", "drop", "discount", "offer", "score"))


@query
def score_auction(spark, sf_dir):
    rows = listings(spark, sf_dir)
    sales = rows.where("deal = 'sale' and source <> 'portal' and price_note is null").withColumns({"deal": F.lit("auction"), "auction_date": F.date_add(F.lit(AS_OF).cast("date"), (F.col("source_no") % 12 - 2).cast("int")), "auction_round": (F.col("source_no") % 3 + 1).cast("int"), "share": F.when(F.col("source_no") % 10 == 0, "1/2")})
    return rounded(scoring.score_auction(sales, market.market_refs(rows), as_settings(), MINS).select("id", "discount", "appraisal", "score"))


@query
def rating_tiers(spark, sf_dir):
    return derived.deals(spark, sf_dir).select("id", "researcher", scoring.rating(F.col("researcher")).alias("rank"))


@query
def open_questions(spark, sf_dir):
    asked = scoring.questions(F.col("researcher"))
    return derived.deals(spark, sf_dir).select("id", F.array_join(asked, ",").alias("questions"), scoring.deal_status(asked).alias("deal_status"))


def _stage_events(e):
    stage = F.when(F.col("event_type") == "view", "viewing").when(F.col("event_type") == "click", "contacted").when(F.col("event_type") == "purchase", "offer").when(F.col("event_type") == "error", "no such stage").otherwise("checks")
    stage = F.when(F.col("event_id") % 10 == 0, "dropped").otherwise(stage)
    return e.select(F.col("user_id").alias("listing_id"), F.when(F.col("user_id") % 3 == 0, "auctions").otherwise("flip").alias("researcher"), stage.alias("stage"), F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("step "), F.col("event_id").cast("string"))).alias("next_step"), F.col("ts").alias("at"), "event_id")


@query
def deal_stages(spark, sf_dir):
    return stages.fold_stages(_stage_events(spark.read.parquet(f"{sf_dir}/events.parquet")))


@query
def stream_deal_stages(spark, sf_dir):
    """ST6: the same as a stream in any order."""
    return folds.stage_stream(_stage_events(jobs.read_stream(spark, f"{sf_dir}/events.parquet")))


@query
def exported_items(spark, sf_dir):
    out = stages.export_items(derived.deals(spark, sf_dir).select("researcher", "id", "score", "qualified"), 300)
    return out.select("researcher", "count", "n_qualified", F.size("items").alias("n_items"), F.get("items", 0)["id"].alias("first_id"))


def _prioritised(spark, sf_dir):
    rows = _scored_base(spark, sf_dir)
    found = market.with_reference(rows, market.market_refs(rows), MINS)
    return found.withColumn("priority", alerts.detail_priority(("NATION_1", "NATION_2", "NATION_3"), (120, 900)))


@query
def eligible_listings(spark, sf_dir):
    """P8."""
    return analysis.eligible(_scored_base(spark, sf_dir), 45).select("id", "deal", "days_listed")


@query
def all_models(spark, sf_dir):
    """D20, UD2: the deals of all registered models over one table of references."""
    found = analysis.analyse(_scored_base(spark, sf_dir), as_settings(), MINS)
    return rounded(found)


@query
def all_penalties(spark, sf_dir):
    """Rejections for all kinds of reasons against deals of the same researcher: by size, place, and what their texts say."""
    codes = ("sml", "big", "loc", "prc", "str", "far", "ren", "bsm", "old", "nhm", "tit", "shr", "agr", "ter", "dup")
    # joined once: the rejections and the items read the written rows
    rows = write_table(spread_listings(spark, sf_dir).select("id", "kind", "city", "district", "area_m2", "source_no"), "rows")
    v = derived.votes(spark, sf_dir, rows=rows).where("vote < 0")
    code = F.element_at(F.array(*map(F.lit, codes)), (F.col("event_id") % 15 + 1).cast("int"))
    rejections = v.select("researcher", "listing_id", code.alias("reason"), "kind", "city", "district", F.col("area_m2").alias("area"))
    said = ("Стан за реновирање", "Сутерен 40м2", "без лифт", "Деловен простор", "без имотен лист", "1/2 идеален дел", "Нива", "стрмна падина", "Стан")
    n = F.col("source_no")
    title = F.element_at(F.array(*map(F.lit, said)), (n % 9 + 1).cast("int"))
    items = rows.select(F.concat(F.lit("r"), (n % 4).cast("string")).alias("researcher"), "id", "kind", "city", "district", F.col("area_m2").alias("area"), title.alias("title"), F.lit(None).cast("string").alias("description"))
    return rounded(reasons.penalties(items, rejections).select("researcher", "id", "penalty", F.array_join("reasons", ",").alias("reasons")))


@query
def detail_priority(spark, sf_dir):
    return _prioritised(spark, sf_dir).select("id", "priority")


@query
def detail_queue(spark, sf_dir):
    """The limits are the reading budget of a run."""
    rows = _prioritised(spark, sf_dir).select("id", "priority", "last_seen", "detail_at")
    return alerts.detail_queue(rows.where("detail_at is null"), rows.where("detail_at is not null"), 900, 80).select("id", "priority")


@query
def alert_outbox(spark, sf_dir):
    sent = derived.latest_votes(spark, sf_dir).select(F.lit("flip").alias("researcher"), F.col("listing_id").alias("id")).distinct()
    return alerts.alert_outbox(derived.deals(spark, sf_dir), sent).select("researcher", "id", "score", "place")


@query
def open_leads(spark, sf_dir):
    return alerts.open_leads(derived.deals(spark, sf_dir))


@query
def due_steps(spark, sf_dir):
    n = F.col("source_no")
    steps = listings(spark, sf_dir).select("id", F.element_at(F.array(*map(F.lit, ("new", "offer", "won", "dropped"))), (n % 4 + 1).cast("int")).alias("stage"), F.date_add(F.lit(AS_OF).cast("date"), (n % 400 - 200).cast("int")).alias("due"))
    return alerts.due_steps(steps, AS_OF).withColumn("due", F.col("due").cast("string"))


@query
def bare_downvotes(spark, sf_dir):
    v = derived.votes(spark, sf_dir)
    return alerts.bare_downvotes(derived.latest_votes(spark, sf_dir), v.where("vote < 0 and event_id % 2 = 0"))


@query
def learning_suggestions(spark, sf_dir):
    v = derived.votes(spark, sf_dir).where("vote < 0")
    return rounded(alerts.suggestions(v.select("researcher", F.when(F.col("event_id") % 2 == 0, "sml").otherwise("loc").alias("reason"), F.col("area_m2").alias("area"))))


@query
def norm_text(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", text.norm(F.col("text")).alias("normed"))


@query
def keyword_hits(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = ["license", "apache", "token", "the", "der", "que"]
    return d.select("doc_id", F.array_join(text.keyword_hits(text.norm(F.col("text")), words, True), ",").alias("hits"))


@query
def redacted_text(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", text.redact(F.col("text")).alias("text"))


@query
def title_jaccard(spark, sf_dir):
    """Likeness of the titles of listings that share a district."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    names = p.groupBy("p_brand", "p_type").agg(F.min("p_name").alias("a"), F.max("p_name").alias("b"))
    return rounded(names.select("p_brand", "p_type", dedupe.jaccard(dedupe.title_words(F.col("a")), dedupe.title_words(F.col("b"))).alias("jaccard")))


def _ads(spark, sf_dir, lineitem=None, rows=None):
    """Listing texts made from the listings' own numbers, in the words that sellers use; ``rows``: listings that are joined already."""
    n = F.col("source_no")
    words = F.element_at(F.array(*map(F.lit, ("Се продава стан", "Se izdava stan", "Плац", "Куќа со двор", "Бара се стан"))), (n % 5 + 1).cast("int"))
    facts = F.element_at(F.array(*map(F.lit, ("струја има, вода во близина", "nema struja i voda, pristap so makadam", "асфалт и вода до плацот", "се очекува струја", ""))), (n % 5 + 1).cast("int"))
    body = F.concat_ws(" ", facts, F.format_string("цена %.0f €, %.0f m2", "price_eur", "area_m2"))
    rows = spread_listings(spark, sf_dir, lineitem) if rows is None else rows
    return rows.select("id", "kind", "city", "district", "price_eur", "area_m2", words.alias("title"), body.alias("text"))


def _runs(spark, sf_dir):
    """Job runs made of the events: one job for each user."""
    e, kind = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_type")
    status = F.when(kind == "error", "running").when(kind == "signup", "failed").otherwise("ok")
    return e.select(F.col("event_id").alias("id"), F.col("user_id").alias("job"), F.col("ts").alias("started"), F.when(status == "ok", F.col("ts") + F.expr("interval 10 minutes")).alias("finished"), status.alias("status"),
                    F.when((kind == "click") & (F.col("user_id") % 2 == 0), "full").when(kind == "view", "quick").alias("mode"), (F.col("event_id") % 500).alias("pages"))


@query
def run_status(spark, sf_dir):
    """SNK9."""
    return runs.settled(_runs(spark, sf_dir)).select("id", "job", "status")


@query
def hours_since_full(spark, sf_dir):
    """A13."""
    return rounded(runs.hours_since_full(_runs(spark, sf_dir), "2024-02-01"))


@query
def recent_runs(spark, sf_dir):
    """SRC7."""
    return runs.recent(_runs(spark, sf_dir)).select("id", "job", "status", "pages")


@query
def advert_facts(spark, sf_dir):
    """What adverts say, which are made of the orders' numbers in the words that sellers use."""
    o = spread(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey").select("o_orderkey", F.floor("o_totalprice").cast("long").alias("a"))
    a, tall = F.col("a").cast("string"), (100 + F.col("a") % 3000).cast("string")
    said = [F.concat(F.lit("Цена: "), a, F.lit(" €, 3 соби, за реновирање")), F.concat(F.lit("prodavam za "), (1000 + F.col("a") % 9000).cast("string"), F.lit("k evra, "), tall, F.lit("m nadmorska visina")),
            F.concat(F.lit("Куќа на Халкидики, цена "), a, F.lit(" денари")), F.concat(F.lit("80 €/м2, надморска висина "), tall, F.lit(" м")), F.concat(F.lit("2,5 SOBI &amp; balkon, namesten, cena "), a, F.lit(" mkd")), F.lit(None).cast("string")]
    t = F.element_at(F.array(*said), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return rounded(o.select("o_orderkey", text.mentions_per_m2(t).alias("per_m2"), text.is_abroad(t).alias("abroad"), text.stated_price(t).alias("price"), text.altitude(t).alias("altitude"), text.rooms(t).alias("rooms"), text.furnished(t).cast("string").alias("furnished"), text.needs_renovation(t).alias("renovate")))


@query
def parsed_ads(spark, sf_dir):
    """X5, X6, X7, X13."""
    t = F.col("text")
    ads = _ads(spark, sf_dir).withColumn("folded", text.norm(t)).withColumn("u", text.utilities(F.col("folded")))
    return rounded(ads.select("id", text.parse_price(t).alias("price"), text.parse_area(t).alias("area"), text.deal_type(F.col("title"), t, F.col("price_eur"), F.col("kind"), F.col("folded")).alias("deal"), *[F.col("u")[k].alias(k) for k in scoring.UTILITIES]))


@query
def price_interpretation(spark, sf_dir):
    m = text.price_meaning(F.col("price_eur"), F.col("kind"), F.col("area_m2"), F.col("title"), F.col("text"))
    return rounded(_ads(spark, sf_dir).select("id", m.alias("m")).select("id", "m.*"))


@query
def reply_facts(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    said = F.concat_ws(" ", F.element_at(F.array(*map(F.lit, ("вода има, струја нема, 1.200 m2", "цена 45.000 €", "асфалт", "не знам"))), (F.col("conv_id") % 4 + 1).cast("int")), "text")
    return c.where("role = 'user'").select("conv_id", "turn", F.to_json(text.seller_facts(said)).alias("facts"))


def _posts(spark, sf_dir, lineitem=None, rows=None):
    """What the texts of posts say of price and area, and where they are."""
    ads = _ads(spark, sf_dir, lineitem, rows)
    return ads.select("id", "kind", F.lit("sale").alias("deal"), "city", "district", text.parse_price(F.col("text")).alias("price_eur"), text.parse_area(F.col("text")).alias("area_m2"), F.lit(None).cast("string").alias("price_note"))


def _verdicts(posts, refs):
    return rounded(market.verdicts(posts, refs, MINS))


@query
def quick_check(spark, sf_dir):
    """D14, SRC17: posts against the market: facts from the text, reference, verdict."""
    # joined once: the posts and the references read the written rows
    rows = write_table(spread_listings(spark, sf_dir).select("id", "source_no", "kind", "deal", "city", "district", "price_eur", "price_note", "area_m2"), "rows")
    return _verdicts(_posts(spark, sf_dir, rows=rows), market.market_refs(rows))


@query
def stream_post_check(spark, sf_dir):
    """ST7: the same as a stream of posts against a written table of references."""
    refs = market.market_refs(listings(spark, sf_dir))
    return jobs.post_check_stream(_posts(spark, sf_dir, jobs.read_stream(spark, f"{sf_dir}/lineitem.parquet")), lambda n: refs, _verdicts, "id string, discount double, verdict string")


@query
def page_details(spark, sf_dir):
    return pages.extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), pages.ARTICLE)


@query
def page_cards(spark, sf_dir):
    return pages.extract(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), pages.LINKS)


@query
def stream_daily_counts(spark, sf_dir):
    """All days, the last ones too."""
    e = jobs.read_stream(spark, f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type")
    return jobs.daily_counts(e, "ts", "event_type", None)


@query
def stream_alerts_once(spark, sf_dir):
    e = jobs.read_stream(spark, f"{sf_dir}/events.parquet")
    return jobs.alerts_once(e.select((F.col("event_id") % 500).cast("string").alias("listing_id"), (F.col("user_id") % 4).cast("string").alias("researcher"), F.col("ts").cast("timestamp").alias("at")))


@query
def stream_price_changes(spark, sf_dir):
    e = jobs.read_stream(spark, f"{sf_dir}/events.parquet")
    return rounded(jobs.price_change_stream(e.select(F.col("user_id").cast("string").alias("listing_id"), F.col("ts").cast("timestamp").alias("seen_at"), F.col("value").alias("price_eur"))))


@query
def stream_upsert(spark, sf_dir):
    """ST1: cards merged as a stream, with the price history that it adds to."""
    last = Window.partitionBy("id").orderBy(F.desc("last_seen"), F.desc("price_eur"))
    current = _two_batches(spark, sf_dir)[0].withColumn("turn", F.row_number().over(last)).where("turn = 1").drop("turn")
    cards = _cards(listings(spark, sf_dir, jobs.read_stream(spark, f"{sf_dir}/lineitem.parquet")))
    state, history = jobs.upsert_stream(cards, current)
    added = history.groupBy(F.col("listing_id").alias("id")).agg(F.count("*").alias("n_history"))
    return state.join(added, "id", "left").select("id", "title", "price_eur", "first_price", F.coalesce("n_history", F.lit(0)).alias("n_history"))


@query
def stream_expiry(spark, sf_dir):
    """ST8: the children of listings that a stream has seen in the last 400 days."""
    alive = folds.expiry_stream(listings(spark, sf_dir, jobs.read_stream(spark, f"{sf_dir}/lineitem.parquet")).select("id", "last_seen"), 400)
    return listings(spark, sf_dir).join(alive, "id", "left_semi").select(F.col("id").alias("listing_id"), "price_eur")


@query
def stream_sitemap(spark, sf_dir):
    """ST3: the entries that three snapshots of a sitemap made due, one after the other."""
    p = jobs.read_stream(spark, f"{sf_dir}/pages.parquet").select("url", "page_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("snapshot"))
    lastmod = F.when((F.col("page_id") + F.col("snapshot")) % 5 == 0, "").otherwise((F.col("page_id") * (F.col("snapshot") + 1) % 3).cast("string"))
    return jobs.sitemap_stream(p.select(F.col("snapshot").cast("long").alias("snapshot"), "url", lastmod.alias("lastmod")))


QUERIES |= texts.QUERIES | owner.QUERIES
SQL |= texts.SQL | owner.SQL
