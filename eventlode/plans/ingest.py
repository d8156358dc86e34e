"""Ingest as one set-based plan: normalize, fold, sync, de-duplicate, resolve venues, infer artists, assign types, insert, place orphans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlode.functions import dates, names
from eventlode.functions import text as T
from eventlode.operators import classify, dealt, fuzzy, upsert, writes
from eventlode.operators.landed import landed
from eventlode.plans.book import Book
from eventlode.plans.search import bound
from eventlode.sources import bind

BOOK = Book()


def split_titles(raw: DataFrame) -> DataFrame:
    """"A @ B" in a name gives the venue; in a venue it gives the title, where the name is part of that."""
    name, venue = T.name_and_venue(F.col("name"), F.col("venue_name"))
    rows = raw.withColumn("_n", name).withColumn("_v", venue)
    parts = F.split("_v", " @ ", 2)
    two = F.size(parts) == 2
    title, place = F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))
    longer = two & (title != "") & (T.blank(F.col("_n")) | F.contains(F.lower(title), F.lower("_n")))
    return rows.withColumn("name", F.when(longer, title).otherwise(F.col("_n"))).withColumn("venue_name", F.when(two, place).otherwise(F.col("_v"))).drop("_n", "_v")


def ingest(events: DataFrame, raw: DataFrame, arrival: str = "arrival", least: float = 0.85) -> DataFrame:
    """events: stored rows (event_id, source, source_id, name, venue_name, start_date, start_time, end_date, end_time, price).
    raw: new records of the same columns without event_id, with an arrival number. Returns all rows after the ingest.

    Equal (source, source_id) fold in arrival order and fill blanks of stored rows; a new row whose name resembles that of
    a stored row or of a new row kept before, at the same venue and day, is dropped; rows without a venue's name are not
    compared. Missing end times follow the start; a new row without an artist gets the one that its title names.
    """
    rows = split_titles(raw).filter(F.col("start_date").isNotNull())
    key = ["source", "source_id"]
    filled = ["price", "start_time", "end_time"]
    delta = landed(upsert.fold_delta(rows, key, arrival).join(rows.groupBy(*key).agg(F.min(arrival).alias(arrival)), key))
    known = delta.join(events.select(*key), key, "left_semi")
    new = landed(delta.join(events.select(*key), key, "left_anti"))
    # stored rows before new ones, and only those of the blocks that new rows come to
    old_rank = events.select("name", "venue_name", "start_date", F.col("event_id").alias("_order"), F.lit(False).alias("_new"))
    new_rank = new.select("name", "venue_name", "start_date", F.col(arrival).alias("_order"), F.lit(True).alias("_new"))
    touched = old_rank.join(new_rank.select("venue_name", "start_date").distinct(), ["venue_name", "start_date"], "left_semi")
    fresh = new.join(fuzzy.surviving(touched.unionByName(new_rank), ["venue_name", "start_date"], "_order", "name", "_new", least).withColumnRenamed("_order", arrival), arrival, "left_semi").select(*key)
    if "artist_name" in new.columns:
        new = new.withColumn("artist_name", F.coalesce(F.nullif("artist_name", F.lit("")), names.artist_in_title(F.col("name"))))
    inserts = upsert.numbered(new.join(fresh, key, "left_semi"), events, "event_id", [arrival]).drop(arrival)
    updated = upsert.upsert(events, known.drop(arrival), key, backfill=filled).drop("change")
    out = updated.unionByName(inserts.select(*updated.columns))
    end_date, end_time = dates.default_end(F.col("start_date"), F.col("start_time"), F.col("end_date"))
    lacks = F.col("end_time").isNull() & F.col("start_time").isNotNull()
    return out.withColumn("_d", F.when(lacks, end_date).otherwise(F.col("end_date"))).withColumn("_t", F.when(lacks, end_time).otherwise(F.col("end_time"))).drop("end_date", "end_time").withColumnsRenamed({"_d": "end_date", "_t": "end_time"})


#: Columns of a stored event besides its id and key.
EVENT = ["name", "artist_name", "artist_youtube_channel", "start_date", "start_time", "end_date", "end_time", "purchase_link", "price", "price_currency", "description", "image_url", "is_online", "venue_id", "venue_name", "sport", "home_team", "away_team", "tv_channels"]
KEY = ["source", "source_id"]


@dataclass(frozen=True)
class City:
    city_id: int
    name: str
    country: str
    timezone: str | None = None


@dataclass(frozen=True)
class Ingested:
    """All events, all venues, and the type of each new event that has one (event_id, type_name)."""

    events: DataFrame
    venues: DataFrame
    types: DataFrame


def folded(rows: DataFrame, arrival: str) -> DataFrame:
    """One row per key: `first`, the first row to arrive; and what the later ones would add to it, in order.

    Price with currency, start time, channel link: the first that there is. End time with date: the first, if no start time came before
    it, which would have set the end. Names follow the last row of sports, channels come from sports rows. A key's sport is one.
    """
    given = lambda c: ~T.blank(F.col(c))
    first_with = lambda value, test: F.min_by(value, F.when(test, F.col(arrival)))
    when = lambda test: F.min(F.when(test, F.col(arrival)))
    has_channels = F.coalesce(F.size("tv_channels") > 0, F.lit(False))
    price, end = F.struct("price", "price_currency"), F.struct("end_time", "end_date")
    all_ = F.struct(arrival, *[c for c in rows.columns if c not in (*KEY, arrival)])
    return rows.dropna(subset=KEY).groupBy(*KEY).agg(
        F.min_by(all_, arrival).alias("first"),
        first_with(price, F.col("price").isNotNull()).alias("_price"),
        first_with(F.col("start_time"), F.col("start_time").isNotNull()).alias("_start"),
        when(F.col("start_time").isNotNull()).alias("_start_at"),
        first_with(end, F.col("end_time").isNotNull()).alias("_end"),
        when(F.col("end_time").isNotNull()).alias("_end_at"),
        F.max_by("name", F.when(given("sport"), F.col(arrival))).alias("_sport_name"),
        first_with(F.struct("sport", "home_team", "away_team"), given("sport")).alias("_sport"),
        first_with(F.col("tv_channels"), given("sport") & has_channels).alias("_channels"),
        first_with(F.col("artist_youtube_channel"), given("artist_youtube_channel")).alias("_link"),
    )


def _delta(known: DataFrame, arrival: str) -> DataFrame:
    """Folded rows of stored keys, as writes.synced takes them. known also has _stored_start."""
    timely = F.when(F.col("_stored_start").isNotNull(), F.col("_end_at") == F.col(f"first.{arrival}")).otherwise(F.col("_start_at").isNull() | (F.col("_end_at") <= F.col("_start_at")))
    fixed = {
        "price": F.col("_price.price"), "price_currency": F.col("_price.price_currency"), "start_time": F.col("_start"), "end_time": F.when(timely, F.col("_end.end_time")), "end_date": F.when(timely, F.col("_end.end_date")),
        "name": F.coalesce("_sport_name", "first.name"), "sport": F.col("_sport.sport"), "home_team": F.col("_sport.home_team"), "away_team": F.col("_sport.away_team"), "tv_channels": F.col("_channels"), "artist_youtube_channel": F.col("_link"),
    }
    return known.select(*KEY, *[c.alias(n) for n, c in fixed.items()])


def placed_venues(new: DataFrame, venues: DataFrame, city: City, arrival: str) -> DataFrame:
    """All venues after those of new rows are found by name in the city or created; found ones get a website and a time zone if they lack one."""
    rows = new.filter(~T.blank(F.col("venue_name")))
    first_with = lambda c: F.min_by(c, F.when(~T.blank(F.col(c)), F.col(arrival)))
    told = rows.groupBy("venue_name").agg(F.min_by(F.struct(arrival, *[f"venue_{c}" for c in ("address", "city", "country", "lat", "lon", "timezone", "website_url")]), arrival).alias("v"), first_with("venue_website_url").alias("_url"), first_with("venue_timezone").alias("_zone"))
    own = venues.filter(F.col("city_id") == city.city_id).groupBy("venue_name").agg(F.min("venue_id").alias("venue_id"))
    of = told.join(own, "venue_name", "left")
    filled = venues.join(of.filter("venue_id is not null").select("venue_id", "_url", "_zone"), "venue_id", "left")
    fill = lambda c, by: F.when(T.blank(F.col(c)) & F.col(by).isNotNull(), F.col(by)).otherwise(F.col(c))
    kept = filled.withColumns({"website_url": fill("website_url", "_url"), "timezone": fill("timezone", "_zone")}).select(*venues.columns)
    either = lambda c, other: F.when(T.blank(F.col(c)), F.lit(other)).otherwise(F.col(c))
    made = of.filter("venue_id is null").select(
        "venue_name", F.lit(city.city_id).cast("long").alias("city_id"), F.coalesce(F.nullif(either("v.venue_timezone", city.timezone), F.lit("")), "_zone").alias("timezone"), F.col("v.venue_address").alias("street_address"),
        either("v.venue_city", city.name).alias("physical_city"), either("v.venue_country", city.country).alias("physical_country"), F.col("v.venue_lat").alias("latitude"), F.col("v.venue_lon").alias("longitude"), F.coalesce("_url", "v.venue_website_url").alias("website_url"), F.col(f"v.{arrival}").alias(arrival),
    )
    return kept.unionByName(upsert.numbered(made, venues, "venue_id", [arrival]).drop(arrival), allowMissingColumns=True)


def ingested(events: DataFrame, raw: DataFrame, venues: DataFrame, performers: DataFrame, kinds: DataFrame, city: City, arrival: str = "arrival", least: float = 0.85) -> Ingested:
    """One batch of records of a city into the catalog.

    events: event_id, source, source_id and EVENT. raw: arrival, KEY, EVENT without venue_id, raw_categories (array), venue_website_url,
    venue_timezone, venue_address, venue_city, venue_country, venue_lat, venue_lon. venues: venue_id, venue_name, city_id, timezone, website_url, street_address,
    physical_city, physical_country, latitude, longitude, default_type. performers: name, name_key, type_name, category. kinds: type_id, type_name, category.

    Titles and venues are split; undated records go. Stored keys are synced. A new record whose name resembles a stored
    or kept one of its venue and day is dropped. Others find or create their venue, get an end and an artist (given, inferred from the title, or the
    performer that the title is), an id in order of arrival, and a type by the priority chain. At last events without a venue's id are placed by name.
    Rows of a key fold in order of arrival, and whether a new key is dropped is decided by its first row: its name, venue and day are
    taken to be one within a batch. Records without a key are ignored.
    """
    keyed = landed(folded(split_titles(raw).filter(F.col("start_date").isNotNull()), arrival))
    stored_keys = events.select(*KEY, F.col("start_time").alias("_stored_start"))
    delta = _delta(keyed.join(stored_keys, KEY), arrival)
    new = landed(keyed.join(stored_keys, KEY, "left_anti"))

    mine = new.select(F.col("first.name").alias("name"), F.col("first.venue_name").alias("venue_name"), F.col("first.start_date").alias("start_date"), F.col(f"first.{arrival}").alias("_order"), F.lit(True).alias("_new"))
    old = events.select("name", "venue_name", "start_date", F.col("event_id").alias("_order"), F.lit(False).alias("_new"))
    touched = old.join(mine.select("venue_name", "start_date").distinct(), ["venue_name", "start_date"], "left_semi")
    fresh = fuzzy.surviving(touched.unionByName(mine), ["venue_name", "start_date"], "_order", "name", "_new", least)
    arrived = new.withColumn("_order", F.col(f"first.{arrival}")).join(fresh, "_order", "left_semi")

    rows = upsert.numbered(arrived.select("_order", *KEY, "first", "_price", "_start", "_start_at", "_end", "_end_at", "_sport_name", "_sport", "_channels", "_link"), events, "event_id", ["_order"])
    rows = landed(rows)
    all_venues = placed_venues(rows.select("first.*"), venues, city, arrival)
    own = all_venues.filter(F.col("city_id") == city.city_id).groupBy("venue_name").agg(F.min(F.struct("venue_id", "default_type")).alias("_v"))
    rows = dealt.left_dealt(rows.withColumn("_name", F.col("first.venue_name")), own.withColumnRenamed("venue_name", "_name"), "_name", "event_id")

    by_name = performers.groupBy(F.lower("name").alias("_title")).agg(F.min("name").alias("_performer"))
    rows = rows.withColumn("_title", F.lower(F.trim("first.name")))
    # titles that many rows share meet few performers, so that this is no join of two large sides
    rows = dealt.left_dealt(rows, by_name.join(rows.select("_title").distinct(), "_title", "left_semi"), "_title", "event_id")
    given = F.coalesce(F.when(~T.blank(F.col("first.artist_name")), F.col("first.artist_name")), names.artist_in_title(F.col("first.name")))
    rows = rows.withColumn("_artist", F.coalesce(given, F.col("_performer")))

    timely = F.col("_start_at").isNull() | (F.col("_end_at") <= F.col("_start_at"))
    late_date, late_time = dates.default_end(F.col("first.start_date"), F.col("_start"), F.col("first.end_date"))
    has_end = F.coalesce(timely & F.col("_end_at").isNotNull(), F.lit(False))
    first_channels = F.when(F.size("first.tv_channels") > 0, F.col("first.tv_channels"))
    value = {
        "name": F.coalesce("_sport_name", "first.name"), "artist_name": F.col("_artist"), "artist_youtube_channel": F.coalesce("_link", "first.artist_youtube_channel"), "start_time": F.col("_start"),
        "end_date": F.when(has_end, F.coalesce("_end.end_date", "first.end_date")).when(F.col("_start").isNotNull(), late_date).otherwise(F.col("first.end_date")),
        "end_time": F.when(has_end, F.col("_end.end_time")).otherwise(late_time), "price": F.col("_price.price"), "price_currency": F.when(F.col("_price").isNotNull(), F.col("_price.price_currency")).otherwise(F.col("first.price_currency")),
        "venue_id": F.col("_v.venue_id"), "sport": F.coalesce("_sport.sport", "first.sport"), "home_team": F.when(F.col("_sport").isNotNull(), F.col("_sport.home_team")).otherwise(F.col("first.home_team")),
        "away_team": F.when(F.col("_sport").isNotNull(), F.col("_sport.away_team")).otherwise(F.col("first.away_team")), "tv_channels": F.coalesce(first_channels, "_channels", F.expr("cast(array() as array<string>)")),
    }
    inserts = rows.select("event_id", *KEY, *[value.get(c, F.col(f"first.{c}")).alias(c) for c in EVENT])

    sport = F.when(~T.blank(F.col("first.sport")), F.col("first.sport"))
    asked = rows.select("event_id", F.col("first.name").alias("name"), F.col("first.description").alias("description"), F.col("first.venue_name").alias("venue_name"), F.col("first.venue_city").alias("venue_city"), sport.alias("sport"), F.col("_artist").alias("artist_name"), F.col("_v.default_type").alias("default_type"), F.col("first.raw_categories").alias("raw_categories"))
    typed = classify.assign_types(asked, performers, kinds).filter("type_name is not null").select("event_id", "type_name")

    synced = writes.synced(events.select("event_id", *KEY, *EVENT), delta, KEY).drop("change")
    return Ingested(writes.orphans_placed(synced.unionByName(inserts), all_venues, city.city_id), all_venues, typed)


@BOOK.add()
def q19_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the derived events as stored, all of them as new records; greedy order has no SQL, tests hold it."""
    c = bound(spark, sf_dir)
    first = c.bridge.groupBy("event_id").agg(F.min("type_id").alias("type_id"))
    rows = landed(c.events.join(first, "event_id").join(c.types, "type_id").join(c.venues, "venue_id").select(
        "event_id", F.col("scrape_source").alias("source"), F.col("event_id").cast("string").alias("source_id"), F.col("type_name").alias("name"), "venue_name", "start_date",
        F.when(F.col("event_id") % 3 == 0, "20:00").alias("start_time"), F.lit(None).cast("date").alias("end_date"), F.lit(None).cast("string").alias("end_time"), "price",
    ))
    stored = rows.filter("event_id % 2 = 0").withColumn("price", F.when(F.col("event_id") % 4 == 0, F.col("price")))
    return ingest(stored, rows.withColumn("arrival", F.col("event_id")).drop("event_id"))


_KNOWN = """
, s AS (SELECT event_id, scrape_source AS source, CASE WHEN event_id % 4 = 0 THEN price END AS price, CASE WHEN event_id % 3 = 0 THEN '20:00' END AS st, start_date, CASE WHEN event_id % 5 = 0 THEN '23:00' END AS et FROM ev WHERE event_id % 2 = 0),
r AS (SELECT event_id, price + 1 AS price, CASE WHEN event_id % 7 <> 0 THEN '19:30' END AS st, CASE WHEN event_id % 11 = 0 THEN '22:45' END AS et FROM ev)
SELECT s.event_id, coalesce(s.price, r.price) AS price, coalesce(s.st, r.st) AS start_time,
 CASE WHEN s.et IS NOT NULL THEN s.et WHEN r.et IS NOT NULL THEN r.et WHEN s.st IS NOT NULL THEN '22:00' WHEN r.st IS NOT NULL THEN '21:30' END AS end_time,
 CASE WHEN s.et IS NULL AND r.et IS NULL AND (s.st IS NOT NULL OR r.st IS NOT NULL) THEN s.start_date END::DATE AS end_date FROM s JOIN r USING (event_id)"""


def _batch(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Ingested]:
    """Half of the derived events as stored, and all of them as records of one city that come again with other prices and times."""
    c, i = bound(spark, sf_dir), F.col("event_id")
    sup = bind.table(spark, sf_dir, "supplier")
    no = lambda kind: F.lit(None).cast(kind)
    match = bind.match_ups(spark, sf_dir)
    base = landed(c.events.join(match, "event_id").join(c.venues.select("venue_id", "venue_name"), "venue_id").join(bind.event_artists(spark, sf_dir), "event_id", "left"))
    common = {"source": F.col("scrape_source"), "source_id": i.cast("string"), "name": F.col("event_name"), "artist_youtube_channel": no("string"), "purchase_link": no("string"), "price_currency": F.lit("USD"), "description": no("string"), "image_url": no("string"), "is_online": F.lit(False), "tv_channels": no("array<string>"), "end_date": no("date")}
    rows = base.withColumns(common)
    stored = rows.filter("event_id % 2 = 0").withColumns({"price": F.when(i % 4 == 0, F.col("price")), "start_time": F.when(i % 3 == 0, "20:00"), "end_time": F.when(i % 5 == 0, "23:00")}).select("event_id", *KEY, *EVENT)
    place = {"raw_categories": F.when(i % 3 == 0, F.array(F.lit("Music"))), "venue_website_url": no("string"), "venue_timezone": no("string"), "venue_address": no("string"), "venue_city": no("string"), "venue_country": no("string"), "venue_lat": no("double"), "venue_lon": no("double")}
    raw = rows.withColumns({"arrival": i, "price": F.col("price") + 1, "start_time": F.when(i % 7 != 0, "19:30"), "end_time": F.when(i % 11 == 0, "22:45"), "artist_name": F.when(i % 5 != 0, F.col("artist_name"))} | place)
    known = c.venues.filter("venue_id % 3 <> 0").select("venue_id", "venue_name", F.lit(1).cast("long").alias("city_id"), no("string").alias("timezone"), "website_url", no("string").alias("street_address"), no("string").alias("physical_city"), no("string").alias("physical_country"), no("double").alias("latitude"), no("double").alias("longitude"), F.when(F.col("venue_id") % 4 == 0, "Comedy Show").alias("default_type"))
    people = sup.select(F.col("s_name").alias("name"), F.lower("s_name").alias("name_key"), no("string").alias("type_name"), F.when(F.col("s_suppkey") % 2 == 0, "Music").alias("category"))
    kinds = spark.createDataFrame([(k, *v) for k, v in enumerate([("Comedy Show", "Comedy"), ("Jazz Concert", "Music"), ("Rock Concert", "Music"), ("Sports Event", "Sports")])], "type_id long, type_name string, category string")
    return stored, ingested(stored, raw.drop("event_id", "venue_id"), known, people, kinds, City(1, "Metropolis", "Nowhere", "UTC"))


@BOOK.add(_KNOWN)
def q19_ingest_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the whole ingest makes of the events that were stored."""
    stored, out = _batch(spark, sf_dir)
    return out.events.join(stored.select("event_id"), "event_id", "left_semi").select("event_id", "price", "start_time", "end_time", "end_date")


@BOOK.add()
def q19_ingest_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New events with their venues and types; order decides which are dropped, so there is no SQL, and a row loop holds it."""
    stored, out = _batch(spark, sf_dir)
    new = out.events.join(stored.select("event_id"), "event_id", "left_anti")
    return new.join(out.types, "event_id", "left").select("event_id", *KEY, "name", "artist_name", "venue_id", "venue_name", "start_date", "start_time", "end_date", "end_time", "sport", "type_name")
