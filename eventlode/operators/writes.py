"""Maintenance writes as pure functions: repairs, backfills, enrichment, stubs, taxonomies, run logs, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlode.functions import dates, text as T
from eventlode.operators.dealt import left_dealt
from eventlode.operators.upsert import insert_absent, numbered


def synced(current: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    """All rules of an event upsert on matched rows; new rows are appended. Adds `change`: inserted, updated or same.

    A missing price is filled with its currency; a missing start time; a missing end time with its date, or two hours after the
    start; for sports rows the sport with both teams where it differs, the name where it differs, channels and the link
    where there are none. The delta has one row per key. Other columns of matched rows stay.
    """
    a, b = current.withColumn("_a", F.lit(True)).alias("a"), delta.withColumn("_b", F.lit(True)).alias("b")
    joined = a.join(b, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key], "full")
    old, new = F.coalesce(F.col("_a"), F.lit(False)), F.coalesce(F.col("_b"), F.lit(False))
    mine, theirs = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}") if c in delta.columns else F.lit(None))
    sports = theirs("sport").isNotNull() & (theirs("sport") != "")
    resport = sports & ~mine("sport").eqNullSafe(theirs("sport"))
    reprice = mine("price").isNull() & theirs("price").isNotNull()
    both: dict[str, Column] = {
        "price": F.coalesce(mine("price"), theirs("price")),
        "price_currency": F.when(reprice, theirs("price_currency")).otherwise(mine("price_currency")),
        "start_time": F.coalesce(mine("start_time"), theirs("start_time")),
        "sport": F.when(resport, theirs("sport")).otherwise(mine("sport")),
        "home_team": F.when(resport, theirs("home_team")).otherwise(mine("home_team")),
        "away_team": F.when(resport, theirs("away_team")).otherwise(mine("away_team")),
        "name": F.when(sports & ~mine("name").eqNullSafe(theirs("name")), theirs("name")).otherwise(mine("name")),
        "tv_channels": F.when(sports & F.coalesce(F.size(theirs("tv_channels")) > 0, F.lit(False)) & ~F.coalesce(F.size(mine("tv_channels")) > 0, F.lit(False)), theirs("tv_channels")).otherwise(mine("tv_channels")),
        "artist_youtube_channel": F.when(T.blank(mine("artist_youtube_channel")), F.coalesce(F.nullif(theirs("artist_youtube_channel"), F.lit("")), mine("artist_youtube_channel"))).otherwise(mine("artist_youtube_channel")),
    }
    given = mine("end_time").isNull() & theirs("end_time").isNotNull()
    start = both["start_time"]
    late_date, late_time = dates.default_end(mine("start_date"), start, mine("end_date"))
    late = mine("end_time").isNull() & ~given & start.isNotNull()
    both["end_time"] = F.when(given, theirs("end_time")).when(late, late_time).otherwise(mine("end_time"))
    both["end_date"] = F.when(given, F.coalesce(theirs("end_date"), mine("end_date"))).when(late, late_date).otherwise(mine("end_date"))
    columns = [c for c in current.columns if c not in key]
    value = lambda c: F.when(old & new, both.get(c, mine(c))).when(old, mine(c)).otherwise(theirs(c))
    changed = T.any_of([~both[c].eqNullSafe(mine(c)) for c in both if c in columns])
    kind = F.when(~old, "inserted").when(new & changed, "updated").otherwise("same")
    return joined.select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in key], *[value(c).alias(c) for c in columns], kind.alias("change"))


def online_repaired(current: DataFrame, delta: DataFrame, key: list[str]) -> DataFrame:
    """Stored rows that are online and now come as in person take the place and the end date; nothing else changes. New rows are appended."""
    d = delta.select(*key, F.col("is_online").alias("_on"), F.col("venue_id").alias("_v"), F.col("venue_name").alias("_n"), F.col("end_date").alias("_e"))
    fix = F.col("is_online") & ~F.col("_on")
    rows = current.join(d, key, "left").withColumn("_fix", F.coalesce(fix, F.lit(False)))
    fixed = rows.withColumns({"venue_id": F.when(F.col("_fix"), F.col("_v")).otherwise(F.col("venue_id")), "venue_name": F.when(F.col("_fix"), F.col("_n")).otherwise(F.col("venue_name")), "end_date": F.when(F.col("_fix"), F.col("_e")).otherwise(F.col("end_date")), "is_online": F.when(F.col("_fix"), F.lit(False)).otherwise(F.col("is_online"))})
    return insert_absent(fixed.drop("_on", "_v", "_n", "_e", "_fix"), delta, key)


def orphans_placed(events: DataFrame, venues: DataFrame, city_id: int | None = None) -> DataFrame:
    """Events with a venue's name but no id take the id of the venue of exactly that name, in one city if given; of several the smallest."""
    own = venues if city_id is None else venues.filter(F.col("city_id") == city_id)
    known = own.groupBy(F.col("venue_name").alias("_n")).agg(F.min("venue_id").alias("_v"))
    lost = F.col("venue_id").isNull() & ~T.blank(F.col("venue_name"))
    return left_dealt(events.withColumn("_n", F.when(lost, F.col("venue_name"))), known, "_n", "event_id").withColumn("venue_id", F.coalesce("venue_id", "_v")).drop("_n", "_v")


def enriched_performers(performers: DataFrame, found: DataFrame) -> DataFrame:
    """Ids, links, image and popularity as found; genres where some were found; type, category and source where a type was found.

    found: performer_id, spotify_id, spotify_url, image_url, popularity, genres (JSON text), event_type_name, category."""
    f = found.select(F.col("performer_id"), *[F.col(c).alias(f"_{c}") for c in found.columns if c != "performer_id"], F.lit(True).alias("_hit"))
    hit, typed = F.coalesce("_hit", F.lit(False)), ~T.blank(F.col("_event_type_name"))
    always = {c: F.when(hit, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("spotify_id", "spotify_url", "image_url", "popularity")}
    some = {"genres": F.when(hit & ~T.blank(F.col("_genres")), F.col("_genres")).otherwise(F.col("genres"))}
    kind = {c: F.when(hit & typed, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("event_type_name", "category")}
    return performers.join(f, "performer_id", "left").withColumns(always | some | kind | {"source": F.when(hit & typed, "spotify").otherwise(F.col("source"))}).select(*performers.columns)


def enriched_events(events: DataFrame, performers: DataFrame) -> DataFrame:
    """Popularity from 1 to 10 and the link for all events of an artist, the image where an event has none. performers: name, popularity, spotify_url, image_url."""
    p = performers.groupBy(F.col("name").alias("_artist")).agg(F.max(F.struct(F.coalesce("popularity", F.lit(0)).alias("popularity"), "spotify_url", "image_url")).alias("_p"))
    rows = events.join(p, F.col("artist_name") == F.col("_artist"), "left")
    return rows.withColumns({"artist_popularity": F.coalesce(T.popularity_tenths(F.col("_p.popularity")), "artist_popularity"), "artist_spotify_url": F.coalesce(F.nullif("_p.spotify_url", F.lit("")), "artist_spotify_url"), "image_url": F.coalesce("image_url", F.nullif("_p.image_url", F.lit("")))}).drop("_artist", "_p")


def with_stubs(current: DataFrame, asked: DataFrame, found: DataFrame, key: str, marks: dict[str, Column]) -> DataFrame:
    """Rows for what was asked for and not found, so that it isn't asked again. `marks` are the stub's other columns."""
    missing = asked.select(key).dropna().distinct().join(found.select(key), key, "left_anti").join(current.select(key), key, "left_anti")
    return current.unionByName(missing.withColumns(marks), allowMissingColumns=True)


def taxonomy_upsert(current: DataFrame, delta: DataFrame, key: str = "sub_genre", value: str = "parent_genre") -> DataFrame:
    """The taxonomy after the delta, each row with `change`: inserted, updated, same. Of a key that comes twice the first counts (`position`)."""
    first = delta.filter(~T.blank(F.col(key))).groupBy(key).agg(F.min_by(value, "position").alias("_new"))
    rows = current.withColumn("_old", F.lit(True)).join(first, key, "full")
    change = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col(value)), "updated").otherwise("same")
    return rows.withColumn("change", change).withColumn(value, F.coalesce("_new", value)).select(key, value, "change")


def classification_upsert(current: DataFrame, delta: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows after the delta with `status`: new, changed, unchanged or absent from the delta; fields are compared null-safely."""
    d = delta.select(key, *[F.col(c).alias(f"_{c}") for c in fields], F.lit(True).alias("_new"))
    rows = current.select(key, *fields).withColumn("_old", F.lit(True)).join(d, key, "full")
    same = T.all_of([F.col(c).eqNullSafe(F.col(f"_{c}")) for c in fields])
    status = F.when(F.col("_old").isNull(), "new").when(F.col("_new").isNull(), "absent").when(same, "unchanged").otherwise("changed")
    return rows.select(key, *[F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in fields], status.alias("status"))


def discovered(venues: DataFrame, found: DataFrame) -> DataFrame:
    """Venues after a discovery: a name that its city has, whatever the case, is skipped. found: venue_name, city_id and more columns."""
    new = found.filter(~T.blank(F.col("venue_name"))).withColumn("_k", F.lower("venue_name")).dropDuplicates(["_k", "city_id"])
    have = venues.select(F.lower("venue_name").alias("_k"), "city_id")
    return venues.unionByName(numbered(new.join(have, ["_k", "city_id"], "left_anti").drop("_k"), venues, "venue_id", ["city_id", "venue_name"]), allowMissingColumns=True)


def run_finished(log: DataFrame, log_id: int, found: int, saved: int, now: Column, error: str | None = None) -> DataFrame:
    """The run log with one running row closed: success, or failed with the error as its note."""
    own = (F.col("log_id") == log_id) & (F.col("status") == "running")
    return log.withColumns({"finished_at": F.when(own, now).otherwise(F.col("finished_at")), "events_found": F.when(own, found).otherwise(F.col("events_found")), "events_saved": F.when(own, saved).otherwise(F.col("events_saved")), "notes": F.when(own & F.lit(error is not None), F.lit(error)).otherwise(F.col("notes")), "status": F.when(own, "failed" if error is not None else "success").otherwise(F.col("status"))})


def performers_uploaded(current: DataFrame, names: DataFrame) -> DataFrame:
    """Uploaded names that are new by their trimmed lower-case form, of confidence 0; of several spellings the first in order."""
    rows = names.select(F.trim("name").alias("name")).filter("name <> ''").groupBy(F.lower("name").alias("normalized_name")).agg(F.min("name").alias("name")).withColumn("confidence", F.lit(0.0))
    return insert_absent(current, rows, ["normalized_name"])


def lookups_written(current: DataFrame, found: DataFrame, key: str, refetch: bool) -> DataFrame:
    """Looked-up rows are appended; known ones are replaced only on a refetch. Adds `change`."""
    f = found.dropDuplicates([key])
    old = current.join(f.select(key, F.lit(True).alias("_hit")), key, "left")
    kept = old.filter("_hit is null" if refetch else "true").drop("_hit").withColumn("change", F.lit("same"))
    known = current.select(key, F.lit(True).alias("_known"))
    new = f.join(known, key, "left").filter("true" if refetch else "_known is null").withColumn("change", F.when(F.col("_known"), "updated").otherwise("inserted")).drop("_known")
    return kept.unionByName(new, allowMissingColumns=True)


def venue_links(venues: DataFrame, events: DataFrame, tag_urls: DataFrame, name_urls: DataFrame, as_of: Column) -> DataFrame:
    """Links of upcoming venues without one, in two phases: by the smallest source id of a venue's events (source_id, url), then,
    for the venues that are left, by name (venue_name, url). Adds phase (0 had one, 1, 2, or null)."""
    up = events.filter((F.col("start_date") >= as_of) & F.col("venue_id").isNotNull())
    first = up.filter(~T.blank(F.col("source_id"))).groupBy("venue_id").agg(F.min("source_id").alias("source_id")).join(tag_urls.select("source_id", F.col("url").alias("_u1")), "source_id").select("venue_id", "_u1")
    active = up.select("venue_id", F.lit(True).alias("_up")).distinct()
    second = name_urls.groupBy("venue_name").agg(F.min("url").alias("_u2"))
    rows = venues.join(active, "venue_id", "left").join(first, "venue_id", "left").join(second, "venue_name", "left")
    lacks = T.blank(F.col("website_url"))
    phase = F.when(~lacks, 0).when(F.col("_up") & F.col("_u1").isNotNull(), 1).when(F.col("_up") & F.col("_u2").isNotNull(), 2)
    out = rows.withColumn("phase", phase).withColumn("website_url", F.when(F.col("phase") == 1, F.col("_u1")).when(F.col("phase") == 2, F.col("_u2")).otherwise(F.col("website_url")))
    return out.select(*venues.columns, "phase")


def pending_links(events: DataFrame, limit: int, sports: bool = False, tried: bool = True) -> DataFrame:
    """Artists without a link, most events first. sports: with sports rows; tried: with those marked by an empty link as looked up."""
    link = F.col("artist_youtube_channel")
    rows = events.filter(~T.blank(F.col("artist_name")) & (T.blank(link) if tried else link.isNull()))
    if not sports:
        rows = rows.filter(F.col("sport").isNull())
    return rows.groupBy("artist_name").agg(F.count(F.lit(1)).alias("n_events")).orderBy(F.desc("n_events"), "artist_name").limit(limit)


def deletion(events: DataFrame, conditions: list[Column], sample: int = 20) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A delete by at least one condition, all AND-ed: what stays, what goes, and a sample of what goes for a dry run."""
    if not conditions:
        raise ValueError("a delete needs a condition")
    hit = F.coalesce(T.all_of(conditions), F.lit(False))
    gone = events.filter(hit)
    return events.filter(~hit), gone, gone.orderBy("event_id").limit(sample)


def resolved_cities(names: DataFrame, cities: DataFrame, districts: DataFrame, default_country: str) -> DataFrame:
    """name, city_id, how: the city of that name, the district's city, or a new one in the default country with the next id.

    cities: city_id, city_name, country; districts: district, city_name. Of cities that share a name the smallest id."""
    by_name = cities.groupBy(F.lower("city_name").alias("_k")).agg(F.min("city_id").alias("_c"))
    wanted = names.select(F.trim("name").alias("name")).filter("name <> ''").distinct().withColumn("_k", F.lower("name"))
    of_district = districts.select(F.lower("district").alias("_k"), F.lower("city_name").alias("_dk")).dropDuplicates(["_k"]).join(by_name.select(F.col("_k").alias("_dk"), F.col("_c").alias("_d")), "_dk").select("_k", "_d")
    rows = wanted.join(by_name, "_k", "left").join(of_district, "_k", "left").withColumn("city_id", F.coalesce("_c", "_d")).withColumn("how", F.when(F.col("_c").isNotNull(), "name").when(F.col("_d").isNotNull(), "district").otherwise("created"))
    new = numbered(rows.filter("city_id is null").select("_k").distinct(), cities, "city_id", ["_k"]).select("_k", F.col("city_id").alias("_new"))
    return rows.join(new, "_k", "left").select("name", F.coalesce("city_id", "_new").alias("city_id"), "how")


def probe_summary(probes: DataFrame, by: str = "source") -> DataFrame:
    """Probes passed and failed per source."""
    return probes.groupBy(by).agg(F.count(F.when(F.col("ok"), 1)).alias("passed"), F.count(F.when(~F.col("ok"), 1)).alias("failed"))


def ranked_candidates(candidates: DataFrame, probes: DataFrame, key: str) -> DataFrame:
    """Candidates that a probe found to work, most events first within a city."""
    rows = candidates.join(probes.filter("ok"), key)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("city_id").orderBy(F.desc("n_events"), key)))
