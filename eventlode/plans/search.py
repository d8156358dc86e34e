"""Faceted search, counting, export filters and autocomplete over the catalog."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventlode.functions import text as T
from eventlode.functions.rule_tables import GENRE_FORMATS
from eventlode.plans.book import Book
from eventlode.sources import bind

BOOK = Book()


@dataclass(frozen=True)
class CatalogFilter:
    """All facets of a search. Empty facets don't filter."""

    as_of: dt.date
    artists: tuple[str, ...] = ()
    categories: tuple[str, ...] = ()
    type_terms: tuple[str, ...] = ()
    search: str = ""
    city_ids: tuple[str, ...] = ()
    country: str = ""
    sources: tuple[str, ...] = ()
    start: dt.date | None = None
    end: dt.date | None = None
    match: str = "word"
    escape: bool = False
    league_labels: tuple[str, ...] = field(default=())
    genres: tuple[str, ...] = ()
    genre_formats: dict[str, tuple[str, list[str]]] = field(default_factory=lambda: GENRE_FORMATS)
    by_name: bool = False


class Catalog:
    """The tables of a catalog. Each is read when a query first asks for it, so that a query costs only the tables that it uses."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._source = spark, sf_dir

    @cached_property
    def cities(self) -> DataFrame:
        return bind.cities(*self._source)

    @cached_property
    def venues(self) -> DataFrame:
        return bind.venues(*self._source)

    @cached_property
    def events(self) -> DataFrame:
        return bind.catalog_events(*self._source)

    @cached_property
    def types(self) -> DataFrame:
        return bind.event_types(*self._source)

    @cached_property
    def bridge(self) -> DataFrame:
        return bind.event_event_types(*self._source)

    @cached_property
    def artists(self) -> DataFrame:
        return bind.event_artists(*self._source)

    @cached_property
    def taxonomy(self) -> DataFrame:
        return bind.genre_taxonomy(*self._source)

    @cached_property
    def artist_genres(self) -> DataFrame:
        return bind.artist_genres(*self._source)

    @cached_property
    def matches(self) -> DataFrame:
        return bind.match_ups(*self._source)


def bound(spark: SparkSession, sf_dir: str) -> Catalog:
    return Catalog(spark, sf_dir)


def _match(c: Column, term: str, f: CatalogFilter) -> Column:
    return T.word_match(c, term, f.escape) if f.match == "word" else T.contains_ci(c, term, f.escape)


def in_genres(cat: Catalog, f: CatalogFilter) -> DataFrame:
    """event_id of events of the parent genres: by the artist's genres, or, where the artist is none of the classified ones and
    the event no sport, by an event type of the genre's category whose name has one of the genre's words. Semi and anti joins only."""
    subs = cat.taxonomy.filter(F.col("parent_genre").isin(list(f.genres))).select("sub_genre").distinct()
    slots = cat.artist_genres.select("normalized_name", F.explode(F.array("primary_genre", "secondary_1", "secondary_2")).alias("sub_genre"))
    tagged = slots.join(subs, "sub_genre", "left_semi").select(F.col("normalized_name").alias("_key"))
    own = cat.artists.withColumn("_key", F.lower("artist_name"))
    by_artist = own.join(tagged, "_key", "left_semi").select("event_id")
    forms = [(F.col("category") == c) & (T.any_of([T.contains_ci(F.col("type_name"), w) for w in words]) if words else F.lit(True)) for g in f.genres for c, words in [f.genre_formats.get(g, (None, None))] if c]
    if not forms:
        return by_artist
    classified = cat.artist_genres.filter("primary_genre <> 'UNKNOWN'").select(F.col("normalized_name").alias("_key"))
    known = own.join(classified, "_key", "left_semi").select("event_id")
    fits = cat.bridge.join(cat.types.filter(T.any_of(forms)), "type_id", "left_semi").select("event_id")
    rest = cat.events.filter(F.col("sport").isNull()).select("event_id").join(known, "event_id", "left_anti").join(fits, "event_id", "left_semi")
    return by_artist.union(rest)


def placed(cat: Catalog, rows: DataFrame) -> DataFrame:
    return rows.join(cat.venues, "venue_id", "left").join(cat.cities, "city_id", "left")


def filtered(cat: Catalog, f: CatalogFilter, complete: bool = True) -> DataFrame:
    """Events with venue, city and artist that pass every facet. Lookups are semi joins inside the plan; nothing is collected.
    complete=False joins only the tables that a facet asks for.

    Date and source filters reach the scan. Terms of type_terms are AND-ed: each must match a type, a category, the
    artist or the venue. City ids that aren't numbers are dropped; with only such ids nothing matches.

    by_name: terms also match the event's name, and `search` that alone. A league's label asks for names that begin with it, and a
    term that any sports row has as a word in its name keeps sports rows of matching names only.
    """
    window = F.col("start_date") >= F.lit(f.as_of)
    if f.start:
        window &= F.col("start_date") >= F.lit(f.start)
    if f.end:
        window &= F.col("start_date") <= F.lit(f.end)
    if f.sources:
        window &= F.col("scrape_source").isin(list(f.sources))
    rows, words = cat.events.filter(window), bool(f.type_terms or f.search)
    if complete or words or f.city_ids or f.country:
        rows = placed(cat, rows)
    if complete or words or f.artists:
        rows = rows.join(cat.artists, "event_id", "left")
    if f.artists:
        rows = rows.filter(F.lower("artist_name").isin([a.lower() for a in f.artists]))
    if f.city_ids:
        ids = [int(c) for c in f.city_ids if c.isdigit()]
        rows = rows.filter(F.col("city_id").isin(ids) if ids else F.lit(False))
    elif f.country:
        rows = rows.filter(F.col("country").ilike(T.like_escaped(f.country, f.escape)))
    if f.genres:
        rows = rows.join(in_genres(cat, f), "event_id", "left_semi")
    if f.categories:
        in_category = cat.types.filter(F.col("category").isin(list(f.categories))).select("type_id")
        rows = rows.join(cat.bridge.join(in_category, "type_id", "left_semi"), "event_id", "left_semi")
    if f.by_name and words:
        rows = rows.join(cat.matches.select("event_id", "event_name"), "event_id", "left")
    labels = {x.lower() for x in f.league_labels}
    for i, term in enumerate(f.type_terms):
        if f.by_name and term.lower() in labels:
            rows = rows.filter(F.col("event_name").ilike(T.like_escaped(term, f.escape) + " -%"))
            continue
        matched = cat.types.filter(_match(F.col("type_name"), term, f) | _match(F.col("category"), term, f)).select("type_id")
        hit = cat.bridge.join(matched, "type_id", "left_semi").select("event_id", F.lit(True).alias(f"_hit{i}")).distinct()
        rows = rows.join(hit, "event_id", "left")
        own = _match(F.col("artist_name"), term, f) | _match(F.col("venue_name"), term, f)
        any_hit = F.coalesce(F.col(f"_hit{i}"), F.lit(False)) | F.coalesce(own, F.lit(False))
        rows = (_locked_to_sports(cat, rows, term, f, any_hit) if f.by_name else rows.filter(any_hit)).drop(f"_hit{i}")
    if f.search and f.by_name:
        if f.search.strip().lower() in labels:
            return rows.filter(F.col("event_name").ilike(T.like_escaped(f.search.strip(), f.escape) + " -%"))
        return _locked_to_sports(cat, rows, f.search.strip(), f, F.lit(False))
    if f.search:
        if f.match == "word" and f.search.lower() in {x.lower() for x in f.league_labels}:
            rows = rows.filter(F.col("artist_name").ilike(T.like_escaped(f.search, f.escape) + " -%"))
        else:
            rows = rows.filter(_match(F.col("artist_name"), f.search, f) | _match(F.col("venue_name"), f.search, f))
            if f.match == "word":  # sports lock: if any sports row has the word at all, other rows go
                probe = cat.events.filter(F.col("sport").isNotNull()).join(cat.artists, "event_id").agg(F.coalesce(F.max(T.whole_word(F.col("artist_name"), f.search, f.escape)), F.lit(False)).alias("_locked"))
                rows = rows.crossJoin(F.broadcast(probe)).filter(~F.col("_locked") | F.col("sport").isNotNull()).drop("_locked")  # one row
    return rows


def _locked_to_sports(cat: Catalog, rows: DataFrame, term: str, f: CatalogFilter, others: Column) -> DataFrame:
    """Rows whose event's name matches, or that pass `others`; if any sports row has the term as a word in its name, sports rows by name only."""
    named = F.coalesce(_match(F.col("event_name"), term, f), F.lit(False))
    if f.match != "word":
        return rows.filter(named | others)
    sports = cat.events.filter(F.col("sport").isNotNull()).select("event_id").join(cat.matches.select("event_id", "event_name"), "event_id")
    probe = sports.agg(F.coalesce(F.max(T.whole_word(F.col("event_name"), term, f.escape)), F.lit(False)).alias("_locked"))
    return rows.crossJoin(F.broadcast(probe)).filter(F.when(F.col("_locked"), F.col("sport").isNotNull() & named).otherwise(named | others)).drop("_locked")  # one row


def with_types(cat: Catalog, rows: DataFrame) -> DataFrame:
    """Adds the event's type names and categories, each once and in order, as text."""
    own = cat.bridge.join(rows.select("event_id"), "event_id", "left_semi").join(cat.types, "type_id")
    lists = own.groupBy("event_id").agg(F.array_join(F.array_sort(F.collect_set("type_name")), ", ").alias("event_types"), F.array_join(F.array_sort(F.collect_set("category")), ", ").alias("categories"))
    return rows.join(lists, "event_id", "left")


def search_events(cat: Catalog, f: CatalogFilter, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page, by date, time and id; only the page's rows get their venues, artists and types."""
    own = ["event_id", "venue_id", "start_date", *(["start_time"] if "start_time" in cat.events.columns else []), "scrape_source", "sport"]
    order = [F.asc_nulls_first(c) for c in own if c.startswith("start_")]
    page = filtered(cat, f, complete=False).select(*own).orderBy(*order, "event_id").offset(offset).limit(min(limit, 500))
    full = placed(cat, page).join(cat.artists, "event_id", "left").select("event_id", "start_date", "venue_name", "city_name", "country", "artist_name", "scrape_source", "sport")
    return with_types(cat, full)


def count_events(cat: Catalog, f: CatalogFilter) -> DataFrame:
    return filtered(cat, f, complete=False).agg(F.countDistinct("event_id").alias("n_events"))


def lookahead(cat: Catalog, f: CatalogFilter, years: int = 2) -> DataFrame:
    """Events in the window; if there are none, those up to `years` later, with the flag saying which."""
    late = CatalogFilter(**{**f.__dict__, "end": None})
    rows = filtered(cat, late).filter(F.col("start_date") <= F.add_months(F.lit(f.end or f.as_of), 12 * years)).withColumn("in_window", F.col("start_date") <= F.lit(f.end or f.as_of))
    any_in = rows.agg(F.coalesce(F.max("in_window"), F.lit(False)).alias("_any"))
    return rows.crossJoin(F.broadcast(any_in)).filter(F.col("in_window") | ~F.col("_any")).drop("_any")


def suggest_all(cat: Catalog, term: str, as_of: dt.date, per_kind: int = 3, limit: int = 12) -> DataFrame:
    """Completions of all kinds: artists, genres (parents, or those of matching sub-genres), teams, events, categories, types, venues.
    If the term starts the league of a sports event's name, the leagues alone are given.

    Each kind is counted by key before names are matched to it, and cut to `per_kind`; the league's answer is chosen in the plan.
    """
    up = cat.events.filter(F.col("start_date") >= F.lit(as_of)).select("event_id", "venue_id", "sport")
    low = term.lower()
    bridged = up.select("event_id").join(cat.bridge, "event_id").groupBy("type_id").agg(F.count(F.lit(1)).alias("n")).join(cat.types, "type_id")
    games = up.join(cat.matches, "event_id")
    parents = cat.taxonomy.withColumn("own", _word(F.col("parent_genre"), term)).withColumn("sub", _word(F.col("sub_genre"), term)).groupBy("parent_genre").agg(F.max("own").alias("own"), F.max("sub").alias("sub"))
    any_own = parents.agg(F.max("own").alias("_any"))
    genres = parents.crossJoin(F.broadcast(any_own)).filter("own or not _any and sub").select(F.col("parent_genre").alias("label"), F.lit(1).cast("long").alias("n"))
    count = lambda df, c: df.filter(_word(F.col(c), term)).groupBy(F.col(c).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    total = lambda df, c: df.filter(_word(F.col(c), term)).groupBy(F.col(c).alias("label")).agg(F.sum("n").alias("n"))
    per_venue = up.groupBy("venue_id").agg(F.count(F.lit(1)).alias("n")).join(cat.venues, "venue_id")
    teams = games.select(F.explode(F.array("home_team", "away_team")).alias("team")).filter("team is not null")
    kinds = [
        ("artist", count(up.join(cat.artists, "event_id"), "artist_name")),
        ("genre", genres),
        ("team", count(teams, "team")),
        ("event", count(games, "event_name")),
        ("category", total(bridged, "category")),
        ("type", total(bridged, "type_name")),
        ("venue", total(per_venue, "venue_name")),
    ]
    rank = F.when(F.lower("label") == low, 0).when(F.lower("label").startswith(low), 1).otherwise(2)
    out = None
    for i, (kind, df) in enumerate(kinds):
        top = df.withColumn("rank", rank).orderBy("rank", F.desc("n"), "label").limit(per_kind).select(F.lit(i).alias("kind_order"), F.lit(kind).alias("kind"), "label", "n", "rank")
        out = top if out is None else out.unionByName(top)
    label = F.trim(F.split_part("event_name", F.lit(" - "), F.lit(1)))
    named = games.filter(F.col("sport").isNotNull() & F.contains("event_name", F.lit(" - "))).select(label.alias("label")).filter(F.lower("label").startswith(low))
    leagues = named.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy("label").limit(limit).select(F.lit(-1).alias("kind_order"), F.lit("sport").alias("kind"), "label", "n", F.lit(0).alias("rank"))
    any_league = leagues.agg((F.count(F.lit(1)) > 0).alias("_league"))
    every = out.unionByName(leagues).crossJoin(F.broadcast(any_league)).filter((F.col("kind_order") < 0) == F.col("_league")).drop("_league")
    return every.orderBy("kind_order", "rank", F.desc("n"), "label").limit(limit)


def _word(c: Column, term: str) -> Column:
    return F.coalesce(T.word_match(c, term), F.lit(False))


def suggest(cat: Catalog, term: str, as_of: dt.date, per_kind: int = 3, limit: int = 12) -> DataFrame:
    """Ranked completions: artists, types, categories, venues; equal names first, then starts, then the rest."""
    up = cat.events.filter(F.col("start_date") >= F.lit(as_of))

    def ranked(df: DataFrame, kind: str, order: int) -> DataFrame:
        name = F.col("label")
        rank = F.when(F.lower(name) == term.lower(), 0).when(F.lower(name).startswith(term.lower()), 1).otherwise(2)
        top = df.filter(T.contains_ci(name, term)).groupBy("label").agg(F.count(F.lit(1)).alias("n")).withColumn("rank", rank).orderBy("rank", F.desc("n"), "label").limit(per_kind)
        pos = F.row_number().over(Window.orderBy("rank", F.desc("n"), "label"))  # per_kind rows
        return top.select(F.lit(order).alias("kind_order"), F.lit(kind).alias("kind"), "label", "n", "rank", pos.alias("pos"))

    kinds = [
        ranked(up.join(cat.artists, "event_id").select(F.col("artist_name").alias("label")), "artist", 0),
        ranked(up.join(cat.bridge, "event_id").join(cat.types, "type_id").select(F.col("category").alias("label")), "category", 1),
        ranked(up.join(cat.bridge, "event_id").join(cat.types, "type_id").select(F.col("type_name").alias("label")), "type", 2),
        ranked(up.join(cat.venues, "venue_id").select(F.col("venue_name").alias("label")), "venue", 3),
    ]
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return out.orderBy("kind_order", "pos").limit(limit)


_UP = "start_date >= DATE '2001-01-01'"
_FULL = "ev LEFT JOIN venues USING (venue_id) LEFT JOIN cities USING (city_id) LEFT JOIN artists USING (event_id)"


@BOOK.add(f"""
, page AS (SELECT event_id, start_date, venue_name, city_name, country, artist_name, scrape_source, sport FROM {_FULL}
  WHERE {_UP} AND country ILIKE 'asia' AND event_id IN (SELECT event_id FROM bridge JOIN types USING (type_id) WHERE category IN ('ECONOMY', 'STANDARD')) ORDER BY start_date NULLS FIRST, event_id LIMIT 50 OFFSET 10)
SELECT page.*, (SELECT string_agg(DISTINCT type_name, ', ' ORDER BY type_name) FROM bridge b JOIN types USING (type_id) WHERE b.event_id = page.event_id) AS event_types,
  (SELECT string_agg(DISTINCT category, ', ' ORDER BY category) FROM bridge b JOIN types USING (type_id) WHERE b.event_id = page.event_id) AS categories FROM page""")
def q01_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = CatalogFilter(bind.AS_OF_DATE, categories=("ECONOMY", "STANDARD"), country="asia")
    return search_events(bound(spark, sf_dir), f, limit=50, offset=10)


@BOOK.add(f"SELECT count(DISTINCT event_id) AS n_events FROM {_FULL} WHERE {_UP} AND country ILIKE 'asia' AND event_id IN (SELECT event_id FROM bridge JOIN types USING (type_id) WHERE category IN ('ECONOMY', 'STANDARD'))")
def q02_count_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_events(bound(spark, sf_dir), CatalogFilter(bind.AS_OF_DATE, categories=("ECONOMY", "STANDARD"), country="asia"))


@BOOK.add(f"""
SELECT event_id, start_date FROM {_FULL} WHERE {_UP}
 AND (event_id IN (SELECT event_id FROM bridge JOIN types USING (type_id) WHERE type_name ILIKE 'ring%' OR type_name ILIKE '% ring%' OR category ILIKE 'ring%' OR category ILIKE '% ring%') OR coalesce(artist_name ILIKE 'ring%' OR artist_name ILIKE '% ring%', false) OR coalesce(venue_name ILIKE 'ring%' OR venue_name ILIKE '% ring%', false))
 AND (event_id IN (SELECT event_id FROM bridge JOIN types USING (type_id) WHERE type_name ILIKE 'red' OR type_name ILIKE 'red %' OR type_name ILIKE '% red %' OR type_name ILIKE '% red') OR coalesce(artist_name ILIKE 'red' OR artist_name ILIKE 'red %', false) OR coalesce(venue_name ILIKE 'red' OR venue_name ILIKE 'red %', false))""")
def p09_type_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = CatalogFilter(bind.AS_OF_DATE, type_terms=("ring", "red"))
    return filtered(bound(spark, sf_dir), f).select("event_id", "start_date")


@BOOK.add(f"SELECT event_id, city_id, artist_name FROM {_FULL} WHERE {_UP} AND city_id IN (3, 7) AND lower(artist_name) IN ('supplier#000000003', 'supplier#000000011', 'supplier#000000020')")
def p05_artists_in_cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = CatalogFilter(bind.AS_OF_DATE, artists=("SUPPLIER#000000003", "Supplier#000000011", "supplier#000000020"), city_ids=("3", "7", "x"))
    return filtered(bound(spark, sf_dir), f).select("event_id", "city_id", "artist_name")


@BOOK.add(f"""
, l AS (SELECT bool_or(artist_name ILIKE 'supplier#000000005') AS locked FROM ev JOIN artists USING (event_id) WHERE sport IS NOT NULL)
SELECT event_id, sport, artist_name FROM {_FULL}, l WHERE {_UP} AND (artist_name ILIKE 'supplier#000000005%' OR venue_name ILIKE 'supplier#000000005%') AND (NOT coalesce(locked, false) OR sport IS NOT NULL)""")
def p11_sports_lock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(bound(spark, sf_dir), CatalogFilter(bind.AS_OF_DATE, search="supplier#000000005")).select("event_id", "sport", "artist_name")


@BOOK.add(f"SELECT event_id, venue_name FROM {_FULL} WHERE {_UP} AND (event_id IN (SELECT event_id FROM bridge JOIN types USING (type_id) WHERE type_name ILIKE '%idge%' OR category ILIKE '%idge%') OR coalesce(artist_name ILIKE '%idge%', false) OR coalesce(venue_name ILIKE '%idge%', false)) AND start_date <= DATE '2001-06-30'")
def p12_export_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = CatalogFilter(bind.AS_OF_DATE, type_terms=("idge",), end=dt.date(2001, 6, 30), match="substring")
    return filtered(bound(spark, sf_dir), f).select("event_id", "venue_name")


@BOOK.add(f"""
, r AS (SELECT event_id, start_date, start_date <= DATE '2001-01-01' AS in_window FROM {_FULL} WHERE {_UP} AND scrape_source = '1-URGENT' AND city_id = 4 AND start_date <= DATE '2003-01-01')
SELECT * FROM r WHERE in_window OR NOT (SELECT coalesce(bool_or(in_window), false) FROM r)""")
def p21_lookahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = CatalogFilter(bind.AS_OF_DATE, sources=("1-URGENT",), city_ids=("4",), end=dt.date(2001, 1, 1))
    return lookahead(bound(spark, sf_dir), f).select("event_id", "start_date", "in_window")


@BOOK.add(f"""
, up AS (SELECT * FROM ev WHERE {_UP}),
k AS (SELECT 0 AS kind_order, 'artist' AS kind, artist_name AS label FROM up JOIN artists USING (event_id)
  UNION ALL SELECT 1, 'category', category FROM up JOIN bridge USING (event_id) JOIN types USING (type_id)
  UNION ALL SELECT 2, 'type', type_name FROM up JOIN bridge USING (event_id) JOIN types USING (type_id)
  UNION ALL SELECT 3, 'venue', venue_name FROM up JOIN venues USING (venue_id)),
g AS (SELECT kind_order, kind, label, count(*) AS n, CASE WHEN lower(label) = 'sm' THEN 0 WHEN starts_with(lower(label), 'sm') THEN 1 ELSE 2 END AS rank FROM k WHERE label ILIKE '%sm%' GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY kind_order ORDER BY rank, n DESC, label)::INT AS pos FROM g QUALIFY row_number() OVER (PARTITION BY kind_order ORDER BY rank, n DESC, label) <= 3""")
def q03_suggest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggest(bound(spark, sf_dir), "sm", bind.AS_OF_DATE)


@BOOK.add(f"""
SELECT event_id, scrape_source FROM ev WHERE {_UP} AND sport IS NULL AND event_id NOT IN (SELECT event_id FROM artists WHERE artist_name < 'Supplier#000000050')
 AND event_id IN (SELECT event_id FROM bridge JOIN types USING (type_id) WHERE category = 'PROMO' AND type_name ILIKE '%bolt%')""")
def p07_format_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unclassified artists' events whose type fits: a semi and an anti join. Classified are the artists below number 50."""
    cat = bound(spark, sf_dir)
    classified = cat.artists.filter(F.col("artist_name") < "Supplier#000000050")
    fits = cat.bridge.join(cat.types.filter((F.col("category") == "PROMO") & T.contains_ci(F.col("type_name"), "bolt")), "type_id", "left_semi")
    rows = cat.events.filter((F.col("start_date") >= F.lit(bind.AS_OF_DATE)) & F.col("sport").isNull())
    return rows.join(classified, "event_id", "left_anti").join(fits, "event_id", "left_semi").select("event_id", "scrape_source")


_FORMS = {"ASIA": ("PROMO", ["bolt"]), "EUROPE": ("ECONOMY", [])}


@BOOK.add(f"""
, tagged AS (SELECT normalized_name FROM genres WHERE len(list_filter([primary_genre, secondary_1, secondary_2], lambda g: g IN (SELECT sub_genre FROM taxonomy WHERE parent_genre IN ('ASIA', 'EUROPE')))) > 0),
tagged2 AS (SELECT DISTINCT normalized_name FROM genres WHERE primary_genre IN (SELECT sub_genre FROM taxonomy WHERE parent_genre IN ('ASIA', 'EUROPE')) OR secondary_1 IN (SELECT sub_genre FROM taxonomy WHERE parent_genre IN ('ASIA', 'EUROPE')))
SELECT event_id, artist_name FROM {_FULL} WHERE {_UP} AND (lower(artist_name) IN (SELECT normalized_name FROM tagged2)
  OR (sport IS NULL AND (artist_name IS NULL OR lower(artist_name) NOT IN (SELECT normalized_name FROM genres WHERE primary_genre <> 'UNKNOWN'))
    AND event_id IN (SELECT event_id FROM bridge JOIN types USING (type_id) WHERE category = 'PROMO' AND type_name ILIKE '%bolt%' OR category = 'ECONOMY')))""".replace(""", tagged AS (SELECT normalized_name FROM genres WHERE len(list_filter([primary_genre, secondary_1, secondary_2], lambda g: g IN (SELECT sub_genre FROM taxonomy WHERE parent_genre IN ('ASIA', 'EUROPE')))) > 0),
tagged2""", ", tagged2"))
def p06_genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of two parent genres, with the fallback by event type."""
    f = CatalogFilter(bind.AS_OF_DATE, genres=("ASIA", "EUROPE"), genre_formats=_FORMS)
    return filtered(bound(spark, sf_dir), f).select("event_id", "artist_name")


def _suggest_sql(term: str) -> str:
    word = lambda c: f"({c} ILIKE '{term}%' OR {c} ILIKE '% {term}%')" if len(term) >= 4 else f"({c} ILIKE '{term}' OR {c} ILIKE '{term} %' OR {c} ILIKE '% {term} %' OR {c} ILIKE '% {term}')"
    low = term.lower()
    return f"""
, up AS (SELECT * FROM ev WHERE {_UP}),
par AS (SELECT parent_genre, bool_or({word('parent_genre')}) AS own, bool_or({word('sub_genre')}) AS sub FROM taxonomy GROUP BY 1),
k AS (SELECT 0 AS kind_order, 'artist' AS kind, artist_name AS label FROM up JOIN artists USING (event_id)
  UNION ALL SELECT 2, 'team', home_team FROM up JOIN matches USING (event_id) UNION ALL SELECT 2, 'team', away_team FROM up JOIN matches USING (event_id)
  UNION ALL SELECT 3, 'event', event_name FROM up JOIN matches USING (event_id)
  UNION ALL SELECT 4, 'category', category FROM up JOIN bridge USING (event_id) JOIN types USING (type_id)
  UNION ALL SELECT 5, 'type', type_name FROM up JOIN bridge USING (event_id) JOIN types USING (type_id)
  UNION ALL SELECT 6, 'venue', venue_name FROM up JOIN venues USING (venue_id)),
n AS (SELECT kind_order, kind, label, count(*)::BIGINT AS n FROM k WHERE {word('label')} GROUP BY ALL
  UNION ALL SELECT 1, 'genre', parent_genre, 1 FROM par WHERE own OR NOT (SELECT bool_or(own) FROM par) AND sub),
r AS (SELECT *, CASE WHEN lower(label) = '{low}' THEN 0 WHEN starts_with(lower(label), '{low}') THEN 1 ELSE 2 END AS rank FROM n),
t AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY kind_order ORDER BY rank, n DESC, label) <= 3),
l AS (SELECT -1 AS kind_order, 'sport' AS kind, league AS label, count(*)::BIGINT AS n, 0 AS rank FROM (SELECT trim(split_part(event_name, ' - ', 1)) AS league FROM up JOIN matches USING (event_id) WHERE sport IS NOT NULL AND contains(event_name, ' - ')) WHERE starts_with(lower(league), '{low}') GROUP BY league)
SELECT * FROM (SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM l) UNION ALL SELECT * FROM l) ORDER BY kind_order, rank, n DESC, label LIMIT 12"""


@BOOK.add(_suggest_sql("red"))
def q03_suggest_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suggest_all(bound(spark, sf_dir), "red", bind.AS_OF_DATE)


@BOOK.add(_suggest_sql("nation_1"))
def q03_suggest_genres(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No parent genre matches, so those of matching sub-genres are given."""
    return suggest_all(bound(spark, sf_dir), "nation_1", bind.AS_OF_DATE)


@BOOK.add(_suggest_sql("leag"))
def q03_suggest_leagues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A league's prefix gives the leagues alone."""
    return suggest_all(bound(spark, sf_dir), "leag", bind.AS_OF_DATE)


_NAMED = f"{_FULL} LEFT JOIN matches USING (event_id)"


def _words_sql(c: str, term: str) -> str:
    tests = [f"{term}%", f"% {term}%"] if len(term) >= 4 else [term, f"{term} %", f"% {term} %", f"% {term}"]
    return "coalesce(" + " OR ".join(f"{c} ILIKE '{t}'" for t in tests) + ", false)"


def _locked_sql(term: str) -> str:
    whole = " OR ".join(f"event_name ILIKE '{t}'" for t in (term, f"{term} %", f"% {term} %", f"% {term}"))
    return f"(SELECT coalesce(bool_or({whole}), false) FROM ev JOIN matches USING (event_id) WHERE sport IS NOT NULL)"


@BOOK.add(f"""
SELECT event_id, event_name, sport FROM {_NAMED} WHERE {_UP} AND CASE WHEN {_locked_sql("ring")} THEN sport IS NOT NULL AND {_words_sql("event_name", "ring")}
 ELSE event_id IN (SELECT event_id FROM bridge JOIN types USING (type_id) WHERE {_words_sql("type_name", "ring")} OR {_words_sql("category", "ring")}) OR {_words_sql("artist_name", "ring")} OR {_words_sql("event_name", "ring")} OR {_words_sql("venue_name", "ring")} END""")
def p09_event_name_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A term that no sports row has: types, artist, venue and the event's name count."""
    return filtered(bound(spark, sf_dir), CatalogFilter(bind.AS_OF_DATE, type_terms=("ring",), by_name=True)).select("event_id", "event_name", "sport")


@BOOK.add(f"""
SELECT event_id, event_name, sport FROM {_NAMED} WHERE {_UP} AND CASE WHEN {_locked_sql("reds")} THEN sport IS NOT NULL AND {_words_sql("event_name", "reds")} ELSE {_words_sql("event_name", "reds")} END
 AND event_name ILIKE 'league 2 -%'""")
def p10_leagues_and_teams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A team's name keeps sports rows only, and a league's label asks for names that begin with it."""
    f = CatalogFilter(bind.AS_OF_DATE, type_terms=("League 2",), league_labels=("league 2",), search=" reds ", by_name=True)
    return filtered(bound(spark, sf_dir), f).select("event_id", "event_name", "sport")


@BOOK.add(f"""
, page AS (SELECT event_id, start_date, venue_name, city_name, country, artist_name, scrape_source, sport FROM {_NAMED}
  WHERE {_UP} AND CASE WHEN {_locked_sql("blue")} THEN sport IS NOT NULL AND {_words_sql("event_name", "blue")} ELSE {_words_sql("event_name", "blue")} END ORDER BY start_date NULLS FIRST, event_id LIMIT 50)
SELECT page.*, (SELECT string_agg(DISTINCT type_name, ', ' ORDER BY type_name) FROM bridge b JOIN types USING (type_id) WHERE b.event_id = page.event_id) AS event_types,
  (SELECT string_agg(DISTINCT category, ', ' ORDER BY category) FROM bridge b JOIN types USING (type_id) WHERE b.event_id = page.event_id) AS categories FROM page""")
def q01_search_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the events whose name has a word that begins with the search."""
    return search_events(bound(spark, sf_dir), CatalogFilter(bind.AS_OF_DATE, search="blue", by_name=True))
