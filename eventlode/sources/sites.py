"""Normalizers of single sources with landed JSON: which path of an item is which field. Paths and names are fixed values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlode.functions import dates, names, text as T
from eventlode.operators import classify
from eventlode.sources import nested
from eventlode.sources.raw import Normalizer, accepted, normalized


def at(path: str):
    return lambda item: F.nullif(F.get_json_object(item, path), F.lit(""))


def clock_of(path: str, midnight: bool = True):
    """HH:MM of an ISO timestamp as it is written; midnight=False takes 00:00 for unknown."""
    def found(item: Column) -> Column:
        time = F.nullif(F.regexp_extract(F.get_json_object(item, path), r"T(\d{2}:\d{2})", 1), F.lit(""))
        return time if midnight else dates.unless_midnight(time)

    return found


def only(*categories: str):
    return lambda item: F.array(*map(F.lit, categories))


def mapped(source: str, path: str):
    return lambda item: F.array_compact(F.array(classify.map_category(F.lit(source), F.get_json_object(item, path))))


# --- fixed values: fields of each source
SEATGEEK = Normalizer(
    "seatgeek", "$.events",
    {"start_date": "$.datetime_local", "artist_name": "$.performers[0].name", "price": "$.stats.lowest_price", "purchase_link": "$.url", "image_url": "$.performers[0].image", "venue_name": "$.venue.name", "venue_address": "$.venue.address", "venue_city": "$.venue.city", "venue_country": "$.venue.country", "venue_lat": "$.venue.location.lat", "venue_lon": "$.venue.location.lon", "source_id": "$.id"},
    {"name": lambda i: names.titled(at("$.title")(i), at("$.performers[0].name")(i)), "start_time": clock_of("$.datetime_local"), "raw_categories": mapped("seatgeek", "$.type")},
)
DICE = Normalizer(
    "dice", "$.data",
    {"start_date": "$.dates.event_start_date", "end_date": "$.dates.event_end_date", "artist_name": "$.summary_lineup.top_artists[0].name", "venue_name": "$.venues[0].name", "venue_address": "$.venues[0].address", "venue_city": "$.venues[0].city.name", "source_id": "$.id"},
    {
        "name": lambda i: F.coalesce(at("$.name")(i), F.lit("Untitled Event")), "start_time": clock_of("$.dates.event_start_date", False), "end_time": clock_of("$.dates.event_end_date", False), "price": lambda i: T.cents(at("$.price.amount_from")(i).try_cast("double")),
        "price_currency": lambda i: F.coalesce(at("$.price.currency")(i), F.lit("USD")), "purchase_link": lambda i: F.concat(F.lit("https://dice.fm/event/"), at("$.perm_name")(i)), "image_url": lambda i: nested.one_of(i, "$.images.landscape", "$.images.square"), "raw_categories": only("Music"),
    },
)
BANDSINTOWN = Normalizer(
    "bandsintown", "$",
    {"start_date": "$.datetime", "description": "$.description", "venue_name": "$.venue.name", "venue_city": "$.venue.city", "venue_country": "$.venue.country", "venue_lat": "$.venue.latitude", "venue_lon": "$.venue.longitude"},
    {
        "name": lambda i: nested.one_of(i, "$.lineup[0]", "$.artist.name"), "artist_name": lambda i: nested.one_of(i, "$.artist.name", "$.lineup[0]"), "start_time": clock_of("$.datetime", False), "source_id": lambda i: F.concat(F.lit("bandsintown:"), at("$.id")(i)),
        "purchase_link": lambda i: F.coalesce(F.get(F.filter(F.from_json(F.get_json_object(i, "$.offers"), "array<struct<type:string,url:string>>"), lambda o: (o["type"] == "Tickets") & ~T.blank(o["url"])), F.lit(0))["url"], at("$.url")(i)),
    },
)
PREDICTHQ = Normalizer(
    "predicthq", "$.results",
    {"start_date": "$.start", "end_date": "$.end", "description": "$.description", "venue_name": "$.entities[0].name", "venue_lon": "$.location[0]", "venue_lat": "$.location[1]", "source_id": "$.id"},
    {"name": lambda i: F.coalesce(at("$.title")(i), F.lit("Untitled Event")), "start_time": clock_of("$.start", False), "end_time": clock_of("$.end", False), "raw_categories": mapped("predicthq", "$.category")},
)
OPENF1 = Normalizer(
    "openf1", "$",
    {"start_date": "$.date_start", "venue_name": "$.circuit_short_name", "venue_city": "$.location", "venue_country": "$.country_name"},
    {
        "name": lambda i: _race_name(i), "end_date": lambda i: F.date_add(F.try_to_date(F.left(at("$.date_start")(i), F.lit(10)), "yyyy-MM-dd"), 3), "sport": lambda i: F.lit("Formula 1"), "source_id": lambda i: F.concat(F.lit("openf1-"), at("$.meeting_key")(i)),
        "purchase_link": lambda i: F.concat(F.lit("https://www.formula1.com/en/racing/"), _race_year(i), F.lit(".html")), "raw_categories": only("Sports", "Formula 1"),
    },
)
SITES = {n.source: n for n in (SEATGEEK, DICE, BANDSINTOWN, PREDICTHQ, OPENF1)}


def _race_year(item: Column) -> Column:
    return F.coalesce(at("$.year")(item), F.left(at("$.date_start")(item), F.lit(4)))


def _race_name(item: Column) -> Column:
    name, year = F.coalesce(at("$.meeting_name")(item), F.lit("Formula 1 Grand Prix")), _race_year(item)
    base = F.when(F.contains(name, year), name).otherwise(F.concat_ws(" ", name, year))
    return F.when(base.startswith("Formula 1 -"), base).otherwise(F.concat(F.lit("Formula 1 - "), base))


def site_records(payloads: DataFrame, source: str, as_of: Column, payload: str = "payload", days: int | None = None) -> DataFrame:
    """A source's records that aren't over, and, with `days`, start within that many. A record is over when its last day is past;
    one source keeps past records too, as its interface is asked for a window."""
    rows = accepted(normalized(payloads, SITES[source], payload))
    if source != "predicthq":
        rows = rows.filter(F.coalesce("end_date" if source == "openf1" else "start_date", "start_date") >= as_of)
    return rows if days is None else rows.filter(F.col("start_date").between(as_of, F.date_add(as_of, days)))
