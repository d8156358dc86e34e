"""Rows out of nested JSON and marked-up text: slots, shows, channels, sides, genres, dates near a match. All Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlode.functions import dates, text as T

_STRINGS = "array<string>"


def one_of(item: Column, *paths: str) -> Column:
    """The first path of a JSON text that holds a non-empty value: for fields that are a list in one row and an object in another."""
    return F.coalesce(*[F.nullif(F.get_json_object(item, p), F.lit("")) for p in paths])


def image_of(item: Column) -> Column:
    """An image as text, as an object with a url, or as a list of either."""
    found = one_of(item, "$.image[0].url", "$.image[0][0]", "$.image[0]", "$.image.url", "$.image")
    return F.when(~found.rlike(r"^[\[{]"), found)


def location_of(item: Column) -> Column:
    """struct(name, city) of a location that is an object or a list of them; a text gives nothing."""
    return F.struct(one_of(item, "$.location.name", "$.location[0].name").alias("name"), one_of(item, "$.location.address.addressLocality", "$.location[0].address.addressLocality").alias("city"))


def held(item: Column, online: bool = True) -> Column:
    """False for cancelled events, and for those that are online only, where a source leaves these out."""
    gone = F.coalesce(F.get_json_object(item, "$.eventStatus"), F.lit("")).contains("Cancelled")
    far = F.coalesce(F.get_json_object(item, "$.eventAttendanceMode"), F.lit("")).contains("OnlineEventAttendanceMode")
    return ~gone & (F.lit(online) | ~far)


def time_slots(df: DataFrame, times: str, prefix: str) -> DataFrame:
    """One row per [show id, "H:MM"] pair of a JSON list, or one without a time where there is none. Adds show_id, start_time, source_id."""
    pairs = F.from_json(F.col(times), "array<array<string>>")
    rows = df.select("*", F.explode_outer(F.when(F.size(pairs) > 0, pairs)).alias("_slot"))
    show, clock = F.nullif(F.get("_slot", F.lit(0)), F.lit("")), F.get("_slot", F.lit(1))
    h, m = F.regexp_extract(clock, r"^\s*(\d+):(\d+)", 1), F.regexp_extract(clock, r"^\s*(\d+):(\d+)", 2)
    start = F.when(h != "", F.concat(F.lpad(h, 2, "0"), F.lit(":"), F.lpad(m, 2, "0")))
    return rows.withColumn("show_id", show).withColumn("start_time", start).withColumn("source_id", F.concat(F.lit(prefix), show)).drop("_slot")


SHOWS = "array<struct<title:string,events:array<struct<id:string,visibility:boolean,availability:boolean,show_date:string,show_time:string,pricelist:array<struct<price:string>>>>>>"


def show_events(df: DataFrame, payload: str, today: Column) -> DataFrame:
    """title, id, start_date, start_time, price of the shows' events that are visible, available and not over; the price is
    the smallest number of the price list."""
    shows = df.select(F.explode(F.from_json(payload, SHOWS)).alias("s")).filter(F.trim("s.title") != "")
    each = shows.select(F.trim("s.title").alias("title"), F.explode("s.events").alias("e")).filter("e.visibility and e.availability")
    price = F.array_min(F.filter(F.transform("e.pricelist", lambda p: p["price"].try_cast("double")), lambda p: p.isNotNull()))
    rows = each.select("title", F.col("e.id").alias("id"), F.try_to_date("e.show_date", "yyyy-MM-dd").alias("start_date"), F.nullif("e.show_time", F.lit("")).alias("start_time"), price.alias("price"))
    return rows.filter(F.col("start_date") >= today)


def channels(broadcasts: Column, regional: Column, country: Column) -> Column:
    """Channels of two JSON lists as array of struct(channel, market, country, type): plain names first, then the richer list,
    each channel once, where it is first seen."""
    plain = F.flatten(F.transform(F.from_json(broadcasts, "array<struct<names:array<string>>>"), lambda b: F.coalesce(b["names"], F.expr(f"cast(array() as {_STRINGS})"))))
    rich = F.from_json(regional, "array<struct<media:struct<shortName:string>,type:struct<shortName:string>,market:struct<type:string>>>")
    row = lambda ch, mk, kind: F.struct(ch.alias("channel"), mk.alias("market"), country.alias("country"), kind.alias("type"))
    nothing = F.expr("cast(array() as array<struct<channel:string,market:string,country:string,type:string>>)")
    first = F.coalesce(F.transform(plain, lambda n: row(n, F.lit("national"), F.lit("TV"))), nothing)
    second = F.coalesce(F.transform(rich, lambda g: row(g["media"]["shortName"], F.lower(F.coalesce(g["market"]["type"], F.lit("National"))), F.coalesce(g["type"]["shortName"], F.lit("TV")))), nothing)
    every = F.filter(F.concat(first, second), lambda c: ~T.blank(c["channel"]))
    return T.once(every, lambda e: T.once(F.transform(e, lambda c: c["channel"]), lambda names: F.filter(e, lambda c, i: F.array_position(names, c["channel"]) == i + 1)))


def sides(competitors: Column) -> Column:
    """struct(home, away): by the homeAway mark, else by position; null unless both are named."""
    return T.once(F.from_json(competitors, "array<struct<homeAway:string,team:struct<displayName:string>>>"), _two_sides)


def _two_sides(c: Column) -> Column:
    pick = lambda mark, i: F.coalesce(F.get(F.filter(c, lambda x: x["homeAway"] == mark), F.lit(0)), F.get(c, F.lit(i)))["team"]["displayName"]
    home, away = F.nullif(pick("home", 0), F.lit("")), F.nullif(pick("away", 1), F.lit(""))
    return F.when((F.size(c) >= 2) & home.isNotNull() & away.isNotNull(), F.struct(home.alias("home"), away.alias("away")))


def infobox_genres(wikitext: Column) -> Column:
    """The genres of an infobox: the field up to the next one, links by their text, without templates and tags; 3 to 59 characters."""
    raw = F.regexp_extract(wikitext, r"(?is)\|\s*genres?\s*=\s*(.*?)(?=\n\s*\||\n\s*\}\})", 1)
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"\[\[(?:[^|\]]+\|)?([^\]]+)\]\]", "$1"), r"\{\{[^}]+\}\}", ""), "<[^>]+>", "")
    return F.filter(F.transform(F.split(plain, r"[,\n*•·]"), lambda g: F.lower(F.trim(g))), lambda g: F.length(g).between(3, 59))


def date_near(html: Column, mark: str, today, window: int = 400) -> Column:
    """The date in the `window` characters on either side of the first match of a pattern; null without a match or a date."""
    at = F.regexp_instr(html, F.lit(mark))
    around = F.substring(html, F.greatest(at - window, F.lit(1)), F.lit(2 * window) + F.length(F.regexp_substr(html, F.lit(mark))))
    return F.when(at > 0, dates.any_date(around, today))


def absolute(base: Column, link: Column) -> Column:
    """A link as an absolute one: absolute as it is, "//host" with the scheme, "/path" on the host, others beside the page."""
    scheme, host = F.try_parse_url(base, F.lit("PROTOCOL")), F.try_parse_url(base, F.lit("HOST"))
    root = F.concat(scheme, F.lit("://"), host)
    beside = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"^([a-z]+://[^/]+(?:/.*)?)/[^/]*$", "$1")
    return F.when(link.rlike("(?i)^[a-z][a-z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(scheme, F.lit(":"), link)).when(link.startswith("/"), F.concat(root, link)).otherwise(F.concat(beside, F.lit("/"), link))


def candidates(cities: DataFrame, templates: list[str], name: str = "city_name") -> DataFrame:
    """A city's candidate urls from templates with {slug} and {dense}; each url once, of its first template.

    Templates are a short constant list, exploded in the row.
    """
    low = F.lower(F.trim(name))
    slug, dense = F.regexp_replace(low, r"[^a-z0-9]+", "-"), F.regexp_replace(low, r"[^a-z0-9]+", "")
    rows = cities.select("*", F.posexplode(F.array(*[F.replace(F.replace(F.lit(t), F.lit("{slug}"), slug), F.lit("{dense}"), dense) for t in templates])).alias("template", "url"))
    return rows.groupBy(*cities.columns, "url").agg(F.min("template").alias("template"))


def page_counts(events: DataFrame, page: str, most: int = 3) -> DataFrame:
    """Per page the number of events and the first names in page order. events: page, position, name."""
    names = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("position", F.coalesce("name", F.lit("Untitled")).alias("name")))), 1, most), lambda x: x["name"])
    return events.groupBy(page).agg(F.count(F.lit(1)).alias("n_events"), names.alias("names"))


def platform_of(html: Column, rules: list[tuple[str, str, str]]) -> Column:
    """struct(platform, platform_id, confidence) by the first rule whose mark is in the page: (mark, platform, pattern of the id). The
    confidence is 0.9 with an id, else 0.5."""
    out = None
    for mark, name, pattern in rules:
        found = F.nullif(F.regexp_extract(html, pattern, 1), F.lit("")) if pattern else F.lit(None).cast("string")
        value = F.struct(F.lit(name).alias("platform"), found.alias("platform_id"), F.when(found.isNotNull(), 0.9).otherwise(0.5).alias("confidence"))
        out = F.when(F.contains(html, F.lit(mark)), value) if out is None else out.when(F.contains(html, F.lit(mark)), value)
    return out


def links_of(url: Column, junk: list[str], *others: Column) -> Column:
    """The first of several looked-up urls whose host is none of the junk hosts or below one."""
    def fair(u: Column) -> Column:
        host = T.bare_host(u)
        bad = T.any_of([(host == j) | host.endswith("." + j) for j in junk])
        return F.when(host.isNotNull() & ~bad, u)

    return F.coalesce(*[fair(u) for u in (url, *others)])
