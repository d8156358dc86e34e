"""Artists, titles and places out of free text, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and patterns that decide results.
ENSEMBLES = ["Trio", "Quartet", "Quintet", "Sextet", "Septet", "Octet", "Nonet", "Duo", "Band", "Big\\s+Band", "Group", "Ensemble", "Orchestra", "Project", "Experience", "Connection", "Collective", "Jazz\\s+Quartet", "Jazz\\s+Trio", "String\\s+Quartet"]
NOT_AN_ARTIST = ["Tribute", "Memorial", "Festival", "Night", "Evening", "Showcase", "Session", "Workshop", "Party", "Tour", "Exhibition", "Museum", "Cruise", "Brunch", "Show", "Dance"]
GENERIC_NAMES = [
    "various artists", "various", "untitled", "event", "show", "performance", "concert", "gig", "tickets", "details", "info", "more", "more info",
    "read more", "buy tickets", "get tickets", "book now", "reserve", "click here", "learn more", "see more", "view details", "view more", "coming soon",
    "to be announced", "tba", "tbd", "sold out", "home", "about", "contact", "menu", "search", "login", "register", "back", "next", "previous", "loading",
    "error", "close", "open", "narrow search", "all upcoming events", "all events", "filter", "see all", "view all", "show all", "load more", "reset",
    "subscribe", "sign up", "newsletter", "follow us",
]
TITLE_TAGS = ["SOLD\\s*OUT", "CANCELLED", "RESCHEDULED", "FREE", "NEW", "HOT", "POSTPONED"]
TOUR_TAGS = ["Touring", "Live", "Tour", "US\\s+Tour", "UK\\s+Tour", "World\\s+Tour", "\\d{4}\\s+Tour", "Live\\s+in\\s+Concert"]
CLUBS = ["^\\d+\\.\\s+(?:FC|FSV|FK|SV)\\s+", "^\\d+\\.\\s+(?i:Bundesliga)", "^(?:FC|AFC|FK|SK|VfL|VfB|TSV|MSV|FSV)\\s+[A-ZÄÖÜ]", "^(?i:AC\\s+(?:Milan|Sparta|Roma|Florentina|Fiorentina|Pisa|Monza))$"]
PROMOTER_WORDS = [
    "presents", "productions?", "aeg", "live nation", "various artists?", "various performers?", "tba", "tbd", "multiple artists?", "open mic", "guest artists?",
    "department of", "university", "college", "orgchestra", "inc\\.?", "llc\\.?", "ent(?:ertainment)?", "featuring",
]
MONTH_DAY = "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\\s+\\d{1,2}"


def _got(c: Column, pattern: str) -> Column:
    """The first group of a pattern, or null where it doesn't match."""
    return F.nullif(F.trim(F.regexp_extract(c, pattern, 1)), F.lit(""))


def artist_in_title(title: Column) -> Column:
    """The performer that a title names by its form: an ensemble word after it, "@ venue", "presents: X", "X b2b Y"."""
    t = F.trim(title)
    no = F.lit(rf"(?i)\b(?:{'|'.join(NOT_AN_ARTIST)})\b")
    junk = F.lit(r"(?i)\?{3,}|\|\s*\w+\s+\d+|-Wait\b")
    ensemble = _got(t, rf"(?i)^(.+?)\s+(?:{'|'.join(ENSEMBLES)})(?:\s|$)")
    at_venue = _got(t, r"^(.+?)\s+@\s+.+$")
    presents = _got(t, r"(?i)^.+?\s+presents?:\s+([A-Za-z][^,&+/\n]{2,40})$")
    both = F.when(t.rlike(r"^[A-Za-z0-9 _\-'&.]+?\s+[Bb]2[Bb]\s+.+$"), t)
    found = F.coalesce(
        F.when(F.length(ensemble) >= 2, ensemble),
        F.when(F.length(at_venue).between(2, 55), at_venue),
        F.when(F.length(presents).between(2, 40), presents),
        both,
    )
    return F.when(F.rlike(t, no) | F.rlike(t, junk), F.lit(None)).otherwise(found)


def is_generic(name: Column) -> Column:
    """Text of a page's controls rather than a name: short, listed, made of listed words, a link, a number or a date."""
    n = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    parts = F.filter(F.split(n, r"[\s\-–—|]+"), lambda w: w != "")
    words = (F.size(parts) > 0) & F.forall(parts, lambda w: w.isin(GENERIC_NAMES) | (F.length(w) < 2))
    return (F.length(n) < 3) | n.isin(GENERIC_NAMES) | words | n.rlike(r"http|www\.|^\d+$|^\d{1,2}/\d{1,2}/\d{2,4}$")


def event_and_artist(name: Column) -> Column:
    """struct(event, artist): "A - E", "A | E", "E featuring A"; the first form there is, if its parts have fair lengths."""
    n = F.trim(F.regexp_replace(F.trim(name), r"(?i)\s*(?:buy tickets|get tickets)\s*$", ""))
    forms = [(r"^(.+?)\s*[-–—]\s*(.+)$", 1, 2), (r"^(.+?)\s*\|\s*(.+)$", 1, 2), (r"(?i)^(.+?)\s+(?:featuring|with)\s+(.+)$", 2, 1)]
    out = None
    for pattern, a, e in forms:
        artist, event = F.trim(F.regexp_extract(n, pattern, a)), F.trim(F.regexp_extract(n, pattern, e))
        good = (F.length(artist) > 2) & (F.length(artist) < 100) & (F.length(event) > 2) & ~is_generic(artist)
        pair = F.struct(event.alias("event"), artist.alias("artist"))
        out = F.when(good, pair) if out is None else out.when(good, pair)
    return out.otherwise(F.struct(n.alias("event"), F.lit(None).cast("string").alias("artist")))


def clean_title(name: Column) -> Column:
    """Titles run together get a dash where a word starts inside another; a date at the end goes."""
    n = F.regexp_replace(name, r"([a-z])([A-Z][a-z])", "$1 - $2")
    n = F.regexp_replace(n, rf"(?i)\s*{MONTH_DAY}\s+at\s+.*$", "")
    return F.trim(F.regexp_replace(n, rf"(?i)\s+on\s+{MONTH_DAY}$", ""))


def clean_artist(name: Column) -> Column:
    """Without quotes or asterisks around, tags in front, and a tour tag behind; spaces collapsed."""
    n = F.trim(name)
    n = F.regexp_replace(n, r'^(?:"\s*)+(.*?)(?:\s*")+$', "$1")
    n = F.regexp_replace(n, r"^(?:\*\s*)+([^*]*?)(?:\s*\*)+$", "$1")
    n = F.regexp_replace(n, rf"(?i)^(?:[*\[]+\s*(?:{'|'.join(TITLE_TAGS)})\s*[*\]]+\s+)+", "")
    n = F.regexp_replace(n, rf"(?i)\s*\((?:{'|'.join(TOUR_TAGS)})\)\s*$", "")
    return F.trim(F.regexp_replace(n, r"\s+", " "))


def is_club(name: Column) -> Column:
    return name.rlike("|".join(f"(?:{p})" for p in CLUBS))


def is_promoter(name: Column) -> Column:
    return name.rlike(rf"(?i)\b(?:{'|'.join(PROMOTER_WORDS)})\b")


def first_artist(name: Column) -> Column:
    """The first of several: before b2b, ×, vs or x, else before the first of two commas or more."""
    out = None
    for mark in (" b2b ", " × ", r" vs\.? ", " x "):
        parts = F.split(name, f"(?i){mark}")
        first = F.nullif(F.trim(F.regexp_replace(F.trim(F.get(parts, F.lit(0))), "^,+|,+$", "")), F.lit(""))
        out = F.when(F.size(parts) >= 2, first) if out is None else out.when(F.size(parts) >= 2, first)
    listed = F.filter(F.transform(F.split(name, ","), lambda x: F.trim(x)), lambda x: x != "")
    return out.when(F.size(listed) >= 3, F.get(listed, F.lit(0))).otherwise(name)


def city_of_address(address: Column, suburbs: dict[str, str] | None = None) -> Column:
    """The last part with a digit, less its postal code, else the last part; a suburb gives its city."""
    parts = F.reverse(F.filter(F.transform(F.split(address, ","), lambda x: F.trim(x)), lambda p: p != ""))
    stripped = F.transform(F.filter(parts, lambda p: p.rlike(r"\d")), lambda p: F.trim(F.regexp_replace(p, r"^\d[\d\s-]+", "")))
    fair = lambda p: (F.length(p) > 1) & ~p.rlike(r"^\d+$")
    city = F.coalesce(F.get(F.filter(stripped, fair), F.lit(0)), F.get(F.filter(parts, fair), F.lit(0)))
    if not suburbs:
        return city
    table = F.create_map(*[F.lit(x) for kv in suburbs.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(city)), city)


def place_line(text: Column) -> Column:
    """struct(city, country, is_online) of "City, Country • In Person"."""
    where, how = F.trim(F.split_part(text, F.lit("•"), F.lit(1))), F.lower(F.trim(F.split_part(text, F.lit("•"), F.lit(2))))
    country = F.nullif(F.trim(F.substring_index(where, ",", -1)), F.lit(""))
    city = F.when(where.contains(","), F.trim(F.substring_index(where, ",", 1)))
    online = how.contains("online") & ~how.contains("person") | (F.lower(where) == "online")
    return F.struct(F.when(~online, city).alias("city"), F.when(~online, country).alias("country"), online.alias("is_online"))


def local_time(utc: Column, zone: Column) -> Column:
    """A UTC timestamp in a venue's zone; an unknown zone leaves it in UTC."""
    return F.from_utc_timestamp(utc, F.coalesce(zone, F.lit("UTC")))


def titled(name: Column, artist: Column) -> Column:
    """A name for any event: its own, else the artist, else "Untitled Event"; the artist is added where the name lacks it."""
    base = F.coalesce(F.nullif(F.trim(name), F.lit("")), F.nullif(F.trim(artist), F.lit("")), F.lit("Untitled Event"))
    lacks = F.coalesce(F.trim(artist) != "", F.lit(False)) & ~F.coalesce(F.contains(F.lower(base), F.lower(artist)), F.lit(False))
    return F.when(lacks, F.concat(base, F.lit(" - "), F.trim(artist))).otherwise(base)
