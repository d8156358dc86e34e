"""Events, titles and links from web pages, feeds and calendars, without leaving the plan where patterns do."""

from __future__ import annotations

import json
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import StringType, StructType

LD_BLOCK = r'(?is)<script[^>]*type="application/ld\+json"[^>]*>(.*?)</script>'
#: Schema.org types that count as events.
EVENT_TYPES = [
    "Event", "BusinessEvent", "ChildrensEvent", "ComedyEvent", "DanceEvent", "EducationEvent", "EventSeries", "ExhibitionEvent", "Festival", "FoodEvent", "Hackathon", "LiteraryEvent", "MusicEvent", "ScreeningEvent", "SocialEvent", "SportsEvent", "TheaterEvent", "VisualArtsEvent",
]


@udtf(returnType=StructType().add("event_json", "string").add("event_type", "string").add("name", "string").add("start_date", "string"))
class FlattenLd:
    """All objects of a JSON-LD block, through lists, @graph and item lists at any depth; bad JSON gives none."""

    def eval(self, block: str):
        try:
            todo = [json.loads(block)] if block else []
        except ValueError:
            return
        while todo:
            x = todo.pop(0)
            if isinstance(x, list):
                todo = x + todo
            elif isinstance(x, dict):
                if isinstance(x.get("@graph"), list):  # a wrapper gives its parts, not itself
                    todo = x["@graph"] + todo
                    continue
                if isinstance(x.get("itemListElement"), list):
                    todo = [i.get("item", i) if isinstance(i, dict) else i for i in x["itemListElement"]] + todo
                    continue
                kind = x.get("@type")
                if isinstance(kind, str):
                    text = lambda k: x[k] if isinstance(x.get(k), str) else None
                    yield json.dumps(x), kind, text("name"), text("startDate")


def ld_events(pages: DataFrame, html: str, key: str, today: Column) -> DataFrame:
    """key, name, start_date, event_type, event_json of event objects that aren't over; a blank date stays."""
    blocks = pages.select(key, F.explode(F.regexp_extract_all(html, F.lit(LD_BLOCK), 1)).alias("block"))
    flat = blocks.lateralJoin(FlattenLd(F.col("block").outer()))
    start = F.substring("start_date", 1, 10)
    return flat.filter(F.col("event_type").isin(EVENT_TYPES) & (F.col("start_date").isNull() | (start >= F.date_format(today, "yyyy-MM-dd")))).select(key, "name", "start_date", "event_type", "event_json")


def cheapest_offer(event_json: Column) -> Column:
    """struct(price, currency) of the cheapest offer that isn't sold out; one offer may stand without a list."""
    offer = "array<struct<price:string,lowPrice:string,priceCurrency:string,availability:string>>"
    many = F.from_json(F.get_json_object(event_json, "$.offers"), offer)
    one = F.from_json(F.concat(F.lit("["), F.get_json_object(event_json, "$.offers"), F.lit("]")), offer)
    offers = F.when(F.get_json_object(event_json, "$.offers").startswith("["), many).otherwise(one)
    open_ = F.filter(offers, lambda o: ~F.coalesce(o["availability"].contains("SoldOut"), F.lit(False)))
    priced = F.filter(F.transform(open_, lambda o: F.struct(F.coalesce(o["lowPrice"], o["price"]).try_cast("double").alias("price"), o["priceCurrency"].alias("currency"))), lambda o: o["price"].isNotNull())
    return F.array_min(priced)


def title(html: Column) -> Column:
    """The page's site name, in either order of attributes, else its title up to " - " or " | "."""
    a = F.nullif(F.regexp_extract(html, r'(?is)<meta[^>]*property="og:site_name"[^>]*content="([^"]*)"', 1), F.lit(""))
    b = F.nullif(F.regexp_extract(html, r'(?is)<meta[^>]*content="([^"]*)"[^>]*property="og:site_name"', 1), F.lit(""))
    t = F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))
    cut = F.substring_index(F.substring_index(t, " - ", 1), " | ", 1)
    return F.coalesce(a, b, F.nullif(cut, F.lit("")))


def heading(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_replace(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), r"<[^>]+>", "")), F.lit(""))


def extended_name(name: Column, h1: Column) -> Column:
    """The heading, where it is longer than the name and holds it."""
    return F.when((F.length(h1) > F.length(name)) & F.contains(F.lower(h1), F.lower(name)), h1).otherwise(name)


def clean(html: Column, most: int = 200_000) -> Column:
    """Without scripts, styles, navigation and comments; tags to spaces; spaces collapsed; cut to `most` characters."""
    out = html
    for tag in ("script", "style", "nav", "header", "footer", "noscript", "svg"):
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->", " "), r"<[^>]+>", " ")
    return F.substring(F.trim(F.regexp_replace(out, r"\s+", " ")), 1, most)


def paginated(html: Column, url: Column) -> Column:
    return F.coalesce(html, F.lit("")).rlike(r'(?i)rel="next"|[?&]page=\d|/page/\d') | F.coalesce(url, F.lit("")).rlike(r"(?i)[?&]page=\d|/page/\d")


def platform(text: Column, domains: dict[str, str]) -> Column:
    out: Column | None = None
    for domain, name in domains.items():
        out = F.when(text.contains(domain), name) if out is None else out.when(text.contains(domain), name)
    return out if out is not None else F.lit(None).cast("string")


@pandas_udf(StringType())
def unescaped(s: pd.Series) -> pd.Series:
    """Entities to characters."""
    return pd.Series([None if x is None else unescape(x) for x in s], dtype="object")


def ics_events(calendar: Column) -> Column:
    """array of struct(uid, summary, start, url) of a calendar text; folded lines are joined first."""
    flat = F.regexp_replace(calendar, r"\r?\n[ \t]", "")
    parts = F.slice(F.split(flat, "BEGIN:VEVENT"), 2, 1_000_000)
    field = lambda x, name: F.nullif(F.regexp_extract(x, rf"(?m)^{name}(?:;[^:\r\n]*)?:([^\r\n]*)", 1), F.lit(""))
    return F.transform(parts, lambda x: F.struct(field(x, "UID").alias("uid"), field(x, "SUMMARY").alias("summary"), field(x, "DTSTART").alias("start"), field(x, "URL").alias("url")))


def video_id(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r'"videoId":"([A-Za-z0-9_-]{11})"', 1), F.lit(""))


def json_in(text: Column) -> Column:
    """The JSON between the first opening and the last closing bracket of a text, code fences or not; null if it is none."""
    inner = F.regexp_extract(text, r"(?s)([\[{].*[\]}])", 1)
    return F.when(F.try_parse_json(inner).isNotNull(), inner)


def first_tier(df: DataFrame, key: str, tier: str) -> DataFrame:
    """Of each key's rows those of its first tier that has any."""
    best = df.groupBy(key).agg(F.min(tier).alias("_t"))
    return df.join(best, key).filter(F.col(tier) == F.col("_t")).drop("_t")
