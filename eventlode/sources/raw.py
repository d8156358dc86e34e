"""The one record that every source becomes, and declarative normalizers from landed JSON."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: All fields of a normalized record, in order.
RAW_EVENT = (
    "name string, start_date date, start_time string, end_date date, end_time string, artist_name string, artist_youtube_channel string, description string, price double, price_currency string, "
    "purchase_link string, image_url string, is_online boolean, venue_name string, venue_address string, venue_city string, venue_country string, venue_lat double, venue_lon double, venue_website_url string, "
    "source string, source_id string, raw_categories array<string>, home_team string, away_team string, sport string, tv_channels array<struct<channel:string,market:string,country:string,type:string>>, venue_timezone string"
)
FIELDS = [tuple(f.strip().split(" ", 1)) for f in RAW_EVENT.replace("channel:string,market:string,country:string,type:string", "@").split(",")]
FIELDS = [(n, t.replace("@", "channel:string,market:string,country:string,type:string")) for n, t in FIELDS]


@dataclass(frozen=True)
class Normalizer:
    """How one source's items become records.

    items: JSON path of the list of items in a payload, "$" for a payload that is an item. paths: field by JSON path in an item.
    columns: field by a function of the item, for all that a path can't say. countries: the gate; empty lets all pass.
    """

    source: str
    items: str = "$"
    paths: dict[str, str] = field(default_factory=dict)
    columns: dict = field(default_factory=dict)
    countries: tuple[str, ...] = ()
    drop_cancelled: bool = True


def normalized(payloads: DataFrame, how: Normalizer, payload: str = "payload", country: str | None = None) -> DataFrame:
    """Records of the items in landed payloads; bad JSON gives none. Items without a name or a date go to the rejects."""
    if how.countries and country not in how.countries:
        return payloads.sparkSession.createDataFrame([], RAW_EVENT)
    text = F.get_json_object(payload, how.items) if how.items != "$" else F.col(payload)
    items = payloads.filter(F.try_parse_json(payload).isNotNull()).select(F.explode(F.from_json(F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]"))), "array<string>")).alias("item"))
    item = F.col("item")

    def value(name: str, kind: str) -> Column:
        if name in how.columns:
            return how.columns[name](item).cast(kind)
        if name not in how.paths:
            return F.lit(how.source).cast(kind) if name == "source" else F.lit("USD").cast(kind) if name == "price_currency" else F.lit(None).cast(kind)
        found = F.nullif(F.get_json_object(item, how.paths[name]), F.lit(""))
        if kind == "date":
            return F.try_to_date(F.substring(found, 1, 10), "yyyy-MM-dd")
        if kind in ("double", "boolean"):
            return found.try_cast(kind)
        return F.from_json(found, kind) if kind.startswith("array") else found

    rows = items.select(*[value(n, t).alias(n) for n, t in FIELDS], item.alias("_item"))
    if how.drop_cancelled:
        rows = rows.filter(~F.coalesce(F.get_json_object("_item", "$.eventStatus"), F.lit("")).contains("Cancelled"))
    return rows.drop("_item")


def accepted(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("name").isNotNull() & F.col("start_date").isNotNull())


def rejected(rows: DataFrame) -> DataFrame:
    """What can't be stored, with the reason."""
    reason = F.when(F.col("name").isNull(), "no name").when(F.col("start_date").isNull(), "no date")
    return rows.withColumn("reason", reason).filter("reason is not null")


def unioned(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
