"""Exports: CSV columns, calendar texts, batches, bundles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from eventlode.functions.text import blank
from eventlode.operators.upsert import numbered


def csv_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """All columns as text, null as empty."""
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns])


def ics_escape(c: Column) -> Column:
    out = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    for mark in (",", ";"):
        out = F.replace(out, F.lit(mark), F.lit("\\" + mark))
    return F.replace(out, F.lit("\n"), F.lit("\\n"))


@pandas_udf(StringType())
def folded(lines: pd.Series) -> pd.Series:
    """Lines of over 75 octets continue after a line end and a space; no character is cut apart."""

    def fold(line: str) -> str:
        raw, parts, at = line.encode(), [], 0
        while len(raw) - at > (room := 75 if at == 0 else 74):
            end = at + room
            while raw[end] & 0xC0 == 0x80:  # within a character
                end -= 1
            parts.append(raw[at:end])
            at = end
        return b"\r\n ".join([*parts, raw[at:]]).decode()

    return pd.Series([None if x is None else x if len(x) < 19 else fold(x) for x in lines], dtype="object")


def ics_entry(uid: Column, name: Column, date: Column, time: Column, place: Column, hours: int = 2) -> Column:
    """One VEVENT: all day without a time, else with an end `hours` later."""
    start = F.try_to_timestamp(F.concat_ws(" ", date.cast("string"), time), F.lit("yyyy-MM-dd HH:mm"))
    stamp = lambda t: F.concat(F.date_format(t, "yyyyMMdd"), F.lit("T"), F.date_format(t, "HHmmss"))
    lines = [
        F.lit("BEGIN:VEVENT"),
        F.concat(F.lit("UID:"), uid.cast("string")),
        folded(F.concat(F.lit("SUMMARY:"), ics_escape(F.coalesce(name, F.lit("Untitled Event"))))),
        F.when(start.isNull(), F.concat(F.lit("DTSTART;VALUE=DATE:"), F.date_format(date, "yyyyMMdd"))).otherwise(F.concat(F.lit("DTSTART:"), stamp(start))),
        F.when(start.isNotNull(), F.concat(F.lit("DTEND:"), stamp(start + F.expr(f"INTERVAL {hours} HOURS")))),
        F.when(place.isNotNull(), folded(F.concat(F.lit("LOCATION:"), ics_escape(place)))),
        F.lit("END:VEVENT"),
    ]
    return F.concat_ws("\r\n", *lines)


def ics_full_entry(e: dict[str, Column], hours: int = 2) -> Column:
    """One VEVENT of uid, name, start_date, start_time, end_date, end_time, zone, venue_name, link, artist_name: floating without a
    zone, all day without a time; without an end `hours` after the start."""
    at = lambda d, t: F.try_to_timestamp(F.concat_ws(" ", d.cast("string"), t), F.lit("yyyy-MM-dd HH:mm"))
    start, end = at(e["start_date"], e["start_time"]), at(e["end_date"], e["end_time"])
    zone = F.when(~blank(e["zone"]), F.concat(F.lit(";TZID="), e["zone"])).otherwise(F.lit(""))
    timed = lambda name, t: F.concat(F.lit(name), zone, F.lit(":"), F.date_format(t, "yyyyMMdd"), F.lit("T"), F.date_format(t, "HHmmss"))
    daily = lambda name, d: F.concat(F.lit(name), F.lit(";VALUE=DATE:"), F.date_format(d, "yyyyMMdd"))
    about = F.concat_ws("\n\n", F.when(~blank(e["artist_name"]), F.concat(F.lit("Artist: "), e["artist_name"])), F.when(~blank(e["link"]), F.concat(F.lit("Buy tickets: "), e["link"])))
    line = lambda name, c: F.when(~blank(c), folded(F.concat(F.lit(name), ics_escape(c))))
    return F.concat_ws(
        "\r\n",
        F.lit("BEGIN:VEVENT"),
        F.concat(F.lit("UID:"), e["uid"].cast("string")),
        line("SUMMARY:", F.coalesce(F.nullif(e["name"], F.lit("")), F.lit("Untitled Event"))),
        F.when(start.isNotNull(), timed("DTSTART", start)).otherwise(daily("DTSTART", e["start_date"])),
        F.when(end.isNotNull(), timed("DTEND", end)).when(e["end_date"].isNotNull(), daily("DTEND", e["end_date"])).when(start.isNotNull(), timed("DTEND", start + F.expr(f"INTERVAL {hours} HOURS"))),
        line("LOCATION:", e["venue_name"]),
        F.when(~blank(e["link"]), folded(F.concat(F.lit("URL:"), e["link"]))),
        line("DESCRIPTION:", about),
        F.lit("END:VEVENT"),
    )


def calendar_head(name: str | None = None, refresh_hours: int | None = None) -> str:
    """The lines before the entries of a calendar file; a subscription has a name and tells how often to ask again."""
    lines = ["BEGIN:VCALENDAR", "VERSION:2.0", "PRODID:-//eventlode//events//EN"]
    if name:
        lines.append(f"X-WR-CALNAME:{name}")
    if refresh_hours:
        lines += [f"REFRESH-INTERVAL;VALUE=DURATION:PT{refresh_hours}H", f"X-PUBLISHED-TTL:PT{refresh_hours}H"]
    return "\r\n".join(lines)


def calendar_label(artists: list[str], genres: list[str], terms: list[str], cities: DataFrame, city_ids: list[int], suffix: str) -> DataFrame:
    """One row: a calendar's name from its facets, with up to three city names in order, or the suffix alone."""
    fixed = [", ".join(p) for p in (artists, genres, [t.title() for t in terms]) if p]
    names = cities.filter(F.col("city_id").isin(city_ids) & ~blank(F.col("city_name"))).select("city_name").distinct().orderBy("city_name").limit(3)
    listed = names.agg(F.array_join(F.array_sort(F.collect_list("city_name")), ", ").alias("c"))
    label = F.concat_ws(" · ", *map(F.lit, fixed), F.nullif("c", F.lit("")))
    return listed.select(F.when(label == "", F.lit(suffix)).otherwise(F.concat(label, F.lit(" – " + suffix))).alias("label"))


def batches(df: DataFrame, order: list[str], size: int = 500) -> DataFrame:
    """Adds batch numbers of `size` rows in order: ranks come from ranges and the counts before them, so no task sees all rows."""
    one = df.sparkSession.range(1).select(F.lit(0).cast("long").alias("_row"))
    return numbered(df, one, "_row", order).withColumn("batch", F.floor((F.col("_row") - 1) / size)).drop("_row")


def write_batches(df: DataFrame, text: str, order: list[str], folder: str, size: int = 500) -> None:
    """One folder of text files per batch of `size` lines."""
    rows = batches(df, order, size)
    rows.select("batch", F.col(text).alias("value")).repartition("batch").write.partitionBy("batch").mode("overwrite").text(folder)


def write_bundle(artists: DataFrame, taxonomy: DataFrame, folder: str, version: int = 1) -> None:
    """A bundle as gzip JSON lines, sorted within range-partitioned files: one `taxonomy` part, one `artists` part, one with the version."""
    taxonomy.select("sub_genre", "parent_genre").repartitionByRange("sub_genre").sortWithinPartitions("sub_genre").write.mode("overwrite").option("compression", "gzip").json(f"{folder}/taxonomy")
    artists.repartitionByRange("normalized_name").sortWithinPartitions("normalized_name").write.mode("overwrite").option("compression", "gzip").json(f"{folder}/artists")
    artists.sparkSession.range(1).select(F.lit(version).alias("version")).write.mode("overwrite").option("compression", "gzip").json(f"{folder}/meta")


def log_searches(searches: DataFrame, folder: str, now: Column) -> None:
    """Searches without a result are appended to a log, as they are, the client's name cut to 500 characters."""
    searches.withColumn("timestamp", now).withColumn("user_agent", F.left("user_agent", F.lit(500))).write.mode("append").parquet(folder)


def with_audit(rows: DataFrame, reason: str = "reason") -> tuple[DataFrame, DataFrame]:
    """What is kept, and what is not with the reason, for a file of its own."""
    return rows.filter(F.col(reason).isNull()).drop(reason), rows.filter(F.col(reason).isNotNull())
