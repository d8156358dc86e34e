"""Normalizers, feeds and the ingest plan."""

import datetime as dt
import json
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from eventlode.plans import ingest
from eventlode.sources import feeds, raw
from tests.test_operators import values

DAY = dt.date(2026, 6, 1)


def test_normalizer_makes_records(spark):
    items = [{"title": "A", "when": "2026-06-01T20:00", "id": 7, "cost": "x", "tags": ["rock"]}, {"title": "", "when": "2026-06-02"}, {"title": "C", "when": "bad", "eventStatus": "EventCancelled"}]
    df = spark.createDataFrame([(json.dumps({"data": {"events": items}}),), ("{bad",), (None,)], "payload string")
    how = raw.Normalizer("site", "$.data.events", {"name": "$.title", "start_date": "$.when", "source_id": "$.id", "price": "$.cost", "raw_categories": "$.tags"}, {"is_online": lambda i: F.lit(False)}, countries=("IL",))
    rows = raw.normalized(df, how, country="IL")
    assert [n for n, _ in raw.FIELDS] == rows.columns and len(rows.columns) == 28
    got = raw.accepted(rows).collect()
    assert [(r.name, r.start_date, r.source, r.source_id, r.price, r.raw_categories, r.is_online) for r in got] == [("A", DAY, "site", "7", None, ["rock"], False)]
    assert [r.reason for r in raw.rejected(rows).collect()] == ["no name"]
    assert raw.normalized(df, how, country="FR").count() == 0 and raw.unioned([rows, rows]).count() == 4


def test_feeds(spark):
    xml = "<urlset><url><loc> https://x.example/event/1 </loc></url><url><loc>https://x.example/blog/2</loc></url></urlset>"
    out = {r.url: (r.section, r.kept) for r in feeds.sitemap(spark.createDataFrame([(xml,)], "x string"), "x", ["/event/"]).collect()}
    assert out == {"https://x.example/event/1": ("event", True), "https://x.example/blog/2": ("blog", False)}
    page = 'x <script>calendarEvents = [{"a": "]\\"["}, [1]]; y</script>'
    assert values(spark, [page, "none", None, "calendarEvents = [1"], feeds.state_after("calendarEvents")) == ['[{"a": "]\\"["}, [1]]', None, None, None]
    html = '<div class="Event-Card"><h3>Gig</h3><p>1 June<br>20:00</p></div><div class="x">no</div><li class="event">B</li>'
    assert [[tuple(c) for c in v] for v in values(spark, [html, None], feeds.cards(["event"]))] == [[("Gig", "Gig 1 June 20:00"), ("B", "B")], []]
    places = spark.createDataFrame([("tlv", 32.08, 34.78), ("jlm", 31.77, 35.21), ("none", None, None)], "n string, lat double, lon double")
    assert [r.n for r in feeds.near(places, "lat", "lon", (32.07, 34.79), 20).collect()] == ["tlv"]


STORED = "event_id long, source string, source_id string, name string, venue_name string, start_date date, start_time string, end_date date, end_time string, price double"


def test_ingest_in_arrival_order(spark):
    stored = spark.createDataFrame([(10, "s", "1", "Big Show", "Hall", DAY, None, None, None, None), (11, "s", "2", "Other", "Club", DAY, "23:00", None, None, 5.0)], STORED)
    new = [
        (1, "s", "1", "ignored", "Hall", DAY, "20:00", None, None, 9.0),
        (2, "t", "a", "Big Show!", "Hall", DAY, None, None, None, 1.0),
        (3, "t", "b", "Jazz Trio @ Bar", None, DAY, None, None, None, None),
        (4, "t", "b", "later", None, DAY, "19:00", None, None, 3.0),
        (5, "t", "c", "Jazz Trio", "Late @ Bar", DAY, None, None, None, None),
        (6, "t", "d", "undated", "Bar", None, None, None, None, None),
        (7, "t", "e", "x", "Xavier Night @ Bar", DAY, None, None, None, None),
    ]
    raw_rows = spark.createDataFrame(new, STORED.replace("event_id", "arrival")).repartition(3)
    out = {r.source_id: (r.event_id, r.name, r.venue_name, r.start_time, r.end_time, r.price) for r in ingest.ingest(stored, raw_rows).collect()}
    assert out["1"] == (10, "Big Show", "Hall", "20:00", "22:00", 9.0)
    assert out["2"] == (11, "Other", "Club", "23:00", "01:00", 5.0)
    assert "a" not in out and "d" not in out
    assert out["b"] == (12, "Jazz Trio", "Bar", "19:00", "21:00", 3.0)
    assert SequenceMatcher(None, "jazz trio", "jazz trio").ratio() > 0.85 and "c" not in out
    assert out["e"] == (13, "Xavier Night", "Bar", None, None, None)
